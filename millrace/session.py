"""Session helpers that behave alike on one machine and on a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a folder that all executors share and is used as
    it is; a cluster without it is an error. Only where it is unset in a local session, as in tests, a
    temporary folder is made.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def _place(spark: SparkSession, path: str):
    """The file system and the path object of ``path``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have ``path`` deleted when the application ends."""
    files, at = _place(spark, path)
    files.deleteOnExit(at)


def _cuts(spark: SparkSession) -> str:
    """The folder of this application's cuts."""
    return f"{checkpoint_dir(spark)}/cuts-{spark.sparkContext.applicationId}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read again, with its lineage cut.

    Survives the loss of executors, since the rows lie in the shared folder; compressed, and read
    column by column. The tables are deleted when the application ends, or by ``drop_cuts``.
    """
    spark = df.sparkSession
    delete_on_exit(spark, _cuts(spark))
    path = f"{_cuts(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cuts(spark: SparkSession) -> None:
    """Delete this application's cuts; DataFrames that still read them can no longer be run."""
    files, at = _place(spark, _cuts(spark))
    files.delete(at, True)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else as it is.

    ``df`` should be cheap to count (a written table or a small aggregate).
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores; one that has them already is not shuffled.

    For work that is dear per row, where a small input lies in a few files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
