"""Table access by name, and the newest delivery of each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet`` as a DataFrame."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def latest(df: DataFrame, key: str | list[str], order: str) -> DataFrame:
    """One row per key: the one with the greatest ``order``; null orders come last.

    Rows that tie on ``order`` are ranked by their other columns, so the choice is stable.
    Null keys form a group of their own.
    """
    keys = [key] if isinstance(key, str) else key
    rest = sorted(c for c, t in df.dtypes if c not in (*keys, order) and not t.startswith("map"))
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in rest])
    return df.withColumn("_delivery", F.row_number().over(w)).where("_delivery = 1").drop("_delivery")
