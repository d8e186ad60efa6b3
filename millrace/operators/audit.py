"""Audit tables as appended events, and the state that follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import preview

ERROR_CHARS = 4000


def latest_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest event of each key; ties are decided by all of ``order``."""
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in order])
    return events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def duration_ms(start: Column, end: Column) -> Column:
    return ((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000).cast("long")


def lifecycle(requests: DataFrame) -> DataFrame:
    """(request_type, status, n, n_unfinished, avg_ms, max_ms) over requests, each once."""
    timed = requests.withColumn("ms", duration_ms(F.col("created_at"), F.col("finished_at")))
    return timed.groupBy("request_type", "status").agg(
        F.count("*").alias("n"), F.count_if(F.col("finished_at").isNull()).alias("n_unfinished"), F.round(F.avg("ms"), 3).alias("avg_ms"), F.max("ms").alias("max_ms")
    )


def hit_rows(hits: DataFrame, limit: int = 800) -> DataFrame:
    """Hits as they are logged: with a preview in place of the text."""
    return hits.select("request_id", "stage", "rank", "chunk_id", "doc_id", "score", preview(F.col("text"), limit).alias("text_preview"))


def error_detail(text: Column) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, ERROR_CHARS)


def document_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents with the number of their chunks, 0 without any."""
    counted = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return documents.join(counted, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
