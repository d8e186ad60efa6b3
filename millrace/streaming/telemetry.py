"""Telemetry over events as streams: windows with late data, deduplication, sessions, and entries that expire.

Each transformation takes a streaming or a batch DataFrame alike; a batch gives the final result at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema, max_files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, a few files a step."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _timed(events: DataFrame, delay: str) -> DataFrame:
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    return timed.withWatermark("at", delay) if events.isStreaming else timed


def tumbling(events: DataFrame, size: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(window_start, event_type, n, total) over windows of ``size``; rows later than ``delay`` are left out of streams."""
    grouped = _timed(events, delay).groupBy(F.window("at", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day", delay: str = "2 days") -> DataFrame:
    grouped = _timed(events, delay).groupBy(F.window("at", size, step), "event_type").agg(F.count("*").alias("n"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "1 day", delay: str = "2 days") -> DataFrame:
    """(user_id, session_start, session_end, n): a user's events until a ``gap`` without any."""
    grouped = _timed(events, delay).groupBy(F.session_window("at", gap), "user_id").agg(F.count("*").alias("n"), F.max("at").alias("session_end"))
    return grouped.select("user_id", F.col("session_window.start").alias("session_start"), "session_end", "n")


def deduplicated(events: DataFrame, key: str = "event_id", delay: str = "2 days") -> DataFrame:
    """Each key once; in streams as long as the watermark remembers it."""
    timed = _timed(events, delay)
    return timed.dropDuplicatesWithinWatermark([key]) if events.isStreaming else timed.dropDuplicates([key])


def expiring_cache(events: DataFrame, ttl_s: int = 86_400, delay: str = "2 days") -> DataFrame:
    """(user_id, n_served, n_stored) in steps: an event is served if its user's entry is younger than ``ttl_s``, else it is stored.

    The state of a user is the time of the entry; it goes when the watermark passes its end.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        entry = state.get[0] if state.exists else None
        times = sorted(int(t.timestamp() * 1000) for b in batches for t in b["at"])
        served = stored = 0
        for t in times:
            if entry is not None and 0 <= t - entry < ttl_s * 1000:
                served += 1
            else:
                entry, stored = t, stored + 1
        state.update((entry,))
        state.setTimeoutTimestamp(max(entry + ttl_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "n_served": [served], "n_stored": [stored]})

    timed = _timed(events, delay)
    return timed.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, n_served long, n_stored long", "entry_ms long", "update", GroupStateTimeout.EventTimeTimeout
    )
