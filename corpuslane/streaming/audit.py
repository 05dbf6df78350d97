"""Streaming: windowed audit counts with late data, incremental note ingest, keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpuslane.operators.deid import deidentify
from corpuslane.operators.sections import clean_notes


def _watermarked(events: DataFrame, time: str, late: str) -> DataFrame:
    """Streams get a watermark, for which the time must carry a zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def windowed_counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 days", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, key, n, total) per tumbling or sliding window; on streams rows later than ``late`` are dropped. Works on batch tables alike."""
    d = _watermarked(events, time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    g = d.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days", time: str = "ts", key: str = "user_id") -> DataFrame:
    """(key, session_start, session_end, n): runs of a key's events with pauses below ``gap``."""
    d = _watermarked(events, time, late)
    g = d.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def ingest_notes(notes: DataFrame, path: str, checkpoint: str, categories: list[str] | None = None) -> StreamingQuery:
    """Append de-identified notes of a stream to Parquet with an audit row each; files already read are not read again."""
    d = deidentify(clean_notes(notes, categories), "text")
    d = d.withColumn("event_type", F.lit("deidentification")).withColumn("original_length", F.length("text")).withColumn("deidentified_length", F.length("deidentified"))
    d = d.withColumn("processed_at", F.current_timestamp()).drop("text")
    return d.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _limit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, total = state.get if state.exists else (0, 0.0)
    for p in parts:
        n, total = n + len(p), total + float(p["value"].fillna(0).sum())
    state.update((n, total))
    yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) so far per user, sent out whenever a user has new events; state is kept per user."""
    return events.groupBy("user_id").applyInPandasWithState(
        _limit, "user_id bigint, n bigint, total double", "n bigint, total double", "update", GroupStateTimeout.NoTimeout
    )
