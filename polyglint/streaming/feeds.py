"""Structured Streaming forms of the event operators; they work on batch tables too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bursts(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """Events of a key that follow each other within a gap become one burst: (key, n, first, last).
    late is the watermark's delay; a stream needs one, and emits a burst once it is past."""
    rows = events if late is None else events.withWatermark(ts, late)
    found = rows.groupBy(F.session_window(ts, gap).alias("__w"), key).agg(F.count("*").alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"))
    return found.select(key, "n", "first", "last")


def deduplicated(events: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """The first event of each key; state is dropped once the watermark has passed."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def appended_log(events: DataFrame, path: str, checkpoint: str):
    """Append a stream to a parquet log once, what is available now; restarts go on from the checkpoint."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(events: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The newest values of each key, as a running aggregate for update or complete mode."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("__v")).select(key, "__v.*")
