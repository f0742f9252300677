"""Streaming forms of the time-dependent operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Upsert each micro-batch of ``id, vector`` (and ``metadata, ttl``) as one commit: write coalescing by time.

    A batch that is run again after a failure writes the same rows once more, which changes nothing.
    """

    def write(rows: DataFrame, _: int) -> None:
        if rows.limit(1).count():
            collection.upsert_frame(rows)

    out = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)).start()


def latest(stream: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Each key's last row so far (update or complete mode)."""
    return stream.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(at, *values)).alias("r")).select(key, "r.*")


def windowed_counts(stream: DataFrame, at: str, by: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows per window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def expiring(stream: DataFrame, at: str, ttl: str, key: str) -> DataFrame:
    """One row for each key while it is alive: repeats within the time to live are dropped, and state goes with the watermark."""
    return stream.withWatermark(at, ttl).dropDuplicatesWithinWatermark([key])
