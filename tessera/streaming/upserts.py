"""Streams over the same operators: bronze upserts by micro-batch, and windows with late data. An extension: the batch
operators do not need it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.dml import last_wins
from tessera.operators.relational import good_and_rejected, rejects
from tessera.sources.sinks import ParquetTable


def upsert_stream(stream: DataFrame, table: ParquetTable, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df, order: str | None = None) -> StreamingQuery:
    """Each micro-batch merged into a table. A batch that is replayed after a failure changes nothing, so the outcome is
    as if each row had come once."""

    def merge(batch: DataFrame, _: int) -> None:
        table.upsert(prepare(batch), order=order)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_checked(stream: DataFrame, table: ParquetTable, bad: ParquetTable, valid: Column, reason: Column, source: str, key: str, checkpoint: str) -> StreamingQuery:
    """The same with a check: rows that pass are merged, the others go to ``bad`` by source and natural key."""

    def merge(batch: DataFrame, _: int) -> None:
        good, rest = good_and_rejected(batch, valid, reason)
        table.upsert(last_wins(good, table.keys, [F.lit(1)]))
        bad.upsert(rejects(rest.drop("reason"), F.lit(source), F.col(key), reason))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling(events: DataFrame, width: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and keys; rows later than the watermark are left out of a stream."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str, late: str = "1 hour") -> DataFrame:
    """Sessions of a key, ended by a gap."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n", "total")
