"""Structured Streaming over change logs: current tables kept by feed, and windowed counts of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataframe.operators.cdc import BucketedTable


def maintain(stream: DataFrame, target: BucketedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Apply every micro-batch of a change stream to a table; a batch that is run again changes nothing.

    A stream is known by its checkpoint folder: batches of another one are numbered anew and applied.
    """
    def batch(df: DataFrame, number: int) -> None:
        if not df.isEmpty():
            target.apply(df, checkpoint, number)
            target.vacuum()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changes_by_window(stream: DataFrame, time: str = "arrivedAt", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, status, changes) of a change stream by window of its arrival; rows later than late are left out."""
    stamped = stream.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    return stamped.groupBy(F.window("__t", window).alias("w"), "status").agg(F.count("*").alias("changes")).select(F.col("w.start").alias("start"), "status", "changes")
