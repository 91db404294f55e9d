"""The lift on streams. Where the blocks are sent to the workers, lifting a stream is a stateless projection; where they are
too many for that, each micro-batch is lifted by the binned join, in a sink of batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from anchorspan.operators.lift import Lifter


def lift_stream(stream: DataFrame, lifter: Lifter, chrom: Column, start: Column, end: Column, strand: Column) -> DataFrame:
    """The stream with a column ``segments`` and a ``status``: ok, multi, unmapped or unknown_chrom."""
    if lifter.sent is None:
        raise ValueError("too many blocks for a projection; use lift_batches()")
    return _with_status(stream.withColumn("segments", lifter.segments(chrom, start, end, strand)))


def lift_batches(stream: DataFrame, lifter: Lifter, chrom: Column, start: Column, end: Column, strand: Column, write: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that lifts each micro-batch, whatever the count of blocks, and gives it to write(batch, number) with ``segments`` and ``status``.

    A batch may be given again after a failure, under the same number; write() has to be able to replace it.
    """

    def lift(batch: DataFrame, number: int) -> None:
        kept = batch.withColumn("_rid", F.monotonically_increasing_id()).persist()  # numbered once, for the join reads the batch twice
        try:
            write(_with_status(lifter.with_segments(kept, "_rid", chrom, start, end, strand)).drop("_rid"), number)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(lift)


def _with_status(lifted: DataFrame) -> DataFrame:
    n = F.size("segments")
    return lifted.withColumn("status", F.when(F.col("segments").isNull(), "unknown_chrom").when(n == 0, "unmapped").when(n > 1, "multi").otherwise("ok"))


def delivered_once(stream: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    """The stream without repeated deliveries of a key that come within ``lateness`` of one another in event time."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark([key])


def outcome_counts(lifted: DataFrame, time: str, width: str, lateness: str | None = None) -> DataFrame:
    """(window_start, status, n) over tumbling windows of event time. lateness: None if the stream has a watermark."""
    marked = lifted.withWatermark(time, lateness) if lateness else lifted
    return marked.groupBy(F.window(time, width), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "status", "n")
