"""Continuous labelling: the delay buckets and mature negatives of the batch jobs, as streams.

State is bounded by the horizon: an impression waits for its conversion at most H seconds,
and is released as a (mature) negative once the watermark has passed that.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_timestamp, epoch_seconds
from ..operators.delays import add_delay_buckets


def label_stream(
    impressions: DataFrame,
    conversions: DataFrame,
    edges: Sequence[float],
    *,
    lateness: str = "1 hour",
) -> DataFrame:
    """Impressions (impression_id, timestamp_dt, ...) labelled by the conversions attributed
    to them (impression_id, conversion_timestamp_dt) within H, and bucketed by delay.

    The join key is the impression, so busy users spread evenly and every impression meets
    at most one conversion (repeated deliveries are dropped).  One without comes out with a
    null conversion after the watermark passes its horizon.
    """
    h = int(edges[-1])
    left = impressions.withWatermark("timestamp_dt", lateness)
    right = (
        conversions.select(F.col("impression_id").alias("_id"), "conversion_timestamp_dt")
        .withWatermark("conversion_timestamp_dt", lateness)
        .dropDuplicatesWithinWatermark(["_id"])
    )
    within = (
        (F.col("impression_id") == F.col("_id"))
        & (F.col("conversion_timestamp_dt") >= F.col("timestamp_dt"))
        & (F.col("conversion_timestamp_dt") <= F.col("timestamp_dt") + F.expr(f"INTERVAL {h} SECONDS"))
    )
    matched = left.join(right, within, "leftOuter").drop("_id")
    delay = epoch_seconds(F.col("conversion_timestamp_dt")) - epoch_seconds(F.col("timestamp_dt"))
    labelled = matched.withColumns({
        "conversion": F.col("conversion_timestamp_dt").isNotNull().cast("int"),
        "conversion_delay": F.coalesce(delay, F.lit(-1).cast("long")),
    })
    return add_delay_buckets(labelled, edges)


def bucket_counts_stream(preprocessed: DataFrame, *, lateness: str = "1 hour") -> DataFrame:
    """Impressions per day and delay bucket, final once the watermark passes the day."""
    return (
        preprocessed.withWatermark("timestamp_dt", lateness)
        .groupBy(F.window("timestamp_dt", "1 day"), F.col("bucket.bucket_id").alias("bucket_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("day"), "bucket_id", "n")
    )


@dataclass(frozen=True)
class StreamRun:
    """What one run did: micro-batches, rows read, and rows that came too late for the watermark."""

    batches: int
    rows: int
    late: int


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run_available(stream: DataFrame, target: str, checkpoint: str, fmt: str = "parquet") -> StreamRun:
    """Process what is there, in as many micro-batches as the source is cut into, and append it to ``target``.

    A later run with the same ``checkpoint`` goes on where this one ended, or failed: a batch that was not
    committed is replayed, and files keep its rows once.  State is held in RocksDB, off the heap, so that it
    may be larger than the executors' memory; what changed goes to the checkpoint with every batch.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_PROVIDER, None)
    conf.set(_PROVIDER, ROCKSDB)
    try:
        query = (
            stream.writeStream.format(fmt).outputMode("append")
            .option("path", target).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
    finally:
        if before is None:
            conf.unset(_PROVIDER)
        else:
            conf.set(_PROVIDER, before)
    told = query.recentProgress
    return StreamRun(
        len([p for p in told if p.numInputRows]), sum(p.numInputRows for p in told),
        sum(s.numRowsDroppedByWatermark for p in told for s in p.stateOperators))


def write_in_turn(rows: DataFrame, folder: str, time_column: str, bounds: Sequence) -> None:
    """Append ``rows`` to ``folder`` window by window: a stream that reads one file at a time sees them in order
    of time.  ``bounds`` are the first moments of all windows but the first."""
    edges = [None, *bounds, None]
    ts = F.col(time_column)
    for low, high in zip(edges, edges[1:]):
        part = rows if low is None else rows.filter(ts >= as_timestamp(low))
        part = part if high is None else part.filter(ts < as_timestamp(high))
        part.coalesce(1).write.mode("append").parquet(folder)
