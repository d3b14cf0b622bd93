"""Rate buckets on a stream (A9, streaming form).

``withWatermark`` + tumbling ``window`` + sums, in append mode.  Spark
windows are ``[start, end)`` while the batch form's buckets are
``(start, end]``: the event time is moved back by one microsecond (Spark's
time resolution) before windowing, so an event exactly on an edge counts in
the earlier bucket.  Output rows carry the bucket as ``(bucket_start,
bucket_end]``.  No zero fill on a stream: a bucket without events has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_rate_buckets(events: DataFrame, ts: str, key: str, value: str | None, interval: str,
                        watermark: str, start_offset: str | None = None) -> DataFrame:
    shifted = F.col(ts).cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND")
    v = F.round(F.col(value) * 100).cast("bigint") if value else F.lit(0).cast("bigint")
    w = (F.window("_t", interval, interval, start_offset) if start_offset
         else F.window("_t", interval))
    return (
        events.select(shifted.alias("_t"), F.col(key).alias("key"), v.alias("_v"))
        .withWatermark("_t", watermark)
        .groupBy(w.alias("w"), "key")
        .agg(F.count("*").cast("bigint").alias("events"), F.sum("_v").cast("bigint").alias("value_cents"))
        .select(F.col("w.start").alias("bucket_start"), F.col("w.end").alias("bucket_end"),
                "key", "events", "value_cents")
    )
