"""Rate series (A9) and their 8-level scale (A10).

Buckets of ``interval_ms`` count from ``start``; bucket ``b`` holds events
with ``start + b*I < t <= start + (b+1)*I`` (open left, closed right; an
event exactly at ``start`` is in bucket 0).  The bucket holding ``now`` is
still open; the series is the last ``n`` closed buckets (n at least 10),
zero-filled, oldest first.

Events are aggregated per ``(key, bucket)`` with partial aggregation; the
zero fill joins the small ``keys x n`` frame.  Only ``start``/``now`` reach
the driver (two scalars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lakeaudit.functions.times import col_millis

LEVELS = 8


def _ms(df: DataFrame, col: str):
    return col_millis(df, col)


def rate_buckets(events: DataFrame, ts: str, key: str, value: str | None, interval_ms: int, n: int,
                 start_ms: int | None = None, now_ms: int | None = None) -> DataFrame:
    """``key, slot, bucket, events, value_cents`` for the last ``n`` closed buckets."""
    n = max(n, 10)
    t = events.select(F.col(key).alias("key"), _ms(events, ts).alias("_t"),
                      (F.round(F.col(value) * 100).cast("bigint") if value else F.lit(0).cast("bigint")).alias("_v"))
    if start_ms is None or now_ms is None:
        r = t.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).collect()[0]
        start_ms = r["lo"] if start_ms is None else start_ms
        now_ms = r["hi"] if now_ms is None else now_ms
    if start_ms is None:  # no events
        return events.sparkSession.createDataFrame(
            [], "key string, slot int, bucket bigint, events bigint, value_cents bigint")
    i = int(interval_ms)
    open_b = max((now_ms - start_ms + i - 1) // i - 1, 0)
    first = open_b - n
    bucket = F.greatest(F.expr(f"(_t - {start_ms} + {i - 1}) div {i}") - 1, F.lit(0))
    agg = (t.where((F.col("_t") > F.lit(start_ms + first * i)) & (F.col("_t") <= F.lit(start_ms + open_b * i)))
           .select("key", bucket.alias("bucket"), "_v")
           .groupBy("key", "bucket")
           .agg(F.count("*").cast("bigint").alias("events"), F.sum("_v").cast("bigint").alias("value_cents")))
    keys = t.select("key").distinct()
    slots = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot")).select(
        "key", F.col("slot").cast("bigint").alias("slot"), (F.col("slot") + F.lit(first)).cast("bigint").alias("bucket"))
    return (slots.join(agg, ["key", "bucket"], "left")
            .select("key", "slot", "bucket",
                    F.coalesce("events", F.lit(0).cast("bigint")).alias("events"),
                    F.coalesce("value_cents", F.lit(0).cast("bigint")).alias("value_cents")))


def rate_totals(events: DataFrame, ts: str, key: str, interval_ms: int) -> DataFrame:
    """Per key: closed total, open-bucket count, all, and the mean rate per second."""
    t = events.select(F.col(key).alias("key"), _ms(events, ts).alias("_t"))
    r = t.agg(F.min("_t").alias("lo"), F.max("_t").alias("hi")).collect()[0]
    start_ms, now_ms = r["lo"], r["hi"]
    i = int(interval_ms)
    open_b = max((now_ms - start_ms + i - 1) // i - 1, 0)
    in_open = F.col("_t") > F.lit(start_ms + open_b * i)
    elapsed = max(now_ms - start_ms, 1)
    return t.groupBy("key").agg(
        F.count_if(~in_open).cast("bigint").alias("closed"),
        F.count_if(in_open).cast("bigint").alias("current"),
        F.count("*").cast("bigint").alias("total"),
    ).select("key", "closed", "current", "total",
             (F.col("total").cast("double") * 1000.0 / F.lit(float(elapsed))).alias("per_sec"))


def rate_levels(series: DataFrame, value: str = "events", key: str = "key", order: str = "slot") -> DataFrame:
    """A10: scale each series to levels 0..7 by its own min and max; a
    constant series is all 0.  Rounded half away from zero."""
    w = Window.partitionBy(key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    step = F.lit(float(LEVELS - 1)) / (hi - lo).cast("double")
    lvl = F.when(hi == lo, F.lit(0)).otherwise(F.round((F.col(value) - lo).cast("double") * step).cast("int"))
    return series.select(key, order, value, lvl.cast("bigint").alias("level"))
