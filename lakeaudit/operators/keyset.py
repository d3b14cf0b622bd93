"""Sets of keys as bitmaps, to test rows where they are scanned.

A set of any size becomes a bitmap of bounded size: a key's hash names one
bit.  Spark builds it by an aggregation (bitmaps of 32,768 bits, one row for
each that has a bit), and a scan looks its rows up in it by a broadcast join
on the number of the bitmap, so nothing of the scanned side is shuffled.

A bit may stand for several keys: a row that is in the set is always found,
one that is not may be too -- about one in ``BITS_PER_KEY`` while the set is
within ``spark.lakeaudit.keySetMaxBits``, more beyond that.  The caller has to
test again what must be exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.session import conf_int

BITMAP = 32_768
BITS_PER_KEY = 16


def key_bits(spark, n: int) -> int:
    """Bits of the bitmap of ``n`` keys: a power of two within the limit."""
    most = conf_int(spark, "keySetMaxBits")
    bits = BITMAP
    while bits < n * BITS_PER_KEY and bits * 2 <= most:
        bits *= 2
    return bits


def _bit(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits)) + 1


def bitmaps(keys: DataFrame, col: str, bits: int) -> DataFrame:
    """``_bucket, _bitmap`` of the longs in ``col``: at most ``bits / 32768``
    rows of 4 KB."""
    bit = _bit(F.col(col), bits)
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_bitmap"))


def mark(df: DataFrame, key: Column, keys: DataFrame, col: str, n: int, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether ``key`` may be among the ``n``
    longs in ``keys.col``; never false for one that is."""
    bits = key_bits(df.sparkSession, n)
    maps = bitmaps(keys, col, bits).select(F.col("_bucket").alias("_key_bucket"), F.col("_bitmap").alias("_key_bitmap"))
    bit = _bit(key, bits)
    # bounded by keySetMaxBits, whatever the number of keys
    out = df.withColumn("_key_bit", bit).join(F.broadcast(maps), F.bitmap_bucket_number("_key_bit") == F.col("_key_bucket"), "left")
    at = F.bitmap_bit_position("_key_bit")
    byte = F.conv(F.hex(F.expr("substring(_key_bitmap, CAST(bitmap_bit_position(_key_bit) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = F.col("_key_bitmap").isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_key_bit", "_key_bucket", "_key_bitmap")
