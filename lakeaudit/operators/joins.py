"""Join strategies the operators share.

* ``broadcast_if_small``: broadcast a side only after counting its rows
  against ``spark.lakeaudit.broadcastMaxRows`` and the bytes of its text
  against ``spark.lakeaudit.broadcastMaxBytes``; beyond that the plain shuffle join is
  kept (used where the key is unique, so no key can be hot).
* ``skew_join``: a many-to-one lookup whose small side knows how many
  big-side rows each key has.  Keys with at least
  ``spark.lakeaudit.hotKeyRows`` rows (at most rows / hotKeyRows of them,
  counted before broadcasting) are spread over ``saltBuckets`` salts on the
  big side and replicated only for themselves on the small side; all other
  keys join once.
* ``lookup_join``: a big frame against a lookup table without counts:
  broadcast after a size check; a large table goes through ``skew_join``
  with key counts taken from the big side (a partial aggregation).
* ``salted_join``: the uniform form -- every key salted, the small side
  replicated ``saltBuckets`` times; only the fallback of ``skew_join`` when
  even the hot-key set is too large to broadcast.

Every form is exact: each big row meets its partner once, and the salt is
a hash of a deterministic big-side column, so a re-run task salts alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.session import conf_int

SALT = "_salt"


def is_small(df: DataFrame, max_rows: int | None = None) -> bool:
    """Whether a side may be broadcast: its rows and the bytes of its text
    columns are both counted and within the limits."""
    spark = df.sparkSession
    limit = max_rows if max_rows is not None else conf_int(spark, "broadcastMaxRows")
    sizes = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    total = sum(sizes[1:], sizes[0]) if sizes else F.lit(0)
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total.cast("long")).alias("b")).first()
    return row.n <= limit and (row.b or 0) <= conf_int(spark, "broadcastMaxBytes")


def broadcast_if_small(df: DataFrame, max_rows: int | None = None, materialize: bool = False) -> DataFrame:
    """Broadcast ``df`` when it has at most ``max_rows`` rows.

    ``materialize``: for a derived frame (not a small input table), write it
    once to the shared checkpoint folder first, so that counting it and
    using it do not compute it twice, and a lost executor does not replay
    its lineage.
    """
    spark = df.sparkSession
    if materialize:
        from lakeaudit.session import checkpoint_dir

        checkpoint_dir(spark)
        df = df.checkpoint(eager=True)
    return F.broadcast(df) if is_small(df, max_rows) else df


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                spread_by: Column | str = "path", buckets: int | None = None) -> DataFrame:
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support {how}")
    spark = big.sparkSession
    n = buckets if buckets is not None else conf_int(spark, "saltBuckets")
    if n <= 1:
        return big.join(small, on, how)
    # a deterministic column of the big side: a re-run task gets the same salts
    spread = F.col(spread_by) if isinstance(spread_by, str) else spread_by
    big_s = big.withColumn(SALT, F.pmod(F.xxhash64(spread), F.lit(n)).cast("int"))
    small_s = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return big_s.join(small_s, on + [SALT], how).drop(SALT)


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner",
                spread_by: Column | str = "path", max_rows: int | None = None,
                materialize: bool = False) -> DataFrame:
    """Join a big frame to a lookup table: broadcast when the table is counted
    small, otherwise a salted shuffle join, so a hot key of the big side (the
    root directory, one digest) is still spread over several tasks.
    ``materialize``: write a derived lookup table to the checkpoint folder
    first, so counting and joining do not compute it twice."""
    spark = big.sparkSession
    if materialize:
        from lakeaudit.session import checkpoint_dir

        checkpoint_dir(spark)
        small = small.checkpoint(eager=True)
    if is_small(small, max_rows):
        return big.join(F.broadcast(small), on, how)
    # large lookup table: find the hot keys from the big side (a partial
    # aggregation over the key columns) and spread only those
    counts = big.groupBy(*on).agg(F.count(F.lit(1)).alias("_key_rows"))
    sized = small.join(counts, on, "left").withColumn("_key_rows", F.coalesce("_key_rows", F.lit(0)))
    return skew_join(big, sized, on, "_key_rows", how, spread_by=spread_by).drop("_key_rows")


def skew_join(big: DataFrame, small: DataFrame, on: list[str], count_col: str, how: str = "inner",
              spread_by: Column | str = "path", hot_rows: int | None = None,
              buckets: int | None = None, materialize: bool = True) -> DataFrame:
    """Many-to-one lookup where ``small`` knows how many big-side rows each of
    its keys has (``count_col``).  Keys with at least
    ``spark.lakeaudit.hotKeyRows`` rows are hot: their big-side rows are spread
    over ``saltBuckets`` salts and only their small-side rows are replicated;
    every other key joins once, unsalted.  The hot-key set is counted before
    it is broadcast (at most rows / hotKeyRows keys); beyond the broadcast
    limit every key is salted (``salted_join``).

    ``materialize``: the small side (an aggregate) is written once to the
    checkpoint folder, so that the hot-key count and the join do not compute
    its upstream twice."""
    spark = big.sparkSession
    if materialize:
        from lakeaudit.session import checkpoint_dir

        checkpoint_dir(spark)
        small = small.checkpoint(eager=True)
    t = hot_rows if hot_rows is not None else conf_int(spark, "hotKeyRows")
    n = buckets if buckets is not None else conf_int(spark, "saltBuckets")
    hot = small.where(F.col(count_col) >= F.lit(t)).select(*on).distinct()
    if not is_small(hot):
        return salted_join(big, small, on, how, spread_by=spread_by, buckets=n)
    spread = F.col(spread_by) if isinstance(spread_by, str) else spread_by
    flag = "_hot"
    b = (big.join(F.broadcast(hot.withColumn(flag, F.lit(True))), on, "left")
         .withColumn(SALT, F.when(F.col(flag), F.pmod(F.xxhash64(spread), F.lit(n))).otherwise(F.lit(0)).cast("int"))
         .drop(flag))
    s = small.withColumn(SALT, F.when(F.col(count_col) >= F.lit(t), F.sequence(F.lit(0), F.lit(n - 1)))
                         .otherwise(F.array(F.lit(0))))
    s = s.withColumn(SALT, F.explode(SALT))
    return b.join(s, on + [SALT], how).drop(SALT)
