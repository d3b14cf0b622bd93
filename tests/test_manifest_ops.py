"""Fuse, seals, nearest root, rates and levels."""

from pyspark.sql import functions as F

from lakeaudit.operators import fuse as U
from lakeaudit.operators import rates as RT
from lakeaudit.operators import roots as R
from lakeaudit.operators import seal as S
from lakeaudit.plans import fixtures as FX

from conftest import SF001

SRC = "source_root string, kind string, dir string, name string, mod_ms bigint, algo string, hash string, size bigint"


def test_fuse_rules(spark):
    rows = [
        ("", "split", "", "top.txt", 1, "md5", "t", 1),           # the fuse root's own: not taken
        ("a", "atom", "", "f1", 1, "md5", "a-f1", 1),
        ("a", "atom", "b", "f2", 1, "md5", "a-f2", 1),            # replaced by the deeper a/b
        ("a", "split", "", "f1", 1, "md5", "split", 1),           # shadowed by the atom in a
        ("a/b", "split", "", "f3", 1, "md5", "ab-f3", 1),
        ("c", "atom", "", "bad", None, "md5", "x", 1),            # invalid source, skipped whole
        ("c", "atom", "", "good", 1, "md5", "x", 1),
    ]
    src = spark.createDataFrame(rows, SRC)
    got = sorted((r["path"], r["hash"]) for r in U.fuse(src).collect())
    assert got == [("a/b/f3", "ab-f3"), ("a/f1", "a-f1")]
    assert U.fuse_count(src).first()[0] == 3
    top = sorted(r["path"] for r in U.fuse(src, include_top=True).collect())
    assert top == ["a/b/f3", "a/f1", "top.txt"]


def test_fuse_of_one_source_is_the_source(spark):
    obs = FX.observed(spark, SF001)
    src = obs.select(F.lit("root").alias("source_root"), F.lit("atom").alias("kind"), "dir", "name", "mod_ms",
                     "algo", "hash", "size")
    fused = U.fuse(src).select(F.regexp_replace("path", "^root/", "").alias("path"), "hash")
    assert fused.exceptAll(obs.select("path", "hash")).count() == 0
    assert obs.select("path", "hash").exceptAll(fused).count() == 0


def test_seal_detects_change(spark):
    obs = FX.observed(spark, SF001).drop("doc_id", "error")
    seals = S.seal(obs)
    assert S.verify_seal(obs, seals).where("NOT verified").count() == 0
    changed = obs.withColumn("hash", F.when(F.col("name") == "d5.txt", F.lit("0" * 32)).otherwise(F.col("hash")))
    bad = S.verify_seal(changed, seals).where("NOT verified").collect()
    assert len(bad) == 1 and bad[0]["status"] == "ERX"


def test_nearest_root(spark):
    paths = spark.createDataFrame([("src1/en/a",), ("src1/de/b",), ("src2/x/y/c",), ("src5/d",), ("top",)], "path string")
    got = {r["path"]: (r["root"], r["kind"]) for r in R.nearest_root(paths, FX.roots(spark)).collect()}
    assert got == {"src1/en/a": ("src1/en", "split"), "src1/de/b": ("src1", "atom"),
                   "src2/x/y/c": ("src2", "atom"), "src5/d": (None, None), "top": (None, None)}


def test_levels_golden(spark):
    """The reference's sparkline test: 11 values to 8 levels."""
    vals = [5, 12, 35, 73, 80, 125, 150, 142, 118, 61, 19]
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(vals)], "key string, slot int, events bigint")
    got = [r["level"] for r in RT.rate_levels(df).orderBy("slot").collect()]
    assert got == [0, 0, 1, 3, 4, 6, 7, 7, 5, 3, 1]
    flat = spark.createDataFrame([("k", i, 3) for i in range(4)], "key string, slot int, events bigint")
    assert {r["level"] for r in RT.rate_levels(flat).collect()} == {0}


def test_rate_buckets_edges(spark):
    # start = 0; interval 10: t=0 -> b0, t=10 -> b0 (closed right), t=11 -> b1, t=35 -> open bucket b3
    ev = spark.createDataFrame([("k", 0), ("k", 10), ("k", 11), ("k", 25), ("k", 35)], "key string, t bigint")
    ev = ev.select("key", F.timestamp_millis("t").alias("ts"))
    rb = RT.rate_buckets(ev, "ts", "key", None, 10, 10, start_ms=0, now_ms=35)
    got = [(r["bucket"], r["events"]) for r in rb.orderBy("slot").collect()]
    assert got[-3:] == [(0, 2), (1, 1), (2, 1)]
    assert len(got) == 10 and all(e == 0 for _, e in got[:-3])
