"""Duplicate space: fixture numbers, a hot digest, class rules, dedup plan."""

from pyspark.sql import functions as F

from lakeaudit.operators import dups as D
from lakeaudit.plans import fixtures as FX

from conftest import SF001

M = "dir string, name string, path string, mod_ms bigint, algo string, hash string, size bigint"


def test_fixture_space(spark):
    bags = D.dup_space(FX.observed(spark, SF001), FX.locations(spark, SF001), min_size=256)
    r = bags.agg(F.count("*"), F.sum("n_items"), F.sum("size"), F.sum(F.col("size") * F.col("n_items")),
                 F.sum("exclusive"), F.sum("shared"), F.count_if("ext_unknown"), F.count_if("has_merged")).first()
    assert tuple(r) == (9, 19, 25246, 54678, 39575, 30206, 1, 4)


def _manifest(spark, rows):
    return spark.createDataFrame([("d", p, "d/" + p, 1, "md5", h, s) for p, h, s in rows], M)


def test_classes_and_merged(spark):
    m = _manifest(spark, [("a", "h1", 100), ("b", "h1", 100), ("c", "h1", 100), ("d", "h1", 100), ("e", "h1", 100)])
    loc = spark.createDataFrame([("d/a", "X"), ("d/b", "X"), ("d/c", "Y"), ("d/d", "Y"), ("d/e", None)],
                                "path string, place string")
    bags = D.dup_space(m, loc, min_size=1)
    b = bags.first()
    # two classes of 2 tie; the one holding the smallest path (X: a, b) wins
    assert (b["n_items"], b["n_classes"], b["merged_n"], b["shared"], b["exclusive"], b["ext_unknown"]) == \
        (5, 3, 2, 200, 300, True)
    items = {r["path"]: r["merged"] for r in D.dup_items(m, bags, loc, min_size=1).collect()}
    assert items == {"d/a": True, "d/b": True, "d/c": False, "d/d": False, "d/e": False}
    plan = sorted(tuple(r) for r in D.dedup_plan(D.dup_items(m, bags, loc, min_size=1)).collect())
    assert plan == [("h1", "d/a", "d/c", 100), ("h1", "d/a", "d/d", 100), ("h1", "d/a", "d/e", 100)]
    after = D.space_after(bags).first()
    assert (after["shared"], after["exclusive"], after["reclaimed"]) == (500, 100, 300)
    # shared + exclusive lies in [2 x size, (n + 1) x size]
    assert 2 * b["size"] <= b["shared"] + b["exclusive"] <= (b["n_items"] + 1) * b["size"]


def test_min_size_missing_and_legacy_size(spark):
    m = _manifest(spark, [("a", "h1", 10), ("b", "h1", 10), ("c", "h2", None), ("e", "h2", None), ("f", "h2", 500),
                          ("g", "h3", 900), ("h", "h3", 900)])
    listing = spark.createDataFrame([("d/a", 10), ("d/b", 10), ("d/c", 700), ("d/e", 700), ("d/f", 500), ("d/g", 900)],
                                    "path string, size bigint")
    bags = {r["hash"]: r for r in D.dup_space(m, None, listing, min_size=100).collect()}
    # h1 below min size; h3 loses its missing file and has one item left
    assert set(bags) == {"h2"}
    assert bags["h2"]["size"] == 500 and bags["h2"]["n_items"] == 3
    # legacy entries without any size take it from the listing
    m2 = _manifest(spark, [("c", "h2", None), ("e", "h2", None)])
    b2 = D.dup_space(m2, None, listing, min_size=100).first()
    assert b2["size"] == 700


def test_hot_digest_is_spread(spark):
    """One digest holds most rows: results stay exact through the salted lookups."""
    big = spark.range(0, 20000).select(
        F.lit("d").alias("dir"), F.col("id").cast("string").alias("name"),
        F.concat(F.lit("d/"), F.col("id").cast("string")).alias("path"), F.lit(1).cast("bigint").alias("mod_ms"),
        F.lit("md5").alias("algo"),
        F.when(F.col("id") < 15000, F.lit("hot")).otherwise(F.concat(F.lit("h"), (F.col("id") % 2500).cast("string"))).alias("hash"),
        F.lit(9000).cast("bigint").alias("size"))
    loc = big.select("path", F.when(F.col("name").cast("bigint") % 3 == 0, F.lit("P")).otherwise(F.col("path")).alias("place"))
    bags = D.dup_space(big, loc, min_size=1)
    hot = bags.where("hash = 'hot'").first()
    assert hot["n_items"] == 15000 and hot["merged_n"] == 5000 and hot["n_classes"] == 10001
    items = D.dup_items(big, bags, loc, min_size=1)
    assert items.where("hash = 'hot' AND merged").count() == 5000
    plan = D.dedup_plan(items)
    assert plan.where("hash = 'hot'").count() == 10000
    assert plan.select("keeper").where("hash = 'hot'").distinct().count() == 1


def test_report_and_select(spark):
    bags = D.dup_space(FX.observed(spark, SF001), FX.locations(spark, SF001), min_size=256)
    r = D.dup_report(bags).first()
    assert r["hashes"] == 9 and r["files"] == 19 and r["reclaimable"] == 39575 - 25246
    assert r["efficiency_bp"] == round((1 - (39575 - 25246) / (54678 - 25246)) * 10000)
    one = bags.select("hash").limit(1)
    assert D.select_hashes(bags, one).count() == 1
    import pytest
    with pytest.raises(KeyError):
        D.select_hashes(bags, spark.createDataFrame([("nope",)], "hash string"))
