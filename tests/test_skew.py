"""Hot keys on the salted paths: one directory / one source holds most rows.
Broadcasting is switched off so that the salted joins are what runs."""

from pyspark.sql import functions as F

from lakeaudit.operators import fuse as U
from lakeaudit.operators import ignore as I
from lakeaudit.operators import roots as R


def _hot(spark, n=30000):
    return spark.range(n).select(
        F.when(F.col("id") % 10 < 8, F.lit("hot")).otherwise(F.concat(F.lit("d"), (F.col("id") % 50).cast("string"))).alias("dir"),
        F.concat(F.lit("f"), F.col("id").cast("string"), F.when(F.col("id") % 7 == 0, F.lit(".log")).otherwise(F.lit(".txt"))).alias("name"),
    ).select("dir", "name", F.concat_ws("/", "dir", "name").alias("path"))


def test_ignore_and_roots_salted(spark):
    spark.conf.set("spark.lakeaudit.broadcastMaxRows", "0")
    try:
        listing = _hot(spark)
        rules = spark.createDataFrame([("", "*.log"), ("hot", "/f1*")], "dir string, pattern string")
        kept = I.apply_ignore(listing, rules)
        expected = listing.where(~F.col("name").endswith(".log") & ~((F.col("dir") == "hot") & F.col("name").startswith("f1")))
        assert kept.count() == expected.count()
        assert kept.exceptAll(expected).count() == 0
        roots = spark.createDataFrame([("hot", "atom"), ("d1", "split")], "root string, kind string")
        got = R.nearest_root(listing.select("path"), roots)
        assert got.where("root = 'hot'").count() == listing.where("dir = 'hot'").count()
        assert got.where("root IS NULL").count() == listing.where("dir NOT IN ('hot', 'd1')").count()
    finally:
        spark.conf.unset("spark.lakeaudit.broadcastMaxRows")


def test_fuse_hot_directory(spark):
    base = _hot(spark)
    cols = [F.lit(1).cast("bigint").alias("mod_ms"), F.lit("md5").alias("algo"), F.md5("path").alias("hash"),
            F.lit(1).cast("bigint").alias("size")]
    shallow = base.select(F.lit("top").alias("source_root"), F.lit("atom").alias("kind"), "dir", "name", *cols)
    deep = base.where("dir = 'hot'").limit(10).select(
        F.lit("top/hot").alias("source_root"), F.lit("split").alias("kind"), F.lit("").alias("dir"), "name", *cols)
    fused = U.fuse(shallow.unionByName(deep))
    # the deeper manifest replaces the whole hot directory
    assert fused.where("dir = 'top/hot'").count() == 10
    assert fused.where("dir <> 'top/hot'").count() == base.where("dir <> 'hot'").count()
