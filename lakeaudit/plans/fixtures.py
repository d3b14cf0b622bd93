"""Inputs derived from the test tables (FIXTURES.md section 3) by Spark.

``observed``: every document is an object ``source/lang/d<id>.txt``.
``stored``: an older snapshot of the same lake.  The rules below do not
select a subset to make checks cheap: they model what happened between the
two snapshots (files added, removed, rewritten, silently damaged), and every
document takes part in the audit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.functions.paths import join_path
from lakeaudit.functions.times import col_millis, year_month
from lakeaudit.operators.audit import dir_pairs
from lakeaudit.schema import MANIFEST_COLUMNS
from lakeaudit.sources.objects import objects, row_objects

# Epoch of the synthetic lake, ms.
BASE_MS = 1_700_000_000_000
# Min size of the duplicate fixture.
DUP_MIN_SIZE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_objects(spark: SparkSession, sf_dir: str, algo: str | None = "md5") -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return objects(
        d,
        dir=F.concat_ws("/", "source", "lang"),
        name=F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")),
        content="text",
        mod_ms=F.lit(BASE_MS) + F.col("doc_id") * 1000,
        algo=algo,
        keep=["doc_id"],
    )


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current manifest of the document lake, with ``doc_id`` kept."""
    return documents_objects(spark, sf_dir, "md5")


def stored(spark: SparkSession, sf_dir: str, sha512_suffix: str | None = None) -> DataFrame:
    """The older snapshot: every audit case occurs in it.

    ``sha512_suffix``: directories ending so were hashed with sha512 then
    (a lake whose algorithm changed over time).
    """
    if sha512_suffix is None:
        o = observed(spark, sf_dir)
    else:
        c = documents_objects(spark, sf_dir, algo=None)
        sha = F.col("dir").endswith(sha512_suffix)
        o = c.select("dir", "name", "path", "mod_ms", "size", "doc_id",
                     F.when(sha, F.lit("sha512")).otherwise(F.lit("md5")).alias("algo"),
                     F.when(sha, F.sha2("content", 512)).otherwise(F.md5("content")).alias("hash"))
    i = F.col("doc_id")
    r23, r29 = F.pmod(i, 23), F.pmod(i, 29)
    mod = (F.when((r23 == 0) | ((r23 > 2) & (r29 == 0)), F.col("mod_ms") - 1000)
           .when(r23 == 2, F.col("mod_ms") + 1000).otherwise(F.col("mod_ms")))
    hsh = F.when(r23 <= 2, F.md5(F.concat("hash", F.lit("x")))).otherwise(F.col("hash"))
    kept = o.where(F.pmod(i, 17) != 0).select(
        "dir", "name", "path", mod.alias("mod_ms"), "algo", hsh.alias("hash"), "size")
    gone_name = F.concat(F.lit("gone"), i.cast("string"), F.lit(".txt"))
    gone = o.where(F.pmod(i, 19) == 0).select(
        "dir", gone_name.alias("name"), join_path("dir", gone_name).alias("path"),
        "mod_ms", "algo", "hash", "size")
    return kept.unionByName(gone).select(*MANIFEST_COLUMNS)


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Physical placement per path; null = could not be read (unsupported)."""
    o = observed(spark, sf_dir)
    place = F.when(F.pmod("doc_id", 41) == 0, F.lit(None)).otherwise(
        F.concat("hash", F.lit("-"), F.pmod("doc_id", 2).cast("string")))
    return o.select("path", place.alias("place"))


def rules(spark: SparkSession) -> DataFrame:
    """Ignore rules ``(dir, pattern)`` of the document lake."""
    # The rule fixture.
    rows = [("", "*7.txt"), ("", "/src1"), ("src2", "en/d1*.txt"), ("src3", "/de"), ("src4", "/d1*.txt")]
    return spark.createDataFrame(rows, "dir string, pattern string")


def roots(spark: SparkSession) -> DataFrame:
    """Directories that own a manifest, by kind."""
    # The manifest-root fixture.
    rows = [("src1", "split"), ("src1", "atom"), ("src1/en", "split"), ("src2", "atom")]
    return spark.createDataFrame(rows, "root string, kind string")


def stored_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory lists of the stored snapshot, plus a vanished subtree."""
    extra = spark.createDataFrame([("src2", "zz"), ("src2/zz", "deep")], "dir string, subdir string")
    return dir_pairs(stored(spark, sf_dir)).unionByName(extra)


def current_dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dir_pairs(observed(spark, sf_dir))


def fuse_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests found below the fuse root, as one table.

    * the fuse root's own manifest (``source_root=''``, the stored snapshot),
      which fuse does not take;
    * one atom manifest per source directory (current hashes);
    * one atom manifest per ``source/en`` directory (stored hashes), deeper,
      so it wins for those directories;
    * a split manifest in the same ``source/en`` directories, which the atom
      there shadows.
    """
    o = observed(spark, sf_dir)
    s = stored(spark, sf_dir)
    cols = ["name", "mod_ms", "algo", "hash", "size"]
    top = s.select(F.lit("").alias("source_root"), F.lit("split").alias("kind"), "dir", *cols)
    src = F.regexp_extract("dir", r"^([^/]*)", 1)
    rest = F.regexp_extract("dir", r"^[^/]*/?(.*)$", 1)
    per_source = o.select(src.alias("source_root"), F.lit("atom").alias("kind"), rest.alias("dir"), *cols)
    en = s.where(F.col("dir").endswith("/en"))
    deep_atom = en.select(F.col("dir").alias("source_root"), F.lit("atom").alias("kind"), F.lit("").alias("dir"), *cols)
    deep_split = o.where(F.col("dir").endswith("/en")).select(
        F.col("dir").alias("source_root"), F.lit("split").alias("kind"), F.lit("").alias("dir"),
        "name", "mod_ms", "algo", F.md5(F.concat("hash", F.lit("split"))).alias("hash"), "size")
    return top.unionByName(per_source).unionByName(deep_atom).unionByName(deep_split)


def pages_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Web pages as objects ``host/url-path`` (``index.html`` for a path
    ending in ``/``); query and fragment are not part of the object key."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    upath = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    upath = F.when(upath == "", F.lit("/")).otherwise(upath)
    full = F.concat(host, upath, F.when(upath.endswith("/"), F.lit("index.html")).otherwise(F.lit("")))
    d = F.regexp_extract(full, r"^(.*)/[^/]*$", 1)
    n = F.regexp_extract(full, r"([^/]*)$", 1)
    return objects(p, dir=d, name=n, content="html", mod_ms=F.lit(BASE_MS) + F.col("page_id") * 1000,
                   keep=["page_id"])


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte sizes of the documents and four derived magnitudes (x1031,
    x1048583, x1073741831, cubed) so that every unit occurs."""
    d = table(spark, sf_dir, "documents")
    s = F.octet_length("text").cast("bigint")
    return d.select("doc_id", s.alias("s_b"), (s * 1031).alias("s_k"), (s * 1048583).alias("s_m"),
                    (s * 1073741831).alias("s_g"), (s * s * s).alias("s_c"))


def lineitem_rows(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    """``lineitem`` rows as objects, in two versions of the table.

    ``current``: the table as given.  ``previous``: the same table before the
    latest changes, modelled on its own columns: open lines with return flag
    N did not exist yet (new), returned lines (R) had one unit less and an
    earlier version time (upd), first lines of accepted returns (A) carried
    another discount under the same version time (DMG), and each finished
    line 1 had a superseded copy numbered 0 (del).
    """
    li = table(spark, sf_dir, "lineitem")
    mod = col_millis(li, "l_shipdate")
    month = year_month(F.col("l_shipdate"))
    keys = ["l_orderkey", "l_linenumber"]
    cols = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_linestatus"]
    if version == "current":
        df = li.withColumn("_mod", mod).withColumn("_dir", month)
        return row_objects(df, keys, cols, dir=F.col("_dir"), mod_ms=F.col("_mod"))
    if version != "previous":
        raise ValueError(version)
    flag, status, line = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber")
    prev = (
        li.where(~((flag == "N") & (status == "O")))
        .withColumn("_mod", F.when(flag == "R", mod - 86_400_000).otherwise(mod))
        .withColumn("l_quantity", F.when(flag == "R", F.col("l_quantity") - 1).otherwise(F.col("l_quantity")))
        .withColumn("l_discount", F.when((flag == "A") & (line == 1), F.col("l_discount") + 0.01)
                    .otherwise(F.col("l_discount")))
    )
    copies = li.where((status == "F") & (line == 1)).withColumn("l_linenumber", F.lit(0)).withColumn("_mod", mod)
    prev = prev.unionByName(copies).withColumn("_dir", month)
    return row_objects(prev, keys, cols, dir=F.col("_dir"), mod_ms=F.col("_mod"))
