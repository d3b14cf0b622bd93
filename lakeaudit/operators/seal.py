"""Per-directory manifest seals (H6).

A seal summarises one directory's entries so that a later reader can tell
whether the manifest rows were altered.  It is computed as an aggregation
that Spark can combine partially: the entry count plus four 32-bit sums of
the md5 of each entry's canonical text.  Order does not matter and no
directory's entries are ever gathered into one list, so a directory holding
a third of all rows is no problem.

(The single-file JSON manifests of the file tool carry an md5 of their
serialised map instead; ``lakeaudit.sources.manifests`` verifies those.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.hashing import row_fingerprint
from lakeaudit.schema import Status


def entry_digest(df: DataFrame):
    """md5 of ``name, mod_ms, algo, hash, size`` joined by U+001F, null as ``\\N``."""
    return F.md5(row_fingerprint([F.col("name"), F.col("mod_ms"), F.col("algo"), F.col("hash"), F.col("size")]))


def seal(manifest: DataFrame) -> DataFrame:
    """``dir, seal``; seal = ``count:s1:s2:s3:s4``."""
    h = entry_digest(manifest)
    slices = [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    d = manifest.select("dir", *[s.alias(f"_s{i}") for i, s in enumerate(slices)])
    agg = d.groupBy("dir").agg(F.count("*").alias("_n"), *[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(4)])
    return agg.select("dir", F.concat_ws(":", *[F.col(c).cast("string") for c in
                                                ["_n", "_t0", "_t1", "_t2", "_t3"]]).alias("seal"))


def verify_seal(manifest: DataFrame, seals: DataFrame) -> DataFrame:
    """``dir, verified, status``: a directory whose recomputed seal differs from
    the stored one (or exists on one side only) gets ``ERX``."""
    now = seal(manifest).withColumnRenamed("seal", "_now")
    j = seals.select("dir", F.col("seal").alias("_was")).join(now, "dir", "full_outer")
    ok = F.coalesce(F.col("_was") == F.col("_now"), F.lit(False))
    return j.select("dir", ok.alias("verified"),
                    F.when(~ok, F.lit(Status.BAD_INDEX)).alias("status"))
