"""Duplicate space kept up to date by changes.

The state of a duplicate run is a table of counts: one row per digest, size
and placement class, with how many entries it has.  A change of the manifest
is a table of signed counts of the same form -- minus one for an entry that
went, plus one for one that came -- so the new state is their sum, and the
space of all bags follows from it by the aggregation that a full run uses.
What is read is the state and the changed directories, not the manifest.

Entries of a size that is not known have no part in it; bags are told apart
by digest and size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.operators.dups import UNKNOWN_PREFIX

KEY = ["hash", "size", "class_key", "unknown"]


def state_of(manifest: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """``hash, size, class_key, unknown, n`` of a whole manifest: a partial
    aggregation, so a digest that a third of all entries have costs a row per
    task and class."""
    return _counts(manifest, locations).groupBy(*KEY).agg(F.sum("n").alias("n"))


def _counts(manifest: DataFrame, locations: DataFrame | None) -> DataFrame:
    rows = manifest.where(F.col("hash").isNotNull() & (F.col("size") >= 0)).select("hash", "size", "path")
    if locations is None:
        place = F.lit(None).cast("string")
    else:
        kind = dict(locations.dtypes)["place"]
        rows = rows.join(locations.select("path", F.col("place").alias("_place")), "path", "left")
        place = F.col("_place")
        empty = F.size(place) == 0 if kind.startswith("array") else place.cast("string") == ""
        text = F.to_json(place) if kind.startswith("array") else place.cast("string")
        rows = rows.withColumn("_key", F.when(~empty, text)).withColumn("_unknown", place.isNull())
        own = F.concat(F.lit(UNKNOWN_PREFIX), F.col("path"))
        return rows.select("hash", "size", F.coalesce("_key", own).alias("class_key"), F.col("_unknown").alias("unknown"), F.lit(1).cast("long").alias("n"))
    own = F.concat(F.lit(UNKNOWN_PREFIX), F.col("path"))
    return rows.select("hash", "size", own.alias("class_key"), place.isNull().alias("unknown"), F.lit(1).cast("long").alias("n"))


def changes(old: DataFrame, new: DataFrame, locations: DataFrame | None = None) -> DataFrame:
    """Signed counts that lead from the entries ``old`` to ``new`` of some
    directories (what a delta of the store replaces, and what it holds).
    Counts that cancel out are left out."""
    minus = _counts(old, locations).withColumn("n", -F.col("n"))
    return _counts(new, locations).unionByName(minus).groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0")


def applied(state: DataFrame, change: DataFrame) -> DataFrame:
    """The state after a change.  A count below zero says that the change does
    not belong to this state and is an error when the rows are read."""
    out = state.select(*KEY, "n").unionByName(change.select(*KEY, "n")).groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0")
    return out.withColumn("n", F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("a change that does not fit the state"))))


def space(state: DataFrame, min_size: int) -> DataFrame:
    """``hash, size, n_items, n_classes, merged_n, shared, exclusive,
    ext_unknown`` of every bag of two entries or more."""
    bags = state.where(F.col("size") >= min_size).groupBy("hash", "size").agg(
        F.sum("n").cast("bigint").alias("n_items"), F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("_top"), F.bool_or("unknown").alias("ext_unknown"))
    merged = F.when(F.col("_top") >= 2, F.col("_top")).otherwise(F.lit(0)).cast("bigint")
    return bags.where("n_items >= 2").select("hash", "size", "n_items", "n_classes", merged.alias("merged_n"), (F.col("size") * merged).alias("shared"),
                                             (F.col("size") * F.col("n_classes")).alias("exclusive"), "ext_unknown")
