"""Nearest manifest root.

For each path, the closest ancestor directory that owns a manifest; at the
same level an atom manifest wins over a split one.  The scan root (``''``)
is never a candidate; a path without one gets nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.paths import ancestors, parent_dir
from lakeaudit.operators.joins import lookup_join

# Precedence of manifest kinds at the same level.
KIND_RANK = {"atom": 2, "split": 1}


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths(path)`` x ``roots(root, kind)`` -> ``path, root, kind``.

    Judged once per distinct directory: its ancestors are exploded (a handful),
    the roots table is joined on the ancestor (broadcast after a size check,
    salted beyond it) and the deepest match is kept with a partial ``max`` over
    ``(depth, kind rank)``; the paths then look up their directory.
    """
    rank = F.when(F.col("kind") == "atom", F.lit(KIND_RANK["atom"])).otherwise(F.lit(KIND_RANK["split"]))
    r = roots.select(F.col("root").alias("anc"), "kind", rank.alias("rank"))
    named = paths.select("path").distinct().withColumn("_dir", parent_dir("path"))
    a = named.select("_dir").distinct().select("_dir", F.explode(ancestors("_dir")).alias("a")).select(
        "_dir", F.col("a.anc").alias("anc"), F.col("a.depth").alias("depth"))
    best = (lookup_join(a, r, ["anc"], "inner", spread_by="_dir").groupBy("_dir")
            .agg(F.max(F.struct("depth", "rank", F.col("anc").alias("root"), "kind")).alias("b")))
    return (lookup_join(named, best, ["_dir"], "left", spread_by="path", materialize=True)
            .select("path", F.col("b.root").alias("root"), F.col("b.kind").alias("kind")))
