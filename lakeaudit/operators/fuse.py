"""Fuse many manifests into one.

``sources`` is one table holding every manifest found below the fuse root:
``source_root`` (where the manifest lives, relative to the fuse root),
``kind`` (``atom`` = one manifest for a whole subtree, ``split`` = one per
directory), ``dir`` (relative to ``source_root``) and the entry columns.

Rules:

* the fuse root's own manifest is not taken (``include_top`` to take it);
* in one directory with both kinds, the atom is used and the split skipped;
* a source with an invalid entry (no name or no mtime) is skipped whole;
* for one final directory, the deepest source wins and replaces the whole
  directory manifest (later saves win, parents are visited first).

Shape: small per-source / per-directory decision tables built with partial
aggregations (they also count each key's rows), then skew-aware joins back to
the entries: a source or directory holding a third of the rows is spread over
several tasks, the others join once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.paths import depth, join_dirs, join_path
from lakeaudit.operators.joins import skew_join
from lakeaudit.schema import MANIFEST_COLUMNS


def _taken(sources: DataFrame, include_top: bool) -> DataFrame:
    s = sources if include_top else sources.where(F.col("source_root") != "")
    per_source = s.groupBy("source_root").agg(
        F.bool_or(F.col("kind") == "atom").alias("has_atom"),
        F.bool_or(F.col("name").isNull() | F.col("mod_ms").isNull()).alias("invalid"),
        F.count("*").alias("_rows"),
    )
    usable = per_source.where(~F.col("invalid")).select("source_root", "has_atom", "_rows")
    s = skew_join(s, usable, ["source_root"], "_rows", "inner",
                  spread_by=F.concat_ws("/", "dir", "name")).drop("_rows")
    return s.where((F.col("kind") == "atom") | ~F.col("has_atom")).drop("has_atom")


def fuse(sources: DataFrame, include_top: bool = False) -> DataFrame:
    """The fused manifest: ``dir, name, path, mod_ms, algo, hash, size, source_root``."""
    s = _taken(sources, include_top)
    s = s.select(
        "*",
        join_dirs("source_root", "dir").alias("_fdir"),
        depth("source_root").alias("_depth"),
    )
    win = s.groupBy("_fdir", "_depth").agg(F.count("*").alias("_rows")).groupBy("_fdir").agg(
        F.max(F.struct("_depth", "_rows")).alias("_w")).select("_fdir", "_w._depth", "_w._rows")
    kept = skew_join(s, win, ["_fdir", "_depth"], "_rows", "left_semi", spread_by="name")
    out = kept.select(F.col("_fdir").alias("dir"), "name", join_path("_fdir", "name").alias("path"),
                      "mod_ms", "algo", "hash", "size", "source_root")
    return out.select(*MANIFEST_COLUMNS, "source_root")


def fuse_count(sources: DataFrame, include_top: bool = False) -> DataFrame:
    """Number of directory manifests taken, overwritten ones included."""
    s = _taken(sources, include_top)
    return s.select("source_root", "dir").distinct().agg(F.count("*").cast("bigint").alias("fused"))
