"""Duplicate space: bags of identical content and what they occupy.

Plan shape (no per-bag item lists, no window over a bag):

1. candidates: manifest rows with a digest and not known to be below
   ``min_size`` (filter pushed to the scan);
2. placement: left join on ``path`` (unique key) to the listing (missing
   files leave the bag) and to the placement table (J6);
3. placement classes: ``groupBy(hash, class_key)`` -- items with the same
   placement form one class, an unknown or empty placement is a class of its
   own (A5);
4. bags: ``groupBy(hash)`` over the classes.  The largest class (ties: the
   one holding the smallest path) is the merged one when it has two or more
   members (W1, as ``min(struct(-n, min_path, key))``), shared = size x its
   members, exclusive = size x classes (A6), bags with < 2 present items go
   (A7).

Both group-bys are partial aggregations, so a hash that holds a third of
all rows (the empty object) is combined map-side and never lands in one
task as a list.  Per-item flags come from a salted lookup of the bag row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.sizes import format_size
from lakeaudit.operators.joins import broadcast_if_small, lookup_join, skew_join

DEFAULT_MIN_SIZE = 8192
UNKNOWN_PREFIX = "\u0001"


def candidates(manifest: DataFrame, min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """F7, first half: drop entries whose known size is below ``min_size``;
    a null digest cannot join a bag."""
    small = (F.col("size") >= 0) & (F.col("size") < F.lit(min_size))
    return manifest.where(F.col("hash").isNotNull() & ~F.coalesce(small, F.lit(False)))


def dup_bags(manifest: DataFrame, min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """A4: ``hash, size, n`` for every digest held by two or more entries.

    Size is the one of the smallest path with a known size.
    """
    c = candidates(manifest, min_size).select("hash", "path", "size")
    sized = F.when(F.col("size") >= 0, F.struct("path", "size"))
    return (
        c.groupBy("hash")
        .agg(F.count("*").cast("bigint").alias("n"), F.min(sized).alias("_first"))
        .select("hash", F.col("_first.size").alias("size"), "n")
        .where((F.col("n") >= 2) & (F.col("size") >= F.lit(min_size)))
    )


def placed_items(manifest: DataFrame, locations: DataFrame | None = None, listing: DataFrame | None = None,
                 min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """Candidates with placement: ``hash, path, size, present, unknown, class_key, listed_size``.

    ``locations(path, place)``: a null place means the placement could not
    be read (unknown); ``place`` may be any type (an extent array groups
    fine).  ``listing(path[, size])``: what exists now; without it all exist.
    """
    items = candidates(manifest, min_size).select("hash", "path", "size")
    if listing is not None:
        lcols = [F.col("path"), F.lit(True).alias("_present")]
        lcols.append(F.col("size").alias("listed_size") if "size" in listing.columns
                     else F.lit(None).cast("bigint").alias("listed_size"))
        items = items.join(listing.select(*lcols), "path", "left")
        present = F.coalesce(F.col("_present"), F.lit(False))
    else:
        items = items.withColumn("listed_size", F.col("size"))
        present = F.lit(True)
    if locations is not None:
        items = items.join(locations.select("path", F.col("place").alias("_place")), "path", "left")
        place = F.col("_place")
        p_type = dict(locations.dtypes)["place"]
        if p_type.startswith("array"):
            empty = F.size(place) == 0
            key = F.to_json(place)
        else:
            place = place.cast("string")
            empty = place == ""
            key = place
        unknown = place.isNull()
        class_key = F.when(unknown | empty, F.concat(F.lit(UNKNOWN_PREFIX), F.col("path"))).otherwise(key)
    else:
        unknown = F.lit(True)
        class_key = F.concat(F.lit(UNKNOWN_PREFIX), F.col("path"))
    return items.select(
        "hash", "path", "size", present.alias("present"), unknown.alias("unknown"),
        class_key.alias("class_key"), "listed_size",
    )


def dup_space(manifest: DataFrame, locations: DataFrame | None = None, listing: DataFrame | None = None,
              min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """A5-A7 + J7 + W1/W2: one row per bag.

    ``hash, size, n_items, n_classes, merged_n, shared, exclusive,
    ext_unknown, has_merged, win_key, keeper``.
    """
    items = placed_items(manifest, locations, listing, min_size)
    pres = F.col("present")
    classes = items.groupBy("hash", "class_key").agg(
        F.count("*").alias("n_all"),
        F.count_if(pres).alias("n"),
        F.min(F.when(pres, F.col("path"))).alias("cmin"),
        F.min(F.when(F.col("size") >= 0, F.struct("path", "size"))).alias("first_sized"),
        F.min(F.when(pres & F.col("listed_size").isNotNull(), F.struct("path", "listed_size"))).alias("first_listed"),
        F.bool_or(F.col("unknown") & pres).alias("unk"),
    )
    bags = classes.groupBy("hash").agg(
        F.sum("n_all").alias("n_all"),
        F.sum("n").cast("bigint").alias("n_items"),
        F.count_if(F.col("n") > 0).cast("bigint").alias("n_classes"),
        F.min("first_sized").alias("first_sized"),
        F.min("first_listed").alias("first_listed"),
        F.bool_or("unk").alias("ext_unknown"),
        F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("neg_n"), "cmin", "class_key"))).alias("win"),
        F.min("cmin").alias("min_path"),
    )
    size = F.coalesce(F.col("first_sized.size"), F.col("first_listed.listed_size"))
    top = -F.col("win.neg_n")
    merged_n = F.when(top >= 2, top).otherwise(F.lit(0)).cast("bigint")
    return (
        bags.select(
            "hash", size.alias("size"), "n_all", "n_items", "n_classes",
            merged_n.alias("merged_n"), "ext_unknown", F.col("win.class_key").alias("win_key"),
            # The keeper is the smallest merged path, else the smallest path
            F.when(merged_n >= 2, F.col("win.cmin")).otherwise(F.col("min_path")).alias("keeper"),
        )
        .where((F.col("n_all") >= 2) & (F.col("n_items") >= 2) & (F.col("size") >= F.lit(min_size)))
        .select(
            "hash", "size", "n_items", "n_classes", "merged_n",
            (F.col("size") * F.col("merged_n")).alias("shared"),
            (F.col("size") * F.col("n_classes")).alias("exclusive"),
            "ext_unknown", (F.col("merged_n") > 0).alias("has_merged"), "win_key", "keeper",
        )
    )


def dup_items(manifest: DataFrame, bags: DataFrame, locations: DataFrame | None = None,
              listing: DataFrame | None = None, min_size: int = DEFAULT_MIN_SIZE) -> DataFrame:
    """Items of the bags: ``hash, path, size, merged, keeper, shared,
    exclusive, ext_unknown``.

    The bag row is looked up once, with a skew-aware join on ``hash``: hot
    digests (bags of ``spark.lakeaudit.hotKeyRows`` items or more) are spread
    over ``spark.lakeaudit.saltBuckets`` tasks, all others join once; the
    plan (D1) and the JSON lines (K5) are projections of this.
    """
    items = placed_items(manifest, locations, listing, min_size).where("present")
    b = bags.select("hash", F.col("size").alias("bag_size"), "merged_n", "win_key", "keeper",
                    "shared", "exclusive", "ext_unknown", "n_items")
    j = skew_join(items, b, ["hash"], "n_items", "inner", spread_by="path")
    merged = (F.col("class_key") == F.col("win_key")) & (F.col("merged_n") >= 2)
    return j.select("hash", "path", F.col("bag_size").alias("size"), merged.alias("merged"), "keeper",
                    "shared", "exclusive", "ext_unknown")


def dup_show(bags: DataFrame) -> DataFrame:
    """O1: bags by size, largest first (ties by hash), sizes formatted."""
    return bags.select(
        "hash", "size", "n_items", "shared", "exclusive", "ext_unknown",
        format_size("size").alias("size_fmt"),
        format_size("shared").alias("shared_fmt"),
        format_size("exclusive").alias("exclusive_fmt"),
    ).orderBy(F.desc("size"), F.asc("hash"))


def dup_report(bags: DataFrame) -> DataFrame:
    """Totals of a duplicate run.

    efficiency_bp = (1 - (actual - min) / (max - min)) in hundredths of a
    percent, rounded half up in exact integer arithmetic; null when max <= min.
    ``used_only``: more than half of the bags have unknown placement, so only
    the used space is meaningful.
    """
    t = bags.agg(
        F.count("*").cast("bigint").alias("hashes"),
        F.sum("n_items").cast("bigint").alias("files"),
        F.sum("size").cast("bigint").alias("min_space"),
        F.sum(F.col("size") * F.col("n_items")).cast("bigint").alias("max_space"),
        F.sum("exclusive").cast("bigint").alias("actual_space"),
        F.count_if("ext_unknown").cast("bigint").alias("unknown_bags"),
    )
    # integer division on decimal(38,0): exact at any lake size
    eff = F.expr(
        "CASE WHEN max_space > min_space THEN CAST("
        "((CAST(max_space AS DECIMAL(38,0)) - actual_space) * 20000 + (max_space - min_space))"
        " div ((CAST(max_space AS DECIMAL(38,0)) - min_space) * 2) AS BIGINT) END")
    return t.select(
        "hashes", "files", "min_space", "max_space", "actual_space",
        (F.col("actual_space") - F.col("min_space")).alias("reclaimable"),
        eff.alias("efficiency_bp"), "unknown_bags",
        (F.col("unknown_bags") * 2 > F.col("hashes")).alias("used_only"),
    )


def select_hashes(bags: DataFrame, hashes: DataFrame | None) -> DataFrame:
    """restrict to the requested digests; all when none are given.
    A requested digest without a bag is an error."""
    if hashes is None:
        return bags
    from lakeaudit.session import checkpoint_dir

    checkpoint_dir(bags.sparkSession)
    req = hashes.select("hash").distinct().checkpoint(eager=True)
    unknown = req.join(bags.select("hash"), "hash", "left_anti").limit(1).collect()
    if unknown:
        raise KeyError(f"no duplicate bag for hash {unknown[0][0]}")
    return lookup_join(bags, req, ["hash"], "left_semi", spread_by="hash")


def dedup_plan(items: DataFrame) -> DataFrame:
    """Per bag a keeper (merged items first, then smallest path) and
    one row ``hash, keeper, duplicate, bytes`` per item still to merge.

    Items from ``dup_items`` already carry their bag's keeper, so this is a
    filter; for other item tables the keeper is aggregated and looked up."""
    if "keeper" in items.columns:
        return items.where(~F.col("merged") & (F.col("path") != F.col("keeper"))).select(
            "hash", "keeper", F.col("path").alias("duplicate"), F.col("size").alias("bytes"))
    keepers = items.groupBy("hash").agg(F.min(F.struct((~F.col("merged")).alias("nm"), "path")).alias("k"),
                                        F.count("*").alias("_rows")).select(
        "hash", F.col("k.path").alias("keeper"), "_rows")
    todo = items.where(~F.col("merged"))
    j = skew_join(todo, keepers, ["hash"], "_rows", "inner", spread_by="path")
    return j.where(F.col("path") != F.col("keeper")).select(
        "hash", "keeper", F.col("path").alias("duplicate"), F.col("size").alias("bytes"))


def dedup_pairs(groups: DataFrame, group_col: str, order_col: str, path_col: str = "path") -> DataFrame:
    """Explicit lists -- the first of each group (by ``order_col``) keeps,
    every other member is merged into it."""
    first = F.struct(F.col(order_col).alias("_o"), F.col(path_col).alias("_p"))
    keepers = groups.groupBy(group_col).agg(F.min(first).alias("k"), F.count("*").alias("_rows")).select(
        group_col, F.col("k._p").alias("keeper"), "_rows")
    j = skew_join(groups, keepers, [group_col], "_rows", "inner", spread_by=path_col)
    return j.where(F.col(path_col) != F.col("keeper")).select(
        group_col, "keeper", F.col(path_col).alias("duplicate"))


def dedup_apply(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """Every object with its canonical copy (the keeper of its bag, or
    itself).  ``plan`` is keyed by ``duplicate`` (unique), so this is a
    plain equi-join on a unique key."""
    # the plan is usually much smaller than the manifest: broadcast after a
    # count (it is written once first), plain shuffle join beyond the limit
    m = broadcast_if_small(plan.select(F.col("duplicate").alias("path"), "keeper"), materialize=True)
    return manifest.join(m, "path", "left").select(
        "path", "hash", F.coalesce("keeper", "path").alias("canonical"),
        F.col("keeper").isNull().alias("is_canonical"))


def space_after(bags: DataFrame) -> DataFrame:
    """D3: a bag after all its pairs are merged: one class holding every item.
    reclaimed = size x pairs merged (pairs = items outside the merged class,
    minus the keeper when no class was merged yet)."""
    pairs = F.when(F.col("merged_n") >= 2, F.col("n_items") - F.col("merged_n")).otherwise(F.col("n_items") - 1)
    return bags.select(
        "hash",
        (F.col("size") * F.col("n_items")).alias("shared"),
        F.col("size").alias("exclusive"),
        (F.col("size") * pairs).alias("reclaimed"),
    )


def same_placement(bags: DataFrame) -> DataFrame:
    """Do all items of a bag share one known, non-empty placement."""
    return bags.select("hash", ((F.col("n_classes") == 1) & ~F.col("ext_unknown")).alias("same"))


def bags_json(items: DataFrame) -> DataFrame:
    """K5: one JSON line per bag item of ``dup_items`` (no per-bag list is built)."""
    return items.select(F.to_json(F.struct(
        "hash", "size", "shared", "exclusive", F.col("ext_unknown").alias("extUnknown"),
        "path", "merged")).alias("json"))
