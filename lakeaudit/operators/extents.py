"""Physical extents (S7, A5, D4): where the bytes of objects lie.

An extent is ``(logical, physical, length)``: a run of bytes of an object and
where it is stored.  Two objects share a placement when their lists describe
the same mapping; how a list is cut into extents, and in what order they
stand, does not matter, so lists are brought to a canonical form first.

Objects may also share a part of their bytes (a block held by a copy that was
changed elsewhere).  Such bytes are found by a sweep over the physical axis:
the borders of all extents cut it into pieces, and running sums over sorted
borders tell how many objects hold each.  The axis is dealt to tasks in
windows of ``WINDOW`` bytes, an extent being cut at their borders, so no task
sees more than its part however the extents overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeaudit.operators.joins import skew_join

EXTENT = "struct<logical:bigint,physical:bigint,length:bigint>"
# bytes of the physical axis that are swept together
WINDOW = 1 << 30


def canonical(extents: Column) -> Column:
    """The list in order of logical offsets, empty extents left out, and
    neighbours that go on in both spaces made one."""
    ordered = F.array_sort(F.filter(extents.cast(f"array<{EXTENT}>"), lambda e: e["length"] > 0))

    def add(done: Column, e: Column) -> Column:
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (last["logical"] + last["length"] == e["logical"]) & (last["physical"] + last["length"] == e["physical"])
        joined = F.struct(last["logical"].alias("logical"), last["physical"].alias("physical"), (last["length"] + e["length"]).alias("length"))
        return F.when(touches, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(e)))

    # an empty list has no last element to look at
    first = F.slice(ordered, 1, 1)
    rest = F.when(F.size(ordered) > 1, F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(1)))).otherwise(F.slice(ordered, 1, 0))
    return F.when(F.size(ordered) > 0, F.aggregate(rest, first, add)).otherwise(ordered)


def placements(locations: DataFrame) -> DataFrame:
    """``path, place`` with canonical lists; null stays null (not readable)."""
    return locations.select("path", F.when(F.col("place").isNotNull(), canonical(F.col("place"))).alias("place"))


def same_placement(groups: DataFrame, locations: DataFrame, group_col: str, order_col: str) -> DataFrame:
    """D4 for given lists of objects ``(group, order, path)``: whether all
    members share the first one's placement, which must be known and not
    empty.  ``group, n, same``.  A member without location shares nothing."""
    rows = groups.join(locations.select("path", "place"), "path", "left")
    known = F.col("place").isNotNull() & (F.size("place") > 0)
    rows = rows.select(F.col(group_col).alias("_g"), F.struct(F.col(order_col), "path").alias("_o"), F.when(known, F.to_json("place")).alias("_k"))
    first = rows.groupBy("_g").agg(F.min_by("_k", "_o").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    marked = skew_join(rows, first, ["_g"], "_rows", "inner", spread_by=F.col("_o"))
    out = marked.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("_k") == F.col("_first"), F.lit(False))).alias("same"))
    return out.withColumnRenamed("_g", group_col)


def pieces(locations: DataFrame, window: int = WINDOW) -> DataFrame:
    """``path, win, s, e``: the physical ranges an object holds, each once,
    cut at the borders of windows."""
    one = locations.where(F.col("place").isNotNull()).select("path", F.explode("place").alias("x")).select(
        "path", F.col("x.physical").alias("s"), (F.col("x.physical") + F.col("x.length")).alias("e")).where("e > s")
    cut = one.select("path", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / F.lit(window)), F.floor((F.col("e") - 1) / F.lit(window)))).alias("win"))
    lo, hi = F.col("win") * window, (F.col("win") + 1) * window
    return cut.select("path", "win", F.greatest("s", lo).alias("s"), F.least("e", hi).alias("e"))


def coverage(locations: DataFrame, window: int = WINDOW) -> DataFrame:
    """``win, s, e, holders``: the pieces of the physical axis between
    neighbouring borders, and how many objects hold each (one at least).

    Borders are summed per position first, so any number of objects that hold
    the same block are one row of the sweep."""
    p = _merged(locations, window)
    borders = p.select("win", F.col("s").alias("at"), F.lit(1).alias("d")).unionByName(p.select("win", F.col("e").alias("at"), F.lit(-1).alias("d")))
    borders = borders.groupBy("win", "at").agg(F.sum("d").alias("d"))
    order = Window.partitionBy("win").orderBy("at")
    swept = borders.withColumn("holders", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("e", F.lead("at").over(order))
    return swept.where("holders > 0").select("win", F.col("at").alias("s"), "e", "holders")


def _merged(locations: DataFrame, window: int) -> DataFrame:
    """``pieces`` in which an object holds no byte twice."""
    order = Window.partitionBy("path", "win").orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = pieces(locations, window).withColumn("s", F.greatest("s", F.coalesce(reach, F.col("s"))))
    return rows.where("e > s")


def shared_bytes(locations: DataFrame, window: int = WINDOW) -> DataFrame:
    """``path, held, shared``: the physical bytes an object holds, and how
    many of them another object holds too.  Objects without a readable
    placement hold none.

    Running sums of shared bytes at the borders give each piece its share by
    two lookups, however many borders lie within it."""
    cover = coverage(locations, window)
    order = Window.partitionBy("win").orderBy("s")
    both = F.when(F.col("holders") > 1, F.col("e") - F.col("s")).otherwise(F.lit(0))
    sums = cover.withColumn("before", F.sum(both).over(order.rowsBetween(Window.unboundedPreceding, 0)) - both)
    # at a border: shared bytes of the window up to it
    at = sums.select("win", F.col("s").alias("at"), F.col("before").alias("upto"), F.lit(1).alias("_n")).unionByName(
        sums.select("win", F.col("e").alias("at"), (F.col("before") + both).alias("upto"), F.lit(1).alias("_n")))
    at = at.groupBy("win", "at").agg(F.max("upto").alias("upto"))
    mine = _merged(locations, window)
    uses = mine.select("win", F.col("s").alias("at")).unionByName(mine.select("win", F.col("e").alias("at"))).groupBy("win", "at").agg(F.count(F.lit(1)).alias("_n"))
    # every border of an object is a border of the sweep; a block that many
    # objects hold is spread over tasks
    at = at.join(uses, ["win", "at"])
    start = at.select("win", F.col("at").alias("s"), F.col("upto").alias("_a"), "_n")
    end = at.select("win", F.col("at").alias("e"), F.col("upto").alias("_b"), F.col("_n").alias("_m"))
    held = skew_join(skew_join(mine, start, ["win", "s"], "_n", "inner", spread_by="path"), end, ["win", "e"], "_m", "inner", spread_by="path")
    per = held.groupBy("path").agg(F.sum(F.col("e") - F.col("s")).alias("held"), F.sum(F.col("_b") - F.col("_a")).alias("shared"))
    return locations.select("path").join(per, "path", "left").select("path", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("shared", F.lit(0)).alias("shared"))
