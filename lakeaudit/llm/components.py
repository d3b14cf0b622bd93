"""Connected components of a link table, by alternating stars.

Each round hooks every node's larger neighbours to the smallest node it
knows (large star), then its smaller neighbours and itself (small star),
until nothing changes; the number of rounds grows with the logarithm of the
longest chain.  Only aggregations and equi-joins over the links run; minima
are aggregated map-side, so a node with a third of all links costs a row per
task, and its join rows are left to the skew-join splitting of the adaptive
planner.  Every round is written to the shared folder: lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeaudit.llm.common import staged


def _hooked(links: DataFrame, least: DataFrame) -> DataFrame:
    return links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _hooked(both.where(F.col("b") > F.col("a")), least).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hooks = _hooked(down, least).unionByName(least.select("a", F.col("m").alias("b")))
    return hooks.distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """``links (a, b)`` of two longs -> ``(a, root)`` for every node that has
    a link to another: ``root`` is the smallest node of its component and has
    no row itself.  Self links, repeats and both directions are fine."""
    links = staged(links.where(F.col("a") != F.col("b")).select("a", "b").distinct(), name)
    before = None
    while True:
        mark = _mark(links)
        if mark[0] == 0 or mark == before:
            return links.select("a", F.col("b").alias("root"))
        before = mark
        links = staged(_small_star(_large_star(links)), name)
