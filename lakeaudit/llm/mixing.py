"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic).  The token mass of the
cells is raked to three marginals: in turn, each margin's cells are scaled to
its target, until all three hold.  What comes out keeps the association
between the margins that the corpus has.  A cell's sampling probability is
proportional to raked over actual mass, scaled so that the largest is 1: the
expected token shares of the sample are exactly the targets, and no document
is taken twice.  The draw is a hash of the id, so it is repeatable.

The corpus is read twice: once to sum tokens per cell (a partial aggregation,
so a source with a third of all rows costs one row per task and cell), once
to draw.  Raking works on the cell table alone: by windows in one task while
that table is counted small, else by group sums and joins that stay
distributed however many sources there are.

Defined cases: null source, language or topic is a value of its own
(``(none)``); a cell without tokens has probability 0; marginals that leave a
value without target drop it; a null id draws like the empty string; repeated
rows are drawn alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeaudit.llm.common import documents, let, spare, staged, text_or_empty, words_of
from lakeaudit.operators.joins import lookup_join
from lakeaudit.session import conf_int

DIMS = ("source", "lang", "topic")
# exponent that flattens a marginal of the corpus into its target
FLATTEN = {"source": 0.8, "lang": 0.8, "topic": 0.95}
ROUNDS = 9
ROUNDS_PER_WRITE = 3
SEED = "mix-1"
NONE = "(none)"


def counted(text: Column) -> Column:
    """``n_words`` and ``topic``, a coarse content type from character shares
    and length, of a text; its words are counted once."""
    size = F.length(text)
    left = lambda chars: size - F.length(F.translate(text, chars, ""))
    return let(F.size(words_of(text)), lambda n: F.struct(
        n.cast("bigint").alias("n_words"),
        F.when(100 * left("|") >= 2 * size, "table")
        .when(100 * left("0123456789") >= 3 * size, "numeric")
        .when(100 * left("ABCDEFGHIJKLMNOPQRSTUVWXYZ") >= 30 * size, "capitals")
        .when(n < 100, "note").when(n < 1000, "article").otherwise("book").alias("topic")))


def described(docs: DataFrame) -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens`` of every row."""
    name = spare(docs, "_counted")
    rows = docs.select("doc_id", F.coalesce("source", F.lit(NONE)).alias("source"), F.coalesce("lang", F.lit(NONE)).alias("lang"),
                       counted(text_or_empty("text")).alias(name))
    return rows.select("doc_id", "source", "lang", F.col(name)["topic"].alias("topic"), F.col(name)["n_words"].alias("n_tokens"))


def cell_table(rows: DataFrame, dims=DIMS) -> DataFrame:
    return rows.groupBy(*dims).agg(F.sum("n_tokens").alias("n_tokens")).where("n_tokens > 0")


def flattened(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target marginal: the corpus' own to a power, as shares of 1."""
    own = cells.groupBy(dim).agg(F.sum("n_tokens").cast("double").alias("_n"))
    total = own.agg(F.sum(F.pow("_n", F.lit(power)))).scalar()
    return own.select(dim, (F.pow("_n", F.lit(power)) / total).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, max_rows: int | None = None) -> DataFrame:
    """``cells`` (dims, n_tokens) with ``mass``: n_tokens scaled so that each
    marginal has its target shares.  ``targets``: per dim ``(dim, target)``.

    A cell table of ``max_rows`` or fewer rows (counted; the broadcast limit
    by default) is raked in one task by window sums; a larger one by group
    sums and joins, which need no value's cells together."""
    spark = cells.sparkSession
    fitted = cells.withColumn("mass", F.col("n_tokens").cast("double"))
    for dim, target in targets.items():
        fitted = fitted.join(target.withColumnRenamed("target", f"_t_{dim}"), dim)
    fitted = staged(fitted, "raked")
    small = fitted.count() <= (conf_int(spark, "broadcastMaxRows") if max_rows is None else max_rows)
    for k in range(rounds):
        if small:
            fitted = fitted.coalesce(1)
        for dim in targets:
            if small:
                total = F.sum("mass").over(Window.partitionBy(dim))
                fitted = fitted.withColumn("mass", F.col("mass") * F.col(f"_t_{dim}") / total)
            else:
                sums = fitted.groupBy(dim).agg(F.sum("mass").alias("_m"))
                fitted = fitted.join(sums, dim).withColumn("mass", F.col("mass") * F.col(f"_t_{dim}") / F.col("_m")).drop("_m")
        if (k + 1) % ROUNDS_PER_WRITE == 0 or k + 1 == rounds:
            fitted = staged(fitted, "raked")
    return fitted.drop(*[f"_t_{d}" for d in targets])


def probabilities(fitted: DataFrame, dims=DIMS) -> DataFrame:
    """Per cell ``prob``: raked over actual mass, the largest one being 1."""
    ratio = F.col("mass") / F.col("n_tokens")
    return fitted.select(*dims, (ratio / fitted.agg(F.max(ratio)).scalar()).alias("prob"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: 52 bits of its seeded MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def sampled(rows: DataFrame, targets: dict[str, DataFrame] | None = None, seed: str = SEED) -> DataFrame:
    """``rows`` (as ``described``) with ``prob`` and ``kept``."""
    cells = staged(cell_table(rows), "cells")
    if targets is None:
        targets = {d: staged(flattened(cells, d, FLATTEN[d]), f"target-{d}") for d in DIMS}
    probs = staged(probabilities(rake(cells, targets)), "probs")
    # a lookup of one row per cell: broadcast when it turns out small
    out = rows.join(probs, list(DIMS), "left").withColumn("prob", F.coalesce("prob", F.lit(0.0)))
    return out.withColumn("kept", draw(F.col("doc_id"), seed) < F.col("prob"))


def op3_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, probability and whether it is drawn."""
    rows = staged(described(documents(spark, sf_dir)), "described")
    return sampled(rows).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("prob", 9).alias("prob"), "kept")


def oracle(rounds: int = ROUNDS) -> str:
    steps = []
    at = "c0"
    targets = "".join(f"""
t_{d} AS (SELECT {d}, pow(sum(n_tokens)::DOUBLE, {FLATTEN[d]}) / sum(pow(sum(n_tokens)::DOUBLE, {FLATTEN[d]})) OVER () AS target
  FROM cells GROUP BY {d}),""" for d in DIMS)
    for i, d in enumerate(DIMS * rounds, 1):
        steps.append(f"c{i} AS MATERIALIZED (SELECT source, lang, topic, n_tokens, mass * target / sum(mass) OVER (PARTITION BY {d}) AS mass "
                     f"FROM {at} JOIN t_{d} USING ({d}))")
        at = f"c{i}"
    return rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
rows AS MATERIALIZED (
  SELECT doc_id, source, lang, n_tokens, CASE
    WHEN 100 * (length(text) - length(replace(text, '|', ''))) >= 2 * length(text) THEN 'table'
    WHEN 100 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) >= 3 * length(text) THEN 'numeric'
    WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) >= 30 * length(text) THEN 'capitals'
    WHEN n_tokens < 100 THEN 'note' WHEN n_tokens < 1000 THEN 'article' ELSE 'book' END AS topic FROM w),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS n_tokens FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0),{targets}
c0 AS MATERIALIZED (SELECT *, n_tokens::DOUBLE AS mass FROM cells),
{", ".join(steps)},
p AS (SELECT source, lang, topic, mass / n_tokens / max(mass / n_tokens) OVER () AS prob FROM {at})
SELECT doc_id, rows.source, rows.lang, rows.topic, n_tokens::BIGINT AS n_tokens, round(coalesce(prob, 0), 9) AS prob,
       ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / {1 << 52} < coalesce(prob, 0) AS kept
FROM rows LEFT JOIN p USING (source, lang, topic)"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what the calibrated draw takes.

    The probabilities (one row per cell) are counted and broadcast, so texts
    are not shuffled; a larger table goes through the skew-aware lookup."""
    rows = staged(described(docs), "described")
    cells = staged(cell_table(rows), "cells")
    targets = {d: staged(flattened(cells, d, FLATTEN[d]), f"target-{d}") for d in DIMS}
    names = {d: spare(docs, f"_mix_{d}") for d in (*DIMS, "prob")}
    probs = staged(probabilities(rake(cells, targets)), "probs").select(
        *[F.col(d).alias(names[d]) for d in (*DIMS, "prob")])
    cell = {"source": F.coalesce("source", F.lit(NONE)), "lang": F.coalesce("lang", F.lit(NONE)),
            "topic": counted(text_or_empty("text"))["topic"]}
    big = docs.withColumns({names[d]: c for d, c in cell.items()})
    out = lookup_join(big, probs, [names[d] for d in DIMS], "inner", spread_by="doc_id")
    return out.where(draw(F.col("doc_id")) < F.col(names["prob"])).select(*docs.columns)
