"""Raking against a plain fit, and the draw against its probabilities."""

import math
from collections import defaultdict

from pyspark.sql import functions as F

from lakeaudit.llm import mixing as M

from .conftest import SF001


def plain_rake(cells, targets, rounds):
    mass = {k: float(v) for k, v in cells.items()}
    for _ in range(rounds):
        for d, target in enumerate(targets):
            total = defaultdict(float)
            for k, m in mass.items():
                total[k[d]] += m
            mass = {k: m * target[k[d]] / total[k[d]] for k, m in mass.items()}
    return mass


def test_rake(spark):
    cells = {(s, lang, t): (i * 7 + j * 3 + k * 5) % 11 + 1 for i, s in enumerate("abcd") for j, lang in enumerate("xy")
             for k, t in enumerate("pqr") if (i + j + k) % 4}
    targets = [{"a": .4, "b": .3, "c": .2, "d": .1}, {"x": .6, "y": .4}, {"p": .2, "q": .5, "r": .3}]
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "source string, lang string, topic string, n_tokens long")
    frames = {d: spark.createDataFrame(list(t.items()), f"{d} string, target double") for d, t in zip(M.DIMS, targets)}
    want = plain_rake(cells, targets, 9)
    for limit in (None, 0):  # in one task, and by group sums and joins
        got = {(r.source, r.lang, r.topic): r.mass for r in M.rake(df, frames, max_rows=limit).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    assert all(math.isclose(sum(m for k, m in want.items() if k[0] == s), targets[0][s], rel_tol=1e-3) for s in "abcd")


def test_shares_of_the_sample_are_the_targets(spark):
    out = M.op3_raked_mixture(spark, SF001).toPandas()
    out["want"] = out.n_tokens * out.prob
    for d in M.DIMS:
        own = out.groupby(d).n_tokens.sum().astype(float) ** M.FLATTEN[d]
        share = out.groupby(d).want.sum() / out.want.sum()
        assert ((share - own / own.sum()).abs() < 1e-3).all()
    assert out.prob.max() == 1.0
    assert abs(out.kept.mean() - out.prob.mean()) < 0.15


def test_edge_rows(spark, edge_docs, no_docs):
    df = edge_docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s"))
    rows = M.described(df)
    out = M.sampled(rows).collect()
    assert len(out) == df.count()
    assert all(r.prob == 0 and not r.kept for r in out if r.doc_id in (2, 3))  # their cells have no tokens
    assert all(0 < r.prob <= 1 for r in out if r.n_tokens)
    assert {r.source for r in out} == {"s", M.NONE}
    assert M.sampled(M.described(no_docs)).count() == 0
    staged = M.stage(spark, df, SF001)
    assert staged.columns == df.columns
    assert sorted(r.doc_id for r in staged.collect()) == sorted(r.doc_id for r in out if r.kept)
    assert M.stage(spark, no_docs, SF001).count() == 0


def test_draw_is_even(spark):
    u = spark.range(4000).select(M.draw(F.col("id")).alias("u")).toPandas().u
    assert u.between(0, 1, inclusive="left").all() and abs(u.mean() - 0.5) < 0.02


def test_stage_with_clashing_names(spark):
    df = spark.createDataFrame([(i, "a b c", "s", "en", "x", 0.5) for i in range(9)],
                               "doc_id long, text string, source string, lang string, _mix_source string, _mix_prob double")
    assert M.stage(spark, df, SF001).columns == df.columns
    assert M.stage(spark, df, SF001).count() == 9
