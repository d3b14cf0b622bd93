"""Whitening against a plain eigendecomposition and exact integers."""

import math

import numpy as np
import pytest

from lakeaudit.llm import whitening as W

from .conftest import SF001


def plain(rows):
    """Fit list, n, sums, eigenvalues and vectors from a dense covariance."""
    x = {tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in rows}
    n, sums = len(x), [sum(c) for c in zip(*x)]
    m = np.array(sorted(x), float) - np.array(sums) / n
    e, v = np.linalg.eigh(m.T @ m / n)
    return n, sums, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("kind", ["random", "graded", "equal", "deficient", "clustered", "diagonal", "one"])
def test_singular_vectors(kind):
    rng = np.random.default_rng(3)
    d = 1 if kind == "one" else 30
    u, v = (np.linalg.qr(rng.standard_normal((d, d)))[0] for _ in range(2))
    s = {"random": rng.random(d) + .1, "graded": 10.0 ** -np.arange(d), "equal": np.r_[np.ones(d // 2), np.full(d - d // 2, .5)],
         "deficient": np.r_[rng.random(12) + .5, np.zeros(18)], "clustered": 1 + 1e-7 * np.arange(d), "diagonal": rng.random(d),
         "one": np.ones(1)}[kind]
    r = np.diag(s) if kind == "diagonal" else np.linalg.qr((u * s) @ v.T, mode="r")
    values, axes = W.right_singular(r, d)
    want = np.sort(np.linalg.svd(r)[1])[::-1][:len(values)]
    assert len(values) == {"deficient": 12, "graded": len(values)}.get(kind, d)
    assert np.allclose(np.sqrt(values), want, rtol=1e-12 if kind != "graded" else 1e-6, atol=1e-14)
    assert np.abs(axes.T @ axes - np.eye(len(values))).max() < 1e-11
    assert np.abs(np.linalg.norm(r @ axes, axis=0) - want).max() < 1e-12 * want[0]
    assert np.abs(r.T @ (r @ axes) - axes * values).max() < 1e-12 * values[0]


def test_dqds_keeps_relative_accuracy():
    """A graded bidiagonal, its values to many digits by exact fractions."""
    from fractions import Fraction

    a, b = [10.0 ** -k for k in range(8)], [10.0 ** -(k + 1) for k in range(7)]
    got = W.dqds([x * x for x in a], [x * x for x in b])
    # the product of all values is the squared determinant, their sum the squared norm
    product, total = Fraction(1), Fraction(0)
    for x in got:
        product, total = product * Fraction(x), total + Fraction(x)
    want = Fraction(1)
    for x in a:
        want *= Fraction(x) ** 2
    assert abs(product / want - 1) < Fraction(1, 10 ** 13)
    assert abs(total / sum(Fraction(x) ** 2 for x in a + b) - 1) < Fraction(1, 10 ** 13)
    assert all(x > 0 for x in got)


def check(rows, out):
    n, sums, e, v = plain([r for _, r in rows])
    by_id = {}
    for r in out:
        by_id.setdefault(r.vec_id, {})[r.component] = r
    k = max(r.component for r in out)
    signs = None
    for i, vec in rows:
        x = [math.floor(64 * float(c)) + 1_000_000 for c in vec]
        got = by_id[i]
        assert sorted(got) == list(range(1, k + 1))
        assert {r.n for r in got.values()} == {n}
        assert {r.deviation for r in got.values()} == {sum((n * c - s) ** 2 for c, s in zip(x, sums))}
        w = (np.array(x) - np.array(sums) / n) @ v[:, :k] / np.sqrt(e[:k])
        mine = np.array([got[c].whitened for c in range(1, k + 1)])
        signs = np.sign(w * mine) if signs is None else signs
        assert np.allclose(mine * signs, w, atol=1e-6)
    share = [by_id[rows[0][0]][c].explained for c in range(1, k + 1)]
    assert np.allclose(share, e[:k] / e.sum(), rtol=1e-9)
    assert len({r.identity_error for r in out}) == 1 and 0 <= out[0].identity_error < 1e-9


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in W.embeddings(spark, SF001).collect()]
    out = W.op11_whitening(spark, SF001).collect()
    assert len(out) == 16 * len(rows)
    check(rows, out)


def test_edge_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.standard_normal(5) * (1, 3, 9, 2, 5)]) for i in range(40)]
    good += [(100, good[0][1]), (101, good[0][1]), (None, good[1][1]), (7, good[7][1])]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0, 3.0, 4.0]), (53, [float("nan")] * 5), (54, [float("inf"), 0.0, 0.0, 0.0, 0.0]),
           (55, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "c") for i, v in good + bad], "vec_id long, embedding array<double>, component string")
    df = df.withColumn("x", df.vec_id).withColumn("n", df.component).repartition(7)
    model = W.fit(df)
    out = W.whiten(df, model).collect()
    assert len(out) == 5 * len(good) and not {r.vec_id for r in out} & {i for i, _ in bad}
    assert sum(r.vec_id is None for r in out) == 5 and sum(r.vec_id == 7 for r in out) == 10
    check([(i, v) for i, v in good if i is not None], [r for r in out if r.vec_id is not None])
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert W.whiten(same, W.fit(same)).count() == 0
    assert W.whiten(df.limit(0), W.fit(df.limit(0))).columns == [c.split()[0] for c in W.SCHEMA.split(", ")]
    flat = spark.createDataFrame([(i, [float(i), 3.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in W.whiten(flat, W.fit(flat)).collect()} == {1}
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 2.0]), (3, [-1e300, 7.0])], "vec_id long, embedding array<double>")
    out = {r.vec_id: r.deviation for r in W.whiten(huge, W.fit(huge)).collect()}
    assert out == {1: None, 2: (3 * 128 - (64 + 128 + 448)) ** 2, 3: None}


def test_tree_of_triangles(spark):
    """Many tasks and a small fan give the triangle of all rows at once."""
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(4)]) for i in range(200)],
                               "vec_id long, embedding array<double>")
    rows = W.fit_list(df)
    n, sums = W._totals(rows)
    model = W.Whitening(n, sums, np.zeros((4, 0)), np.zeros(0), 0.0)
    r = W.reduced(rows.repartition(23), model, fan=3)
    x = np.array([r.x for r in rows.collect()], float)
    x -= x.mean(axis=0)
    assert np.allclose(r.T @ r, x.T @ x)
