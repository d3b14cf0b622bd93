"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from lakeaudit.llm import hnsw as H

from .conftest import SF001


def brute(rows, queries, k=10):
    """(query_id, rank, vec_id, score) over every usable row but the query's own."""
    out = []
    good = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    good = sorted({(i, tuple(v)) for i, v in good})
    for q, x in good:
        if queries(q):
            near = {}
            for i, v in good:
                if i != q and len(v) == len(x):
                    s = math.dist(x, v)
                    near[i] = min(s, near.get(i, s))
            best = sorted((s, i) for i, s in near.items())[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(best, 1)]
    return out


def recall(got, want):
    hit, score = 0, {(q, i): s for q, _, i, s in want}
    for q, _, i, s in got:
        if (q, i) in score:
            assert math.isclose(s, score[q, i], rel_tol=1e-9, abs_tol=1e-12)
            hit += 1
    return hit / max(1, len(want))


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def ordered(rows):
    """Ranks without a gap, nearest first, ties to the smaller id."""
    by = {}
    for q, r, i, s in rows:
        by.setdefault(q, []).append((r, s, i))
    for x in by.values():
        assert [r for r, _, _ in x] == list(range(1, len(x) + 1))
        assert [(s, i) for _, s, i in x] == sorted((s, i) for _, s, i in x)


@pytest.mark.parametrize("n", [1, 2, 5, 41, 700])
def test_graph(n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 12))
    g = H.build(x)
    for links, count in zip(g.links, g.count):
        assert links.max() < count and (links != np.arange(count)[:, None]).all()
        assert all(len(set(row)) == len(row) for row in ([i for i in r if i >= 0] for r in links.tolist()))
    got = g.search(x, min(n, 10))
    want = np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :10]
    assert sum(len(set(a) & set(b)) for a, b in zip(got.tolist(), want.tolist())) >= 0.99 * want.size


def test_distant_clusters():
    """Tight groups far from each other are all reached."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((30, 8)) * 100, 40, axis=0) + rng.standard_normal((1200, 8))
    x = x[rng.permutation(len(x))]
    got = H.build(x).search(x, 10)
    want = np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :10]
    assert sum(len(set(a) & set(b)) for a, b in zip(got.tolist(), want.tolist())) >= 0.95 * want.size


def test_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    got = rows_of(H.op12_hnsw(spark, SF001))
    want = brute(rows, lambda q: q % 100 == 0)
    ordered(got)
    assert len(got) == len(want) and recall(got, want) >= 0.95


def test_shards_are_merged(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(c) for c in rng.standard_normal(6)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graphs = H.index(df, rows_per_shard=100)
    assert graphs.select("shard").distinct().count() == 9
    asked = H.vectors(df).where("id % 20 = 0")
    got = rows_of(H.search(graphs, asked))
    want = brute(rows, lambda q: q % 20 == 0)
    ordered(got)
    assert len(got) == len(want) and recall(got, want) >= 0.97
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # shards and queries over batch borders
    try:
        assert rows_of(H.search(graphs, asked)) == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_edge_rows(spark):
    """Copies, ties, repeated rows, odd vectors, several lengths, no id."""
    v, w = [1.0, 2.0, 3.0], [1.0, 2.0, 4.0]
    rows = [(i, v) for i in range(0, 60)] + [(i, w) for i in range(60, 75)] + [(200, v), (200, v), (300, w), (300, [9.0, 9.0, 9.0])]
    rows += [(400, None), (500, []), (600, [0.0, 0.0, 0.0]), (700, [1.0, None, 1.0]), (800, [float("nan"), 1.0, 1.0]),
             (900, [float("inf"), 1.0, 1.0]), (None, v), (1000, [1.0, 2.0]), (1001, [1.0, 2.5]), (1100, [7.0])]
    df = spark.createDataFrame([(i, x, "c") for i, x in rows], "vec_id long, embedding array<double>, rank string")
    df = df.withColumn("score", df["rank"]).withColumn("id", df["rank"]).withColumn("h", df["rank"])
    got = rows_of(H.search(H.index(df), H.vectors(df).where("id % 100 = 0")))
    want = brute(rows, lambda q: q % 100 == 0)
    # id 300 holds two vectors: each row asks, a found id counts with its least distance
    strip = lambda x: [(q, r, i, round(s, 9)) for q, r, i, s in x if q != 300]
    assert strip(got) == strip(want)
    assert [r[2] for r in got if r[0] == 300][:2] == [60, 61]
    assert [x for x in got if x[0] == 1000] == [(1000, 1, 1001, 0.5)] and not [x for x in got if x[0] in (400, 500, 600, 700, 800, 900, 1100)]
    empty = df.limit(0)
    assert H.search(H.index(empty), H.vectors(empty)).count() == 0
