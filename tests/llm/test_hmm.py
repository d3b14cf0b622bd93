"""The hidden Markov model against plain sums over all state paths, and the
base score against its definition."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeaudit.llm import hmm as H

from .conftest import EDGE, SF001


def random_model(rng, k, n):
    def rows(*shape):
        x = rng.random(shape) + 0.05
        return x / x.sum(axis=-1, keepdims=True)

    return H.Model(rows(k), rows(k, k), rows(k, n).T.copy())


def by_paths(seq, m):
    """Likelihood and expected counts by summing over every path."""
    k = len(m.start)
    total, start, move, emit = 0.0, np.zeros(k), np.zeros((k, k)), np.zeros_like(m.emit)
    for path in itertools.product(range(k), repeat=len(seq)):
        p = m.start[path[0]] * m.emit[seq[0], path[0]]
        for a, b, x in zip(path, path[1:], seq[1:]):
            p *= m.move[a, b] * m.emit[x, b]
        total += p
        start[path[0]] += p
        for a, b in zip(path, path[1:]):
            move[a, b] += p
        for s, x in zip(path, seq):
            emit[x, s] += p
    return total, start / total, move / total, emit / total


@pytest.mark.parametrize("piece", [1, 2, 3, 100])
def test_recursions(piece):
    rng = np.random.default_rng(piece)
    m = random_model(rng, 3, 4)
    seqs = [rng.integers(0, 4, n) for n in (1, 7, 2, 5, 1, 6, 4)]
    sizes, flat = np.array([len(s) for s in seqs]), np.concatenate(seqs)
    want = [by_paths(list(s), m) for s in seqs]
    assert np.allclose(H.log10_likelihood(flat, sizes, m, piece), [math.log10(w[0]) for w in want])
    got = H.expected_counts(flat, sizes, m, piece)
    for i in range(3):
        assert np.allclose(got[i], sum(w[i + 1] for w in want))


def test_rounds_never_lower_the_likelihood():
    rng = np.random.default_rng(5)
    seqs = [rng.integers(0, 20, 300) // (1 + i % 2) for i in range(12)]
    sizes, flat = np.array([len(s) for s in seqs]), np.concatenate(seqs)
    counts = np.bincount(flat, minlength=20).astype(float)
    m, last = H.first_model(counts, 2), -np.inf
    for _ in range(6):
        now = H.log10_likelihood(flat, sizes, m, 64).sum()
        assert now > last - 1e-3 * abs(now)
        m, last = H.next_model(*H.expected_counts(flat, sizes, m, 64), counts), now
        for x in (m.start, m.move.T, m.emit):
            assert np.allclose(x.sum(axis=0), 1)
    assert last > H.log10_likelihood(flat, sizes, H.first_model(counts, 1, 0), 64).sum()


def tokens(t):
    t = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", t) + [None]


def base(rows):
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    c = Counter(x for i, t in rows if not held[i] for x in tokens(t))
    n, v = sum(c.values()), len(c)
    return sorted(((i, held[i], len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n,
                    round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t in rows), key=repr)


def got_base(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df), key=repr)


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    out = H.op9_hmm(spark, SF001).collect()
    want = base(rows)
    for a, b in zip(got_base(out), want):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-5)
    # the model tells held-out texts better than the base counts do
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in out)


def test_small_vocabulary_goes_through_the_join(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = H.score(docs, rounds=1, frequent=50, own=10).collect()
    for a, b in zip(got_base(out), base(rows)):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-5)


def test_scores_are_probabilities(spark):
    """Over all texts of one word the probabilities sum to less than one."""
    train = [(i, "a b a c " * 3) for i in range(40)]
    seen = [("a",), ("b",), ("c",), ("zz",)]
    probe = [(1000 + i, w[0]) for i, w in enumerate(seen)]
    out = {r.doc_id: r.score for r in H.score(spark.createDataFrame(train + probe, "doc_id long, text string"), states=2).collect()}
    assert 0 < sum(10 ** out[i] for i, _ in probe) < 1


def test_edge_rows(spark, edge_docs, no_docs):
    rows = [(i, t) for i, t, _ in EDGE]
    out = H.score(edge_docs, rounds=2).collect()
    assert got_base(out) == base(rows)
    assert len({r.score for r in out if r.doc_id == 6}) == 1
    assert H.score(no_docs, rounds=1).count() == 0
    only_held = [i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    rows = [(i, "a b") for i in only_held]
    out = H.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()
    assert got_base(out) == base(rows) and all(r.base_score == 0 for r in out)
    rows = [(None, "a b"), (None, "c"), (3, "a")]
    out = H.score(spark.createDataFrame(rows, "doc_id long, text string"), rounds=1).collect()
    assert sorted(x[2:] for x in got_base(out)) == sorted(x[2:] for x in base(rows))


def test_training_rounds_and_precision():
    """Five rounds by default; counts in single precision end at the scores
    of those in double."""
    import inspect

    assert H.ROUNDS == 5
    assert all(inspect.signature(f).parameters["rounds"].default == 5 for f in (H.train, H.score))
    rng = np.random.default_rng(6)
    sizes = rng.integers(1, 2500, 60)
    tokens = np.minimum(rng.zipf(1.3, sizes.sum()), 300) - 1
    counts = np.bincount(tokens, minlength=300)
    scores = []
    for single in (False, True):
        model = H.first_model(counts)
        for _ in range(H.ROUNDS):
            model = H.next_model(*H.expected_counts(tokens, sizes, model.single() if single else model), counts)
        scores.append(H.log10_likelihood(tokens, sizes, model))
    assert np.allclose(*scores, rtol=1e-4)
