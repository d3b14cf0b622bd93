"""SimHash against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lakeaudit.llm import components as C, simhash as S

from .conftest import EDGE, SF001

A_Z = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(A_Z))
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(docs, radius=3):
    fp = [(i, plain_fingerprint(t)) for i, t in docs]
    pairs = [(a, b) for a, x in fp for b, y in fp if a < b and (x ^ y).bit_count() <= radius]
    comp = plain_components(pairs, [i for i, _ in fp])
    return sorted((i, f"{x:016x}", comp[i]) for i, x in fp)


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert S.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4, 6, 7])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    fps = rng.integers(0, 2 ** 63, 150, dtype=np.uint64)
    for i in range(1, 150):
        if i % 3:
            fps[i] = fps[i - 1]
            for b in rng.integers(0, 64, radius + (i % 4) - 1 if radius + (i % 4) > 1 else 0):
                fps[i] ^= np.uint64(1) << np.uint64(b)
    near = S.within(S.bit_planes(fps), fps, ~S._lanes(np.ones((150, 150), bool)), radius)
    got = np.unpackbits(near.view(np.uint8), axis=1, bitorder="little")[:, :150].astype(bool)
    want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps])
    assert (got == want).all()


def test_masks_cover_every_difference():
    masks = S.part_masks()
    rng = random.Random(1)
    for _ in range(300):
        diff = sum({1 << rng.randrange(64) for _ in range(3)})
        assert any(diff & m == 0 for m in masks)


def test_links_with_small_blocks(spark):
    """Hot buckets cut into block pairs, buckets over batch borders."""
    rng = random.Random(7)
    fps = {rng.getrandbits(64)}
    while len(fps) < 400:
        x = rng.choice(sorted(fps)) if rng.random() < .8 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    rows = [(i, x - 2 ** 64 if x >> 63 else x) for i, x in enumerate(sorted(fps))]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    want = plain_components([(a, b) for a, x in rows for b, y in rows if a < b and ((x ^ y) & (2 ** 64 - 1)).bit_count() <= 3],
                            [i for i, _ in rows])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        for block in (8, 4096):
            roots = dict(C.components(S.links(nodes, block=block)).collect())
            assert {i: roots.get(i, i) for i, _ in rows} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    got = dict(C.components(df).collect())
    want = plain_components(pairs, {x for p in pairs for x in p})
    assert got == {k: v for k, v in want.items() if k != v}


def test_long_chain(spark):
    df = spark.range(60).selectExpr("(id * 37) % 61 AS a", "((id + 1) * 37) % 61 AS b")
    assert {r.root for r in C.components(df).collect()} == {0}


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in S.op4_simhash(spark, SF001).collect()) == brute(docs)


def test_edge_rows(spark, edge_docs, no_docs):
    got = sorted(tuple(r) for r in S.near_duplicates(edge_docs).collect())
    want = brute([(i, t) for i, t, _ in EDGE])
    assert got == want
    assert S.near_duplicates(no_docs).count() == 0
    kept = S.stage(spark, edge_docs, SF001)
    assert kept.columns == edge_docs.columns
    assert {r.doc_id for r in kept.collect()} == {c for _, _, c in want}
    no_id = spark.createDataFrame([(None, "p q r s"), (5, "p q r s"), (None, "z")], "doc_id long, text string")
    assert sorted(S.near_duplicates(no_id).select("component_id").toPandas().component_id.fillna(-1)) == [-1, 5, 5]


def test_fingerprints_that_only_rows_without_id_have(spark, monkeypatch):
    """0, 7 and 63 join through the row in the middle, which has no id; ``d``
    stands alone, once with and once without id."""
    fps = {"a": 0, "b": 7, "c": 63, "d": 63 << 40, "e": 63 << 50}

    def given_fps(docs, **_):
        pairs = F.create_map(*[F.lit(x) for kv in fps.items() for x in kv])
        return docs.select("doc_id", pairs[F.col("text")].cast("long").alias("fp"), S.text_md5(F.col("text")).alias("text_md5"))

    monkeypatch.setattr(S, "fingerprints", given_fps)
    docs = spark.createDataFrame([(9, "a"), (None, "b"), (1, "c"), (None, "d"), (4, "d"), (None, "e")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, int(r.fingerprint, 16)) for r in S.near_duplicates(docs).collect()}
    assert got == {(9, 1, 0), (None, 1, 7), (1, 1, 63), (None, 4, 63 << 40), (4, 4, 63 << 40), (None, None, fps["e"])}


def test_stage_one_id_with_two_texts(spark):
    """Id 5 holds x, which it keeps for its copies, and y, a copy of id 3's."""
    x, y = " ".join(f"x{i}" for i in range(30)), " ".join(f"y{i}" for i in range(30))
    docs = spark.createDataFrame([(3, y), (5, x), (5, y), (7, x), (None, x)], "doc_id long, text string")
    kept = {(r.doc_id, r.text) for r in S.stage(spark, docs, SF001).collect()}
    assert kept == {(3, y), (5, x), (None, x)}
