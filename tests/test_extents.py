"""Extent lists against a byte by byte account, and duplicate counts by change."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators import dup_changes as C
from lakeaudit.operators import dups as D
from lakeaudit.operators import extents as X

PLACE = "path string, place array<struct<logical:long,physical:long,length:long>>"


def byte_map(extents):
    return {l + i: p + i for l, p, n in extents for i in range(n)}


def made(seed, n=60):
    """Objects of a few blocks, cut and ordered at random; some share blocks
    whole or in part, some hold a block twice."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        extents, at = [], 0
        for _ in range(rng.randint(0, 4)):
            size, where = rng.randint(1, 30), rng.choice([rng.randint(0, 200), 40, 120])
            cut = rng.randint(0, size)
            extents += [(at, where, cut), (at + cut, where + cut, size - cut)]
            at += size
        rng.shuffle(extents)
        out.append((f"p{k}", None if rng.random() < .1 else extents))
    return out


def test_canonical_lists(spark):
    rows = made(1, 200)
    df = spark.createDataFrame(rows, PLACE)
    got = {r.path: r.place for r in X.placements(df).collect()}
    canon = {}
    for path, extents in rows:
        if extents is None:
            assert got[path] is None
            continue
        mine = [tuple(e) for e in got[path]]
        assert byte_map(mine) == byte_map(extents)
        assert all(a[0] + a[2] != b[0] or a[1] + a[2] != b[1] for a, b in zip(mine, mine[1:])) and mine == sorted(mine)
        canon.setdefault(tuple(sorted(byte_map(extents).items())), set()).add(tuple(mine))
    assert all(len(v) == 1 for v in canon.values())


@pytest.mark.parametrize("window", [7, 64, 1 << 30])
def test_partly_shared_bytes(spark, window):
    rows = made(2)
    holders = defaultdict(set)
    for path, extents in rows:
        for p in set(byte_map(extents or []).values()):
            holders[p].add(path)
    want = {path: (len(set(byte_map(x or []).values())), sum(len(holders[p]) > 1 for p in set(byte_map(x or []).values()))) for path, x in rows}
    df = spark.createDataFrame(rows, PLACE)
    assert {r.path: (r.held, r.shared) for r in X.shared_bytes(df, window).collect()} == want
    total = X.coverage(df, window).agg(F.sum((F.col("e") - F.col("s")) * F.col("holders"))).first()[0]
    assert total == sum(len(v) for v in holders.values())


def test_same_placement_of_lists(spark):
    a, b = [(0, 10, 5), (5, 15, 5)], [(0, 10, 10)]
    rows = [("x", a), ("y", b), ("z", [(0, 11, 10)]), ("none", None), ("empty", [])]
    loc = X.placements(spark.createDataFrame(rows, PLACE))
    lists = {"same": "xy", "other": "xyz", "self": "z", "lost": ["x", "missing"], "unknown": ["none", "none"], "empty": ["empty", "empty"]}
    df = spark.createDataFrame([(g, i, p) for g, ps in lists.items() for i, p in enumerate(ps)], "g string, i long, path string")
    got = {r.g: (r.n, r.same) for r in X.same_placement(df, loc, "g", "i").collect()}
    assert got == {"same": (2, True), "other": (3, False), "self": (1, True), "lost": (2, False), "unknown": (2, False), "empty": (2, False)}


def test_chain_of_changes(spark):
    """After any chain of changes the space is that of a full run."""
    rng = random.Random(7)
    schema = "hash string, path string, size long"
    now = {f"p{i}": rng.choice("abcdefg") for i in range(80)}
    size = {h: 10 * (i + 1) for i, h in enumerate("abcdefg")}
    places = spark.createDataFrame([(f"p{i}", rng.choice(["u", "v", None, ""])) for i in range(120)], "path string, place string")

    def frame(entries):
        return spark.createDataFrame([(h, p, size[h]) for p, h in entries.items()], schema)

    state = C.state_of(frame(now), places)
    for _ in range(3):
        touched = {f"p{rng.randrange(120)}" for _ in range(30)}
        nxt = {p: h for p, h in now.items() if p not in touched}
        nxt.update({p: rng.choice("abcdefg") for p in touched if rng.random() < .6})
        old_part, new_part = ({p: h for p, h in m.items() if p in touched} for m in (now, nxt))
        state = C.applied(state, C.changes(frame(old_part), frame(new_part), places)).checkpoint()
        now = nxt
        cols = ["hash", "size", "n_items", "n_classes", "merged_n", "shared", "exclusive", "ext_unknown"]
        full = D.dup_space(frame(now), places, min_size=0)
        assert sorted(map(tuple, C.space(state, 0).select(*cols).collect())) == sorted(map(tuple, full.select(*cols).collect()))
    wrong = C.applied(state, state.withColumn("n", -F.col("n") - 1))
    with pytest.raises(Exception, match="does not fit"):
        wrong.collect()
