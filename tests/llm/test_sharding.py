"""Sharding: the table against its definition, balance and disruption."""

from collections import Counter

import pytest

from lakeaudit.llm import sharding as S

from .conftest import SF001


def plain_table(shards, size):
    """Whole preference lists, one claim per turn."""
    prefs = []
    for s in shards:
        offset, skip = S._hash(f"offset:{s}") % size, S._hash(f"skip:{s}") % (size - 1) + 1
        prefs.append([(offset + k * skip) % size for k in range(size)])
    owner = {}
    while len(owner) < size:
        for i, p in enumerate(prefs):
            free = next((x for x in p if x not in owner), None)
            if free is not None:
                owner[free] = i
    return [owner[x] for x in range(size)]


@pytest.mark.parametrize("n,size", [(1, 7), (3, 101), (7, 211), (50, 53)])
def test_table(n, size):
    names = S.shard_names(n)
    assert S.fill_table(names, size) == plain_table(names, size)


def test_balance_and_disruption():
    names = S.shard_names(50)
    table = S.fill_table(names, 10_007)
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    less = S.fill_table(names[:20] + names[21:], 10_007)
    moved = sum(names[a] != (names[:20] + names[21:])[b] for a, b in zip(table, less))
    assert moved < 0.06 * 10_007
    heavy = Counter(S.fill_table(names[:3], 1009, weights=[1, 1, 2]))
    assert abs(heavy[2] - 504) <= 2 and Counter(S.fill_table(names[:2], 101, weights=[0, 1])) == {1: 101}


@pytest.mark.parametrize("args", [([], 7), (["a", "a"], 7), (["a"], 8), (["a", "b", "c"], 2), (["a"], 2_000_003)])
def test_bad_tables(args):
    with pytest.raises(ValueError):
        S.fill_table(*args)


def test_edge_rows(spark, edge_docs, no_docs):
    names = S.shard_names(5)
    out = S.place(edge_docs, "lang", names, 101)
    rows = out.select("lang", "shard_id", "slot").collect()
    assert len(rows) == edge_docs.count() and set(edge_docs.columns) <= set(out.columns)
    assert len({(r.lang, r.slot, r.shard_id) for r in rows}) == 2  # 'en' and null
    assert S.place(no_docs, "doc_id", names, 101).count() == 0


def test_plan_is_one_broadcast_join(spark):
    plan = S.op1_maglev_shards(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "Python" not in plan
