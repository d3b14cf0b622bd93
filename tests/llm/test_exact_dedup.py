"""Exact dedup against plain grouping, over several batches."""

import hashlib
import re

from pyspark.sql import functions as F

from lakeaudit.llm import exact_dedup as D
from lakeaudit.llm.common import shared_path

from .conftest import EDGE, SF001


def key(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def plain(rows):
    rows = {(i, key(t)) for i, t in rows}
    groups = {}
    for i, k in rows:
        groups.setdefault(k, []).append(i)
    return sorted((i, min(groups[k]), len(groups[k]), i == min(groups[k]), k) for i, k in rows)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_edge_rows(spark, edge_docs, no_docs):
    assert rows_of(D.decide(edge_docs)) == plain([(i, t) for i, t, _ in EDGE])
    assert D.decide(no_docs).count() == 0
    kept = D.stage(spark, edge_docs, SF001)
    assert kept.columns == edge_docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 7, 8, 9]


def test_batches(spark):
    path = shared_path(spark, "test-index")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    index = D.DigestIndex(spark, path, 4)
    seen = {}
    for part in range(3):
        mine = [d for d in docs if d[0] % 3 == part]
        got = rows_of(index.dedup(spark.createDataFrame(mine, "doc_id long, text string")))
        groups = {}
        for i, t in mine:
            groups.setdefault(key(t), []).append(i)
        for k, ids in groups.items():
            seen.setdefault(k, min(ids))
        assert got == sorted((i, seen[key(t)], len(groups[key(t)]), i == seen[key(t)], key(t)) for i, t in mine)
        # a repeated batch decides alike and adds nothing
        assert rows_of(index.dedup(spark.createDataFrame(mine, "doc_id long, text string"))) == got
    assert index.table().count() == len(seen)
    again = D.DigestIndex(spark, path, 4)  # as a later session attaches it
    assert dict(again.table().collect()) == seen
    small = again.compact(shared_path(spark, "test-index"))
    assert dict(small.table().collect()) == seen


def test_rows_without_id(spark):
    df = spark.createDataFrame([(None, "a b"), (4, "a  b"), (None, "z"), (None, "z")], "doc_id long, text string")
    got = {(r.doc_id, r.keep_id, r.kept) for r in D.decide(df).collect()}
    assert got == {(None, 4, False), (4, 4, True), (None, None, True)}


def test_sort_merge_anti_join_without_shuffling_the_index(spark):
    index = D.DigestIndex(spark, shared_path(spark, "test-index"), 4)
    index.append(spark.range(1000).selectExpr("md5(string(id)) AS digest", "id AS keep_id"))
    groups = spark.range(2000).selectExpr("md5(string(id)) AS digest", "id AS keep_id")
    df = index.unseen(groups)
    assert df.count() == 1000
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_one_id_with_two_texts(spark):
    """Id 5 holds X, which it keeps for its copies, and Y, a copy of id 3's."""
    docs = spark.createDataFrame([(3, "y y"), (5, "x x"), (5, "y y"), (7, "x x"), (9, "z")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in D.stage(spark, docs, SF001).collect()) == [(3, "y y"), (5, "x x"), (9, "z")]


def test_repeated_rows_with_other_columns(spark):
    """Of rows that repeat id and text the first in JSON order stays; rows
    without id all stay."""
    rows = [(1, "a  b", "z"), (1, "a b", "y"), (1, "a b", "x"), (2, "a b", "w"), (None, "q", "1"), (None, "q", "2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone string")
    got = sorted(tuple(r) for r in D.stage(spark, docs, SF001).select(F.coalesce("doc_id", F.lit(0)), "text", "_gone").collect())
    assert got == [(0, "q", "1"), (0, "q", "2"), (1, "a  b", "z")]
