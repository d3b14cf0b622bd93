"""Quality rules against a plain reading of the definitions."""

import math
import re
from collections import Counter

import pytest
import xxhash

from lakeaudit.llm import quality as Q

from .conftest import SF001


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def buckets(t):
    w = words(t)
    grams = [a[-2:] + " " + b[:2] for a, b in zip(w, w[1:])]
    return [xxhash.xxh64_intdigest(g.encode(), 42) % Q.N_BUCKETS if xxhash.xxh64_intdigest(g.encode(), 42) < 2 ** 63
            else (xxhash.xxh64_intdigest(g.encode(), 42) - 2 ** 64) % Q.N_BUCKETS for g in grams]


def base(t):
    t = t or ""
    w = words(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    c = Counter(win)
    rep = {i + k for i, x in enumerate(win) if c[x] > 1 for k in range(8)}
    failed = len(w) < 20 or 100 * len(rep) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(rep), failed


def plain(docs, labels):
    good = {i for i, q, x in labels if q == 1 and not x}
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(buckets(t))
        if i in good:
            target.update(buckets(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    out = []
    for i, t in docs:
        b = buckets(t)
        s = sum(math.log((target[x] + 1) / (n_target + Q.N_BUCKETS)) - math.log((raw[x] + 1) / (n_raw + Q.N_BUCKETS)) for x in b)
        s = s / len(b) if b and n_target else 0.0
        out.append((i, *base(t), round(s, 9), not base(t)[5] and s >= Q.THRESHOLD))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed,
                    round(r.score, 9), r.kept) for r in df.select("doc_id", "_q.*").collect()), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF001}/labels.parquet")
    want = plain([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    rows = got(Q.scored(docs, labels))
    assert rows == want
    kept = [r for r in rows if r[-1]]
    assert 0.5 * len(rows) < len(kept) < len(rows)
    q = sorted(r.doc_id for r in Q.op8_quality(spark, SF001).where("kept").collect())
    assert q == sorted(r[0] for r in kept)


def test_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(9, 1, 0), (1, 1, None), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert got(Q.scored(edge_docs, labels)) == plain(docs, [(9, 1, 0), (1, 1, None)])
    assert got(Q.scored(edge_docs, labels.limit(0))) == plain(docs, [])
    assert Q.scored(no_docs, labels).count() == 0
    assert Q.scored(edge_docs, labels).columns == [*edge_docs.columns, "_q"]


@pytest.mark.parametrize("text", ["a b c d e f g h " * 3, "x " * 40, "one two three four five six seven eight nine " * 2 + "tail",
                                  "l1 x\nl1 x\n\n\n \nl2\nl1 x", "\v\f\r\n a|b #<>& é🙂"])
def test_counts(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert got(Q.scored(df, labels)) == plain([(1, text)], [])


def test_trusted_sample_is_bounded(spark):
    labels = spark.range(5000).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    assert Q.trusted_ids(labels, 10_000).count() == 5000
    assert 800 < Q.trusted_ids(labels, 1000).count() < 1200


def test_native(spark):
    plan = Q.op8_quality(spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
