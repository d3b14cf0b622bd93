"""Phrases against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lakeaudit.llm import phrases as P

from .conftest import EDGE, SF001

A_Z = {c: c + 32 for c in range(65, 91)}


def plain(docs, least=P.LEAST, top=P.TOP):
    """docs: (text, lang) -> rows (lang, rank, phrase, a, l, r, n, score)."""
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = P.UND if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cand = {p for p, a in f.items() if a >= least and len(p) > 1}
        rows = []
        for p in cand:
            inside = [q for q in cand if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))] if len(p) < 4 else []
            if any(100 * f[q] >= 80 * f[p] for q in inside):
                continue
            score, k = min((2_000_000 * f[p] // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def made(n, seed=1):
    """Texts from a few words of uneven frequency, with all kinds of breaks."""
    rng = np.random.default_rng(seed)
    words = ["The", "of", "été", "x-y", "new", "york", "city", "hall", "İ", "a\x1cb", "z"]
    p = 1 / np.arange(1, len(words) + 1)
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " - "]
    out = []
    for _ in range(n):
        k = int(rng.integers(0, 40))
        t = "".join(words[i] + marks[j] for i, j in zip(rng.choice(len(words), k, p=p / p.sum()), rng.choice(9, k, p=[.7, .05, .05, .05, .05, .03, .03, .02, .02])))
        out.append((t + "new york city hall " * int(rng.integers(0, 3)), [None, "en", "und", "fr"][int(rng.integers(0, 4))]))
    return out


@pytest.mark.parametrize("mode", ["broadcast", "joined", "mixed"])
def test_against_plain_counting(spark, monkeypatch, mode):
    docs = made(300)
    if mode == "joined":  # tables too large to broadcast
        monkeypatch.setattr(P, "WORDS_AT_ONCE", 3)
        monkeypatch.setattr(P, "CELLS_AT_ONCE", 3)
    if mode == "mixed":  # pairs broadcast, then phrases of three joined
        sizes = iter([True, False, True])
        monkeypatch.setattr(P, "is_small", lambda *_: next(sizes))
    df = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    got = rows_of(P.collocations(df, least=8, top=40))
    assert got == plain(docs, 8, 40) and len(got) > 40


def test_whole_table(spark):
    docs = [(r.text, r.lang) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = rows_of(P.op13_phrases(spark, SF001))
    assert got == plain(docs) and len(got) > 30


def test_cells():
    """Dense and sparse tiles, small address spaces, several hand-overs."""
    rng = np.random.default_rng(2)
    for tile, dense, held in ((4, 1, 10), (4, 30, 5), (16, 10 ** 9, 40), (64, 100, 10 ** 6)):
        cells, want, got = P.Cells(tile, dense, held), Counter(), Counter()
        for _ in range(9):
            left, right = (rng.zipf(1.3, 400) % 300 for _ in range(2))
            want.update(zip(left.tolist(), right.tolist()))
            cells.add(left.astype(np.int64), right.astype(np.int64))
            if cells.full() and rng.random() < .5:
                for codes, counts in cells.drain():
                    got.update({(c >> 32, c & 0xFFFFFFFF): n for c, n in zip(codes.tolist(), counts.tolist())})
        for codes, counts in cells.drain():
            for c, n in zip(codes.tolist(), counts.tolist()):
                got[c >> 32, c & 0xFFFFFFFF] += n
        assert got == want


def test_ranks(spark):
    df = spark.createDataFrame([(i, (i * 7) % 13) for i in range(500)], "k long, a long").repartition(6)
    got = [(r.id, r.k) for r in P.ranked(df, "k").orderBy("id").collect()]
    assert got == list(enumerate(k for _, k in sorted((-((k * 7) % 13), k) for k in range(500))))


def test_edge_rows(spark, edge_docs, no_docs):
    docs = [(t, l) for _, t, l in EDGE]
    clash = edge_docs
    for name in ("a", "l", "r", "word", "words", "phrase", "rank", "id", "key", "ids"):
        clash = clash.withColumn(name, clash.slot)
    assert rows_of(P.collocations(clash)) == plain(docs)
    assert P.collocations(clash, least=1).count() == len(plain(docs, 1))
    assert P.collocations(no_docs).count() == 0
    text = "one two three. " * 40  # one long text without id
    one = spark.createDataFrame([(None, text * 500, None)], "doc_id long, text string, lang string")
    assert rows_of(P.collocations(one)) == [("und", 1, "one two three", 20000, 20000, 20000, 60000, 1_000_000)]


def test_driver_holds_columns(spark, monkeypatch):
    """Words and cells pass the driver as columns, not as objects, and only
    for lengths that longer phrases follow."""
    import tracemalloc

    from lakeaudit.session import ship_package
    from pyspark.sql import functions as F

    ship_package(spark)
    words = spark.range(60_000).select(F.lit("en").alias("lang"), F.concat(F.lit("w"), "id").alias("word"), F.lit(9).cast("long").alias("a"), "id")
    docs = spark.createDataFrame([("w5 W59999 w60000, w0", "en"), ("w5", "fr"), (None, "en")], "text string, lang string")
    cells = spark.range(60_000).select((F.col("id") * 7 % 60_000).alias("l"), (F.col("id") % 11).alias("r"), "id")
    tracemalloc.start()
    seqs = P.sequences(docs, words)
    codes, numbers = P.cell_table(cells)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 60_000
    assert sorted(r.ids for r in seqs.collect()) == [[-1], [-1, -1], [5, 59999, -1, -1, 0, -1]]
    want = sorted(((i * 7 % 60_000) << 32 | i % 11, i) for i in range(60_000))
    assert list(zip(codes.tolist(), numbers.tolist())) == want
    tables, fetched = P.cell_table, []
    monkeypatch.setattr(P, "cell_table", lambda c: fetched.append(1) or tables(c))
    few = spark.createDataFrame([("a b c d. " * 9, "en")], "text string, lang string")
    assert [t.count() for t in P.phrase_tables(few, 5, 4)[0]] == [4, 3, 2, 1]
    assert len(fetched) == 2
