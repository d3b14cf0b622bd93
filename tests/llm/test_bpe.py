"""BPE against the public tokenizer library, and round trips."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from lakeaudit.llm import bpe as B

from .conftest import EDGE, SF001


@pytest.fixture(scope="module")
def ours():
    return B._bpe(B.rank_bytes(P.path(B.RANK_FILE)), P.PATTERN)


@pytest.fixture(scope="module")
def theirs(ours):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ours.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(max_size=200), st.text("abcdethinors  \n'", max_size=200)))
def test_same_ids_as_the_library(ours, theirs, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    ids = theirs.encode_ordinary(text)
    assert ours.encode(text) == ids
    assert ours.decode(ids) == text.encode()
    n, a, b = ours.digests(text)
    assert n == len(ids)
    assert a == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert b == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("text", ["a" * 3000, " " * 2500, "ab" * 2000, "the" * 1500, "é" * 900, "\n \n" * 700,
                                  "<|endoftext|> x", "\x1c\x85 　a", "don't 've 'LL 12345678901234567890"])
def test_runs_and_odd_texts(ours, theirs, text):
    assert ours.encode(text) == theirs.encode_ordinary(text)


def test_every_entry_is_its_own_encoding(ours, theirs):
    for token, rank in list(ours.ranks.items())[::7]:
        assert ours.encode_piece(token) == [rank]
        assert ours.encode_piece(token + token) == theirs._encode_single_piece(token + token)


def test_a_text_in_runs(ours, theirs, monkeypatch):
    text = "one two\n\n three 'll été " * 400
    monkeypatch.setattr(B, "LONG_TEXT", 50)
    monkeypatch.setattr(B, "RUN_PIECES", 7)
    ids = theirs.encode_ordinary(text)
    assert ours.encode(text) == ids
    assert ours.digests(text)[0] == len(ids)


def test_memos_are_bounded(ours, theirs, monkeypatch):
    for name in ("PIECE_MEMO", "PAIR_MEMO"):
        monkeypatch.setattr(B, name, 5)
    text = "some words that differ one from another, again and again"
    assert ours.encode(text) == theirs.encode_ordinary(text)
    ours.digests(text)
    assert len(ours.named) <= 6 or len(ours.named) > 100  # filled before this test, or kept small


def test_frames(spark, edge_docs, no_docs, ours, theirs):
    path = P.path(B.RANK_FILE)
    got = B.encode_frame(edge_docs, path)
    rows = sorted((r.doc_id, list(r.token_ids)) for r in got.collect())
    assert rows == sorted((i, theirs.encode_ordinary(t or "")) for i, t, _ in EDGE)
    back = sorted((r.doc_id, bytes(r["bytes"])) for r in B.decode_frame(got, path).collect())
    assert back == sorted((i, (t or "").encode()) for i, t, _ in EDGE)
    dig = sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in B.digest_frame(edge_docs, path).collect())
    assert dig == sorted((i, len(theirs.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in EDGE)
    assert B.digest_frame(no_docs, path).count() == 0 and B.encode_frame(no_docs, path).count() == 0


def test_whole_table(spark, theirs):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    got = sorted(tuple(r) for r in B.op7_byte_bpe(spark, SF001).collect())
    want = []
    for r in docs:
        ids = theirs.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want)


def test_a_batch_in_small_runs(spark, theirs, monkeypatch):
    """Long, empty and null texts over several runs of one batch."""
    import pyarrow as pa
    from lakeaudit.llm.common import text_runs

    texts = ["x " * 700, None, "", "y" * 3000, "z", None, "w " * 900]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    runs = list(text_runs(batch, rows=3, size=1500))
    assert [t for r in runs for t in r.column(1).to_pylist()] == texts
    assert max(r.num_rows for r in runs) <= 3 and len(runs) > 3
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 300)], "doc_id long, text string").coalesce(1)
    got = [list(r.token_ids) for r in B.encode_frame(df, P.path(B.RANK_FILE)).orderBy("doc_id").collect()]
    assert got == [theirs.encode_ordinary(t or "") for t in texts] * 300


def test_memo_holds_the_pieces_of_a_large_table():
    """150,000 short pieces stay, so that a second text finds those of the first."""
    memo = B.Memo()
    for i in range(150_000):
        memo.keep(f" w{i}", "17,4")
    assert len(memo) == 150_000
