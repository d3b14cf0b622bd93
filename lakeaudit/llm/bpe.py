"""Byte-level BPE encoding and decoding by backtracking over an automaton.

A text is split by the pretokenizer's pattern; each piece is encoded on its
own.  The bytes of a piece are read as Latin-1 characters, so one pass of a
multi-pattern automaton finds every vocabulary entry at every position.
Encoding then walks from the front with the longest entry and steps back to
shorter ones: an entry may follow another only if merging their joint bytes
would leave the boundary between them alone.  That test is memoised per pair
of entries.  A sequence in which every neighbouring pair passes is the one
the merges produce, and each prefix has exactly one, so a position that led
nowhere is never tried twice and the walk is linear in the piece.

Finished pieces are memoised too, in dictionaries of bounded bytes.  The
vocabulary is a broadcast of fixed size (the rank file).  Texts are worked
off whole, a batch in runs of about a megabyte and a text in runs of pieces,
and ids are gathered in machine integers, so a task holds little more than
the text at hand however large the batch.

Defined cases: a null or empty text has no tokens (the digests are those of
the empty string); special tokens are ordinary text; other columns are not
read; an empty table gives an empty result; repeated rows repeat.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from lakeaudit.llm.common import documents, text_runs
from lakeaudit.session import ship_package

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
# bytes that each memo of finished pieces may hold, and entries of the one
# of pairs (about 100 bytes each)
PIECE_MEMO = 64 << 20
PAIR_MEMO = 200_000
LONG_TEXT = 1_000_000
RUN_PIECES = 50_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines ``base64 rank`` of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Memo(dict):
    """A dictionary that starts anew when what it holds passes ``PIECE_MEMO``
    bytes, an entry counting as the size of both its parts and 160 more."""

    held = 0

    def keep(self, key, value) -> None:
        size = len(key) + len(value) * getattr(value, "itemsize", 1) + 160
        if size > PIECE_MEMO // 1000:
            return
        if self.held + size > PIECE_MEMO:
            self.clear()
            self.held = 0
        self[key] = value
        self.held += size


class Bpe:
    """Encoder and decoder for one rank table (ids are ranks)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.text_of = {i: str(i) for i in self.bytes_of}
        self.size_of = {i: len(t) for t, i in ranks.items()}
        self.find = regex.compile(pattern)
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                parts = self._merge_below(token, rank)
                if len(parts) != 2:
                    continue  # no merge makes it: only a piece equal to it has this id
                self.halves[rank] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = rank
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # the longest entry that is a proper prefix of an entry
        self.shorter: dict[int, int] = {}
        for token, rank in ranks.items():
            cut = (token[:k] for k in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((ranks[c] for c in cut if len(c) == 1 or ranks.get(c) in self.halves), -1)
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces: Memo = Memo()
        self.named: Memo = Memo()
        self.spelled: Memo = Memo()

    def _merge_below(self, token: bytes, limit: int) -> list[int]:
        """Plain merging of a token's bytes with the ranks below its own."""
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
            if best >= limit:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both entries leaves them as they are.

        Undo merges from the last one on; a merge across the boundary that
        ranks before the merge just undone would have come first."""
        known = self.pairs.get((left, right))
        if known is not None:
            return known
        a, b, limit, ok = left, right, len(self.ranks) + 1, True
        while True:
            across = self.joined.get((a, b))
            if across is not None and across < limit:
                ok = False
                break
            a_rank = a if a in self.halves else -1
            b_rank = b if b in self.halves else -1
            if a_rank < 0 and b_rank < 0:
                break
            if a_rank > b_rank:
                limit, a = a_rank, self.halves[a][1]
            else:  # of equal merges the left one comes first
                limit, b = b_rank + 1, self.halves[b][0]
        if len(self.pairs) >= PAIR_MEMO:
            self.pairs.clear()
        self.pairs[left, right] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        chars = piece.decode("latin-1")
        longest = [found for _, found in self.automaton.iter_long(chars)]
        pairs, compatible = self.pairs, self.compatible
        good = 1
        for pair in zip(longest, longest[1:]):
            ok = pairs.get(pair)
            if not (compatible(*pair) if ok is None else ok):
                return self._backtrack(chars, longest, good)
            good += 1
        return longest

    def _backtrack(self, chars: str, longest: list[int], good: int) -> list[int]:
        """The walk from where the longest entries stop fitting: ``good`` of
        them do, the next one does not."""
        size, shorter, compatible, look = self.size_of, self.shorter, self.compatible, self.automaton.iter_long
        out, starts, pos = [], [], 0
        for token in longest[:good]:
            out.append(token)
            starts.append(pos)
            pos += size[token]
        n, dead, token = len(chars), set(), shorter[longest[good]]
        while pos < n:
            while token >= 0 and (pos + size[token] in dead or out and not compatible(out[-1], token)):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                starts.append(pos)
                pos += size[token]
                if pos < n:
                    token = next(look(chars, pos))[1]
            else:
                dead.add(pos)
                pos = starts.pop()
                token = shorter[out.pop()]
        return out

    def runs(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, in runs of bounded length."""
        if len(text) < LONG_TEXT:
            yield self.find.findall(text)
        else:
            found = (m.group() for m in self.find.finditer(text))
            yield from iter(lambda: list(islice(found, RUN_PIECES)), [])

    def _ids(self, piece: str) -> array:
        ids = array("i", self.encode_piece(piece.encode("utf-8")))
        self.pieces.keep(piece, ids)
        return ids

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def ids(self, text: str) -> array:
        out, get = array("i"), self.pieces.get
        for run in self.runs(text):
            for p in run:
                out += get(p) or self._ids(p)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])

    def _name(self, piece: str) -> str:
        name = ",".join([self.text_of[i] for i in self.encode_piece(piece.encode("utf-8"))])
        self.named.keep(piece, name)
        return name

    def _spell(self, name: str) -> bytes:
        spelled = self.decode(map(int, name.split(",")))
        self.spelled.keep(name, spelled)
        return spelled

    def digests(self, text: str) -> tuple[int, str, str]:
        """Token count, digest of the ids, digest of the decoded bytes.

        Both directions are memoised by piece: a piece's ids as written into
        the digest, and the bytes that such ids decode to."""
        n, ids_sha, bytes_sha = 0, hashlib.sha256(), hashlib.sha256()
        named, spelled = self.named.get, self.spelled.get
        for run in self.runs(text):
            names = [named(p) or self._name(p) for p in run]
            if names:
                ids = ",".join(names)
                ids_sha.update((("," if n else "") + ids).encode())
                bytes_sha.update(b"".join([spelled(x) or self._spell(x) for x in names]))
                n += ids.count(",") + 1
        return n, ids_sha.hexdigest(), bytes_sha.hexdigest()


@lru_cache(maxsize=2)
def _bpe(data: bytes, pattern: str) -> Bpe:
    return Bpe(read_ranks(data), pattern)


def rank_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_frame(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Ids of every text: ``doc_id, token_ids array<int>``.  ``path``: the
    rank file, read by the driver and broadcast."""
    spark = df.sparkSession
    ship_package(spark)
    data = spark.sparkContext.broadcast(rank_bytes(path))

    def encode(batches):
        bpe = _bpe(data.value, pattern)
        for b in (run for whole in batches for run in text_runs(whole)):
            ids, ends = array("i"), [0]
            for t in b.column(1):
                ids += bpe.ids(t.as_py() or "")
                ends.append(len(ids))
            flat = pa.array(np.frombuffer(ids, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "token_ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(encode, f"doc_id {kind}, token_ids array<int>")


def decode_frame(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """The bytes of every id list: ``doc_id, bytes binary``."""
    spark = df.sparkSession
    ship_package(spark)
    data = spark.sparkContext.broadcast(rank_bytes(path))

    def decode(batches):
        bpe = _bpe(data.value, public_tokenizers.PATTERN)
        for b in (whole.slice(k, 256) for whole in batches for k in range(0, whole.num_rows, 256)):
            out = [bpe.decode(ids.values.to_pylist() if ids.is_valid else []) for ids in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(decode, f"doc_id {kind}, bytes binary")


def digest_frame(df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode, decode and digest in one pass, so that neither ids nor decoded
    texts have to be stored."""
    spark = df.sparkSession
    ship_package(spark)
    data = spark.sparkContext.broadcast(rank_bytes(path))

    def work(batches):
        bpe = _bpe(data.value, pattern)
        for b in (run for whole in batches for run in text_runs(whole)):
            rows = [bpe.digests(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "text").mapInArrow(
        work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; token count and digests of both."""
    return digest_frame(documents(spark, sf_dir), public_tokenizers.path(RANK_FILE))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: what stays, as ids to train on
    (``doc_id, token_ids, n_tokens``)."""
    from pyspark.sql import functions as F

    return encode_frame(docs, public_tokenizers.path(RANK_FILE)).withColumn("n_tokens", F.size("token_ids").cast("bigint"))
