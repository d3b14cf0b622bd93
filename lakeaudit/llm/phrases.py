"""Phrase collocations by direct-address tiling.

Words that come often enough are numbered by frequency, over all languages at
once (a number stands for a word of one language).  Texts become sequences of
numbers, in which anything else is a break.  Two neighbours are a cell of the
pair matrix; ranked by frequency, its mass lies in the first rows and columns.
The matrix is cut into tiles of ``TILE`` x ``TILE``: a tile that holds many
pairs of a run is counted densely, by one bincount into its own address space;
what falls into sparse tiles is sorted and counted as coordinates (COO).
Tasks hand on partial counts of cells, Spark adds them up.

Cells that reach the least count are numbered by frequency in turn, and the
sequence of words becomes one of pairs: position i holds the number of the
pair (i, i+1).  Two neighbours there are a phrase of three words, so the same
counting, ranking and renumbering gives three and four words; a phrase is
only counted where both its parts are frequent, which loses nothing.

Every phrase carries the counts of its beginnings and ends along, so its cuts
are scored by joins of the small phrase tables alone.

A table of numbers is broadcast while it is counted within ``WORDS_AT_ONCE``
or ``CELLS_AT_ONCE``; a larger one is joined to the exploded positions
instead, hot keys spread by the counts the table itself holds.

Defined cases: a null or empty text has no words; a null language is
``und``; repeated rows and copies count as often as they come; texts are
counted whole, however long; rows without id count like any other (the id is
not read); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeaudit.llm.common import documents, staged, text_runs
from lakeaudit.operators.joins import is_small, lookup_join, skew_join
from lakeaudit.session import ship_package

LEAST = 30
LONGEST = 4
COVER = (80, 100)  # a longer phrase with this share of the count covers it
SCALE = 2_000_000
TOP = 2000
UND = "und"
TILE = 1024
# a tile with this many pairs of a run is counted densely
DENSE = TILE * TILE // 16
RUN = 1 << 19  # numbers worked off at a time
# different words and cells that a task holds before it hands them on, and
# dense tiles, 8 MB each
WORDS_HELD, HELD, TILES = 1 << 18, 1 << 20, 6
# rows of a table that is broadcast, and bytes of its words
WORDS_AT_ONCE, WORD_BYTES, CELLS_AT_ONCE = 500_000, 16 << 20, 4_000_000

# A-Z lower-cased; what ends a piece is a line end; a tab is a blank
_TABLE = bytes(10 if chr(c) in ".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def plain_bytes(text: str | None) -> bytes:
    """The text with every end of a piece as a line end, in UTF-8."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE)


def _words(data: bytes) -> list[bytes]:
    return data.replace(b"\n", b" ").split(b" ")


def _tokens(data: bytes) -> list[bytes]:
    """Words, and a line end after each piece; empty strings mean nothing."""
    return (data + b"\n").replace(b"\n", b" \n ").split(b" ")


# ---------------------------------------------------------------------- words
def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, a``: occurrences, summed over partial counts of tasks."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out():
            for lang, c in held.items():
                c.pop(b"", None)
                words = pa.array(list(c), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), words, pa.array(list(c.values()), pa.int64())],
                                                 ["lang", "word", "a"])
            held.clear()

        for b in (run for whole in batches for run in text_runs(whole)):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                held[lang].update(_words(plain_bytes(text.as_py())))
            if sum(map(len, held.values())) > WORDS_HELD:
                yield from out()
        yield from out()

    parts = docs.select(_lang(), "text").mapInArrow(work, "lang string, word string, a long")
    return parts.groupBy("lang", "word").agg(F.sum("a").alias("a"))


def _lang() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(UND)).alias("lang")


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with ``id``: 0, 1, ... by falling ``a``, ties by ``keys``.

    Sorted by ranges and written; a row's number is its place in its range
    and the sizes of the ranges before, which are a row per task."""
    rows = df.repartitionByRange(F.desc("a"), *keys).sortWithinPartitions(F.desc("a"), *keys)
    rows = staged(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() % (1 << 33)), "ranked")
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
    starts, at = [], 0
    for r in sizes:
        starts.append((r["_part"], at))
        at += r.n
    starts = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    return rows.join(F.broadcast(starts), "_part").withColumn("id", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


class WordTable:
    """Numbers of words by language.  It is sent as columns: only the workers
    hold a Python object for each word."""

    def __init__(self, rows: pa.Table):
        self.rows = rows

    @cached_property
    def numbers(self) -> dict[str, dict[bytes, int]]:
        out: dict[str, dict[bytes, int]] = defaultdict(dict)
        for b in self.rows.to_batches():
            for lang, word, i in zip(*(c.to_pylist() for c in (b.column(0), b.column(1).cast(pa.binary()), b.column(2)))):
                out[lang][word] = i
        return dict(out)


def sequences(docs: DataFrame, words: DataFrame) -> DataFrame:
    """``key, ids``: each text as numbers of its words, -1 for breaks, the
    last one a break.  ``words``: ``lang, word, a, id``."""
    spark = docs.sparkSession
    rows = docs.select(_lang(), "text")
    if not _fits(words):
        return _sequences_joined(rows, words)
    shared = spark.sparkContext.broadcast(WordTable(words.select("lang", "word", "id").toArrow()))  # counted above

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key = shared.value.numbers, TaskContext.get().partitionId() << 33
        for b in (run for whole in batches for run in text_runs(whole)):
            flat, ends = [], [0]
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                get = table.get(lang, {}).get
                flat.append(np.array([get(t, -1) for t in _tokens(plain_bytes(text.as_py())) if t], np.int32))
                ends.append(ends[-1] + len(flat[-1]))
            yield _rows(key, flat, ends)
            key += b.num_rows

    return staged(rows.mapInArrow(work, "key long, ids array<int>"), "phrase-words")


def _rows(key: int, flat: list[np.ndarray], ends: list[int]) -> pa.RecordBatch:
    ids = pa.array(np.concatenate(flat))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + len(flat))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)],
                                      ["key", "ids"])


def _fits(words: DataFrame) -> bool:
    n, size = words.agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).first()
    return n <= WORDS_AT_ONCE and (size or 0) <= WORD_BYTES


def _sequences_joined(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``sequences`` by a join: any number of words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for b in (run for whole in batches for run in text_runs(whole)):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                tokens = [t for t in _tokens(plain_bytes(text.as_py())) if t]
                n = len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, key)), pa.array(np.arange(n, dtype=np.int32)), pa.array([lang] * n, pa.string()),
                     pa.array(tokens, pa.binary()).cast(pa.string())], ["key", "pos", "lang", "word"])
                key += 1

    at = staged(rows.mapInArrow(work, "key long, pos int, lang string, word string"), "phrase-tokens")
    found = skew_join(at, words.select("lang", "word", "id", "a"), ["lang", "word"], "a", "left", spread_by=F.struct("key", "pos"))
    return _gathered(found.select("key", "pos", F.coalesce("id", F.lit(-1)).cast("int").alias("id")))


def _gathered(found: DataFrame) -> DataFrame:
    """Positions of a text back in a row: ``key, ids``, missing ones -1."""
    lists = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("p"))
    return staged(lists.select("key", F.col("p.id").alias("ids")), "phrase-words")


# ---------------------------------------------------------------------- cells
class Cells:
    """Counts of cells (left, right), some tiles dense, the rest sorted."""

    def __init__(self, tile: int = TILE, dense: int = DENSE, held: int = HELD):
        self.tile, self.dense, self.held = tile, dense, held
        self.tiles: dict[tuple[int, int], np.ndarray] = {}
        self.sparse: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def _dense(self, row: int, col: int, left: np.ndarray, right: np.ndarray) -> None:
        t = self.tile
        counts = np.bincount((left - row * t) * t + (right - col * t), minlength=t * t)
        if (row, col) in self.tiles:
            self.tiles[row, col] += counts
        else:
            self.tiles[row, col] = counts

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        t = self.tile
        first = (left < t) & (right < t)  # most of the mass, not worth a sort
        if (0, 0) in self.tiles or np.count_nonzero(first) >= self.dense:
            self._dense(0, 0, left[first], right[first])
            left, right = left[~first], right[~first]
        if not len(left):
            return
        across = int(right.max()) // t + 1
        place = (left // t) * across + right // t
        order = np.argsort(place, kind="stable")
        left, right, place = left[order], right[order], place[order]
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sizes = np.diff(np.r_[starts, len(place)])
        rest = np.ones(len(place), bool)
        for s, n in zip(starts.tolist(), sizes.tolist()):
            row, col = divmod(int(place[s]), across)
            # an address space that is in use takes what comes
            if n >= self.dense or (row, col) in self.tiles:
                self._dense(row, col, left[s:s + n], right[s:s + n])
                rest[s:s + n] = False
        if rest.any():
            codes, counts = np.unique((left[rest] << 32) | right[rest], return_counts=True)
            self.sparse.append((codes, counts))
            self.size += len(codes)

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        codes, inverse = np.unique(np.concatenate([c for c, _ in self.sparse]), return_inverse=True)
        return codes, np.bincount(inverse, np.concatenate([n for _, n in self.sparse])).astype(np.int64)

    def full(self) -> bool:
        """Whether it is time to hand on what is held: cells that come often
        enough to be worth holding shrink when they are added up."""
        if self.size > self.held:
            codes, counts = self._merged()
            self.sparse, self.size = [(codes, counts)], len(codes)
            if self.size > self.held // 2:
                return True
        return len(self.tiles) > TILES

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All cells, as codes and counts."""
        for (row, col), counts in self.tiles.items():
            at = np.flatnonzero(counts)
            yield ((at // self.tile + row * self.tile) << 32) | (at % self.tile + col * self.tile), counts[at]
        if self.sparse:
            yield self._merged()
        self.tiles, self.sparse, self.size = {}, [], 0


def renumbered(ids: np.ndarray, codes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Per position the number of the cell (i, i+1), -1 where it has none;
    one shorter.  ``codes`` ascend."""
    out = np.full(max(0, len(ids) - 1), -1, np.int64)
    both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    if len(both) and len(codes):
        mine = (ids[both] << 32) | ids[both + 1]
        at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
        hit = codes[at] == mine
        out[both[hit]] = numbers[at[hit]]
    return out


def cell_table(cells: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes, ascending, and numbers of cells that were counted to fit: two
    columns of 12 bytes a cell, sorted and packed by the tasks."""
    code = F.shiftleft(F.col("l"), 32).bitwiseOR(F.col("r")).alias("c")
    part = cells.select(code, F.col("id").cast("int").alias("id")).orderBy("c").toArrow()
    return part["c"].to_numpy(), part["id"].to_numpy()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The sequences of many rows as one, in runs; each ends with a break."""
    for b in batches:
        lists = b.column(0)
        ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy()
        at = 0
        while at < len(lists):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + RUN, "right")) - 1)
            yield flat[ends[at]:ends[to]].astype(np.int64)
            at = to


def cell_counts(seqs: DataFrame, tables: list, least: int, tile: int = TILE, dense: int = DENSE) -> DataFrame:
    """``l, r, a``: cells of two neighbouring numbers that come ``least``
    times, after renumbering the sequences by each of the broadcast
    ``tables`` (codes, numbers) in turn."""
    ship_package(seqs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(tile, dense)

        def out():
            for codes, counts in cells.drain():
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(counts.astype(np.int64))], ["c", "a"])

        for ids in _runs(batches):
            for t in tables:
                ids = renumbered(ids, *t.value)
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0)) if len(ids) > 1 else np.zeros(0, np.int64)
            if len(both):
                cells.add(ids[both], ids[both + 1])
            if cells.full():
                yield from out()
        yield from out()

    parts = seqs.select("ids").mapInArrow(work, "c long, a long")
    sums = parts.groupBy("c").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return sums.select(F.shiftrightunsigned("c", 32).alias("l"), F.col("c").bitwiseAND(F.lit(0xFFFFFFFF)).alias("r"), "a")


def _renumbered_joined(seqs: DataFrame, cells: DataFrame) -> DataFrame:
    """Sequences of the next level by a join: any number of cells."""
    at = seqs.select("key", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("ids") - 1, F.lit(1))),
        lambda i: F.struct(F.get("ids", i - 1).alias("l"), F.coalesce(F.get("ids", i), F.lit(-1)).alias("r")))).alias("pos", "x"))
    at = staged(at.select("key", "pos", F.col("x.l").cast("long").alias("l"), F.col("x.r").cast("long").alias("r")), "phrase-cells")
    found = skew_join(at, cells.select("l", "r", "id", "a"), ["l", "r"], "a", "left", spread_by=F.struct("key", "pos"))
    return _gathered(found.select("key", "pos", F.coalesce("id", F.lit(-1)).cast("int").alias("id")))


# -------------------------------------------------------------------- phrases
def phrase_tables(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[list[DataFrame], DataFrame]:
    """Per length from 1 a table of the phrases that come ``least`` times --
    ``id, l, r`` (numbers of its two parts one word shorter), ``lang, words, a,
    heads, tails`` (counts of its beginnings and ends, by length) -- and
    ``lang, n``."""
    spark = docs.sparkSession
    ship_package(spark)
    counts = staged(word_counts(docs), "phrase-counts")
    totals = staged(counts.groupBy("lang").agg(F.sum("a").alias("n")), "phrase-totals")
    words = staged(ranked(counts.where(F.col("a") >= least), "lang", "word"), "phrase-vocabulary")
    none = F.array().cast("array<bigint>")
    tables = [words.select("id", F.lit(None).cast("long").alias("l"), F.lit(None).cast("long").alias("r"), "lang",
                           F.array("word").alias("words"), "a", none.alias("heads"), none.alias("tails"))]
    seqs, held = sequences(docs, words), []
    for k in range(2, longest + 1):
        cells = staged(ranked(staged(cell_counts(seqs, held, least), "phrase-cells"), "l", "r"), "phrase-cells")
        below = tables[-1]
        left = below.select(F.col("id").alias("l"), "lang", "words", F.concat("heads", F.array("a")).alias("heads"))
        right = below.select(F.col("id").alias("r"), F.element_at("words", -1).alias("last"), F.concat("tails", F.array("a")).alias("tails"))
        joined = lookup_join(lookup_join(cells, left, ["l"], spread_by="id"), right, ["r"], spread_by="id")
        tables.append(staged(joined.select("id", "l", "r", "lang", F.concat("words", F.array("last")).alias("words"), "a", "heads", "tails"), "phrases"))
        if k == longest:  # nothing is counted beyond
            break
        if is_small(cells.select("id"), CELLS_AT_ONCE):
            held.append(spark.sparkContext.broadcast(cell_table(cells)))
        else:
            for t in held:  # the levels below, by their broadcast tables
                seqs = _stepped(seqs, t)
            seqs, held = _renumbered_joined(seqs, cells), []
    return tables, totals


def _stepped(seqs: DataFrame, table) -> DataFrame:
    """Sequences of the next level by a broadcast table, written."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, 64) for whole in batches for k in range(0, whole.num_rows, 64)):
            flat = [renumbered(row.values.to_numpy().astype(np.int64), *table.value).astype(np.int32) for row in b.column(1)]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in flat])]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(flat)))], ["key", "ids"])

    return staged(seqs.select("key", "ids").mapInArrow(work, "key long, ids array<int>"), "phrase-words")


def scored(table: DataFrame) -> DataFrame:
    """Phrases of one length with ``cl, cr, score`` of their worst cut.
    Products are decimals: they may pass 64 bits."""
    k = F.size("words")
    cuts = F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.struct(
        i.alias("k"), F.get("heads", i - 1).alias("l"), F.get("tails", k - i - 1).alias("r")))
    rows = table.withColumn("_c", F.explode(cuts)).select("id", "l", "r", "lang", "words", "a", "_c.k", F.col("_c.l").alias("cl"), F.col("_c.r").alias("cr"))
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0)) div (CAST(cl AS DECIMAL(19,0)) + CAST(cr AS DECIMAL(19,0)))")
    rows = rows.withColumn("score", score)
    worst = F.min_by(F.struct("cl", "cr", "score"), F.struct("score", "k")).alias("_w")
    return rows.groupBy("id", "l", "r", "lang", "words", "a").agg(worst).select("id", "l", "r", "lang", "words", "a", "_w.*")


def covered(table: DataFrame, longer: DataFrame) -> DataFrame:
    """Numbers of phrases that a phrase one word longer covers.  A phrase of
    still more words holds one of those and comes no more often."""
    share, of = COVER
    parts = longer.select(F.col("l").alias("id"), F.col("a").alias("m")).unionByName(longer.select(F.col("r").alias("id"), F.col("a").alias("m")))
    most = parts.groupBy("id").agg(F.max("m").alias("m"))
    big = lambda c, n: F.col(c).cast("decimal(19,0)") * F.lit(n).cast("decimal(4,0)")
    return table.select("id", "a").join(most, "id").where(big("m", of) >= big("a", share)).select("id")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``."""
    tables, totals = phrase_tables(docs, least, longest)
    out = None
    for k in range(1, longest):
        rows = scored(tables[k])
        if k + 1 < longest:
            rows = rows.join(covered(tables[k], tables[k + 1]), "id", "left_anti")
        rows = rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", F.col("cl").alias("l"), F.col("cr").alias("r"), "score")
        out = rows if out is None else out.unionByName(rows)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = out.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of every language."""
    return collocations(documents(spark, sf_dir))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS t, coalesce(lang, '{UND}') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
  FROM documents),
p AS (SELECT t, lang, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pn FROM d),
q AS (SELECT t, pn, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
w AS (SELECT t, pn, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM q),
g AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY t, pn ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {LEAST}),
f2 AS (SELECT lang, w1, w2, count(*) AS a FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS a FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f4 AS (SELECT lang, w1, w2, w3, w4, count(*) AS a FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.a, 1 AS k, x.a AS l, y.a AS r FROM f2 c
    JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), c.a, 1, x.a, y.a FROM f3 c
    JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), c.a, 2, x.a, y.a FROM f3 c
    JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3, c.w4), c.a, 1, x.a, y.a FROM f4 c
    JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f3 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3 AND y.w3 = c.w4
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3, c.w4), c.a, 2, x.a, y.a FROM f4 c
    JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w3 AND y.w2 = c.w4
  UNION ALL
  SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3, c.w4), c.a, 3, x.a, y.a FROM f4 c
    JOIN f3 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 AND x.w3 = c.w3 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w4),
worst AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS j FROM (
    SELECT *, ({SCALE}::HUGEINT * a) // (l + r) AS score FROM cuts)),
longer AS (
  SELECT lang, concat_ws(' ', w1, w2) AS phrase, a FROM f3 UNION ALL SELECT lang, concat_ws(' ', w2, w3), a FROM f3
  UNION ALL SELECT lang, concat_ws(' ', w1, w2), a FROM f4 UNION ALL SELECT lang, concat_ws(' ', w2, w3), a FROM f4
  UNION ALL SELECT lang, concat_ws(' ', w3, w4), a FROM f4
  UNION ALL SELECT lang, concat_ws(' ', w1, w2, w3), a FROM f4 UNION ALL SELECT lang, concat_ws(' ', w2, w3, w4), a FROM f4),
most AS (SELECT lang, phrase, max(a) AS m FROM longer GROUP BY ALL),
kept AS (
  SELECT c.lang, c.phrase, c.a, c.l, c.r, c.score FROM worst c LEFT JOIN most USING (lang, phrase)
  WHERE j = 1 AND NOT coalesce({COVER[1]}::HUGEINT * m >= {COVER[0]}::HUGEINT * c.a, false)),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM top JOIN n USING (lang) WHERE rank <= {TOP}"""
