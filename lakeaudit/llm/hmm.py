"""Hidden Markov language model: Baum-Welch over partitions, exact scoring.

Tokens are the words of the lower-cased text and one end.  A latent state
moves along the text; each state emits word classes, and a class emits its
words.  The ``OWN_CLASSES`` most frequent tokens are classes of one; the rest
of the vocabulary, however large, is hashed into ``SHARED_CLASSES`` classes
that emit their members by add-one counts.  So the trained model has a fixed
size (states x classes), yet every token of every text has its probability,
and the probability of a text is that of an ordinary HMM over words.

Training: token counts over all training texts (a shuffle that grows with the
corpus); texts encoded once as class numbers and written to the shared
folder; then rounds of Baum-Welch in which every task adds up the expected
counts of its texts and one aggregation sums them.  Only model-sized tables
reach the driver.  All training texts take part in every round.

Scoring: the scaled forward recursion gives the exact likelihood.  Texts are
worked off side by side, one position at a time.  A long text is cut into
pieces; the product of its step matrices tells each piece how the text before
it ends, which is exact, so its pieces run side by side as well and its
length does not serialise a task.

Counts of rare tokens are looked up by a join on the token (they are too many
to broadcast); those of the ``FREQUENT`` most frequent ones are a broadcast
of bounded size, so hot words never enter a shuffle.

Defined cases: a null, empty or blank text is the end token alone; a null id
counts as empty text for the split; rows sharing id and text score alike;
without training texts every token has base probability 1 and the model is
uniform; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import documents, staged
from lakeaudit.session import ship_package

STATES = 6
ROUNDS = 5
OWN_CLASSES = 8192
SHARED_CLASSES = 1024
FREQUENT = 200_000
# steps of the histogram of counts per doubling
COUNT_LEVELS = 32
PIECE = 1024
# tokens worked off together in a task
TOKENS_AT_ONCE = 500_000
DISTINCT_AT_ONCE = 400_000
HELD_OUT_MOD, HELD_OUT_IS = 7, 2
STAY = 0.9
EMISSION_PRIOR = 10.0
TRANSITION_PRIOR = 0.1
# no word is empty, so the empty string names the end token
END = b""

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def shared_class(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 7) % SHARED_CLASSES


# ------------------------------------------------------------ recursions
class Model:
    """Start, transition and emission probabilities, as arrays."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # (K), (K, K), (classes, K)

    def single(self) -> "Model":
        return Model(*(x.astype(np.float32) for x in (self.start, self.move, self.emit)))


def first_model(class_counts: np.ndarray, states: int = STATES, seed: int = 1) -> Model:
    """States that stay, and emissions around the class frequencies."""
    rng = np.random.default_rng(seed)
    share = (class_counts + 0.5) / (class_counts.sum() + 0.5 * len(class_counts))
    emit = share[:, None] * np.exp(rng.normal(0.0, 1.0, (len(share), states)))
    move = np.full((states, states), (1 - STAY) / max(1, states - 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def next_model(start: np.ndarray, move: np.ndarray, emit: np.ndarray, class_counts: np.ndarray) -> Model:
    """Re-estimation from expected counts, smoothed towards the class
    frequencies so that no class becomes impossible."""
    share = (class_counts + 0.5) / (class_counts.sum() + 0.5 * len(class_counts))
    start, move = start + TRANSITION_PRIOR, move + TRANSITION_PRIOR
    emit = emit + EMISSION_PRIOR * share[:, None]
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Pieces:
    """Some texts as pieces of at most ``piece`` tokens, laid out position by
    position: first the first token of every piece, then the second ones, and
    so on, longer pieces first, so that each position is one slice."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, piece: int = PIECE):
        n_pieces = -(-sizes // piece)
        self.text = np.repeat(np.arange(len(sizes)), n_pieces)
        first = np.cumsum(n_pieces) - n_pieces
        self.rank = np.arange(len(self.text)) - first[self.text]
        length = np.minimum(sizes[self.text] - self.rank * piece, piece)
        begin = (np.cumsum(sizes) - sizes)[self.text] + self.rank * piece
        order = np.argsort(-length, kind="stable")
        self.place = np.empty(len(order), np.int64)  # piece -> row
        self.place[order] = np.arange(len(order))
        self.length, self.begin = length[order], begin[order]
        longest = int(self.length[0]) if len(order) else 0
        # how many pieces have a token at each position, and where it starts
        self.active = np.searchsorted(-self.length, -np.arange(longest), side="left")
        self.offset = np.concatenate([[0], np.cumsum(self.active)]).astype(np.int64)
        row = np.concatenate([np.arange(a) for a in self.active]) if longest else np.zeros(0, np.int64)
        self.at = self.begin[row] + np.repeat(np.arange(longest), self.active)
        self.x = tokens[self.at]
        self.n_pieces, self.first = n_pieces, first
        # rows of the pieces of texts that have several
        self.long = self.place[np.flatnonzero(n_pieces[self.text] > 1)]

    def last(self, rows: np.ndarray) -> np.ndarray:
        """Where the last token of each row is in the layout."""
        return self.offset[self.length[rows] - 1] + rows


def _products(p: Pieces, model: Model, emitted: np.ndarray) -> dict[int, np.ndarray]:
    """Per piece of a long text: the matrix that takes the state weights
    before its first token to those after its last one, up to scale."""
    rows = np.sort(p.long)
    if not len(rows):
        return {}
    k = len(model.start)
    out = np.zeros((len(rows), k, k), emitted.dtype)
    out[:, range(k), range(k)] = emitted[rows]
    for t in range(1, int(p.length[rows].max())):
        n = int(np.searchsorted(rows, p.active[t]))
        part = (out[:n].reshape(-1, k) @ model.move).reshape(n, k, k)
        part *= emitted[p.offset[t] + rows[:n]][:, None, :]
        part /= part.sum(axis=(1, 2), keepdims=True)
        out[:n] = part
    return {int(r): out[i] for i, r in enumerate(rows)}


def _long_texts(p: Pieces) -> Iterator[np.ndarray]:
    """Rows of each text of several pieces, in order."""
    for text in np.flatnonzero(p.n_pieces > 1):
        yield p.place[p.first[text]:p.first[text] + p.n_pieces[text]]


def _forward(p: Pieces, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict]:
    """Scaled forward weights and scales of every token."""
    emitted = model.emit[p.x]
    prior = np.tile(model.start, (len(p.length), 1))
    products = _products(p, model, emitted)
    for rows in _long_texts(p):
        for a, b in zip(rows[:-1], rows[1:]):
            after = prior[a] @ products[int(a)]
            prior[b] = after / after.sum() @ model.move
    weight, scale = np.empty_like(emitted), np.empty(len(p.x), emitted.dtype)
    before = prior
    for t, n in enumerate(p.active):
        s = slice(p.offset[t], p.offset[t + 1])
        now = (before[:n] if t == 0 else before[:n] @ model.move) * emitted[s]
        total = now.sum(axis=1)
        now /= total[:, None]
        weight[s], scale[s], before = now, total, now
    return emitted, prior, weight, scale, products


def log10_likelihood(tokens: np.ndarray, sizes: np.ndarray, model: Model, piece: int = PIECE) -> np.ndarray:
    """Exact log10 probability of each class sequence."""
    p = Pieces(tokens, sizes, piece)
    if not len(p.x):
        return np.zeros(len(sizes))
    scale = _forward(p, model)[3]
    logs = np.empty(len(scale))
    logs[p.at] = np.log10(scale)
    return np.add.reduceat(logs, np.cumsum(sizes) - sizes)


def expected_counts(tokens: np.ndarray, sizes: np.ndarray, model: Model, piece: int = PIECE):
    """Baum-Welch counts of the sequences: start (K), move (K, K), emit
    (classes, K)."""
    k = len(model.start)
    start, move, emit = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    p = Pieces(tokens, sizes, piece)
    if not len(p.x):
        return start, move, emit
    emitted, prior, weight, scale, products = _forward(p, model)
    # what follows a piece: one for a text's last, else through the pieces after it
    beyond = np.ones((len(p.length), k), emitted.dtype)
    before = {}
    for rows in _long_texts(p):
        ends = weight[p.last(rows)]
        for i in range(len(rows) - 2, -1, -1):
            v = model.move @ (products[int(rows[i + 1])] @ beyond[rows[i + 1]])
            beyond[rows[i]] = v / (ends[i] @ v)
            before[int(rows[i + 1])] = ends[i]
    back = None
    for t in range(len(p.active) - 1, -1, -1):
        n, s = p.active[t], slice(p.offset[t], p.offset[t + 1])
        now = beyond[:n].copy()
        if back is not None:
            now[:len(back)] = back @ model.move.T
            move += weight[s][:len(back)].T @ back
        back = emitted[s] * now / scale[s][:, None]
        weight_now = weight[s] * now
        emitted[s] = weight_now  # from here on: the state posteriors
    move *= model.move
    if before:
        rows = np.array(list(before))
        move += (np.array(list(before.values())).T @ back[rows]) * model.move
    heads = p.place[p.first]
    start += emitted[heads].sum(axis=0)
    for j in range(k):
        emit[:, j] = np.bincount(p.x, weights=emitted[:, j], minlength=len(emit))
    return start, move, emit


# ------------------------------------------------------------ counting
def token_counts(docs: DataFrame) -> DataFrame:
    """``token binary, n`` over the texts; the end token is empty."""
    ship_package(docs.sparkSession)

    def work(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                              ["token", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                counts.update(words(text))
                counts[END] += 1
                if len(counts) > DISTINCT_AT_ONCE:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return docs.select("text").mapInArrow(work, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The bounded part of the vocabulary: the most frequent tokens with
    their counts, and the classes."""

    def __init__(self, frequent: list[tuple[bytes, int]], class_tokens: np.ndarray, class_types: np.ndarray,
                 train_tokens: int, types: int, own: int = OWN_CLASSES):
        self.train_tokens, self.types = train_tokens, types
        self.count = dict(frequent)
        self.own = {t: i for i, (t, _) in enumerate(frequent[:own])}
        self.n_own = own
        # tokens and distinct ones of each shared class, in training
        self.class_tokens, self.class_types = class_tokens, class_types

    def class_counts(self) -> np.ndarray:
        own = np.zeros(self.n_own)
        own[:len(self.own)] = [self.count[t] for t in self.own]
        return np.concatenate([own, self.class_tokens])


def vocabulary(counts: DataFrame, frequent: int = FREQUENT, own: int = OWN_CLASSES) -> Vocabulary:
    """From the staged count table; what is collected has a fixed size.

    The frequent tokens are those above a count that a coarse histogram of
    the counts gives, so that ``frequent`` of them at most are collected and
    no task has to send its own candidates."""
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    level = F.floor(F.log2("n") * COUNT_LEVELS).cast("int")
    wanted, least = 0, None
    for row in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True):
        wanted += row.k
        if wanted > frequent:
            break
        least = row.level
    top: list[tuple[bytes, int]] = []
    if least is not None:
        found = counts.where(level >= least).select("token", "n").toArrow()
        top = sorted(zip(found.column("token").to_pylist(), found.column("n").to_pylist()), key=lambda x: (-x[1], x[0]))
    names = counts.sparkSession.sparkContext.broadcast(frozenset(t for t, _ in top[:own]))

    def classes(batches):
        for b in batches:
            tokens, n = b.column(0).to_pylist(), b.column(1).to_numpy()
            rare = np.array([t not in names.value for t in tokens], bool)
            cls = np.array([shared_class(t) for t in tokens], np.int64)[rare]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(SHARED_CLASSES)), pa.array(np.bincount(cls, n[rare], SHARED_CLASSES).astype(np.int64)),
                 pa.array(np.bincount(cls, minlength=SHARED_CLASSES))], ["c", "n", "v"])

    rows = (counts.select("token", "n").mapInArrow(classes, "c long, n long, v long")
            .groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect())
    tokens, types = np.zeros(SHARED_CLASSES), np.zeros(SHARED_CLASSES)
    for r in rows:
        tokens[r.c], types[r.c] = r.n, r.v
    return Vocabulary(top, tokens, types, total.n or 0, total.v, own)


# ------------------------------------------------------------ encoding
ENCODED = ("doc_id long, text_crc long, held_out boolean, n_tokens long, n_known long, log_counts double, "
           "log_classes double, classes array<int>, rare array<binary>, rare_n array<int>")


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Every text as class numbers, its sums over frequent tokens, and its
    rare tokens (all of them, with their number)."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int32()),
             pa.list_(pa.binary()), pa.list_(pa.int32())]
    names = [f.split()[0] for f in ENCODED.split(", ")]

    def work(batches):
        v = shared.value
        # -log10 of what the members of a shared class divide by
        share = -np.log10(v.class_tokens + v.class_types + 1)
        # a frequent token is a number; per number its class and its logs
        number = {t: i for i, t in enumerate(v.count)}
        class_of = np.array([v.own.get(t, -1) for t in v.count], np.int64)
        logs_of = np.log10(np.fromiter(v.count.values(), np.float64, len(number)) + 1)
        in_class = np.zeros(len(number))
        for i, t in enumerate(v.count):
            if class_of[i] < 0:
                c = shared_class(t)
                class_of[i], in_class[i] = v.n_own + c, share[c] + logs_of[i]
        get = number.get

        def row(doc_id, text):
            tokens = words(text)
            tokens.append(END)
            at = np.array([get(t, -1) for t in tokens], np.int64)
            if len(number):
                classes, logs, within = class_of[at], logs_of[at], in_class[at]
            else:
                classes, logs, within = at.copy(), np.zeros(len(at)), np.zeros(len(at))
            out = np.flatnonzero(at < 0).tolist()
            rare = [tokens[i] for i in out]
            if out:
                c = np.array([shared_class(t) for t in rare])
                classes[out], logs[out], within[out] = v.n_own + c, 0.0, share[c]
            tally = Counter(rare)
            name = "" if doc_id is None else str(doc_id)
            return (classes, len(tokens) - len(out), float(logs.sum()), float(within.sum()), list(tally), list(tally.values()),
                    zlib.crc32((text or "").encode("utf-8", "replace")), zlib.crc32(name.encode()) % HELD_OUT_MOD == HELD_OUT_IS)

        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                rows = [row(*x) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                classes, known, logs, within, rare, rare_n, crc, held = zip(*rows)
                sizes = np.array([len(c) for c in classes])
                flat = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), np.concatenate(classes).astype(np.int32))
                columns = [part.column(0), crc, held, sizes, known, logs, within, flat, rare, rare_n]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, ENCODED)


def _sequences(batches, column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Whole batches, gathered up to about TOKENS_AT_ONCE tokens, with the
    flat class numbers and the size of each text."""
    for b in batches:
        at = 0
        sizes = np.diff(b.column(column).offsets.to_numpy())
        while at < len(sizes):  # at least one text, then as many as fit
            to = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), TOKENS_AT_ONCE, side="right")))
            part = b.slice(at, to - at)
            yield part, part.column(column).flatten().to_numpy(), sizes[at:to]
            at = to


def train(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over all training texts."""
    spark = encoded.sparkSession
    class_counts = vocab.class_counts()
    model = first_model(class_counts, states)
    rows = encoded.where(~F.col("held_out")).select("classes")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def work(batches):
            # single precision is enough for expected counts (not for scores)
            m, total = shared.value.single(), None
            for _, tokens, sizes in _sequences(batches, 0):
                part = np.concatenate([x.ravel() for x in expected_counts(tokens, sizes, m)])
                total = part if total is None else total + part
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["i", "x"])

        sums = rows.mapInArrow(work, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        flat = np.zeros(states + states * states + len(class_counts) * states)
        flat[sums["i"].to_numpy(np.int64)] = sums["x"].to_numpy()
        start, move, emit = np.split(flat, [states, states + states * states])
        model = next_model(start, move.reshape(states, states), emit.reshape(-1, states), class_counts)
        shared.unpersist()
    return model


def likelihoods(encoded: DataFrame, model: Model) -> DataFrame:
    """The encoded rows' sums, with ``log_model``: the log10 probability of
    the class sequence."""
    shared = encoded.sparkSession.sparkContext.broadcast(model)
    keep = ["doc_id", "text_crc", "held_out", "n_tokens", "n_known", "log_counts", "log_classes"]

    def work(batches):
        for part, tokens, sizes in _sequences(batches, len(keep)):
            logs = log10_likelihood(tokens, sizes, shared.value)
            yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(logs)], [*keep, "log_model"])

    schema = ", ".join(ENCODED.split(", ")[:len(keep)]) + ", log_model double"
    return encoded.select(*keep, "classes").mapInArrow(work, schema)


def rare_sums(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """Per text: sums over its rare tokens, through a join on the token."""
    one = (encoded.select("doc_id", "text_crc", F.explode(F.arrays_zip("rare", "rare_n")).alias("r"))
           .select("doc_id", "text_crc", F.col("r.rare").alias("token"), F.col("r.rare_n").alias("k")))
    found = one.join(counts, "token")
    return found.groupBy("doc_id", "text_crc").agg(
        F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("rare_logs"), F.sum("k").alias("rare_known"))


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT, own: int = OWN_CLASSES) -> DataFrame:
    """Train on the training texts and score all: ``doc_id, held_out,
    n_tokens, n_known, train_tokens, base_score, score``."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    training = docs.where(F.crc32(F.encode(name, "UTF-8")) % HELD_OUT_MOD != HELD_OUT_IS)
    counts = staged(token_counts(training), "token-counts")
    vocab = vocabulary(counts, frequent, own)
    encoded = staged(encode(docs, vocab), "encoded")
    model = train(encoded, vocab, states, rounds)
    # a text that occurs several times under one id met the join as often
    times = encoded.groupBy("doc_id", "text_crc").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1")
    rare = rare_sums(encoded, counts)
    on = ["doc_id", "text_crc"]
    out = likelihoods(encoded, model)
    for side in (rare, times):
        side = side.withColumnsRenamed({c: f"_{c}" for c in on})
        out = out.join(side, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_crc") == F.col("_text_crc")), "left").drop(*[f"_{c}" for c in on])
    share = F.coalesce("_times", F.lit(1))
    rare_logs = F.coalesce("rare_logs", F.lit(0.0)) / share
    n_train = vocab.train_tokens
    log_all = math.log10(n_train + vocab.types + 1)
    return out.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) / share).cast("long").alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_counts") + rare_logs - F.col("n_tokens") * F.lit(log_all)).alias("base_score"),
        (F.col("log_model") + F.col("log_classes") + rare_logs).alias("score"))


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and model score."""
    return score(documents(spark, sf_dir))
