"""Quality rules with a hashed n-gram log-likelihood ratio.

Two multinomials over hashed n-grams are counted: one over the trusted target
(documents labelled good and not toxic), one over the raw corpus (all
documents).  A document's score is the mean of ``ln p_target - ln p_raw`` over
its n-grams, so it does not depend on length; it is rejected when the score
is below a fixed threshold, or when it breaks a base rule.

The n-gram is taken at word borders: the last two characters of a word, a
blank and the first two of the next.  There is one per pair of neighbouring
words, so it costs as much as word bigrams, but shows shouting, tables and
symbol noise that have never been seen before.

Only DataFrame functions run.  The counts are a partial aggregation over
``N_BUCKETS`` keys (a bounded table, whatever the corpus); the ratio table
comes back as one array of that size through a scalar subquery, and every
document is then scored by expressions on its own row: no shuffle of texts.
The trusted ids are broadcast; they are at most ``MAX_TRUSTED`` labelled
rows in expectation (all of them below that, else an even hash sample): a
bounded sample of labelled rows to fit on.  Everything else covers all rows.

Defined cases: a null or blank text has no words, fails the base rules and
scores 0; a text of one word has no n-gram and scores 0; without any trusted
document both multinomials are taken as equal, every score is 0 and only the
base rules reject; rows with null labels are not trusted; repeated rows count
as often as they occur; other columns are kept by ``scored`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import WS_CHARS, documents, let, spare, text_or_empty, words_of

N_BUCKETS = 16_384
MAX_TRUSTED = 100_000
SMOOTHING = 1.0
THRESHOLD = -0.3
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PCT = 30
# characters counted as symbols (fixed by the contract)
SYMBOLS = "#*$%&|<>"


def ngram_buckets(words: Column, n_buckets: int = N_BUCKETS) -> Column:
    """Bucket of each word border of a word array bound to a variable."""
    borders = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                          lambda w, i: F.concat(F.substring(F.get(words, i), -2, 2), F.lit(" "), F.substring(w, 1, 2)))
    return F.transform(borders, lambda g: F.pmod(F.xxhash64(g), F.lit(n_buckets)).cast("int"))


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """Ids of trusted documents, about ``max_trusted`` at most."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()
    n = good.count()
    if n > max_trusted:
        share = F.lit(int((1 << 40) * max_trusted / n))
        good = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < share)
    return good


def ratio_table(docs: DataFrame, labels: DataFrame, n_buckets: int = N_BUCKETS,
                max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row with ``llr array<double>``: per bucket the log ratio of the
    smoothed target and raw probabilities."""
    spark = docs.sparkSession
    marks = trusted_ids(labels, max_trusted).withColumn("_trusted", F.lit(1))
    rows = (docs.select("doc_id", F.col("text"))
            .join(F.broadcast(marks), "doc_id", "left")
            .select(F.coalesce("_trusted", F.lit(0)).alias("_trusted"),
                    F.explode(let(words_of(text_or_empty("text")), lambda w: ngram_buckets(w, n_buckets))).alias("_b")))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_raw"), F.sum("_trusted").alias("_target"))
    full = (spark.range(n_buckets).select(F.col("id").cast("int").alias("_b")).join(counts, "_b", "left")
            .select("_b", F.coalesce("_raw", F.lit(0)).alias("_raw"), F.coalesce("_target", F.lit(0)).alias("_target")))
    one = full.agg(F.array_sort(F.collect_list(F.struct("_b", "_raw", "_target"))).alias("_t"),
                   F.sum("_raw").alias("_n_raw"), F.sum("_target").alias("_n_target"))
    pad = SMOOTHING * n_buckets
    return one.select(F.transform("_t", lambda t: F.when(F.col("_n_target") == 0, F.lit(0.0)).otherwise(
        F.log((t["_target"] + SMOOTHING) / (F.col("_n_target") + pad)) -
        F.log((t["_raw"] + SMOOTHING) / (F.col("_n_raw") + pad)))).alias("llr"))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the array."""
    n_windows = F.size(words) - (window - 1)
    hashes = F.when(n_windows < 2, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), n_windows), lambda i: F.xxhash64(F.slice(words, i, window))))

    def covered(at: Column) -> Column:
        # positions of repeated windows, ascending: each adds what the next
        # one does not cover
        return F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window)))),
                           F.lit(0), lambda a, x: a + x)

    def positions(ordered: Column) -> Column:
        twice = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i + 1)["h"]) | (x["h"] == F.get(ordered, i - 1)["h"]))
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def count(hs: Column) -> Column:
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(
            let(let(pairs, positions), covered))

    return let(hashes, count)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, n_buckets: int = N_BUCKETS) -> DataFrame:
    """``docs`` with one struct more, the last column: ``n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept``."""
    text = text_or_empty("text")
    table = ratio_table(docs, labels, n_buckets).scalar()

    def of_words(w: Column, llr: Column) -> Column:
        buckets = ngram_buckets(w, n_buckets)
        total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(llr, b))
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"), repeat_words(w).cast("bigint").alias("n_repeat_words"),
            F.when(F.size(w) < 2, F.lit(0.0)).otherwise(total / (F.size(w) - 1)).alias("score"))

    def verdict(r: Column) -> Column:
        n, rep, score = (r[x] for x in ("n_words", "n_repeat_words", "score"))
        failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PCT * n)
        return F.struct(n.alias("n_words"), rep.alias("n_repeat_words"), failed.alias("base_failed"), score.alias("score"),
                        (~failed & (score >= threshold)).alias("kept"))

    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WS_CHARS)) != "")
    bare = F.length(F.translate(text, WS_CHARS, ""))
    llr, ws, name = (spare(docs, x) for x in ("_llr", "_w", "_q"))
    base = docs.withColumn(llr, table)
    # one expression per row, verdict included: a filter on it that the
    # optimiser pushes below this projection does not repeat the word work
    base = base.withColumn(ws, let(let(words_of(text), lambda w: of_words(w, F.col(llr))), verdict))
    w = F.col(ws)
    q = F.struct(
        w["n_words"].alias("n_words"), bare.cast("bigint").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint").alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"), w["base_failed"].alias("base_failed"), w["score"].alias("score"),
        w["kept"].alias("kept"))
    return base.withColumn(name, q).drop(ws, llr)


def labels_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base counts, score and verdict."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return scored(docs, labels_table(spark, sf_dir)).select("doc_id", "_q.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: what the rules reject goes."""
    out = scored(docs, labels_table(spark, sf_dir))
    return out.where(F.col(out.columns[-1])["kept"]).select(*docs.columns)
