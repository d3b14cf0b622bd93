"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, at a path of the
caller's: one row (digest, keep_id) per distinct text ever seen.  A batch is
reduced to its digests, grouped (partial aggregation, so a digest held by a
third of all rows costs one row per task), and anti-joined to the index by a
sort-merge join; the index side is read bucket by bucket without a shuffle.
What is new is appended, one sorted file per bucket and batch; ``compact``
folds a long history back into one file per bucket.

Texts are equal when identical after every run of blanks, tabs and line ends
is replaced by one space (a null text counts as empty).  Of equal texts the
row with the smallest id stays, or the row the index already holds.

Defined cases: rows repeating both id and text are one document; one id with
two texts is two documents; a row without id never becomes the keeper unless
its whole group has none, and it then has ``keep_id`` null and is kept; an
empty batch appends nothing.  Running a batch again gives the same decisions,
so a job that died after its append may simply be repeated.  Columns other
than id and text are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import WS_CLASS, documents, shared_path, spare, staged, text_or_empty
from lakeaudit.operators.joins import broadcast_if_small
from lakeaudit.session import conf_int

N_BUCKETS = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), WS_CLASS + "+", " ")


def digest_of(text: Column) -> Column:
    return F.sha2(F.encode(normalised(text), "UTF-8"), 256)


class DigestIndex:
    """The index at ``path``; made when missing, attached when there.

    ``buckets`` must stay the same for the life of the index (at 100 TB take
    some ten thousand, so that one bucket is a few hundred MB)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = N_BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        self._attach()

    def _attach(self) -> None:
        at = self.path.replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE {self.name} (digest STRING, keep_id BIGINT) USING parquet "
                       f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, groups: DataFrame) -> DataFrame:
        """The groups whose digest the index does not hold."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, fresh: DataFrame) -> None:
        # dealt like the buckets, so every task writes one sorted bucket file
        (fresh.select("digest", "keep_id").repartition(self.buckets, "digest")
         .write.insertInto(self.name))

    def compact(self, path: str) -> "DigestIndex":
        """The same index, one file per bucket, at a new path."""
        out = DigestIndex(self.spark, path, self.buckets)
        out.append(self.table().groupBy("digest").agg(F.min("keep_id").alias("keep_id")))
        return out

    def dedup(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Decide a batch and append what is new.

        One row per document: ``doc_id, keep_id, group_size`` (documents of
        this batch with the text), ``kept, text_sha256``."""
        digests = staged(batch.select(F.col(id_col).cast("bigint").alias("doc_id"),
                                      digest_of(F.col(text_col)).alias("digest")).distinct(), "digests")
        groups = staged(digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"),
                                                      F.count(F.lit(1)).alias("group_size")), "groups")
        self.append(self.unseen(groups))
        # only groups that hold a copy, or that an earlier batch holds, need a
        # lookup; every other row keeps itself
        held = self.table().withColumnRenamed("keep_id", "_held")
        look = (groups.join(held, "digest")
                .where((F.col("group_size") > 1) | ~F.col("keep_id").eqNullSafe(F.col("_held")))
                .select("digest", F.col("_held").alias("keep_id"), "group_size", F.lit(True).alias("_found")))
        out = digests.join(look, "digest", "left")
        keep = F.when(F.col("_found"), F.col("keep_id")).otherwise(F.col("doc_id"))
        return out.select("doc_id", keep.alias("keep_id"),
                          F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                          F.col("doc_id").eqNullSafe(keep).alias("kept"),
                          F.col("digest").alias("text_sha256"))


def decide(docs: DataFrame) -> DataFrame:
    """Decisions for a whole table as the first batch of a fresh index."""
    spark = docs.sparkSession
    return DigestIndex(spark, shared_path(spark, "index")).dedup(docs)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays, through a fresh index."""
    return decide(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN g USING (h)"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts stays.

    Only ids and digests are shuffled: the dropped ones are counted and
    broadcast, or joined when they are too many.  One id with two texts is
    two documents; rows that repeat an id and its text are one, of which the
    first in the order of their JSON form stays; rows without id stay."""
    decisions = staged(decide(docs), "exact")
    mark, name, sha = (spare(docs, c) for c in ("_digest", "_gone", "_sha"))
    has_id = F.col("doc_id").isNotNull()
    gone = decisions.where(~F.col("kept") & has_id).select(F.col("doc_id").alias(name), F.unhex("text_sha256").alias(sha))
    gone = broadcast_if_small(gone, conf_int(spark, "broadcastMaxKeys"))
    out = docs.withColumn(mark, F.unhex(digest_of(F.col("text"))))
    out = out.join(gone, (F.col("doc_id") == F.col(name)) & (F.col(mark) == F.col(sha)), "left_anti")
    if docs.count() != decisions.count():  # some row comes more than once
        many = staged(docs.groupBy("doc_id").count().where(has_id & (F.col("count") > 1)).select(F.col("doc_id").alias(name)), "repeats")
        many = broadcast_if_small(many)
        row = F.struct(*docs.columns)
        once = out.join(many, F.col("doc_id") == F.col(name), "left_semi").groupBy("doc_id", mark).agg(
            F.min_by(row, F.to_json(row, {"ignoreNullFields": "false"})).alias(name))
        out = out.join(many, F.col("doc_id") == F.col(name), "left_anti").select(*docs.columns).unionByName(
            once.select(*[F.col(name)[c].alias(c) for c in docs.columns]))
    return out.select(*docs.columns)
