"""Sharding by a permutation-filled lookup table.

Shards take turns claiming slots of a table whose size is a prime: on its
turn a shard claims the next slot of its own preference order (offset plus
multiples of a skip, a permutation because the size is prime) that is still
free.  The filled table has ``table_size`` rows, whatever the data: its size
is a parameter, so broadcasting it is bounded.  A row is placed by hashing
its key to a slot and reading the slot's shard: one hash and one broadcast
hash join, no shuffle, and no key can make a task hot.

When a shard is added or removed, only about its share of the slots changes
owner; everything else stays in place.

Defined cases: a null key hashes as its own marker (all null keys share one
slot); equal keys always share a shard; an empty table gives an empty result;
columns named like the outputs are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import documents

TABLE_SIZE = 65_537
N_SHARDS = 512
# most slots a table may have, so that the broadcast stays below a few MB
MAX_TABLE_SIZE = 1_000_003
NULL_KEY = "\x00null"


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: Sequence[str], table_size: int = TABLE_SIZE,
               weights: Sequence[int] | None = None) -> list[int]:
    """Slot -> index into ``shards``.  ``weights``: turns per round of each
    shard (default one).  The order of ``shards`` decides ties only."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if not _is_prime(table_size) or not len(shards) <= table_size <= MAX_TABLE_SIZE:
        raise ValueError(f"table size must be a prime from the shard count to {MAX_TABLE_SIZE}")
    turns = list(weights) if weights is not None else [1] * len(shards)
    if len(turns) != len(shards) or min(turns) < 0 or not any(turns):
        raise ValueError("one weight per shard, none negative, one positive")
    place = [_hash(f"offset:{s}") % table_size for s in shards]
    skip = [_hash(f"skip:{s}") % (table_size - 1) + 1 for s in shards]
    table, free = [-1] * table_size, table_size
    while True:
        for i, n in enumerate(turns):
            for _ in range(n):
                at = place[i]
                while table[at] >= 0:
                    at = (at + skip[i]) % table_size
                table[at] = i
                place[i] = (at + skip[i]) % table_size
                free -= 1
                if not free:
                    return table


def slot_of(key: Column, table_size: int = TABLE_SIZE) -> Column:
    """The slot of a key: the first 60 bits of its MD5 modulo the size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit(NULL_KEY)))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % table_size).cast("int")


def table_frame(spark: SparkSession, table: Sequence[int]) -> DataFrame:
    """The table as rows (slot, shard_id), made inside the JVM from one literal."""
    packed = F.lit(",".join(map(str, table)))
    return spark.range(1).select(F.posexplode(F.split(packed, ",")).alias("slot", "_s")).select(
        "slot", F.col("_s").cast("int").alias("shard_id"))


def place(df: DataFrame, key: Column | str, shards: Sequence[str], table_size: int = TABLE_SIZE,
          weights: Sequence[int] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard_id`` (index into ``shards``)."""
    table = table_frame(df.sparkSession, fill_table(shards, table_size, weights))
    col = F.col(key) if isinstance(key, str) else key
    placed = df.drop("shard_id").withColumn("slot", slot_of(col, table_size))
    return placed.join(F.broadcast(table), "slot")


def shard_names(n: int = N_SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def op1_maglev_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard out of 512 over a table of 65,537 slots."""
    docs = documents(spark, sf_dir).select("doc_id")
    return place(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard_id")


def oracle() -> str:
    table = ",".join(map(str, fill_table(shard_names())))
    return f"""
WITH t AS (SELECT unnest([{table}]) AS shard_id, unnest(range({TABLE_SIZE})) AS slot),
d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0) || 'null')), 1, 15))::BIGINT
             % {TABLE_SIZE} AS slot FROM documents)
SELECT d.doc_id, CAST(d.slot AS INTEGER) AS slot, CAST(t.shard_id AS INTEGER) AS shard_id
FROM d JOIN t USING (slot)"""
