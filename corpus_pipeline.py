"""Corpus pipeline: stages over ``documents``, each written and read again.

Quality rules, exact dedup, SimHash near-dedup, mixing to target weights,
byte-level BPE.  Every stage works on all that the one before kept; all but
the last return the columns of ``documents``, the last one the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeaudit.llm import bpe, exact_dedup, mixing, quality, simhash
from lakeaudit.llm.common import documents, staged

STAGES = [
    ("quality_rules", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("simhash_near_dedup", simhash.stage),
    ("mixing", mixing.stage),
    ("byte_bpe", bpe.stage),
]

# XXH64, SimHash and BPE have no DuckDB form: tests/llm holds the rows
# against a brute-force version instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, from ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
