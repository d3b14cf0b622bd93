"""Small helpers the training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.session import checkpoint_dir

# the white space of every word rule here: blank, tab, LF, VT, FF, CR
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a frame feeds several branches: it is computed once, its
    lineage ends there, and a lost executor costs a re-read, not a replay.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Catalyst may inline an expression into a lambda and then evaluates it for
    every array element; a one-element transform binds it first.
    """
    return F.transform(F.array(value), body)[0]


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_or_empty(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a non-null text, in order."""
    body = F.btrim(text, F.lit(WS_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS_CLASS + "+"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_runs(batch: pa.RecordBatch, column: int = 1, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of ``rows`` rows and ``size`` bytes of text at most
    (one row at least): what a task holds as Python objects at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        to = max(at + 1, min(at + rows, full))
        yield batch.slice(at, to - at)
        at = to
