"""Tables as observed objects (S2) and table rows as objects (S3).

An observed object has the manifest columns plus, before hashing, the
content.  Hashing is a narrow projection done before any shuffle, so only
digests travel through joins, never the content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.hashing import content_hash, row_fingerprint
from lakeaudit.functions.paths import join_path
from lakeaudit.functions.times import epoch_millis


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def objects(df: DataFrame, dir, name, content, mod_ms, algo: str | None = "md5",
            keep: list[str] | None = None) -> DataFrame:
    """Observed objects from any table.

    ``dir``/``name``/``content``/``mod_ms`` are column names or Columns.  With
    ``algo`` the content is hashed right here (narrow, codegen); with
    ``algo=None`` the content column stays for a later per-entry choice.
    ``size`` is the byte length of the content; a null content is a read
    error (``error`` column), reported as PNC by the audit.
    """
    content_c = _c(content)
    cols = [
        _c(dir).alias("dir"),
        _c(name).alias("name"),
        join_path(_c(dir), _c(name)).alias("path"),
        _c(mod_ms).cast("bigint").alias("mod_ms"),
    ]
    keep = keep or []
    base = df.select(*cols, content_c.alias("content"), *keep)
    size = F.octet_length("content").cast("bigint")
    error = F.when(F.col("content").isNull(), F.lit("no content"))
    if algo is None:
        return base.select("dir", "name", "path", "mod_ms", size.alias("size"),
                           error.alias("error"), "content", *keep)
    return base.select(
        "dir", "name", "path", "mod_ms",
        F.lit(algo).alias("algo"),
        content_hash("content", algo).alias("hash"),
        size.alias("size"),
        error.alias("error"),
        *keep,
    )


def round_half_away(v: Column) -> Column:
    """Round a double to an integer, halves away from zero, exactly.

    ``v - floor(v)`` is exact in binary, so the comparison with 0.5 decides
    on the true value; this stays in generated code (no decimal detour).
    """
    fl, ce = F.floor(v), F.ceil(v)
    return (F.when(v >= 0, fl + F.when(v - fl >= 0.5, 1).otherwise(0))
            .otherwise(ce - F.when(ce - v >= 0.5, 1).otherwise(0)))


def money_cents(col) -> Column:
    """Doubles as integer cents, so that every engine prints them alike."""
    return round_half_away(_c(col) * 100).cast("bigint")


def normalised(df: DataFrame, cols: list[str]) -> list[Column]:
    """Type-stable text forms: doubles -> cents, timestamps -> epoch millis."""
    out = []
    types = dict(df.dtypes)
    for c in cols:
        t = types[c]
        if t in ("double", "float"):
            out.append(money_cents(c))
        elif t.startswith("timestamp"):
            out.append(epoch_millis(F.col(c), t))
        elif t == "date":
            out.append(F.unix_date(F.col(c)))
        else:
            out.append(F.col(c))
    return out


def row_objects(df: DataFrame, keys: list[str], cols: list[str] | None, dir, mod_ms,
                algo: str = "md5") -> DataFrame:
    """Each row is an object: name = keys joined by ``-``, fingerprint = digest
    of the canonical row text (S3).  ``cols`` defaults to all non-key columns.
    """
    cols = cols if cols is not None else [c for c in df.columns if c not in keys]
    text = row_fingerprint(normalised(df, cols))
    name = F.concat_ws("-", *[F.col(k).cast("string") for k in keys])
    return (
        df.select(_c(dir).alias("_dir"), name.alias("_name"), _c(mod_ms).cast("bigint").alias("_mod"),
                  text.alias("_text"))
        .select(
            F.col("_dir").alias("dir"), F.col("_name").alias("name"),
            join_path(F.col("_dir"), F.col("_name")).alias("path"),
            F.col("_mod").alias("mod_ms"),
            F.lit(algo).alias("algo"),
            content_hash("_text", algo).alias("hash"),
            F.octet_length("_text").cast("bigint").alias("size"),
            F.lit(None).cast("string").alias("error"),
        )
    )
