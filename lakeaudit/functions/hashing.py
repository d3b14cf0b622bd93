"""Content digests (H1, H3) as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeaudit.schema import HASH_ALGOS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def check_algo(algo: str) -> str:
    """Validate a run's hash algorithm; unknown names are an error."""
    if algo == "blake3":
        raise NotImplementedError("blake3 digests are not computed here (see README); use md5 or sha512")
    if algo not in HASH_ALGOS:
        raise ValueError(f"{algo} is unknown")
    return algo


def content_hash(content, algo: str = "md5") -> Column:
    """Hex digest of a string or binary column (H1)."""
    algo = check_algo(algo)
    c = _c(content)
    return F.md5(c) if algo == "md5" else F.sha2(c, 512)


def pick_hash(algo_col, hashes: dict[str, Column]) -> Column:
    """Choose among digests computed ahead for each algorithm in ``hashes``."""
    a = _c(algo_col)
    expr = None
    for name, h in hashes.items():
        expr = F.when(a == name, h) if expr is None else expr.when(a == name, h)
    return expr if expr is not None else F.lit(None).cast("string")


def row_fingerprint(cols: list[Column]) -> Column:
    """Canonical row string: fields joined by U+001F, null as ``\\N``.

    Callers normalise types first (doubles to integer cents, timestamps to
    millis) so that every engine prints the same text.
    """
    return F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])
