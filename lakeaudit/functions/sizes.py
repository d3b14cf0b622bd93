"""Human sizes (X1 format_size, X2 parse_size) as built-in expressions.

``format_size``: unit index = largest k with 1024^k <= size; a whole value
prints without decimals, otherwise with one decimal rounded half to even
(size / 1024^k is exact in binary below 2^53), so ``1280`` prints ``1.2K``;
0 prints ``0``; from 1024^6 on the plain byte count is printed.

``parse_size``: the last character is the unit, the rest a decimal number;
the product is truncated.  An unknown unit or a bad number gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit letters of the size format, in order of 1024 powers.
SIZE_UNITS = ["", "K", "M", "G", "T", "P"]
# Units accepted by parse_size and their multipliers.
PARSE_UNITS = {"B": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def format_size(size) -> Column:
    s = _c(size).cast("bigint")
    # unit index: largest k with 1024^k <= s (comparisons only)
    k = F.lit(0)
    for i in range(1, len(SIZE_UNITS)):
        k = F.when(s >= F.lit(1024 ** i), F.lit(i)).otherwise(k)
    # s / 1024^k is exact in binary below 2^53; bround is half-to-even on it
    v = s.cast("double") / F.pow(F.lit(1024.0), k)
    unit = F.element_at(F.array(*[F.lit(u) for u in SIZE_UNITS]), k + 1)
    text = (F.when(v == F.floor(v), F.concat(F.floor(v).cast("string"), unit))
            .otherwise(F.concat(F.format_string("%.1f", F.bround(v, 1)), unit)))
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when((s <= 0) | (s >= F.lit(1024 ** len(SIZE_UNITS))), s.cast("string"))
            .otherwise(text))


def parse_size(text) -> Column:
    t = F.upper(_c(text))
    unit = F.substring(t, -1, 1)
    number = F.when(F.length(t) > 1, t.substr(F.lit(1), F.length(t) - 1))
    mult = None
    for u, m in PARSE_UNITS.items():
        mult = F.when(unit == u, F.lit(m)) if mult is None else mult.when(unit == u, F.lit(m))
    value = number.try_cast("double") * mult.cast("double")
    return F.when(value.isNull() | F.isnan(value), F.lit(None).cast("bigint")).otherwise(_trunc(value))


def _trunc(v: Column) -> Column:
    # truncate toward zero, null when out of bigint range
    return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).try_cast("bigint")
