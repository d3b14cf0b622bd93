"""Time columns as epoch milliseconds, independent of the session time zone.

A ``timestamp_ntz`` is a wall-clock value; it is read as UTC here (as the
table writers and DuckDB do): the millisecond difference to the wall-clock
epoch, which involves no session zone.  A ``timestamp`` is an instant already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch_millis(c: Column, dtype: str) -> Column:
    if dtype == "timestamp_ntz":
        return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c)
    if dtype == "timestamp":
        return F.unix_millis(c)
    if dtype == "date":
        return F.unix_date(c).cast("bigint") * 86_400_000
    return c.cast("bigint")


def col_millis(df: DataFrame, name: str) -> Column:
    return epoch_millis(F.col(name), dict(df.dtypes)[name])


def year_month(c: Column) -> Column:
    """``yyyy-MM`` of a date or wall-clock timestamp, without zone conversion."""
    return F.concat(F.year(c).cast("string"), F.lit("-"), F.lpad(F.month(c).cast("string"), 2, "0"))
