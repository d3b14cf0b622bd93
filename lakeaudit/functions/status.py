"""Status predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeaudit.schema import Status


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_error_or_warning(status) -> Column:
    return _c(status).isin(*Status.ERROR_OR_WARNING)


def is_verbose(status) -> Column:
    return _c(status).isin(*Status.VERBOSE)
