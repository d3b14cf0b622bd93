"""Shell-style name patterns (X3) turned into anchored Java regular expressions.

Pattern language: ``*`` any run of characters other than ``/``; ``?`` one
character other than ``/``; ``[...]`` / ``[^...]`` a class of characters and
``lo-hi`` ranges (a class may match ``/``); ``\\`` escapes the next
character.  A malformed pattern (open class, empty class, trailing escape,
``-`` or ``]`` where a class item should start) never matches.

The translation runs once per rule row (rules are few); matching then is the
built-in ``regexp_like`` inside the JVM.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NEVER = r"(?!)"


class BadPattern(ValueError):
    pass


def _lit(ch: str) -> str:
    if ch.isascii() and ch.isalnum():
        return ch
    return "\\x{%x}" % ord(ch)


def _class_item(p: str, i: int) -> tuple[str, int]:
    """One possibly escaped character of a class, and the next index."""
    if i >= len(p) or p[i] in "-]":
        raise BadPattern(p)
    if p[i] == "\\":
        i += 1
        if i >= len(p):
            raise BadPattern(p)
    return p[i], i + 1


def glob_to_regex(pattern: str) -> str:
    """Anchored Java regex for ``pattern``; ``(?!)`` when malformed."""
    try:
        return "(?s)\\A" + _translate(pattern) + "\\z"
    except BadPattern:
        return NEVER


def _translate(p: str) -> str:
    out = []
    i = 0
    while i < len(p):
        ch = p[i]
        if ch == "*":
            while i < len(p) and p[i] == "*":
                i += 1
            out.append("[^/]*")
            continue
        if ch == "?":
            out.append("[^/]")
            i += 1
            continue
        if ch == "\\":
            i += 1
            if i >= len(p):
                raise BadPattern(p)
            out.append(_lit(p[i]))
            i += 1
            continue
        if ch == "[":
            i += 1
            negated = i < len(p) and p[i] == "^"
            if negated:
                i += 1
            ranges = []
            n = 0
            while True:
                if i < len(p) and p[i] == "]" and n > 0:
                    i += 1
                    break
                lo, i = _class_item(p, i)
                hi = lo
                if i < len(p) and p[i] == "-":
                    hi, i = _class_item(p, i + 1)
                n += 1
                if lo <= hi:
                    ranges.append((lo, hi))
            if not ranges:
                out.append("(?s:.)" if negated else NEVER)
            else:
                body = "".join(_lit(a) if a == b else _lit(a) + "-" + _lit(b) for a, b in ranges)
                out.append("[" + ("^" if negated else "") + body + "]")
            continue
        out.append(_lit(ch))
        i += 1
    return "".join(out)


@F.pandas_udf(T.StringType())
def _glob_regex_udf(patterns: pd.Series) -> pd.Series:
    return patterns.map(lambda p: None if p is None else glob_to_regex(p))


def glob_regex(pattern) -> Column:
    """Column version for rule tables (Arrow-batched, one call per batch)."""
    return _glob_regex_udf(F.col(pattern) if isinstance(pattern, str) else pattern)
