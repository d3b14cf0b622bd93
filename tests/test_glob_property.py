"""Glob translation against a direct backtracking matcher (hypothesis);
matching runs in the JVM with regexp_like, as in the ignore join."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeaudit.functions.glob import glob_regex


def _tokens(p):
    """Pattern -> tokens, or None when malformed."""
    out, i = [], 0
    while i < len(p):
        c = p[i]
        if c == "*":
            out.append(("star",))
            i += 1
        elif c == "?":
            out.append(("any",))
            i += 1
        elif c == "\\":
            if i + 1 >= len(p):
                return None
            out.append(("lit", p[i + 1]))
            i += 2
        elif c == "[":
            i += 1
            neg = i < len(p) and p[i] == "^"
            i += neg
            ranges, n = [], 0
            while True:
                if i < len(p) and p[i] == "]" and n > 0:
                    i += 1
                    break
                item = []
                for _ in range(2):
                    if i >= len(p) or p[i] in "-]":
                        return None
                    if p[i] == "\\":
                        i += 1
                        if i >= len(p):
                            return None
                    item.append(p[i])
                    i += 1
                    if not (i < len(p) and p[i] == "-"):
                        break
                    i += 1
                lo, hi = item[0], item[-1]
                ranges.append((lo, hi))
                n += 1
            out.append(("cls", neg, ranges))
        else:
            out.append(("lit", c))
            i += 1
    return out


def _match(toks, s):
    if not toks:
        return s == ""
    t = toks[0]
    if t[0] == "star":
        k = 0
        while True:
            if _match(toks[1:], s[k:]):
                return True
            if k >= len(s) or s[k] == "/":
                return False
            k += 1
    if not s:
        return False
    c = s[0]
    if t[0] == "any":
        ok = c != "/"
    elif t[0] == "lit":
        ok = c == t[1]
    else:
        inside = any(lo <= c <= hi for lo, hi in t[2])
        ok = inside != t[1]
    return ok and _match(toks[1:], s[1:])


def glob_match(p, s):
    toks = _tokens(p)
    return toks is not None and _match(toks, s)


pattern = st.text(alphabet="ab*?[]^-\\/", max_size=6)
name = st.text(alphabet="ab/-^]", max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pairs=st.lists(st.tuples(pattern, name), min_size=20, max_size=40))
def test_glob_translation(spark, pairs):
    df = spark.createDataFrame(pairs, "p string, n string")
    got = df.select("p", "n", glob_regex("p").alias("rx")).select(
        "p", "n", F.expr("regexp_like(n, rx)").alias("m")).collect()
    for r in got:
        assert r["m"] == glob_match(r["p"], r["n"]), (r["p"], r["n"])
