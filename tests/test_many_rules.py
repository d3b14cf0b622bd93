"""Large rule tables: the same verdicts as pair by pair, without the pairs."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeaudit.operators import ignore as I

from test_ignore_property import DIRS, PATTERNS, ignored, path

MORE = PATTERNS + ["a*", "*a", "b/a*", "/a*", "*", "**", "x\\\\1", "[^a]", "a/b/a.txt", "*.t?t", "/*xt", "b.*", "a?t*", "/b/a", "a.tx*t", "b/*"]
rules = st.lists(st.tuples(st.sampled_from(DIRS), st.sampled_from(MORE)), min_size=1, max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(paths=st.sets(path, min_size=1, max_size=12), rule_list=rules, include_dot=st.booleans())
def test_lookups_match_direct_rules(spark, monkeypatch, paths, rule_list, include_dot):
    monkeypatch.setattr(I, "FEW_RULES", 0)
    monkeypatch.setattr(I, "RULES_AT_ONCE", 2)
    listing = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
    r = spark.createDataFrame(rule_list, "dir string, pattern string")
    got = {x["path"] for x in I.apply_ignore(listing, r, include_dot=include_dot).collect()}
    assert got == {p for p in paths if not ignored(p, rule_list, include_dot)}
    shown = {x["path"] for x in I.show_ignored(listing, r, include_dot=include_dot).collect()}
    out = {p for p in paths if ignored(p, rule_list, include_dot)}
    tops = {next("/".join(p.split("/")[:j]) for j in range(1, 9) if ignored("/".join(p.split("/")[:j]), rule_list, include_dot)) for p in out}
    assert shown == {t for t in tops if not (t in paths and I.INDEX_NAME in t)}


def test_many_rules_over_one_root(spark):
    """20,000 rules of one directory, 4,000 paths: no row per path and rule."""
    rng = random.Random(5)
    rows = [("", f"file{i}.dat") for i in range(0, 40_000, 4)] + [("", f"*.x{i}") for i in range(5000)] + [("", f"tmp{i}*") for i in range(4900)]
    rows += [("", f"q?{i}") for i in range(100)]
    paths = [f"d{i % 7}/" + rng.choice([f"file{i}.dat", f"name.x{i * 3}", f"tmp{i}_", f"qz{i}", f"keep{i}"]) for i in range(4000)]

    def out(p):
        n = p.split("/")[1]
        if n.startswith("file"):
            return int(n[4:-4]) % 4 == 0
        if n.startswith("name"):
            return int(n[6:]) < 5000
        if n.startswith("tmp"):
            return int(n[3:-1]) < 4900 or any(int(n[3:-1][:k]) < 4900 for k in range(1, len(n) - 3))
        return n.startswith("qz") and int(n[2:]) < 100

    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    r = spark.createDataFrame(rows, "dir string, pattern string")
    ready = I.RuleSet(spark, r)
    assert ready.few is None and ready.tables["regex"].count() <= 100
    m = I._matches(listing, ready)
    assert m.count() < 12 * len(paths)
    got = {x["path"] for x in I.apply_ignore(listing, r).collect()}
    assert got == {p for p in paths if not out(p)} and 500 < len(got) < 3500
