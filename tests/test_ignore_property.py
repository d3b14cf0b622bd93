"""Hierarchical ignore against a direct implementation of the rules
(pruning included), on random trees and rule sets."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeaudit.operators import ignore as I

from test_glob_property import glob_match

NAMES = ["a", "b", "x1", ".d", "a.txt", "b.md"]
PATTERNS = ["a", "/a", "*.txt", "/*.md", "b/a.txt", "a/*", "x?", "/b", ".*", "[ab]"]
DIRS = ["", "a", "b", "a/b", "x1"]

path = st.lists(st.sampled_from(NAMES), min_size=1, max_size=3).map("/".join)
rules = st.lists(st.tuples(st.sampled_from(DIRS), st.sampled_from(PATTERNS)), max_size=5)


def ignored(p, rule_list, include_dot):
    parts = p.split("/")
    by_dir = {}
    for d, pat in rule_list:
        by_dir.setdefault(d, []).append(pat)
    for j in range(1, len(parts) + 1):           # each entry on the path
        entry = parts[j - 1]
        if entry.startswith(".lakeindex") or (not include_dot and entry.startswith(".")):
            return True
        for i in range(j):                        # rules of each directory above it
            anc = "/".join(parts[:i])
            rel = "/".join(parts[i:j])
            own = i == j - 1
            for pat in by_dir.get(anc, []):
                if pat.startswith("/"):
                    if own and glob_match(pat[1:], entry):
                        return True
                    continue
                if glob_match(pat, entry) or (not own and glob_match(pat, rel)):
                    return True
    return False


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(paths=st.sets(path, min_size=1, max_size=12), rule_list=rules, include_dot=st.booleans())
def test_apply_ignore_matches_direct_rules(spark, paths, rule_list, include_dot):
    listing = spark.createDataFrame([(p,) for p in sorted(paths)], "path string")
    r = spark.createDataFrame(rule_list, "dir string, pattern string")
    got = {x["path"] for x in I.apply_ignore(listing, r, include_dot=include_dot).collect()}
    want = {p for p in paths if not ignored(p, rule_list, include_dot)}
    assert got == want
