"""Duplicate space against a brute-force computation on random manifests."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeaudit.operators import dups as D

M = "dir string, name string, path string, mod_ms bigint, algo string, hash string, size bigint"

item = st.tuples(st.sampled_from(["h1", "h2", "h3"]), st.sampled_from([None, 50, 300]),
                 st.sampled_from([None, "P", "Q", "R"]))
manifest = st.dictionaries(st.sampled_from([f"f{i:02d}" for i in range(12)]), item, max_size=12)


def brute(m, min_size):
    bags = defaultdict(list)
    for name, (h, size, place) in sorted(m.items()):
        if size is not None and size < min_size:
            continue
        bags[h].append((name, size, place))
    out = {}
    for h, its in bags.items():
        sized = [s for _, s, _ in sorted(its) if s is not None]
        if len(its) < 2 or not sized or sized[0] < min_size:
            continue
        size = sized[0]
        classes = defaultdict(list)
        for name, _, place in its:
            classes[place if place is not None else "\u0001" + name].append(name)
        top = max(len(v) for v in classes.values())
        merged = top if top >= 2 else 0
        best = min((-len(v), min(v)) for v in classes.values())
        keeper = best[1] if merged else min(n for n, _, _ in its)
        out[h] = (size, len(its), len(classes), size * merged, size * len(classes),
                  any(p is None for _, _, p in its), "d/" + keeper)
    return out


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(m=manifest)
def test_dup_space_matches_brute_force(spark, m):
    man = spark.createDataFrame([("d", n, "d/" + n, 1, "md5", h, s) for n, (h, s, _) in m.items()], M)
    loc = spark.createDataFrame([("d/" + n, p) for n, (_, _, p) in m.items()], "path string, place string")
    got = {r["hash"]: (r["size"], r["n_items"], r["n_classes"], r["shared"], r["exclusive"], r["ext_unknown"],
                       r["keeper"])
           for r in D.dup_space(man, loc, min_size=100).collect()}
    assert got == brute(m, 100)
