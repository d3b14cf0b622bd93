"""Audit statuses against a direct implementation of the truth table, on
random small snapshot pairs (hypothesis)."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeaudit.operators import audit as A

M = "dir string, name string, path string, mod_ms bigint, algo string, hash string, size bigint"
O = "dir string, name string, path string, mod_ms bigint, size bigint, algo string, hash string"

entry = st.tuples(st.integers(0, 3), st.sampled_from(["h1", "h2", None]))
snap = st.dictionaries(st.sampled_from([f"f{i}" for i in range(8)]), entry, max_size=8)


def expected(stored, observed, keep_missing, log_deleted):
    out = {}
    for n, (bm, bh) in observed.items():
        if n not in stored:
            out[n] = "new"
            continue
        am, ah = stored[n]
        if ah is not None and bh is not None and ah == bh:
            out[n] = "ok"
        elif am == bm:
            out[n] = "DMG"
        elif am < bm:
            out[n] = "upd"
        else:
            out[n] = "old"
    for n in stored:
        if n not in observed and log_deleted and not keep_missing:
            out[n] = "del"
    return out


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(stored=snap, observed=snap, keep_missing=st.booleans(), log_deleted=st.booleans())
def test_audit_matches_truth_table(spark, stored, observed, keep_missing, log_deleted):
    s = spark.createDataFrame([("d", n, "d/" + n, m, "md5", h, 1) for n, (m, h) in stored.items()], M)
    # observed digests given directly (None = could not be read -> PNC)
    o = spark.createDataFrame([("d", n, "d/" + n, m, 1, "md5", h) for n, (m, h) in observed.items()], O)
    t = A.audit(s, o, keep_missing=keep_missing, log_deleted=log_deleted)
    got = {r["name"]: r["status"] for r in A.events(t).collect()}
    want = expected(stored, {n: v for n, v in observed.items() if v[1] is not None}, keep_missing, log_deleted)
    for n, (_, h) in observed.items():
        if h is None:
            want[n] = "PNC"
    assert got == want
    kept = {r["name"] for r in A.next_manifest(t).collect()}
    gone = {n for n in stored if n not in observed}
    assert (gone <= kept) == (keep_missing or not gone)
