"""Audit: truth table, damage timeline, fixture counts, properties."""

from pyspark.sql import functions as F

from lakeaudit.operators import audit as A
from lakeaudit.plans import fixtures as FX
from lakeaudit.sources.objects import objects

from conftest import SF001

M = "dir string, name string, path string, mod_ms bigint, algo string, hash string, size bigint"
O = "dir string, name string, path string, mod_ms bigint, size bigint, content string"


def _stored(spark, rows):
    return spark.createDataFrame([("d", n, "d/" + n, mod, "md5", h, 3) for n, mod, h in rows], M)


def _observed(spark, rows):
    return spark.createDataFrame([("d", n, "d/" + n, mod, 3, c) for n, mod, c in rows], O)


def _md5(s):
    import hashlib
    return hashlib.md5(s.encode()).hexdigest()


def _status(t):
    return {r["name"]: r["status"] for r in A.events(t).collect()}


def test_truth_table(spark):
    stored = _stored(spark, [
        ("ok", 10, _md5("x")), ("okmod", 10, _md5("x")), ("dmg", 10, _md5("x")), ("upd", 10, _md5("x")),
        ("old", 10, _md5("x")), ("gone", 10, _md5("x")), ("nullh", 10, None),
    ])
    observed = _observed(spark, [
        ("ok", 10, "x"), ("okmod", 20, "x"), ("dmg", 10, "y"), ("upd", 20, "y"), ("old", 5, "y"),
        ("new", 10, "z"), ("nullh", 10, "x"), ("err", 10, None),
    ])
    t = A.audit(stored, observed)
    st = _status(t)
    assert st == {"ok": "ok", "okmod": "ok", "dmg": "DMG", "upd": "upd", "old": "old", "gone": "del",
                  "new": "new", "nullh": "DMG", "err": "PNC"}
    nm = {r["name"]: r for r in A.next_manifest(t).collect()}
    assert nm["dmg"]["hash"] == _md5("x")            # damage keeps the stored entry
    assert nm["upd"]["hash"] == _md5("y") and nm["upd"]["mod_ms"] == 20
    assert "gone" not in nm and "err" not in nm
    assert nm["okmod"]["mod_ms"] == 20              # ok refreshes the mtime
    changed = {r[0] for r in A.changed_dirs(t).collect()}
    assert changed == {"d"}
    # force takes the observed entry for damage
    nf = {r["name"]: r for r in A.next_manifest(A.audit(stored, observed, force=True)).collect()}
    assert nf["dmg"]["hash"] == _md5("y")
    # keep_missing keeps the vanished entry and logs nothing for it
    tk = A.audit(stored, observed, keep_missing=True)
    assert "gone" not in _status(tk)
    assert "gone" in {r["name"] for r in A.next_manifest(tk).collect()}
    # no deletion log
    assert "gone" not in _status(A.audit(stored, observed, log_deleted=False))


def test_unchanged_dir_not_modified(spark):
    stored = _stored(spark, [("a", 10, _md5("x"))])
    observed = _observed(spark, [("a", 10, "x")])
    assert A.changed_dirs(A.audit(stored, observed)).count() == 0


def test_skip_existing(spark):
    stored = _stored(spark, [("same", 10, _md5("x")), ("dmg", 10, _md5("x")), ("nullh", 10, None),
                             ("moved", 10, _md5("x"))])
    observed = _observed(spark, [("same", 10, "x"), ("dmg", 10, "y"), ("nullh", 10, "x"), ("moved", 20, "y")])
    t = A.audit(stored, observed, skip_existing=True)
    st = _status(t)
    assert st == {"same": "ok", "dmg": "ok", "nullh": "DMG", "moved": "upd"}
    s = A.run_summary(t).first()
    assert s["total"] == 2  # ok is not counted with skip_existing


def test_damage_timeline(spark):
    """new -> old -> upd -> DMG (reference end-to-end damage test)."""
    steps = [("foo1", "2022-02-01 12:00:00", "new"), ("foo2", "2022-02-01 11:00:00", "old"),
             ("foo3", "2022-02-01 13:00:00", "upd"), ("foo4", "2022-02-01 13:00:00", "DMG")]
    stored = spark.createDataFrame([], M)
    for content, ts, expected in steps:
        raw = spark.createDataFrame([(content, ts)], "c string, ts string")
        obs = objects(raw, dir=F.lit("d"), name=F.lit("test.txt"), content="c",
                      mod_ms=F.unix_millis(F.to_timestamp("ts")), algo=None)
        t = A.audit(stored, obs)
        assert _status(t) == {"test.txt": expected}
        v = A.verdict(t).first()
        assert v["exit_code"] == (1 if expected == "DMG" else 0)
        stored = spark.createDataFrame(A.next_manifest(t).collect(), M)


def test_fixture_counts(spark):
    t = A.audit(FX.stored(spark, SF001), FX.documents_objects(spark, SF001, algo=None))
    counts = dict(A.events(t).groupBy("status").count().collect())
    assert counts == {"DMG": 9, "del": 11, "new": 12, "ok": 162, "old": 9, "upd": 8}
    ok_new_mtime = t.where((F.col("status") == "ok") & F.col("modified")).count()
    assert ok_new_mtime == 5


def test_audit_of_itself_is_all_ok(spark):
    obs = FX.observed(spark, SF001)
    t = A.audit(obs.drop("doc_id", "error"), FX.documents_objects(spark, SF001, algo=None))
    assert {r[0] for r in A.events(t).select("status").distinct().collect()} == {"ok"}


def test_vanished_dirs_topmost_only(spark):
    stored_dirs = spark.createDataFrame([("", "a"), ("a", "b"), ("a/b", "c"), ("", "x")], "dir string, subdir string")
    current = spark.createDataFrame([("", "a")], "dir string, subdir string")
    got = sorted(r["path"] for r in A.vanished_dirs(stored_dirs, current).collect())
    assert got == ["a/b", "x"]


def test_report_filters(spark):
    ev = spark.createDataFrame([("p1", "ok"), ("p2", "new"), ("p3", "DMG"), ("p4", "ign"), ("p5", "xup")],
                               "path string, status string")
    assert sorted(r[0] for r in A.report(ev).collect()) == ["p2", "p3"]
    assert sorted(r[0] for r in A.report(ev, verbose=True, hide_new=True).collect()) == ["p1", "p3", "p4"]


def test_rehash_with_stored_algo(spark):
    """H3: entries stored with sha512 are re-hashed with sha512; statuses equal the md5 run."""
    plain = A.audit(FX.stored(spark, SF001), FX.documents_objects(spark, SF001, algo=None))
    mixed = A.audit(FX.stored(spark, SF001, sha512_suffix="/de"), FX.documents_objects(spark, SF001, algo=None))
    a = {r["path"]: r["status"] for r in A.events(plain).collect()}
    b = {r["path"]: r["status"] for r in A.events(mixed).collect()}
    assert a == b
    # re-hashed entries keep their stored algorithm; new ones take the run's
    rehashed = mixed.where(F.col("status").isin("ok", "upd", "old"))
    de = rehashed.where(F.col("dir").endswith("/de"))
    assert de.count() > 0 and de.where("algo <> 'sha512' OR length(hash) <> 128").count() == 0
    assert rehashed.where(~F.col("dir").endswith("/de") & (F.col("algo") != "md5")).count() == 0
    assert mixed.where("status = 'new' AND algo <> 'md5'").count() == 0
