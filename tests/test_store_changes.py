"""Deltas on a base: what is written, read, folded, refused."""

import os

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators import audit as A
from lakeaudit.plans import run as R
from lakeaudit.schema import MANIFEST_SCHEMA
from lakeaudit.sinks import store as K

T0 = 1_600_000_000


def rows(spark, entries):
    """{(dir, name): mod} as a manifest."""
    return spark.createDataFrame([(d, n, f"{d}/{n}" if d else n, m, "md5", f"h{m}", 1) for (d, n), m in entries.items()], MANIFEST_SCHEMA)


def held(spark, store):
    return {(r["dir"], r["name"]): r["mod_ms"] for r in K.read_current(spark, store).collect()}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_chain_of_deltas(spark, tmp_path):
    store = str(tmp_path / "store")
    K.init_store(spark, store)
    state = {(f"d{i % 40}", f"n{i}"): 1 for i in range(4000)}
    lists = spark.createDataFrame([("", f"d{i}") for i in range(40)], "dir string, subdir string")
    assert not K.publish_changes(rows(spark, state), store, "1", spark.createDataFrame([("x",)], "dir string"), dirs=lists)  # no base yet
    base = size(f"{store}/snapshots/snapshot=1")
    for k, (changed, gone) in enumerate(((["d1", "d2"], "d3"), (["d1", "new"], "d4"), (["d3", "d1"], "d2")), 2):
        state = {(d, n): k if d in changed else m for (d, n), m in state.items() if d != gone}
        state.update({(d, f"k{k}"): k for d in changed})
        dirs = spark.createDataFrame([(d,) for d in (*changed, gone, None)], "dir string")
        assert K.publish_changes(rows(spark, state), store, str(k), dirs, dirs=lists)
        assert held(spark, store) == state
        assert size(f"{store}/snapshots/snapshot={k}") < base / 2
        assert {r.dir for r in K.read_current_seals(spark, store).collect()} == {d for d, _ in state}
        assert K.read_current_dirs(spark, store).count() == 40
    assert K.current(spark, store).deltas == ("2", "3", "4")
    seals = {tuple(r) for r in K.read_current_seals(spark, store).collect()}
    assert K.compact(spark, store, keep=1) == "5"
    assert K.current(spark, store).deltas == () and held(spark, store) == state
    assert {tuple(r) for r in K.read_current_seals(spark, store).collect()} == seals
    # the version before it stays with its whole chain
    assert sorted(os.listdir(f"{store}/snapshots")) == [f"snapshot={i}" for i in "12345"]
    K.publish_changes(rows(spark, state), store, "6", dirs.limit(0), dirs=lists, keep=1)
    assert sorted(os.listdir(f"{store}/snapshots")) == ["snapshot=5", "snapshot=6"] and held(spark, store) == state


def test_large_deltas_get_a_base(spark, tmp_path):
    store = str(tmp_path / "store")
    K.init_store(spark, store)
    state = {(f"d{i}", "n"): 1 for i in range(10)}
    K.publish_snapshot(rows(spark, state), store, "1")
    every = spark.createDataFrame([(f"d{i}",) for i in range(10)], "dir string")
    assert K.publish_changes(rows(spark, state), store, "2", every)
    assert not K.publish_changes(rows(spark, state), store, "3", every)  # the delta is as large as the base
    # lists begin to be kept: a new base
    assert not K.publish_changes(rows(spark, state), store, "4", every, dirs=spark.createDataFrame([("", "d1")], "dir string, subdir string"))
    assert held(spark, store) == state and K.read_current_dirs(spark, store).count() == 1


def test_two_writers_and_used_ids(spark, tmp_path):
    store = str(tmp_path / "store")
    K.init_store(spark, store)
    one = rows(spark, {("d", "a"): 1})
    K.publish_snapshot(one, store, "nightly")
    seq = K.current(spark, store).seq
    K.publish_snapshot(rows(spark, {("d", "b"): 2}), store, K.next_id(spark, store), after=seq)
    with pytest.raises(RuntimeError):  # began with the same version
        K.publish_snapshot(one, store, "late", after=seq)
    assert held(spark, store) == {("d", "b"): 2}
    for used in ("nightly", K.current_id(spark, store)):  # kept as backups
        with pytest.raises(ValueError):
            K.publish_snapshot(one, store, used)
        with pytest.raises(ValueError):
            K.publish_changes(one, store, used, one.select("dir"))


def test_key_order_within_files(spark, tmp_path):
    store = str(tmp_path / "store")
    K.init_store(spark, store)
    K.publish_snapshot(rows(spark, {(f"d{i % 7}", f"n{i * 37 % 101}"): i for i in range(500)}).repartition(9), store, "1")
    at = spark.read.parquet(f"{store}/snapshots/snapshot=1").select("path", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"))
    files = {}
    for r in at.orderBy("i").collect():
        files.setdefault(r.f, []).append(r.path)
    assert len(files) > 4 and all(p == sorted(p) for p in files.values())


def test_audit_shuffles_one_side(spark, tmp_path):
    """The stored side of the audit join stays where its buckets are, with
    and without deltas."""
    store = str(tmp_path / "store")
    K.init_store(spark, store)
    state = {(f"d{i % 30}", f"n{i}"): 1 for i in range(3000)}
    K.publish_snapshot(rows(spark, state), store, "1")
    seen = rows(spark, state).withColumnRenamed("hash", "h").withColumnRenamed("h", "hash")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for snapshot in "23":
            t = A.audit(K.read_current(spark, store), seen, algos=["md5"])
            assert t.where("status = 'ok'").count() == 3000
            plan = t._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
            assert K.publish_changes(rows(spark, state), store, snapshot, spark.createDataFrame([("d3",)], "dir string"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _w(path, text, mtime=T0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    os.utime(path, (mtime, mtime))


def test_update_writes_changed_directories(spark, tmp_path):
    root, store = str(tmp_path / "root"), str(tmp_path / "store")
    for d in range(12):
        for n in range(5):
            _w(f"{root}/d{d}/sub/n{n}.txt", f"{d} {n}")
    R.update(spark, root, store, snapshot_id="first")
    _w(f"{root}/d1/sub/n0.txt", "changed", T0 + 5)
    os.remove(f"{root}/d2/sub/n1.txt")
    for n in range(5):
        os.remove(f"{root}/d3/sub/n{n}.txt")
    os.rmdir(f"{root}/d3/sub")
    res = R.update(spark, root, store, log_deleted=True)
    v = K.current(spark, store)
    assert v.base == "first" and len(v.deltas) == 1
    written = {r["dir"] for r in spark.read.parquet(f"{store}/changed/snapshot={v.id}").collect()}
    assert written == {"d1/sub", "d2/sub", "d3", "d3/sub"}
    assert {r["dir"] for r in spark.read.schema(MANIFEST_SCHEMA).parquet(f"{store}/snapshots/snapshot={v.id}").collect()} == {"d1/sub", "d2/sub"}
    want = {(r["path"], r["hash"]) for r in res.next_manifest.collect()}
    assert {(r["path"], r["hash"]) for r in K.read_current(spark, store).collect()} == want and len(want) == 54
    again = R.update(spark, root, store, log_deleted=True)
    assert {r["status"] for r in again.events.collect()} == {"ok"}
    assert spark.read.parquet(f"{store}/changed/snapshot={K.current_id(spark, store)}").count() == 0
    assert R.update(spark, root, store, readonly=True).events.where("status <> 'ok'").count() == 0


def test_odd_bytes(spark, tmp_path):
    """File names, directory names and rule files that are not UTF-8, and a
    rule file that cannot be read."""
    root, store = tmp_path / "root", str(tmp_path / "store")
    raw = os.fsencode(str(root))
    for name in (b"a\xff.txt", b"d\xfe/x.txt", b"d\xfe/\xc3.tmp", "d/\U0010ffab.txt".encode(), b"d/plain.txt", b"d/skip\xfd"):
        os.makedirs(os.path.dirname(raw + b"/" + name), exist_ok=True)
        with open(raw + b"/" + name, "wb") as f:
            f.write(name)
    with open(raw + b"/.lakeignore", "wb") as f:
        f.write(b"*\xfd\nno\xff\n")
    res = R.update(spark, str(root), store)
    got = {r["path"]: r["status"] for r in res.events.collect()}
    assert sorted(got.values()) == ["ign", "new", "new", "new", "new", "new"]
    back = {os.fsencode(R.name_bytes(p)) for p, s in got.items() if s == "new"}
    assert back == {b"a\xff.txt", b"d\xfe/x.txt", b"d\xfe/\xc3.tmp", "d/\U0010ffab.txt".encode(), b"d/plain.txt"}
    assert {r["status"] for r in R.update(spark, str(root), store).events.collect()} == {"ok", "ign"}
    # a rule file that cannot be opened: an error of its directory
    os.remove(raw + b"/.lakeignore")
    real = R.read_ignore_files
    os.makedirs(str(root / "d2"))
    (root / "d2" / "y.txt").write_text("y")
    (root / "d2" / ".lakeignore").write_text("*.zip")
    os.chmod(str(root / "d2" / ".lakeignore"), 0)
    if os.access(str(root / "d2" / ".lakeignore"), os.R_OK):  # as root: a file that is listed but gone when it is read
        listing = spark.createDataFrame([("d2", ".lakeignore", "d2/none", "file")], "dir string, name string, path string, kind string")
        row = real(listing, str(root)).first()
        assert row["dir"] == "d2" and row["pattern"] is None and row["error"]
        scan = R.scan
        R.scan = lambda *a, **k: (lambda s: R.Scan(s.kept, s.ignored, s.errors, spark.createDataFrame([("d2",)], "path string")))(scan(*a, **k))
    try:
        res = R.update(spark, str(root), store)
    finally:
        if "scan" in dir():
            R.scan = scan
    got = {r["path"]: r["status"] for r in res.events.collect()}
    assert got["d2"] == "PNC" and got["d2/y.txt"] == "new" and res.verdict.first()["exit_code"] == 1
