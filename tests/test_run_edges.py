"""Runs that meet unreadable directories, links, aborts, and the options of a run."""

import os

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators import audit as A
from lakeaudit.plans import run as R
from lakeaudit.sinks import store as K
from lakeaudit.sources import listing as L

from test_run import _w

T0 = 1_600_000_000
M = "dir string, name string, path string, mod_ms bigint, algo string, hash string, size bigint"


def by_path(res):
    return {r["path"]: r["status"] for r in res.events.collect()}


def test_unreadable_directory(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "root"), str(tmp_path / "store")
    for p in ("open/a.txt", "locked/k.txt", "locked/in/m.txt"):
        _w(f"{root}/{p}", p, T0)
    R.update(spark, root, store)
    # the tests run as root, who may list anything: let one directory fail
    # (the task's function takes the lister with it by value)
    listed = L._list_dir

    def failing(root_, rel, follow):
        if rel == "locked":
            yield rel, "", rel, "error", None, None, "denied"
        else:
            yield from listed(root_, rel, follow)

    monkeypatch.setattr(L, "_list_dir", failing)
    res = R.update(spark, root, store, log_deleted=True)
    assert by_path(res) == {"open/a.txt": "ok", "locked": "PNC"}
    assert res.verdict.first()["exit_code"] == 1 and res.summary.first()["errors"] == 1
    assert sorted(r["path"] for r in res.next_manifest.collect()) == ["locked/in/m.txt", "locked/k.txt", "open/a.txt"]
    monkeypatch.undo()
    res = R.update(spark, root, store, log_deleted=True)
    assert set(by_path(res).values()) == {"ok"} and res.verdict.first()["exit_code"] == 0


def test_links_to_files_are_not_files(spark, tmp_path):
    root = str(tmp_path / "root")
    _w(f"{root}/a/x.txt", "x", T0)
    os.symlink(f"{root}/a/x.txt", f"{root}/linked.txt")
    os.symlink(f"{root}/a", f"{root}/alias")
    assert sorted(r["path"] for r in L.walk(spark, root).where("kind = 'file'").collect()) == ["a/x.txt", "alias/x.txt"]
    assert sorted(r["path"] for r in L.walk(spark, root, follow_links=False).where("kind = 'file'").collect()) == ["a/x.txt"]


def test_listing_of_a_missing_directory_is_an_error_row():
    assert [r[3] for r in L._list_dir("/nowhere/at/all", "", True)] == ["error"]


def test_many_algorithm_names(spark):
    rows = [("d", f"f{i}", f"d/f{i}", 1, a, "h", 1) for i, a in enumerate(["md5", "sha512", *(f"odd{k}" for k in range(12))])]
    assert A._stored_algos(spark.createDataFrame(rows, M)) == ["md5", "sha512"]


def test_readonly_does_not_read_new_files(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "root"), str(tmp_path / "store")
    _w(f"{root}/a/x.txt", "x", T0)
    R.update(spark, root, store)
    _w(f"{root}/a/y.txt", "y", T0)
    seen = []
    real = R.hash_files
    monkeypatch.setattr(R, "hash_files", lambda files, *a, **k: (seen.extend(r["path"] for r in files.collect()), real(files, *a, **k))[1])
    res = R.update(spark, root, store, readonly=True)
    assert by_path(res) == {"a/x.txt": "ok", "a/y.txt": "new"} and seen == ["a/x.txt"]
    assert res.verdict.first()["exit_code"] == 0 and K.read_current(spark, store).count() == 1


def test_start_paths_and_their_rules(spark, tmp_path):
    root, store = str(tmp_path / "root"), str(tmp_path / "store")
    for p in (".cfg/in/a.txt", "p/photos/b.tmp", "p/photos/c.txt", "q/d.txt"):
        _w(f"{root}/{p}", p, T0)
    _w(f"{root}/p/photos/.lakeignore", "# none\r\n\r\n", T0)
    rules = spark.createDataFrame([("", "photos/*.tmp")], "dir string, pattern string")
    # the names of the start path itself are not tested; global rules see its last name
    res = R.update(spark, root, store, subpath=[".cfg/in", "p/photos"], global_rules=rules)
    got = by_path(res)
    assert got.pop("p/photos/b.tmp") == "ign" and got == {".cfg/in/a.txt": "new", "p/photos/c.txt": "new"}
    assert sorted(r["path"] for r in R.update(spark, root, store, subpath="q").next_manifest.collect()) == \
        [".cfg/in/a.txt", "p/photos/c.txt", "q/d.txt"]
    with pytest.raises(ValueError):
        R.update(spark, root, store, subpath=["p", "p/photos"])
    shown = [(r["path"], r["kind"]) for r in R.show_ignored(spark, root, "p/photos", global_rules=rules).collect()]
    assert shown == [("p/photos/b.tmp", "file")]


def test_directory_tracking_off(spark, tmp_path):
    root, store = str(tmp_path / "root"), str(tmp_path / "store")
    _w(f"{root}/a/b/x.txt", "x", T0)
    R.update(spark, root, store, track_dirs=False)
    assert K.read_current_dirs(spark, store).count() == 0
    os.remove(f"{root}/a/b/x.txt")
    os.rmdir(f"{root}/a/b")
    res = R.update(spark, root, store, log_deleted=True, track_dirs=False)
    assert by_path(res) == {}


def manifest(spark, *names):
    return spark.createDataFrame([("d", n, f"d/{n}", 1, "md5", "h" + n, 1) for n in names], M)


def names(spark, store):
    return sorted(r["name"] for r in K.read_current(spark, store).collect())


def test_publish_again_after_an_abort(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    K.init_store(spark, store)
    K.publish_snapshot(manifest(spark, "a"), store, "1")
    real = K._point
    for broken in ("seal", "point"):
        if broken == "seal":
            monkeypatch.setattr("lakeaudit.operators.seal.seal", lambda df: 1 / 0)
        else:
            monkeypatch.setattr(K, "_point", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            K.publish_snapshot(manifest(spark, "b", "c"), store, "2")
        monkeypatch.undo()
        assert names(spark, store) == ["a"]
    K.publish_snapshot(manifest(spark, "d"), store, "2")
    assert names(spark, store) == ["d"] and K.read_current_seals(spark, store).count() == 1
    # a pointer that was not finished does not count
    os.makedirs(f"{store}/current/000000000099")
    assert K.current_id(spark, store) == "2" and K._point is real
    with pytest.raises(ValueError):
        K.publish_snapshot(manifest(spark, "e"), store, "2")


def test_force_clears_everything(spark, tmp_path):
    root, store = str(tmp_path / "root"), str(tmp_path / "store")
    _w(f"{root}/a/x.txt", "x", T0)
    R.update(spark, root, store)
    K.store_bags(spark.createDataFrame([("h", 1)], "hash string, size bigint"), store)
    K.init_store(spark, store, force=True)
    assert names(spark, store) == [] and K.read_current_dirs(spark, store).count() == 0
    assert K.read_current_seals(spark, store) is None
    os.remove(f"{root}/a/x.txt")
    os.rmdir(f"{root}/a")
    assert by_path(R.update(spark, root, store, log_deleted=True)) == {}


def test_generation_counts_on(spark, tmp_path):
    store = str(tmp_path / "store")
    K.init_store(spark, store)
    bags = spark.createDataFrame([("h", 1)], "hash string, size bigint")
    assert [K.store_bags(b, store, b) for b in (bags, bags.limit(0), bags)] == [1, 2, 3]
    assert K.read_bags(spark, store).count() == K.read_bags(spark, store, "dup_items").count() == 1


def test_retention(spark, tmp_path):
    store = str(tmp_path / "store")
    K.init_store(spark, store)
    for i in "123":
        K.publish_snapshot(manifest(spark, i), store, i, keep=1)
    assert sorted(os.listdir(f"{store}/snapshots")) == ["snapshot=2", "snapshot=3"] and names(spark, store) == ["3"]


def test_skip_existing_shuffles_no_content(spark):
    obs = spark.createDataFrame([("d", f"n{i}", f"d/n{i}", i % 2, 1, f"text {i}") for i in range(40)],
                                "dir string, name string, path string, mod_ms bigint, size bigint, content string")
    held = obs.select("dir", "name", "path", F.lit(0).cast("bigint").alias("mod_ms"), F.lit("md5").alias("algo"),
                      F.md5(F.col("content").cast("binary")).alias("hash"), "size")
    want = None
    for limit in ("2000000", "5"):
        spark.conf.set("spark.lakeaudit.broadcastMaxKeys", limit)
        try:
            t = A.audit(held, obs, skip_existing=True)
            plan = t._jdf.queryExecution().optimizedPlan().toString()
            rows = sorted((r["path"], r["status"], r["hash"]) for r in t.collect())
        finally:
            spark.conf.unset("spark.lakeaudit.broadcastMaxKeys")
        join = plan[plan.index("Join FullOuter"):]
        above = plan[:plan.index("Join FullOuter")]
        assert "content" not in above and join
        assert want is None or rows == want
        want = rows
    assert {s for _, s, _ in want} == {"ok"}
