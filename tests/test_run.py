"""End to end on a generated tree, after the reference's integration test:
new -> delete (dir reported once) -> repeat -> add-only -> older rewrite ->
dot files -> silent damage."""

import os

from pyspark.sql import functions as F

from lakeaudit.plans.run import update


def _w(path, text, mtime=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)
    if mtime is not None:
        os.utime(path, (mtime, mtime))


def _counts(res):
    return dict(res.events.groupBy("status").count().collect())


def test_tree_end_to_end(spark, tmp_path):
    root = str(tmp_path / "root")
    store = str(tmp_path / "store")
    t0 = 1_600_000_000
    _w(f"{root}/a/x1.txt", "x1", t0)
    _w(f"{root}/a/x2.txt", "x2", t0)
    _w(f"{root}/a/sub/y1.txt", "y1", t0)
    _w(f"{root}/a/sub/y2.txt", "y2", t0)
    _w(f"{root}/b/z1.txt", "z1", t0)
    _w(f"{root}/b/z2.csv", "z2", t0)
    _w(f"{root}/b/.lakeignore", "# skip tables\n*.csv\n", t0)
    _w(f"{root}/c/w.txt", "w", t0)

    r = update(spark, root, store)
    s = r.summary.first()
    assert (s["total"], s["new"], s["upd"], s["del"]) == (6, 6, 0, 0)
    assert r.next_manifest.count() == 6

    # delete a directory and a file: two removals (files below the directory are not listed)
    for p in ("a/sub/y1.txt", "a/sub/y2.txt"):
        os.remove(f"{root}/{p}")
    os.rmdir(f"{root}/a/sub")
    os.remove(f"{root}/c/w.txt")
    chk = update(spark, root, store, readonly=True, log_deleted=True)
    dels = sorted(r["path"] for r in chk.events.where("status = 'del'").collect())
    assert dels == ["a/sub", "c/w.txt"]
    assert chk.summary.first()["del"] == 2
    assert update(spark, root, store, readonly=True).events.where("status = 'del'").count() == 0

    r = update(spark, root, store, log_deleted=True)
    assert r.summary.first()["del"] == 2
    r = update(spark, root, store)
    s = r.summary.first()
    assert (s["total"], s["new"], s["upd"], s["del"]) == (3, 0, 0, 0)

    # add only, skipping unchanged files
    _w(f"{root}/d/n1.txt", "n1", t0)
    _w(f"{root}/a/n2.txt", "n2", t0)
    r = update(spark, root, store, skip_existing=True)
    s = r.summary.first()
    assert (s["total"], s["new"], s["changed_dirs"]) == (2, 2, 3)

    # rewrite with an older date
    _w(f"{root}/a/x1.txt", "x1 again", t0 - 3600)
    r = update(spark, root, store, skip_existing=True)
    assert _counts(r).get("old") == 1

    # dot names are out unless included; they are reported as ignored
    _w(f"{root}/.hid/q.txt", "q", t0)
    _w(f"{root}/b/.dot", "d", t0)
    r = update(spark, root, store)
    assert r.summary.first()["new"] == 0
    ign = sorted(x["path"] for x in r.events.where("status = 'ign'").collect())
    assert ign == [".hid", "b/.dot", "b/z2.csv"]
    chk = update(spark, root, store, readonly=True, include_dot=True, hide_new=True)
    assert chk.summary.first()["new"] == 0 and chk.events.where("status = 'new'").count() == 0
    r = update(spark, root, store, include_dot=True)
    assert r.summary.first()["new"] == 2

    # silent damage: content changes, mtime does not
    _w(f"{root}/a/x2.txt", "x2 damaged", t0)
    r = update(spark, root, store, readonly=True)
    assert [x["path"] for x in r.events.where("status = 'DMG'").collect()] == ["a/x2.txt"]
    assert r.verdict.first()["exit_code"] == 1


def test_dedup_cycle(spark, tmp_path):
    from lakeaudit.plans.run import dedup_detect, dedup_plan, dedup_show

    root = str(tmp_path / "root")
    store = str(tmp_path / "store")
    body = "x" * 9000
    for p in ("a/1.bin", "a/2.bin", "b/3.bin"):
        _w(f"{root}/{p}", body, 1_600_000_000)
    _w(f"{root}/b/small.bin", "y", 1_600_000_000)
    _w(f"{root}/b/small2.bin", "y", 1_600_000_000)
    update(spark, root, store)
    loc = spark.createDataFrame([("a/1.bin", "P"), ("a/2.bin", "P"), ("b/3.bin", "Q")], "path string, place string")
    assert dedup_detect(spark, store, loc) == 1
    show, report = dedup_show(spark, store)
    b = show.first()
    assert (b["n_items"], b["shared"], b["exclusive"]) == (3, 18000, 18000)
    r = report.first()
    assert (r["hashes"], r["files"], r["min_space"], r["max_space"], r["actual_space"]) == (1, 3, 9000, 27000, 18000)
    plan = [tuple(x) for x in dedup_plan(spark, store).collect()]
    assert [(k, d, n) for _, k, d, n in plan] == [("a/1.bin", "b/3.bin", 9000)]
    assert dedup_detect(spark, store, loc) == 2


def test_ignored_directories_are_not_listed(spark, tmp_path):
    from lakeaudit.operators import ignore as I
    from lakeaudit.plans.run import read_ignore_files, update
    from lakeaudit.sources.listing import walk

    root = str(tmp_path / "root")
    store = str(tmp_path / "store")
    _w(f"{root}/.lakeignore", "node_modules\n", 1_600_000_000)
    _w(f"{root}/app/main.txt", "m", 1_600_000_000)
    for i in range(3):
        _w(f"{root}/app/node_modules/pkg{i}/deep/x.txt", "x", 1_600_000_000)

    def prune(level, seen):
        dirs = level.where("kind = 'dir'")
        return I.apply_ignore(dirs, read_ignore_files(seen, root)).select("path")

    listed = [r["path"] for r in walk(spark, root, prune=prune).collect()]
    assert "app/node_modules" in listed and not any("pkg" in p for p in listed)
    s = update(spark, root, store).summary.first()
    assert (s["total"], s["new"], s["errors"]) == (1, 1, 0)


def test_bad_seal_is_reported(spark, tmp_path):
    from lakeaudit.sinks import store as K

    root = str(tmp_path / "root")
    store = str(tmp_path / "store")
    _w(f"{root}/a/x.txt", "x", 1_600_000_000)
    _w(f"{root}/b/y.txt", "y", 1_600_000_000)
    update(spark, root, store)
    assert update(spark, root, store, readonly=True).events.where("status = 'ERX'").count() == 0
    # tamper with the stored rows of directory a behind the store's back
    sid = K.current_id(spark, store)
    part = f"{store}/snapshots/snapshot={sid}"
    rows = spark.read.parquet(part).withColumn("mod_ms", F.col("mod_ms") + F.lit(1)).collect()
    spark.createDataFrame(rows, spark.read.parquet(part).schema).where("dir = 'a'").unionByName(
        spark.createDataFrame(rows, spark.read.parquet(part).schema).where("dir <> 'a'").withColumn(
            "mod_ms", F.col("mod_ms") - F.lit(1))).write.mode("overwrite").parquet(part)
    r = update(spark, root, store, readonly=True)
    assert [(x["path"], x["status"]) for x in r.events.where("status = 'ERX'").collect()] == [("a", "ERX")]
    assert r.summary.first()["changed_dirs"] >= 1
