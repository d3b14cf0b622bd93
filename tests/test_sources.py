"""Manifest formats, hidden-aware walk, file hashing, store sinks, streaming rates."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lakeaudit.sinks import store as K
from lakeaudit.sources import listing as L
from lakeaudit.sources import manifests as MF
from lakeaudit.sources.manifests import compact_escaped, parse_index


def go_json(obj) -> str:
    """Compact JSON, map keys sorted, entry fields in declared order, HTML
    escaping -- like the tool's writer."""
    s = "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + json.dumps(v, separators=(",", ":"), ensure_ascii=False)
                       for k, v in sorted(obj.items())) + "}"
    return s.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def v2(entries, dirlist=None, broken=False):
    idx = go_json(entries)
    h = hashlib.md5(idx.encode()).hexdigest()
    if broken:
        h = "0" * 32
    out = '{"v":2,"idx":' + idx + ',"idx_hash":"' + h + '"'
    if dirlist is not None:
        out += ',"dirlist":' + json.dumps(dirlist)
    return out + "}"


E1 = {"a.txt": {"mod": 1000, "a": "md5", "h": "aa", "s": 3}, "b<c>.txt": {"mod": 2000, "a": "sha512", "h": "bb", "s": 4}}


def test_parse_v2_seals():
    ents, dirs, ok, conv = parse_index(v2(E1, ["sub"]))
    assert ok and not conv and dirs == ["sub"]
    assert sorted(ents) == [("a.txt", 1000, "md5", "aa", 3), ("b<c>.txt", 2000, "sha512", "bb", 4)]
    assert parse_index(v2(E1, broken=True))[2] is False
    # written with spaces and unescaped '<' by another writer, sealed over the compact escaped text
    idx = go_json(E1)
    spaced = json.dumps(E1, ensure_ascii=False, indent=1)
    text = '{"v": 2, "idx": ' + spaced + ', "idx_hash": "' + hashlib.md5(idx.encode()).hexdigest() + '"}'
    assert compact_escaped(spaced) == idx
    assert parse_index(text)[2] is True


def test_parse_legacy_forms():
    py = {"x": {"mod": 5, "md5": "mm"}}
    idx = go_json(py)
    text = '{"v":1,"idx":' + idx + ',"idx_hash":"' + hashlib.md5(idx.encode()).hexdigest() + '"}'
    ents, _, ok, conv = parse_index(text)
    assert ents == [("x", 5, "md5", "mm", None)] and ok and not conv
    js = '{"data":{"y":{"mod":7,"md5":"jj"}}}'
    ents, _, ok, conv = parse_index(js)
    assert ents == [("y", 7, "md5", "jj", None)] and ok and conv
    ents, _, ok, conv = parse_index("{}")
    assert ents == [] and ok and conv


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_walk_split_and_atom(spark, tmp_path):
    root = str(tmp_path / "lake")
    _write(f"{root}/.lakeindex", v2({"top.txt": {"mod": 1, "a": "md5", "h": "t", "s": 1}}, ["d"]))
    _write(f"{root}/top.txt", "x")
    _write(f"{root}/d/.lakeindex", v2({"f.txt": {"mod": 2, "a": "md5", "h": "f", "s": 1}}, []))
    _write(f"{root}/d/f.txt", "y")
    _write(f"{root}/d/.hidden", "h")
    _write(f"{root}/_under", "u")
    listing = L.walk(spark, root)
    names = sorted(r["path"] for r in listing.where("kind = 'file'").collect())
    assert names == sorted([".lakeindex", "_under", "d/.lakeindex", "d/.hidden", "d/f.txt", "top.txt"])
    assert sorted(r["path"] for r in L.walk(spark, root, max_depth=1).where("kind='file'").collect()) == \
        [".lakeindex", "_under", "top.txt"]
    # Spark's own listing skips hidden names
    assert sorted(r["path"] for r in L.list_files(spark, root).collect()) == ["d/f.txt", "top.txt"]
    idx_files = listing.where("kind = 'file' AND name = '.lakeindex'").select("path", "dir")
    entries, indexes = MF.read_split_manifests(idx_files, root)
    assert sorted((r["path"], r["hash"]) for r in entries.collect()) == [("d/f.txt", "f"), ("top.txt", "t")]
    assert all(r["verified"] for r in indexes.collect())


def test_atom(spark, tmp_path):
    root = str(tmp_path / "a")
    good = ('{"type":"lakeindex","version":6,"data":{"":' + v2({"r": {"mod": 1, "a": "md5", "h": "r0", "s": 1}})
            + ',"sub":' + v2({"s": {"mod": 1, "a": "md5", "h": "s0", "s": 1}})
            + ',"sub":' + v2({"s2": {"mod": 1, "a": "md5", "h": "s1", "s": 1}}) + "}}")
    _write(f"{root}/x/.lakeindex-db", good)
    _write(f"{root}/y/.lakeindex-db", '{"type":"lakeindex","version":5,"data":{}}')
    _write(f"{root}/z/.lakeindex-db", '{"version":6,"type":"lakeindex","data":{}}')
    files = spark.createDataFrame([("x/.lakeindex-db", "x"), ("y/.lakeindex-db", "y"), ("z/.lakeindex-db", "z")],
                                  "path string, dir string")
    entries, indexes = MF.read_atom_manifest(files, root)
    assert sorted((r["path"], r["hash"]) for r in entries.collect()) == [("x/r", "r0"), ("x/sub/s2", "s1")]
    errs = {r["source"]: r["error"] for r in indexes.where("error IS NOT NULL").collect()}
    assert set(errs) == {"y/.lakeindex-db", "z/.lakeindex-db"}


def test_hash_files(spark, tmp_path):
    root = str(tmp_path / "h")
    data = {"a/one.bin": b"abc" * 100000, "two.bin": b"", "b/c/three": os.urandom(300000)}
    for p, b in data.items():
        os.makedirs(os.path.dirname(f"{root}/{p}") or root, exist_ok=True)
        with open(f"{root}/{p}", "wb") as f:
            f.write(b)
    files = spark.createDataFrame([(os.path.dirname(p), os.path.basename(p), p) for p in data] + [("", "gone", "gone")],
                                  "dir string, name string, path string")
    got = {r["path"]: r for r in L.hash_files(files, root, "sha512").collect()}
    for p, b in data.items():
        assert got[p]["hash"] == hashlib.sha512(b).hexdigest() and got[p]["size"] == len(b)
    assert got["gone"]["hash"] is None and got["gone"]["error"]


def test_store_publish_and_merge(spark, tmp_path):
    store = str(tmp_path / "store")
    K.init_store(spark, store)
    with pytest.raises(FileExistsError):
        K.init_store(spark, store)
    K.init_store(spark, store, force=True)
    assert K.read_current(spark, store).count() == 0
    m1 = spark.createDataFrame([("d", "a", "d/a", 1, "md5", "h1", 1), ("e", "b", "e/b", 1, "md5", "h2", 1)],
                               "dir string, name string, path string, mod_ms bigint, algo string, hash string, size bigint")
    K.publish_snapshot(m1, store, "1")
    assert K.current_id(spark, store) == "1" and K.read_current(spark, store).count() == 2
    m2 = spark.createDataFrame([("d", "a", "d/a", 2, "md5", "h9", 1)], m1.schema)
    changed = spark.createDataFrame([("d",)], "dir string")
    merged = K.merge_changed(K.read_current(spark, store), m2, changed, scope=changed)
    assert sorted((r["path"], r["hash"]) for r in merged.collect()) == [("d/a", "h9"), ("e/b", "h2")]
    K.publish_snapshot(merged, store, "2")
    assert K.current_id(spark, store) == "2"
    bags = spark.createDataFrame([("h", 10)], "hash string, size bigint")
    assert K.store_bags(bags, store) == 1
    assert K.store_bags(bags, store) == 2
    assert K.read_bags(spark, store).count() == 1


def test_stream_rate_buckets(spark, tmp_path):
    from lakeaudit.streaming.rates import stream_rate_buckets

    src = str(tmp_path / "events")
    ev = spark.createDataFrame(
        [("k", "2024-01-01 00:00:00"), ("k", "2024-01-01 01:00:00"), ("k", "2024-01-01 01:00:00.001"),
         ("k", "2024-01-01 05:00:00")], "event_type string, ts string"
    ).select("event_type", F.to_timestamp("ts").alias("ts"), F.lit(1.0).alias("value"))
    ev.write.parquet(src)
    stream = spark.readStream.schema(ev.schema).parquet(src)
    q = (stream_rate_buckets(stream, "ts", "event_type", "value", "1 hour", "1 hour")
         .writeStream.outputMode("append").format("memory").queryName("rates_t").start())
    q.processAllAvailable()
    q.stop()
    rows = sorted((str(r["bucket_end"]), r["events"]) for r in spark.sql("SELECT * FROM rates_t").collect())
    # the event exactly at 01:00 stays in the bucket ending at 01:00
    assert ("2024-01-01 01:00:00", 1) in rows and ("2024-01-01 02:00:00", 1) in rows


def test_fuse_tree(spark, tmp_path):
    from lakeaudit.plans.run import fuse_tree, locate_roots
    from lakeaudit.sinks.store import read_current

    root = str(tmp_path / "lake")
    e = lambda h: {"f.txt": {"mod": 1, "a": "md5", "h": h, "s": 1}}
    _write(f"{root}/.lakeindex", v2(e("top")))                                   # the fuse root's own: not taken
    _write(f"{root}/a/.lakeindex", v2(e("a-split")))                             # shadowed by the atom in a
    _write(f"{root}/a/.lakeindex-db", '{"type":"lakeindex","version":6,"data":{"":' + v2(e("a-atom"))
           + ',"b":' + v2(e("ab-from-atom")) + "}}")
    _write(f"{root}/a/b/.lakeindex", v2(e("ab-split")))                          # deeper: wins for a/b
    _write(f"{root}/c/.lakeindex", "{not json")                                  # invalid: skipped
    _write(f"{root}/d/.lakeindex", '{"data":{"old.txt":{"mod":5,"md5":"legacy"}}}')
    store = str(tmp_path / "store")
    fused, report = fuse_tree(spark, root, store)
    got = sorted((r["path"], r["hash"]) for r in fused.collect())
    assert got == [("a/b/f.txt", "ab-split"), ("a/f.txt", "a-atom"), ("d/old.txt", "legacy")]
    assert report.where("error IS NOT NULL").count() == 1
    assert sorted((r["path"], r["hash"]) for r in read_current(spark, store).collect()) == got
    roots = {(r["root"], r["kind"]) for r in locate_roots(L.walk(spark, root)).collect()}
    assert ("a", "atom") in roots and ("a", "split") in roots and ("a/b", "split") in roots


def test_changed_while_hashing(tmp_path, monkeypatch):
    """H5: when mtime and size both move during the read, the file is hashed
    again and the later stat is kept; one of them moving is not enough."""
    p = tmp_path / "f.bin"
    p.write_bytes(b"abc")
    calls = {"stat": 0, "digest": 0}
    real_digest = L._digest

    def fake_stat(path, seq):
        calls["stat"] += 1
        return seq[min(calls["stat"], len(seq)) - 1]

    def counting_digest(path, algo):
        calls["digest"] += 1
        return real_digest(path, algo)

    monkeypatch.setattr(L, "_digest", counting_digest)
    monkeypatch.setattr(L, "_stat", lambda path: fake_stat(path, [(1, 3), (2, 4)]))
    mod, size, digest, err = L.hash_file(str(p), "md5")
    assert (mod, size, err) == (2, 4, None) and calls["digest"] == 2
    assert digest == hashlib.md5(b"abc").hexdigest()
    calls.update(stat=0, digest=0)
    monkeypatch.setattr(L, "_stat", lambda path: fake_stat(path, [(1, 3), (2, 3)]))
    mod, size, _, _ = L.hash_file(str(p), "md5")
    assert (mod, size) == (1, 3) and calls["digest"] == 1
