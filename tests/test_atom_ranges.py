"""One atom file decoded by many tasks: the same rows as by one."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeaudit.sources import manifests as MF

ODD = ['a"b', "br{ace", "}", "x\\\\", "tab\t", "été", "\u2028", "quote\\\"", "co,mma", "[", "", "日本"]


def index(rng, n, style):
    idx = {f"{rng.choice(ODD)}{i}.txt": {"mod": i, "a": "md5", "h": f"h{rng.choice(ODD)}{i}", "s": i} for i in range(n)}
    text = json.dumps(idx, ensure_ascii=style % 2 == 0, separators=(",", ":"))
    more = ', "dirlist": ["a", "b{"]' if style % 3 == 0 else ""
    return f'{{ "v":2,"idx":{text},"idx_hash":"{hashlib.md5(text.encode()).hexdigest()}"{more} }}'


def atom(seed, dirs=12):
    rng = random.Random(seed)
    names = [f"{rng.choice(ODD)}d{i % 9}" for i in range(dirs)]  # some come twice
    members = [f'{json.dumps(n, ensure_ascii=seed % 2 == 0)} :{" " * rng.randint(0, 3)}{index(rng, rng.randint(0, 6), i)}' for i, n in enumerate(names)]
    return f'{{"type":"{MF.ATOM_TYPE}","version": {MF.ATOM_VERSION} ,"data":{{{" , ".join(members)}}} }}\n'


def read(spark, root, paths, step):
    files = spark.createDataFrame([(p, "top") for p in paths], "path string, dir string")
    entries, indexes = MF.read_atom_manifest(files, root, range_bytes=step)
    return (sorted(tuple(r) for r in entries.collect()),
            sorted((r.source, r.dir, r.verified, r.converted, r.dirlist, r.error is not None) for r in indexes.collect()))


def write(tmp_path, texts):
    for k, t in enumerate(texts):
        (tmp_path / f"f{k}").write_bytes(t if isinstance(t, bytes) else t.encode())
    return str(tmp_path), [f"f{k}" for k in range(len(texts))]


@pytest.mark.parametrize("step", [7, 61, 640])
def test_same_rows_as_in_one_task(spark, tmp_path, step):
    good = [atom(s) for s in range(3)] + [f'{{"type":"{MF.ATOM_TYPE}","version":6,"data":{{ }} }}']
    t = good[0]
    header = len(t.split("data")[0]) + 7
    broken = [t[:-3], t[:len(t) // 2], t.replace('"version": 6', '"version": 5'), t.replace('"type"', '"kind"'), t[:header] + "," + t[header:],
              t.rstrip()[:-1].rstrip()[:-1] + ",}}", t.replace('"mod":0', '"mod":0 0', 1), t.replace('"v":2', '"v:2', 1), t + t, "{}" * 40,
              t.encode().replace(b"top", b"t\xffp").replace(b'"v":2', b'"v\xff":2', 1), "[" * 90, "x" * 100, '"' * 99]
    root, paths = write(tmp_path, good + broken)
    want = read(spark, root, paths, 1 << 20)
    got = read(spark, root, paths, step)
    assert got == want
    bad = {r[0] for r in want[1] if r[-1]}
    assert not bad & {"f0", "f1", "f2", "f3"} and len(bad) == len(broken) - 1  # what follows a whole document is not read
    assert len(want[0]) > 30


def test_scan_of_a_range_in_both_cases():
    """States and depths against a plain scanner, cut anywhere."""
    text = atom(5).encode()
    state = [(False, False, 0)]
    for c in text:
        inside, escaped, depth = state[-1]
        if inside:
            state.append((not (c == 34 and not escaped), c == 92 and not escaped, depth))
        else:
            state.append((c == 34, False, depth + (c in b"{[") - (c in b"}]")))
    data = np.frombuffer(text, np.uint8)
    for s in range(0, len(text), 13):
        for e in (s + 1, s + 40, len(text)):
            part = data[s:e]
            outside, after = MF._outside(part, state[s][0], state[s][1])
            assert after == state[min(e, len(text))][0]
            assert state[s][2] + MF._nesting(part, outside)[1].sum() == state[min(e, len(text))][2]


def test_many_tasks(spark, tmp_path):
    """A file of 60,000 entries in ranges of 64 KB: no task has much of it."""
    idx = [json.dumps({f"n{j}": {"mod": 1, "a": "md5", "h": f"{i}-{j}", "s": 1} for j in range(60)}) for i in range(1000)]
    text = f'{{"type":"{MF.ATOM_TYPE}","version":6,"data":{{' + ",".join(f'"d{i}":{{"v":2,"idx":{x},"idx_hash":""}}' for i, x in enumerate(idx)) + "}}"
    root, paths = write(tmp_path, [text])
    files = spark.createDataFrame([(p, "", len(text)) for p in paths], "path string, dir string, size long")
    rows = MF._in_ranges(files, root, MF.ATOM_TYPE, 65536).withColumn("task", F.spark_partition_id()).where("kind = 'E'")
    sizes = [r["count"] for r in rows.groupBy("task").count().collect()]
    assert sum(sizes) == 60_000 and max(sizes) < 20_000 and len(sizes) > 6
    entries, _ = MF.read_atom_manifest(files, root, range_bytes=65536)
    assert entries.count() == 60_000
