"""Bitmaps of keys, and files packed into tasks."""

import random

from pyspark.sql import functions as F

from lakeaudit.operators import audit as A
from lakeaudit.operators import keyset as S
from lakeaudit.sources import listing as L


def test_no_key_is_missed(spark):
    keys = spark.range(0, 300_000, 3).select(F.xxhash64("id").alias("k"))
    for bits in (None, S.BITMAP):  # as large as asked for, and overfull
        if bits:
            spark.conf.set("spark.lakeaudit.keySetMaxBits", str(bits))
        try:
            df = S.mark(spark.range(300_000), F.xxhash64("id"), keys, "k", 100_000, "hit")
            n = df.groupBy((F.col("id") % 3 == 0).alias("key")).agg(F.count_if("hit").alias("hits"), F.count("*").alias("n")).collect()
        finally:
            spark.conf.unset("spark.lakeaudit.keySetMaxBits")
        by = {r.key: r for r in n}
        assert by[True].hits == by[True].n == 100_000
        assert by[False].hits < 0.08 * by[False].n if not bits else by[False].hits > 0


def test_skip_existing_reads_little(spark):
    """With many changed keys the others are not digested, and the result is
    that of digesting everything."""
    n = 60_000
    obs = spark.range(n).select(F.lit("d").alias("dir"), F.concat(F.lit("n"), "id").alias("name"), F.concat(F.lit("d/n"), "id").alias("path"),
                                (F.col("id") % 4).alias("mod_ms"), F.lit(1).cast("long").alias("size"), F.concat(F.lit("text "), "id").alias("content"))
    held = obs.select("dir", "name", "path", F.lit(0).cast("long").alias("mod_ms"), F.lit("md5").alias("algo"), F.md5(F.col("content").cast("binary")).alias("hash"), "size")
    left = A._skip_unchanged(obs, held).groupBy("mod_ms").agg(F.count("content").alias("read")).collect()
    read = {r.mod_ms: r.read for r in left}
    assert read[1] == read[2] == read[3] == n // 4 and read[0] < 0.2 * n // 4
    t = A.audit(held, obs, skip_existing=True)
    plan = t._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in plan[:plan.index("Join FullOuter")]
    assert t.groupBy("status").count().collect()[0]["count"] == n
    same = A._skip_unchanged(obs, obs.select("path", "mod_ms"))
    assert same.where("content IS NOT NULL").count() == 0


def test_files_are_packed_by_size(spark):
    rng = random.Random(3)
    room = 1000
    sizes = [rng.choice([rng.randint(0, 60), rng.randint(60, 400), rng.randint(400, 1300), rng.randint(1300, 9000), None]) for _ in range(3000)]
    sizes += [0] * 500 + [50_000, 1200, 1201, 600, 601]
    files = spark.createDataFrame([("d", f"n{i}", f"d/n{i}", s) for i, s in enumerate(sizes)], "dir string, name string, path string, size long").repartition(7)
    packed, n = L.hash_tasks(files, room)
    tasks = {}
    for r in packed.collect():
        tasks.setdefault(r.task, []).append(r.size or 0)
    assert sum(map(len, tasks.values())) == len(sizes) and 0 <= min(tasks) and max(tasks) < n
    assert all(len(t) == 1 or sum(t) <= 1.2 * room for t in tasks.values())
    assert all(len(tasks[k]) == 1 for k in range(sum((s or 0) > 1.2 * room for s in sizes)))  # the largest first
    total = sum(s or 0 for s in sizes)
    assert n < 2.5 * total / room + 20
    # every task is a partition of its own
    at = packed.repartitionById(n, F.col("task")).withColumn("p", F.spark_partition_id())
    assert at.where("p <> task").count() == 0
    empty, n = L.hash_tasks(files.limit(0), room)
    assert n == 1 and empty.count() == 0
