"""File listings (S1) and file digests (H2, H5) on shared storage.

* ``list_files``: Spark's ``binaryFile`` source with recursive lookup,
  selecting only ``path, modificationTime, length`` (the content column is
  pruned, so no file is read).  Spark skips names starting with ``.`` or
  ``_``.
* ``walk``: the listing that sees every name, expanded one directory level
  per Spark job: the frontier of directories is a DataFrame, each task lists
  its directories (``mapInPandas``), files go to the result, subdirectories
  form the next frontier.  Each level is checkpointed to the shared
  checkpoint folder, so a lost executor only repeats its level.  The driver
  only learns whether the frontier is empty.
* ``hash_files``: digests of files too large for a row, read in blocks of
  256 KiB inside ``mapInPandas``; the file is stat-ed before and after and
  hashed again when both mtime and size moved meanwhile (H5).

Paths are URIs or local paths; non-local schemes go through ``pyarrow.fs``.
File names are bytes: one that is not UTF-8 stands in a table with each odd
byte as a character of a private range, from which the file's real name is
made again (``name_text``, ``name_bytes``).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeaudit.functions.hashing import check_algo
from lakeaudit.session import conf_int

BLOCK = 262_144
ROWS_PER_FRAME = 20_000

LISTING_SCHEMA = "dir string, name string, path string, kind string, mod_ms bigint, size bigint, error string"
WALK_SCHEMA = LISTING_SCHEMA + ", level int"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Regular files below ``root`` (hidden names excluded by Spark)."""
    root_uri = root if "://" in root or root.startswith("file:") else "file:" + os.path.abspath(root)
    prefix = root_uri.rstrip("/") + "/"
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
          .select("path", "modificationTime", "length"))
    rel = F.when(F.col("path").startswith(prefix), F.substring("path", len(prefix) + 1, 1 << 30)).otherwise(F.col("path"))
    return df.select(
        F.regexp_extract(rel, r"^(.*)/[^/]*$", 1).alias("dir"),
        F.regexp_extract(rel, r"([^/]*)$", 1).alias("name"),
        rel.alias("path"),
        F.lit("file").alias("kind"),
        F.unix_millis("modificationTime").alias("mod_ms"),
        F.col("length").cast("bigint").alias("size"),
        F.lit(None).cast("string").alias("error"),
    )


# byte b of a name that is not UTF-8 is the character ODD + b; characters of
# that range in a proper name are written by their own bytes, so nothing clashes
ODD = 0x10FF00


def name_text(name: str) -> str:
    """A name as the system gives it (odd bytes as surrogates), for a table."""
    if name.isascii():
        return name
    out = []
    for c in name:
        if 0xDC80 <= ord(c) <= 0xDCFF:
            out.append(chr(ODD + ord(c) - 0xDC00))
        elif ord(c) >= ODD + 0x80:
            out += [chr(ODD + b) for b in c.encode()]
        else:
            out.append(c)
    return "".join(out)


def name_bytes(text: str) -> str:
    """The name for the system, from that of a table."""
    if text.isascii():
        return text
    raw = "".join(chr(0xDC00 + ord(c) - ODD) if ord(c) >= ODD + 0x80 else c for c in text)
    return raw.encode("utf-8", "surrogateescape").decode("utf-8", "surrogateescape")


def _local(path: str) -> str | None:
    """The local name of a path, None when it is on another file system."""
    if path.startswith("file://"):
        path = path[len("file://"):]
    elif path.startswith("file:"):
        path = path[len("file:"):]
    elif "://" in path:
        return None
    return name_bytes(path)


def _list_dir(root: str, rel: str, follow_links: bool) -> Iterator[tuple]:
    """The entries of one directory; one that cannot be listed gives a row of
    kind ``error`` with an empty name, an entry that cannot be read one with
    its name, on every file system alike.  Links to directories are followed
    if asked for, links to files never."""
    base = root.rstrip("/") + ("/" + rel if rel else "")
    loc = _local(base)
    if loc is not None:
        try:
            with os.scandir(loc) as it:
                for e in it:
                    name = name_text(e.name)
                    p = f"{rel}/{name}" if rel else name
                    try:
                        if e.is_dir(follow_symlinks=follow_links):
                            yield rel, name, p, "dir", None, None, None
                        elif e.is_file(follow_symlinks=False):
                            st = e.stat(follow_symlinks=False)
                            yield rel, name, p, "file", int(st.st_mtime_ns // 1_000_000), st.st_size, None
                    except OSError as err:
                        yield rel, name, p, "error", None, None, name_text(str(err))
        except OSError as err:
            yield rel, "", rel, "error", None, None, name_text(str(err))
        return
    from pyarrow import fs as pafs

    try:
        fsys, p0 = pafs.FileSystem.from_uri(base)
        infos = fsys.get_file_info(pafs.FileSelector(p0, recursive=False))
    except OSError as err:
        yield rel, "", rel, "error", None, None, str(err)
        return
    for info in infos:
        p = f"{rel}/{info.base_name}" if rel else info.base_name
        if info.type == pafs.FileType.Directory:
            yield rel, info.base_name, p, "dir", None, None, None
        elif info.type == pafs.FileType.File:
            mod = int(info.mtime_ns // 1_000_000) if info.mtime_ns is not None else None
            yield rel, info.base_name, p, "file", mod, info.size, None


def walk(spark: SparkSession, root: str, *, follow_links: bool = True, max_depth: int = 0,
         recurse: bool = True, prune=None) -> DataFrame:
    """Every regular file and directory below ``root``: ``dir, name, path,
    kind ('file'|'dir'|'error'), mod_ms, size, error, level``.  Level 1 is the
    root's own content; ``max_depth`` stops after that many levels (0 = all),
    so directories of a level below it are the ones that were descended.

    ``prune(level_df, seen_df) -> DataFrame(path)``: the directories of a
    level to descend into, given that level's listing and everything listed
    so far (ignore rules found on the way); without it all are descended.
    """
    from lakeaudit.session import checkpoint_dir

    checkpoint_dir(spark)
    cols = ["dir", "name", "path", "kind", "mod_ms", "size", "error"]

    def lister(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # frames of bounded size, however large a directory is
        for pdf in it:
            entries = (e for rel in pdf["path"] for e in _list_dir(root, rel, follow_links))
            while rows := list(islice(entries, ROWS_PER_FRAME)):
                yield pd.DataFrame(rows, columns=cols)

    frontier = spark.createDataFrame([("",)], "path string")
    levels = []
    depth = 1
    while True:
        level = frontier.mapInPandas(lister, LISTING_SCHEMA).withColumn("level", F.lit(depth)).checkpoint()
        levels.append(level)
        if not recurse or (max_depth and depth >= max_depth):
            break
        if prune is None:
            frontier = level.where(F.col("kind") == "dir").select("path")
        else:
            seen = levels[0]
            for lv in levels[1:]:
                seen = seen.unionByName(lv)
            frontier = prune(level, seen).select("path").checkpoint()
        if frontier.isEmpty():
            break
        n = spark.sparkContext.defaultParallelism
        frontier = frontier.repartition(n)
        depth += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return out


def _stat(path: str):
    loc = _local(path)
    if loc is not None:
        st = os.stat(loc)
        return int(st.st_mtime_ns // 1_000_000), st.st_size
    from pyarrow import fs as pafs

    fsys, p = pafs.FileSystem.from_uri(path)
    info = fsys.get_file_info(p)
    return int(info.mtime_ns // 1_000_000), info.size


def _digest(path: str, algo: str) -> str:
    h = hashlib.md5() if algo == "md5" else hashlib.sha512()
    loc = _local(path)
    if loc is not None:
        with open(loc, "rb") as f:
            while True:
                b = f.read(BLOCK)
                if not b:
                    break
                h.update(b)
        return h.hexdigest()
    from pyarrow import fs as pafs

    fsys, p = pafs.FileSystem.from_uri(path)
    with fsys.open_input_stream(p) as f:
        while True:
            b = f.read(BLOCK)
            if not b:
                break
            h.update(b)
    return h.hexdigest()


def hash_file(path: str, algo: str) -> tuple[int | None, int | None, str | None, str | None]:
    """(mod_ms, size, hash, error) with the changed-while-hashing guard."""
    try:
        mod, size = _stat(path)
        digest = _digest(path, algo)
        mod2, size2 = _stat(path)
        if mod2 != mod and size2 != size:
            digest = _digest(path, algo)
            mod, size = mod2, size2
        return mod, size, digest, None
    except OSError as err:
        return None, None, None, name_text(str(err))


def hash_files(files: DataFrame, root: str, algo: str = "md5", algo_col: str | None = None,
               partitions: int | None = None) -> DataFrame:
    """Observed objects for files: ``files(dir, name, path)`` relative to
    ``root`` -> manifest columns plus ``error``.  ``algo_col`` names a column
    with a per-row algorithm (H3).

    With a ``size`` column the files are packed into tasks by size
    (``hash_tasks``); without, dealt by a hash of the path."""
    algo = check_algo(algo)
    base = root.rstrip("/")
    spark = files.sparkSession
    cols = ["dir", "name", "path", (F.col(algo_col) if algo_col else F.lit(algo)).alias("algo")]
    if partitions is None and "size" in files.columns:
        packed, n = hash_tasks(files.select(*cols, "size"), conf_int(spark, "hashTaskBytes"))
        sel = packed.repartitionById(n, F.col("task")).select("dir", "name", "path", "algo")
    else:
        sel = files.select(*cols).repartition(partitions or spark.sparkContext.defaultParallelism * 4, F.xxhash64("path"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            res = [hash_file(f"{base}/{p}", a or algo) for p, a in zip(pdf["path"], pdf["algo"])]
            out = pdf.copy()
            out["mod_ms"] = pd.array([r[0] for r in res], dtype="Int64")
            out["size"] = pd.array([r[1] for r in res], dtype="Int64")
            out["hash"] = [r[2] for r in res]
            out["error"] = [r[3] for r in res]
            yield out[["dir", "name", "path", "mod_ms", "algo", "hash", "size", "error"]]

    schema = "dir string, name string, path string, mod_ms bigint, algo string, hash string, size bigint, error string"
    return sel.mapInPandas(run, schema)


# files of which up to so many fit into a task are dealt by number
CLASSES = 6


def hash_tasks(files: DataFrame, task_bytes: int) -> tuple[DataFrame, int]:
    """``files`` with ``task``, and the number of tasks: one file, or at most
    1.2 times ``task_bytes``, to each; the largest files have the first ones.

    Files over 1.2 x have a task each; those of which 1 to 6 fit within it are
    dealt in such numbers; the rest, under a fifth each, are cut by the running
    sum of their bytes.  Places and running sums are distributed: rows are
    dealt to ranges, summed within each, and the sums of the ranges before (a
    row per range and class) are added."""
    room = 1.2 * task_bytes
    size = F.coalesce(F.col("size"), F.lit(0))
    fit = F.floor(F.lit(room) / F.greatest(size, F.lit(1)))
    kind = F.when(fit > CLASSES, CLASSES + 1).otherwise(fit).cast("int")
    spark = files.sparkSession
    least = spark.sparkContext.defaultParallelism * 4
    rows = files.withColumn("_kind", kind).withColumn("_size", size)
    rows = rows.repartitionByRange(least, "_kind", F.xxhash64("path")).withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = rows.groupBy("_range", "_kind").agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("bytes")).orderBy("_kind", "_range").collect()
    before, total = [], {}
    for r in sums:
        n, held = total.get(r["_kind"], (0, 0))
        before.append((r["_range"], r["_kind"], n, held))
        total[r["_kind"]] = (n + r["n"], held + r["bytes"])
    # small files fill the tasks of a whole cluster before they fill their room
    small = min(task_bytes, max(1, -(-total.get(CLASSES + 1, (0, 0))[1] // least)))
    first, at = [], 0
    for k in range(CLASSES + 2):
        n, held = total.get(k, (0, 0))
        first.append(at)
        at += n if k == 0 else -(-n // k) if k <= CLASSES else (held // small + 1 if n else 0)
    before = spark.createDataFrame(before, "_range int, _kind int, _n0 long, _b0 long")
    start = F.create_map(*[F.lit(x) for k, f in enumerate(first) for x in (k, f)])
    order = Window.partitionBy("_range", "_kind").orderBy("path", "dir")
    rows = (rows.join(F.broadcast(before), ["_range", "_kind"])
            .withColumn("_place", F.col("_n0") + F.row_number().over(order) - 1)
            .withColumn("_start", F.col("_b0") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size")))
    within = (F.when(F.col("_kind") == 0, F.col("_place")).when(F.col("_kind") <= CLASSES, F.floor(F.col("_place") / F.greatest("_kind", F.lit(1))))
              .otherwise(F.floor(F.col("_start") / F.lit(small))))
    return rows.withColumn("task", (start[F.col("_kind")] + within).cast("int")).select(*files.columns, "task"), max(1, at)
