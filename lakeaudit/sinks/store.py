"""Manifest store on shared storage (K1-K4).

Layout under ``store``::

    snapshots/snapshot=<id>/    a whole manifest (a base), or a run's delta: all
                                entries of the directories it changed
    changed/snapshot=<id>/      of a delta: the directories it speaks for
    dirs/snapshot=<id>/         directory lists (dir, subdir) of the same directories
    seals/snapshot=<id>/        per-directory seals (dir, seal) of the same rows
    current/<sequence>/         one row: a published version
    dups/gen=<n>/               duplicate bags of a detect run
    dup_items/gen=<n>/          their items
    dups_current/<sequence>/    one row: a published generation

A version is a base and the deltas published on it.  Of each directory the
newest part that speaks for it counts, be it without entries; so a run writes
what it changed and no more, and ``compact`` folds the deltas into a new base.

Bases and deltas are bucketed by path and in the order of paths within a file
(O4): the audit, which joins on the path, reads the stored side without a
shuffle (K2).  Files that were not written so are read plainly.

A run writes its own folders and then adds a new pointer folder, moved into
place when it is complete; the newest pointer counts.  A run that dies
anywhere before that publishes nothing, what it left behind is replaced by
the next attempt, and the previous version stays as the backup (K2).  Of two
runs that began with the same version the second to publish fails.  An id
that was published once is never written again.  The duplicate result (K4) is
published alike; its generation is the pointer, so it goes on counting after
an empty result.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.operators.joins import is_small, lookup_join
from lakeaudit.schema import DIRS_SCHEMA, MANIFEST_COLUMNS, MANIFEST_SCHEMA
from lakeaudit.session import checkpoint_dir, conf_int

SEALS_SCHEMA = "dir string, seal string"
_PARTS = ("snapshots", "changed", "dirs", "seals", "current", "dups", "dup_items", "dups_current")
_BUCKET_FILE = re.compile(r"_\d{5}(\..*)?$")
# a version with this many deltas gets a new base
MAX_DELTAS = 16


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _latest(spark: SparkSession, path: str) -> int:
    """The newest complete pointer of a pointer folder, 0 when none."""
    done = [int(n) for n in _names(spark, path) if n.isdigit() and _exists(spark, f"{path}/{n}/_SUCCESS")]
    return max(done, default=0)


def _point(spark: SparkSession, path: str, value: str, after: int | None = None) -> int:
    """Add the pointer that follows ``after`` (the newest one when None)."""
    seq = (_latest(spark, path) if after is None else after) + 1
    at = f"{path}/{seq:012d}"
    if _exists(spark, f"{at}/_SUCCESS"):
        raise RuntimeError(f"another run has published meanwhile: {at}")
    _delete(spark, at)  # left unfinished
    new = f".next-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(value).alias("value")).coalesce(1).write.parquet(f"{path}/{new}")
    fs, source = _hadoop(spark, f"{path}/{new}")
    moved = fs.rename(source, _hadoop(spark, at)[1])
    # a folder that was there already takes the new one inside, or refuses it
    if not moved or _exists(spark, f"{at}/{new}"):
        _delete(spark, f"{at}/{new}" if moved else f"{path}/{new}")
        raise RuntimeError(f"another run has published meanwhile: {at}")
    return seq


def _pointed(spark: SparkSession, path: str) -> str | None:
    seq = _latest(spark, path)
    return spark.read.schema("value string").parquet(f"{path}/{seq:012d}").first()["value"] if seq else None


def store_exists(spark: SparkSession, store: str) -> bool:
    return _latest(spark, f"{store}/current") > 0


def init_store(spark: SparkSession, store: str, force: bool = False) -> None:
    """K1: an empty store; refuses an existing one unless ``force``, which
    clears all of it.  What an unfinished ``init_store`` left is replaced."""
    if store_exists(spark, store) and not force:
        raise FileExistsError(f"store already exists: {store}")
    # the pointers go first: from here on there is no published state
    for part in reversed(_PARTS):
        _delete(spark, f"{store}/{part}")
    spark.createDataFrame([], MANIFEST_SCHEMA).write.mode("overwrite").parquet(f"{store}/snapshots/snapshot=0")
    _point(spark, f"{store}/current", "0")


def ensure_store(spark: SparkSession, store: str) -> None:
    """Create the store when it is missing, on whatever file system."""
    if not store_exists(spark, store):
        init_store(spark, store)


@dataclass(frozen=True)
class Version:
    """A published state: a base, the deltas on it, and what they carry."""

    id: str
    base: str
    deltas: tuple[str, ...] = ()
    buckets: int = 0
    dirs: bool = True
    seals: bool = True
    seq: int = 0

    @property
    def parts(self) -> tuple[str, ...]:
        return (self.base, *self.deltas)

    def text(self) -> str:
        return json.dumps({"id": self.id, "base": self.base, "deltas": self.deltas, "buckets": self.buckets,
                           "dirs": self.dirs, "seals": self.seals})


def _version(value: str, seq: int = 0) -> Version:
    if not value.startswith("{"):
        return Version(value, value, seq=seq)
    v = json.loads(value)
    return Version(v["id"], v["base"], tuple(v["deltas"]), v["buckets"], v["dirs"], v["seals"], seq)


def current(spark: SparkSession, store: str) -> Version:
    seq = _latest(spark, f"{store}/current")
    if not seq:
        raise FileNotFoundError(f"no published snapshot in {store}")
    return _version(spark.read.schema("value string").parquet(f"{store}/current/{seq:012d}").first()["value"], seq)


def current_id(spark: SparkSession, store: str) -> str:
    return current(spark, store).id


def _published(spark: SparkSession, store: str) -> list[Version]:
    """Every version that is still pointed to, oldest first."""
    path = f"{store}/current"
    done = sorted(int(n) for n in _names(spark, path) if n.isdigit() and _exists(spark, f"{path}/{n}/_SUCCESS"))
    return [_version(spark.read.schema("value string").parquet(f"{path}/{n:012d}").first()["value"], n) for n in done]


def next_id(spark: SparkSession, store: str) -> str:
    """The id of the next run: a number, whatever earlier ids were called."""
    n = _latest(spark, f"{store}/current")
    while _exists(spark, f"{store}/snapshots/snapshot={n}") and any(str(n) in v.parts for v in _published(spark, store)):
        n += 1
    return str(n)


def _table(spark: SparkSession, at: str, buckets: int) -> str:
    """A name for a bucketed folder, to be dropped after use (the files stay)."""
    fs, p = _hadoop(spark, at)
    name = f"lake_part_{uuid.uuid4().hex}"
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MANIFEST_SCHEMA.fields)
    where = fs.makeQualified(p).toString().replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (path) SORTED BY (path) INTO {buckets} BUCKETS LOCATION '{where}'")
    return name


def _write_part(manifest: DataFrame, at: str, buckets: int) -> None:
    """A manifest into its folder: one file per bucket that has rows, each in
    the order of paths."""
    spark = manifest.sparkSession
    _delete(spark, at)
    name = _table(spark, at, buckets)
    try:
        manifest.select(*MANIFEST_COLUMNS).repartition(buckets, "path").write.insertInto(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def _read_part(spark: SparkSession, at: str, buckets: int) -> DataFrame:
    files = [n for n in _names(spark, at) if n.endswith(".parquet")]
    if not buckets or not all(_BUCKET_FILE.search(n) for n in files):
        return spark.read.schema(MANIFEST_SCHEMA).parquet(at).select(*MANIFEST_COLUMNS)
    name = _table(spark, at, buckets)
    # a column that says whence it comes has no table's name before its own;
    # a union knows parts that are bucketed alike by such columns only
    keyed = [F.col(c).alias(c, metadata={"bucketed": buckets}) if c == "path" else F.col(c) for c in MANIFEST_COLUMNS]
    try:
        return spark.table(name).select(*keyed)  # resolved here: the name is not needed later
    finally:
        spark.sql(f"DROP TABLE {name}")


def _chained(spark: SparkSession, store: str, v: Version, read, spread_by: str) -> DataFrame:
    """One table out of the parts of a version: of each directory the rows of
    the newest part that speaks for it.  ``read(id)`` gives the rows of one."""
    out = read(v.base)
    if not v.deltas:
        return out
    owners = newer = None
    for k, d in enumerate(v.deltas):
        mark = F.lit(k).alias("_part")
        mine = spark.read.schema("dir string").parquet(f"{store}/changed/snapshot={d}").select("dir", mark)
        rows = read(d).select("*", mark)
        owners = mine if owners is None else owners.unionByName(mine)
        newer = rows if newer is None else newer.unionByName(rows)
    checkpoint_dir(spark)
    owners = owners.groupBy("dir").agg(F.max("_part").alias("_part")).checkpoint()
    if is_small(owners):  # keeps both sides where their buckets are
        base = out.join(F.broadcast(owners.select("dir")), "dir", "left_anti")
        newer = newer.join(F.broadcast(owners), ["dir", "_part"], "left_semi")
    else:
        base = lookup_join(out, owners.select("dir"), ["dir"], "left_anti", spread_by=spread_by)
        newer = lookup_join(newer, owners, ["dir", "_part"], "left_semi", spread_by=spread_by)
    return base.select(*out.columns).unionByName(newer.select(*out.columns))


def read_version(spark: SparkSession, store: str, v: Version) -> DataFrame:
    return _chained(spark, store, v, lambda i: _read_part(spark, f"{store}/snapshots/snapshot={i}", v.buckets), "path")


def read_current(spark: SparkSession, store: str) -> DataFrame:
    """The published manifest, partitioned by path where it is bucketed."""
    return read_version(spark, store, current(spark, store))


def _read_lists(spark: SparkSession, store: str, v: Version, part: str, schema, spread_by: str) -> DataFrame:
    return _chained(spark, store, v, lambda i: spark.read.schema(schema).parquet(f"{store}/{part}/snapshot={i}"), spread_by)


def read_current_dirs(spark: SparkSession, store: str) -> DataFrame:
    """Directory lists of the published snapshot (empty when none were kept)."""
    v = current(spark, store)
    if not v.dirs or not _exists(spark, f"{store}/dirs/snapshot={v.base}"):
        return spark.createDataFrame([], DIRS_SCHEMA)
    return _read_lists(spark, store, v, "dirs", DIRS_SCHEMA, "subdir")


def read_current_seals(spark: SparkSession, store: str) -> DataFrame | None:
    """Seals of the published snapshot; None when it was published without."""
    v = current(spark, store)
    if not v.seals or not _exists(spark, f"{store}/seals/snapshot={v.base}"):
        return None
    return _read_lists(spark, store, v, "seals", SEALS_SCHEMA, "seal")


def _refuse(spark: SparkSession, store: str, snapshot_id: str) -> None:
    if _exists(spark, f"{store}/snapshots/snapshot={snapshot_id}") and any(
            snapshot_id in v.parts or snapshot_id == v.id for v in _published(spark, store)):
        raise ValueError(f"snapshot {snapshot_id} was published before")


def _write_lists(spark: SparkSession, store: str, v: Version, snapshot_id: str, dirs: DataFrame | None, sealed: bool) -> None:
    for part, wanted in (("dirs", dirs is not None), ("seals", sealed)):
        if not wanted:  # left behind by an unfinished attempt
            _delete(spark, f"{store}/{part}/snapshot={snapshot_id}")
    if dirs is not None:
        dirs.select("dir", "subdir").write.mode("overwrite").parquet(f"{store}/dirs/snapshot={snapshot_id}")
    if sealed:
        # sealed from what was written, so the seal covers the stored rows
        from lakeaudit.operators.seal import seal

        written = _read_part(spark, f"{store}/snapshots/snapshot={snapshot_id}", v.buckets)
        seal(written).write.mode("overwrite").parquet(f"{store}/seals/snapshot={snapshot_id}")


def _rows(spark: SparkSession, store: str, ids) -> int:
    """Rows of some parts, from the footers of their files."""
    return sum(spark.read.schema(MANIFEST_SCHEMA).parquet(f"{store}/snapshots/snapshot={i}").count() for i in ids)


def _buckets(spark: SparkSession, store: str, before: Version) -> int:
    """Buckets of a new base: as many as set, or as the last state asks for."""
    return max(conf_int(spark, "storeBuckets"), -(-_rows(spark, store, before.parts) // conf_int(spark, "storeBucketRows")))


def publish_snapshot(manifest: DataFrame, store: str, snapshot_id: str, dirs: DataFrame | None = None,
                     sealed: bool = True, keep: int | None = None, after: int | None = None) -> None:
    """K2 + O4: write the next manifest whole, with its directory lists and
    seals, then add the pointer.  An id that was published before is refused.
    ``keep``: how many older versions stay (all when None, one at least).
    ``after``: the sequence number this run began with; another run that has
    published since makes it fail."""
    spark = manifest.sparkSession
    before = current(spark, store)
    _refuse(spark, store, snapshot_id)
    v = Version(snapshot_id, snapshot_id, (), _buckets(spark, store, before), dirs is not None, sealed)
    _write_part(manifest, f"{store}/snapshots/snapshot={snapshot_id}", v.buckets)
    _write_lists(spark, store, v, snapshot_id, dirs, sealed)
    _point(spark, f"{store}/current", v.text(), before.seq if after is None else after)
    if keep is not None:
        drop_old(spark, store, keep)


def publish_changes(manifest: DataFrame, store: str, snapshot_id: str, changed: DataFrame, dirs: DataFrame | None = None,
                    sealed: bool = True, keep: int | None = None, after: int | None = None) -> bool:
    """K3: publish the next manifest by writing the directories ``changed
    (dir)`` alone: every entry they have in ``manifest`` (none: they are
    forgotten).  Returns whether a delta was written; a new base is written
    instead when there is none yet, when the deltas are many or hold half as
    many rows as the base, or when lists or seals begin or cease to be kept."""
    spark = manifest.sparkSession
    before = current(spark, store)
    _refuse(spark, store, snapshot_id)
    fits = (before.buckets and len(before.deltas) < MAX_DELTAS and before.dirs == (dirs is not None) and before.seals == sealed
            and 2 * _rows(spark, store, before.deltas) <= _rows(spark, store, [before.base]))
    if fits:
        at = f"{store}/changed/snapshot={snapshot_id}"
        changed.select("dir").where(F.col("dir").isNotNull()).distinct().write.mode("overwrite").parquet(at)
        changed = spark.read.schema("dir string").parquet(at)
        fits = is_small(changed)
    if not fits:
        publish_snapshot(manifest, store, snapshot_id, dirs, sealed, keep, after)
        return False
    v = Version(snapshot_id, before.base, (*before.deltas, snapshot_id), before.buckets, before.dirs, before.seals)
    mine = F.broadcast(changed)  # counted above
    _write_part(manifest.join(mine, "dir", "left_semi"), f"{store}/snapshots/snapshot={snapshot_id}", v.buckets)
    _write_lists(spark, store, v, snapshot_id, dirs.join(mine, "dir", "left_semi") if dirs is not None else None, sealed)
    _point(spark, f"{store}/current", v.text(), before.seq if after is None else after)
    if keep is not None:
        drop_old(spark, store, keep)
    return True


def compact(spark: SparkSession, store: str, snapshot_id: str | None = None, keep: int | None = None) -> str:
    """Fold the deltas of the published version into a new base; the manifest,
    lists and seals stay as they are.  Returns the id."""
    before = current(spark, store)
    snapshot_id = snapshot_id or next_id(spark, store)
    _refuse(spark, store, snapshot_id)
    v = Version(snapshot_id, snapshot_id, (), _buckets(spark, store, before), before.dirs, before.seals)
    _write_part(read_version(spark, store, before), f"{store}/snapshots/snapshot={snapshot_id}", v.buckets)
    # the seals are copied, not made anew: a damaged directory stays reported
    for part, kept, rows in (("dirs", before.dirs, read_current_dirs(spark, store)), ("seals", before.seals, read_current_seals(spark, store))):
        if kept and rows is not None:
            rows.write.mode("overwrite").parquet(f"{store}/{part}/snapshot={snapshot_id}")
        else:
            _delete(spark, f"{store}/{part}/snapshot={snapshot_id}")
    _point(spark, f"{store}/current", v.text(), before.seq)
    if keep is not None:
        drop_old(spark, store, keep)
    return snapshot_id


def drop_old(spark: SparkSession, store: str, keep: int = 1) -> None:
    """Retention: the published version and the ``keep`` ones published before
    it stay with all their parts, every other snapshot folder goes."""
    done = _published(spark, store)
    kept = done[-(max(1, keep) + 1):]
    stay = {i for v in kept for i in v.parts}
    for v in done[:-len(kept)]:
        _delete(spark, f"{store}/current/{v.seq:012d}")
    for part in ("snapshots", "changed", "dirs", "seals"):
        for name in _names(spark, f"{store}/{part}"):
            if name.startswith("snapshot=") and name[len("snapshot="):] not in stay:
                _delete(spark, f"{store}/{part}/{name}")


def merge_changed(old: DataFrame, nxt: DataFrame, changed_dirs: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """K3: the next manifest when only changed directories are rewritten.

    Full run (``scope`` None): the next manifest itself -- directories that
    vanished are forgotten.  Subset run: entries of changed directories come
    from ``nxt``, every other directory keeps its old entries.  ``dir`` may be
    hot, so the directory lookups are size-checked / skew-aware.
    """
    if scope is None:
        return nxt.select(*MANIFEST_COLUMNS)
    ch = changed_dirs.select("dir").distinct()
    new_part = lookup_join(nxt.select(*MANIFEST_COLUMNS), ch, ["dir"], "left_semi", spread_by="name")
    keep_old = lookup_join(old.select(*MANIFEST_COLUMNS), ch, ["dir"], "left_anti", spread_by="name")
    return new_part.unionByName(keep_old)


def store_bags(bags: DataFrame, store: str, items: DataFrame | None = None) -> int:
    """K4: replace the duplicate result, bags and items together; returns the
    generation, one more than the last.  Older generations go afterwards."""
    spark = bags.sparkSession
    gen = int(_pointed(spark, f"{store}/dups_current") or 0) + 1
    bags.withColumn("gen", F.lit(gen)).withColumn("updated", F.current_timestamp()).write.mode("overwrite").parquet(f"{store}/dups/gen={gen}")
    if items is not None:
        items.withColumn("gen", F.lit(gen)).write.mode("overwrite").parquet(f"{store}/dup_items/gen={gen}")
    else:
        _delete(spark, f"{store}/dup_items/gen={gen}")
    _point(spark, f"{store}/dups_current", str(gen))
    for part in ("dups", "dup_items"):
        for name in _names(spark, f"{store}/{part}"):
            if name != f"gen={gen}":
                _delete(spark, f"{store}/{part}/{name}")
    return gen


def read_bags(spark: SparkSession, store: str, part: str = "dups") -> DataFrame:
    """The published duplicate result: ``dups`` or ``dup_items``."""
    gen = _pointed(spark, f"{store}/dups_current")
    if gen is None:
        raise FileNotFoundError(f"no duplicate result in {store}")
    return spark.read.parquet(f"{store}/{part}/gen={gen}")
