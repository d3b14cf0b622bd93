"""End-to-end runs over a directory tree (the tool's ``update`` / ``check``).

``update(spark, root, store)``:

1. walk the tree (hidden names included), level by level, descending only
   into directories the ignore rules found so far keep (pruning);
2. read the ignore files found by the walk and drop ignored entries (F1-F5);
3. join the listing to the published manifest on ``path`` to pick each
   entry's algorithm (H3) and, with ``skip_existing``, to leave files with
   an unchanged mtime unread (H4);
4. hash the remaining files in ``mapInPandas`` (H2, H5);
5. audit the entries of the visited directories against the published
   manifest (J1), add vanished directories (J2), directory-list changes
   (A2, against the directory lists kept with the snapshot) and ``ERX`` for
   directories whose stored rows fail their seal (H6);
6. unless ``readonly``, publish the next manifest and directory lists as a
   new version (K2), writing the changed directories alone (K3); a subset run
   keeps unvisited directories.

Files below a vanished directory get no event of their own (the directory
is reported once), as in the tool.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.operators import audit as A
from lakeaudit.operators import ignore as I
from lakeaudit.operators.joins import lookup_join
from lakeaudit.functions.paths import ancestors
from lakeaudit.schema import DIRS_SCHEMA, MANIFEST_COLUMNS, Status
from lakeaudit.session import checkpoint_dir, ship_package
from lakeaudit.sinks import store as K
from lakeaudit.sources.listing import hash_files, name_bytes, walk


@dataclass
class RunResult:
    events: DataFrame        # dir, name, path, status
    summary: DataFrame       # one row, see operators.audit.run_summary
    next_manifest: DataFrame
    verdict: DataFrame


def read_ignore_files(listing: DataFrame, root: str, ignore_name: str = I.IGNORE_NAME) -> DataFrame:
    """Rules ``(dir, pattern, error)`` from the ignore files a walk of
    ``root`` found; a file that cannot be read gives a row with its error
    instead.  Lines are bytes as file names are: an odd one in a pattern
    stands for that byte in a name."""
    base = root.rstrip("/")
    files = listing.where((F.col("kind") == "file") & (F.col("name") == ignore_name)).select("dir", "path")

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lakeaudit.sources.listing import name_text
        from lakeaudit.sources.manifests import read_bytes

        for pdf in it:
            rows = []
            for d, p in zip(pdf["dir"], pdf["path"]):
                try:
                    text = name_text(read_bytes(f"{base}/{p}").decode("utf-8", "surrogateescape"))
                    rows += [(d, line, None) for line in text.split("\n")]
                except OSError as err:
                    rows.append((d, None, name_text(str(err))))
            yield pd.DataFrame(rows, columns=["dir", "pattern", "error"])

    return files.mapInPandas(read, "dir string, pattern string, error string")


def _prefix(listing: DataFrame, subpath: str) -> DataFrame:
    """Paths of a walk below ``subpath`` made relative to the manifest root."""
    if not subpath:
        return listing
    pre = subpath + "/"
    return listing.select(
        F.when(F.col("dir") == "", F.lit(subpath)).otherwise(F.concat(F.lit(pre), "dir")).alias("dir"),
        "name", F.when(F.col("path") == "", F.lit(subpath)).otherwise(F.concat(F.lit(pre), "path")).alias("path"),
        *[c for c in listing.columns if c not in ("dir", "name", "path")])


@dataclass
class Scan:
    """What one start path holds, paths relative to the manifest root."""

    kept: DataFrame      # files and directories the rules leave in, with level
    ignored: DataFrame   # path, kind of what they leave out
    errors: DataFrame    # listing rows that could not be read
    unruled: DataFrame   # path of directories whose rule file could not be read


def scan(spark: SparkSession, root: str, subpath: str = "", *, include_dot: bool = False, max_depth: int = 0,
         follow_links: bool = True, global_rules: DataFrame | None = None, index_name: str = I.INDEX_NAME,
         ignore_name: str = I.IGNORE_NAME) -> Scan:
    """Walk ``root/subpath`` and apply the ignore rules found on the way.

    Rules hold relative to the start path (whose own name is never tested);
    each level's rule files are read once, and ignored directories are not
    descended into."""
    start = root.rstrip("/") + ("/" + subpath if subpath else "")
    names = {"index_name": index_name, "ignore_name": ignore_name}
    options = {"include_dot": include_dot, "global_rules": global_rules, "root_name": start.rsplit("/", 1)[-1], **names}
    found: list[DataFrame] = []

    def rules_so_far() -> DataFrame:
        out = found[0]
        for r in found[1:]:
            out = out.unionByName(r)
        return out

    def prune(level: DataFrame, seen: DataFrame) -> DataFrame:
        # a directory of this level is decided by rule files of its ancestors,
        # all listed by now
        found.append(read_ignore_files(level, start, ignore_name).checkpoint())
        return I.apply_ignore(level.where(F.col("kind") == "dir"), rules_so_far(), **options).select("path")

    listing = walk(spark, start, follow_links=follow_links, max_depth=max_depth, prune=prune)
    last = listing if not found else listing.where(F.col("level") > len(found))
    found.append(read_ignore_files(last, start, ignore_name).checkpoint())
    rules = rules_so_far()
    # entries that could not be read are subject to the rules like any other;
    # the start path itself is not
    top = listing.where((F.col("kind") == "error") & (F.col("path") == ""))
    kept, ignored = I.judge(listing.where(F.col("path") != ""), rules, **options)
    below, kept = kept.where(F.col("kind") == "error"), kept.where(F.col("kind") != "error")
    unruled = rules.where(F.col("error").isNotNull()).select(F.col("dir").alias("path")).distinct()
    if subpath:
        ignored = ignored.withColumn("path", F.concat(F.lit(subpath + "/"), "path"))
        unruled = unruled.withColumn("path", F.when(F.col("path") == "", F.lit(subpath)).otherwise(F.concat(F.lit(subpath + "/"), "path")))
    return Scan(_prefix(kept, subpath), ignored, _prefix(below.unionByName(top), subpath), unruled)


def _events_of(paths: DataFrame, status: str) -> DataFrame:
    return paths.select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), "path", F.lit(status).alias("status"))


def show_ignored(spark: SparkSession, root: str, subpath: str = "", **options) -> DataFrame:
    """Only what a run would ignore, ``path, kind``; no content is read."""
    return scan(spark, root, subpath.strip("/"), **options).ignored


def _under(rows: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows whose ``dir`` is one of ``tops (path)`` or lies below one.

    Judged once per distinct directory, then looked up by directory."""
    dirs = rows.select("dir").distinct()
    above = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(ancestors("dir"), lambda a: a["anc"]))).alias("path"))
    hit = lookup_join(above, tops.select("path").distinct(), ["path"], "left_semi", spread_by="dir").select("dir").distinct()
    return lookup_join(rows, hit, ["dir"], "left_semi", spread_by=rows.columns[1])


def update(spark: SparkSession, root: str, store: str, *, subpath: str | list[str] = "", readonly: bool = False,
           algo: str = "md5", skip_existing: bool = False, force: bool = False, keep_missing: bool = False,
           log_deleted: bool = False, include_dot: bool = False, max_depth: int = 0, recurse: bool = True,
           follow_links: bool = True, global_rules: DataFrame | None = None,
           snapshot_id: str | None = None, hide_new: bool = False, track_dirs: bool = True,
           keep: int | None = None, index_name: str = I.INDEX_NAME, ignore_name: str = I.IGNORE_NAME) -> RunResult:
    """Audit the tree below ``root/subpath`` against the published manifest.

    ``subpath`` may be a list of start paths (none within another).
    ``events`` holds every event of the run, ``ign`` ones included (filter
    with ``operators.audit.report`` for what the tool would print);
    ``hide_new`` drops ``new`` events and counts them as 0 (``check -s``).
    ``readonly`` reads stored files only: a file that is not in the manifest
    is reported as new without being hashed.  ``track_dirs=False``: lists of
    subdirectories are neither compared nor kept.  ``keep``: how many older
    snapshots stay.

    Only the directories this run descends into are compared (the scan root,
    and below it as far as ``recurse``/``max_depth`` allow); a full run from
    the root forgets directories that vanished, a subset run keeps every
    directory it did not visit.  A directory that cannot be listed is a
    ``PNC`` event; it does not count as visited, and what the manifest holds
    of it and below is kept.
    """
    checkpoint_dir(spark)
    ship_package(spark)
    starts = [x.strip("/") for x in ([subpath] if isinstance(subpath, str) else subpath)] or [""]
    for x in starts:
        if any(y != x and (not y or x.startswith(y + "/")) for y in starts) or starts.count(x) > 1:
            raise ValueError(f"start path {x!r} lies within another")
    K.ensure_store(spark, store)
    version = K.current(spark, store)
    stored = K.read_version(spark, store, version)
    stored_dirs = K.read_current_dirs(spark, store) if track_dirs else spark.createDataFrame([], DIRS_SCHEMA)
    if not recurse:
        max_depth = 1
    full_run = starts == [""] and max_depth == 0

    scans = [scan(spark, root, x, include_dot=include_dot, max_depth=max_depth, follow_links=follow_links,
                  global_rules=global_rules, index_name=index_name, ignore_name=ignore_name) for x in starts]

    def union(part: str) -> DataFrame:
        out = getattr(scans[0], part)
        for other in scans[1:]:
            out = out.unionByName(getattr(other, part))
        return out

    kept, errors = union("kept"), union("errors").checkpoint()
    files = kept.where(F.col("kind") == "file")
    dirs = kept.where(F.col("kind") == "dir")
    # a row without name: the directory itself could not be listed
    bad_dirs = errors.where(F.col("name") == "").select("path")
    bad_files = errors.where(F.col("name") != "").select("dir", "name", "path", "error")
    any_bad = not bad_dirs.isEmpty()
    current_dirs = dirs.select("dir", F.col("name").alias("subdir"))
    if not track_dirs:
        current_dirs = current_dirs.where(F.lit(False))
    descended = dirs if max_depth == 0 else dirs.where(F.col("level") < max_depth)
    visited = descended.select(F.col("path").alias("dir")).unionByName(
        spark.createDataFrame([(x,) for x in starts], "dir string")).distinct()
    if any_bad:
        visited = visited.join(bad_dirs.withColumnRenamed("path", "dir"), "dir", "left_anti")
    visited = visited.checkpoint()  # small, reused by every directory-level step below

    # only entries of visited directories take part (a vanished directory
    # is not visited, so its files get no event of their own)
    in_scope = lookup_join(stored, visited, ["dir"], "left_semi", spread_by="path")

    # H3/H4: one join of the listing to the stored keys decides algorithm and skipping
    s = in_scope.select("path", F.lit(True).alias("s_in"), F.col("algo").alias("s_algo"), F.col("mod_ms").alias("s_mod"))
    f = files.join(s, "path", "left")
    skip = (F.col("s_mod") == F.col("mod_ms")) if skip_existing else F.lit(False)
    unread = F.col("s_in").isNull() if readonly else F.lit(False)
    f = (f.withColumn("_unread", unread).withColumn("_skip", F.coalesce(skip, F.lit(False)) | F.col("_unread"))
         .withColumn("_algo", F.coalesce("s_algo", F.lit(algo))))
    to_hash = f.where(~F.col("_skip")).select("dir", "name", "path", "_algo", "size")
    hashed = hash_files(to_hash, root, algo, algo_col="_algo").withColumn("unread", F.lit(False))
    none = F.lit(None).cast("string")
    unchanged = f.where(F.col("_skip")).select(
        "dir", "name", "path", "mod_ms", none.alias("algo"), none.alias("hash"), "size", none.alias("error"),
        F.col("_unread").alias("unread"))
    failed = bad_files.select("dir", "name", "path", F.lit(None).cast("bigint").alias("mod_ms"), none.alias("algo"),
                              none.alias("hash"), F.lit(None).cast("bigint").alias("size"), "error", F.lit(False).alias("unread"))
    observed = hashed.unionByName(unchanged).unionByName(failed)

    t = A.audit(in_scope, observed, algo=algo, force=force, keep_missing=keep_missing, log_deleted=log_deleted,
                skip_existing=skip_existing)
    t = t.checkpoint()  # one materialised audit table feeds every output below
    vanished = A.vanished_dirs(stored_dirs, current_dirs, log_deleted=log_deleted, keep_missing=keep_missing,
                               visited=visited)
    # a rule file that cannot be read is an error of its directory, whose
    # entries are then judged by the other rules
    unlisted = _events_of(bad_dirs.unionByName(union("unruled")).distinct(), Status.PANIC)
    dir_events = vanished.unionByName(unlisted)
    evts = A.events(t).unionByName(dir_events)
    dl_changed = A.dirlist_changed(stored_dirs, current_dirs, keep_missing=keep_missing, visited=visited)
    # H6/case 11: directories of the snapshot whose rows no longer match their seal
    seals = K.read_current_seals(spark, store)
    if seals is not None:
        from lakeaudit.operators.seal import verify_seal

        seals_in_scope = lookup_join(seals, visited, ["dir"], "left_semi", spread_by="seal")
        bad = verify_seal(in_scope, seals_in_scope).where(~F.col("verified")).select("dir")
        evts = evts.unionByName(bad.select("dir", F.lit("").alias("name"), F.col("dir").alias("path"),
                                           F.lit(Status.BAD_INDEX).alias("status")))
        dl_changed = dl_changed.unionByName(bad)
    # entries of visited directories that the rules leave out (verbose-only in the tool)
    evts = evts.unionByName(_events_of(union("ignored"), Status.IGNORED))
    summary = A.run_summary(t, dirlist_changed=dl_changed, dir_events=dir_events, hide_new=hide_new)
    if hide_new:
        evts = evts.where(F.col("status") != Status.NEW)

    nxt = A.next_manifest(t)
    next_dirs = current_dirs
    if keep_missing:
        kept_dirs = lookup_join(stored_dirs, visited, ["dir"], "left_semi", spread_by="subdir")
        next_dirs = next_dirs.unionByName(kept_dirs).distinct()
    if not full_run:
        # a subset run keeps what it did not visit
        nxt = nxt.unionByName(lookup_join(stored, visited, ["dir"], "left_anti", spread_by="path"))
        next_dirs = next_dirs.unionByName(lookup_join(stored_dirs, visited, ["dir"], "left_anti",
                                                      spread_by="subdir"))
    elif any_bad:
        # nothing is known about what lies below a directory that cannot be listed
        nxt = nxt.unionByName(_under(stored.select("dir", *[c for c in MANIFEST_COLUMNS if c != "dir"]), bad_dirs).select(*MANIFEST_COLUMNS))
        next_dirs = next_dirs.unionByName(_under(stored_dirs, bad_dirs))
    if not readonly:
        # K3: directories with another entry or list than before, and those that
        # a full run forgets
        changed = t.where("differs").select("dir").unionByName(dl_changed.select("dir"))
        if full_run:
            held = stored.select("dir").distinct().unionByName(stored_dirs.select("dir").distinct())
            changed = changed.unionByName(held.join(visited, "dir", "left_anti"))
        K.publish_changes(nxt, store, snapshot_id or K.next_id(spark, store), changed, dirs=next_dirs if track_dirs else None, keep=keep,
                          after=version.seq)
    return RunResult(evts, summary, nxt, A.verdict(t.select("status").unionByName(unlisted.select("status"))))


ATOM_SUFFIX = "-db"


def manifest_files(listing: DataFrame, index_name: str = I.INDEX_NAME) -> DataFrame:
    """Manifest files a walk found: ``path, dir, kind`` (split index per
    directory, or atom file for a subtree)."""
    name = F.col("name")
    kind = (F.when(name == index_name, F.lit("split"))
            .when(name == index_name + ATOM_SUFFIX, F.lit("atom")))
    return (listing.where(F.col("kind") == "file").select("path", "dir", kind.alias("mkind"))
            .where(F.col("mkind").isNotNull()).withColumnRenamed("mkind", "kind"))


def locate_roots(listing: DataFrame, index_name: str = I.INDEX_NAME) -> DataFrame:
    """``root, kind`` of every directory that owns a manifest (input of J4)."""
    return manifest_files(listing, index_name).select(F.col("dir").alias("root"), "kind").distinct()


def fuse_tree(spark: SparkSession, root: str, store: str | None = None, *, include_top: bool = False,
              index_name: str = I.INDEX_NAME, follow_links: bool = True) -> tuple[DataFrame, DataFrame]:
    """The tool's ``fuse``: every split and atom manifest below ``root``
    becomes one manifest (U1/W3/U3); the sources stay untouched.

    Returns (fused manifest, per-file index report); with ``store`` the fused
    manifest is published there as a new snapshot.
    """
    from lakeaudit.operators import fuse as U
    from lakeaudit.sources.manifests import read_atom_manifest, read_split_manifests

    listing = walk(spark, root, follow_links=follow_links)
    files = manifest_files(listing, index_name).checkpoint()
    split_e, split_i = read_split_manifests(files.where(F.col("kind") == "split"), root)
    atom_e, atom_i = read_atom_manifest(files.where(F.col("kind") == "atom"), root)
    kinds = files.select(F.col("path").alias("source"), F.col("dir").alias("source_root"), "kind")
    entries = split_e.unionByName(atom_e)
    # entry dirs are relative to the fuse root; make them relative to their source
    rel = F.when(F.col("source_root") == "", F.col("dir")).when(
        F.col("dir") == F.col("source_root"), F.lit("")).otherwise(
        F.expr("substring(dir, length(source_root) + 2)"))
    sources = lookup_join(entries, kinds, ["source"], "inner", spread_by="path").select(
        "source_root", "kind", rel.alias("dir"), "name", "mod_ms", "algo", "hash", "size")
    fused = U.fuse(sources, include_top=include_top)
    report = split_i.unionByName(atom_i)
    if store is not None:
        K.ensure_store(spark, store)
        sid = K.next_id(spark, store)
        K.publish_snapshot(fused.select(*fused.columns[:7]), store, sid)
    return fused, report


def dedup_detect(spark: SparkSession, store: str, locations: DataFrame | None = None,
                 listing: DataFrame | None = None, min_size: int = 8192) -> int:
    """The tool's ``dedup detect``: bags of the published manifest with their
    space accounting, stored with a new generation (K4); items (with merged
    flags and keepers) are stored next to them.  Returns the generation."""
    from lakeaudit.operators import dups as D

    manifest = K.read_current(spark, store)
    bags = D.dup_space(manifest, locations, listing, min_size=min_size).checkpoint()
    items = D.dup_items(manifest, bags, locations, listing, min_size=min_size)
    return K.store_bags(bags, store, items)


def dedup_show(spark: SparkSession, store: str) -> tuple[DataFrame, DataFrame]:
    """The tool's ``dedup show``: bags by size and the space report."""
    from lakeaudit.operators import dups as D

    bags = K.read_bags(spark, store)
    return D.dup_show(bags), D.dup_report(bags)


def dedup_plan(spark: SparkSession, store: str, hashes: DataFrame | None = None) -> DataFrame:
    """The tool's ``dedup run`` as a plan: ``hash, keeper, duplicate, bytes``
    for the selected bags (all when ``hashes`` is None; unknown ones fail)."""
    from lakeaudit.operators import dups as D

    items = K.read_bags(spark, store, "dup_items")
    if hashes is not None:
        bags = D.select_hashes(K.read_bags(spark, store), hashes)
        items = lookup_join(items, bags.select("hash"), ["hash"], "left_semi", spread_by="path")
    return D.dedup_plan(items)
