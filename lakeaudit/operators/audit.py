"""Audit: compare a stored manifest with freshly observed objects.

One full outer equi-join on ``path`` (a unique key on both sides, so no
skew), then a projection that classifies each path and builds the next
manifest in the same row.  Directory-level results (A2) aggregate on
``dir`` with partial aggregation, so one huge directory is combined
map-side before the shuffle.

Classification (stored ``a``, observed ``b``):

1. no ``a``                              -> ``new``
2. both digests non-null and equal       -> ``ok`` (dir modified if mtime moved)
3. else same mtime                       -> ``DMG`` (keep ``a``; ``b`` with force)
4. else ``a`` older                      -> ``upd``
5. else ``a`` newer                      -> ``old``
6. no ``b``, keep_missing                -> no event, keep ``a``
7. no ``b``                              -> ``del`` when logged, dropped
8. ``b`` could not be read               -> ``PNC``, ``a`` is kept
9. skip_existing and same mtime          -> ``b := a`` (no re-hash)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeaudit.functions.hashing import check_algo, content_hash, pick_hash
from lakeaudit.functions.paths import ancestors, join_path
from lakeaudit.operators.joins import lookup_join
from lakeaudit.operators.keyset import mark
from lakeaudit.schema import HASH_ALGOS, MANIFEST_COLUMNS, Status

AUDIT_COLUMNS = [
    "dir", "name", "path", "status", "modified", "counted",
    "mod_ms", "algo", "hash", "size", "keep", "differs",
]


def _stored_algos(stored: DataFrame) -> list[str]:
    # only names that can be computed matter: as many rows as there are of them
    return sorted(r[0] for r in stored.select("algo").where(F.col("algo").isin(*HASH_ALGOS)).distinct().collect())


def _hash_observed(observed: DataFrame, algos: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """Digest the content once per algorithm in use, before the join."""
    hashes = {a: content_hash("content", a).alias(f"_h_{a}") for a in algos if a in HASH_ALGOS}
    df = observed.select(*[c for c in observed.columns if c != "content"], *hashes.values())
    return df, {a: F.col(f"_h_{a}") for a in hashes}


def _skip_unchanged(observed: DataFrame, stored: DataFrame) -> DataFrame:
    """H4: only entries whose (path, mtime) is not in the stored manifest need
    a digest; the others take the stored one (the audit join decides that).

    Content never crosses a shuffle.  The changed paths go out as a bitmap of
    bounded size, whatever their number; an entry that it marks without need
    costs a digest and nothing else, as the join compares the real keys."""
    keys = stored.select("path", "mod_ms")
    changed = (observed.select("path", "mod_ms").join(keys, ["path", "mod_ms"], "left_anti")
               .select(F.xxhash64("path").alias("_changed")).checkpoint())
    n = changed.count()
    if not n:
        return observed.withColumn("content", F.lit(None).cast(observed.schema["content"].dataType))
    marked = mark(observed, F.xxhash64("path"), changed, "_changed", n, "_may_differ")
    return marked.withColumn("content", F.when(F.col("_may_differ"), F.col("content"))).drop("_may_differ")


def audit(stored: DataFrame, observed: DataFrame, *, algo: str = "md5", force: bool = False,
          keep_missing: bool = False, log_deleted: bool = True, skip_existing: bool = False,
          algos: list[str] | None = None) -> DataFrame:
    """Audit table: one row per path seen on either side (see module doc).

    ``observed`` carries either ``content`` (hashed here with the stored
    algorithm of each entry, H3) or ready ``algo``/``hash`` columns.
    ``unread`` (optional, boolean) marks entries left unread on purpose: one
    that is not stored is ``new`` and is not published without a digest.
    ``algos``: the algorithms used in ``stored`` when known (e.g. kept with
    the snapshot); otherwise one pass over its ``algo`` column finds them.
    """
    algo = check_algo(algo)
    if "error" not in observed.columns:
        observed = observed.withColumn("error", F.lit(None).cast("string"))
    if "unread" not in observed.columns:
        observed = observed.withColumn("unread", F.lit(False))
    if "content" in observed.columns:
        if skip_existing:
            observed = _skip_unchanged(observed, stored)
        algos = sorted(set([algo] + (algos if algos is not None else _stored_algos(stored))))
        obs, hashes = _hash_observed(observed, algos)
        hash_cols = [f"_h_{a}" for a in hashes]
    else:
        obs = observed.withColumnRenamed("hash", "_h_given").withColumnRenamed("algo", "_a_given")
        hash_cols = ["_h_given", "_a_given"]
        hashes = None

    # only the key and the payload cross the shuffle; dir and name are
    # recovered from the path afterwards (a name never contains "/")
    a = stored.select(
        "path", F.lit(True).alias("a_in"),
        F.col("mod_ms").alias("a_mod"), F.col("algo").alias("a_algo"),
        F.col("hash").alias("a_hash"), F.col("size").alias("a_size"),
    )
    b = obs.select(
        "path", F.lit(True).alias("b_in"),
        F.col("mod_ms").alias("b_mod"), F.col("size").alias("b_size"),
        F.col("error").alias("b_error"), F.col("unread").alias("b_unread"), *hash_cols,
    )
    j = a.join(b, "path", "full_outer")

    a_in = F.col("a_in").isNotNull()
    b_in = F.col("b_in").isNotNull()
    both = a_in & b_in
    skip = both & (F.col("a_mod") == F.col("b_mod")) if skip_existing else F.lit(False)
    eff_algo = F.coalesce(F.col("a_algo"), F.lit(algo))
    if hashes is not None:
        fresh = pick_hash(eff_algo, hashes)
    else:
        fresh = F.when(F.col("_a_given") == eff_algo, F.col("_h_given"))
    b_hash = F.when(skip, F.col("a_hash")).otherwise(fresh)
    b_err = F.when(
        b_in & ~skip,
        F.coalesce(F.col("b_error"),
                   F.when(fresh.isNull() & ~F.col("b_unread"), F.concat(F.lit("cannot hash with "), eff_algo))),
    )

    name = F.substring_index("path", "/", -1)
    j = j.select(
        "*",
        F.when(F.instr("path", "/") > 0,
               F.expr("substring(path, 1, length(path) - length(substring_index(path, '/', -1)) - 1)"))
        .otherwise(F.lit("")).alias("dir"),
        name.alias("name"),
        b_hash.alias("b_hash"),
        b_err.alias("b_err"),
        skip.alias("skip"),
        eff_algo.alias("eff_algo"),
    )
    a_mod, b_mod = F.col("a_mod"), F.col("b_mod")
    status = (
        F.when(b_in & F.col("b_err").isNotNull(), F.lit(Status.PANIC))
        .when(~a_in, F.lit(Status.NEW))
        .when(both & (F.col("a_hash") == F.col("b_hash")), F.lit(Status.OK))
        .when(both & (a_mod == b_mod), F.lit(Status.DAMAGE))
        .when(both & (a_mod < b_mod), F.lit(Status.UPDATE))
        .when(both & (a_mod > b_mod), F.lit(Status.OLD))
    )
    if log_deleted and not keep_missing:
        status = status.when(a_in & ~b_in, F.lit(Status.DELETED))
    st = F.col("status")
    modified = (
        F.when(st == Status.NEW, True)
        .when(st == Status.OK, F.coalesce(a_mod != b_mod, F.lit(True)) & ~F.col("skip"))
        .when(st == Status.DAMAGE, F.lit(force))
        .when(st.isin(Status.UPDATE, Status.OLD), True)
        .when(a_in & ~b_in, F.lit(not keep_missing))
        .otherwise(False)
    )
    # next manifest: take b, or a (damage without force, skipped, missing kept, read error)
    take_a = (
        F.col("skip")
        | (st == Status.PANIC)
        | ((st == Status.DAMAGE) & F.lit(not force))
        | (a_in & ~b_in)
    )
    keep = (F.when(a_in & ~b_in, F.lit(keep_missing)).when(st == Status.PANIC, a_in)
            .when(~a_in & F.coalesce("b_unread", F.lit(False)), F.lit(False)).otherwise(True))
    nxt = {"mod_ms": F.when(take_a, a_mod).otherwise(b_mod),
           "algo": F.when(take_a, F.col("a_algo")).otherwise(F.col("eff_algo")),
           "hash": F.when(take_a, F.col("a_hash")).otherwise(F.col("b_hash")),
           "size": F.when(take_a, F.col("a_size")).otherwise(F.col("b_size"))}
    same = nxt["mod_ms"].eqNullSafe(a_mod)
    for c in ("algo", "hash", "size"):
        same = same & nxt[c].eqNullSafe(F.col(f"a_{c}"))
    # whether the next manifest has another entry than the stored one, or only one has any
    differs = (keep != a_in) | (keep & a_in & ~same)
    counted = st.isin(Status.DAMAGE, Status.OLD, Status.UPDATE, Status.NEW)
    if not skip_existing:
        counted = counted | (st == Status.OK)
    return (
        j.withColumn("status", status)
        .select(
            "dir", "name", "path", "status",
            modified.alias("modified"),
            F.coalesce(counted, F.lit(False)).alias("counted"),
            *[c.alias(n) for n, c in nxt.items()],
            keep.alias("keep"),
            differs.alias("differs"),
        )
    )


def events(table: DataFrame) -> DataFrame:
    """Status events: ``dir, name, path, status``."""
    return table.where(F.col("status").isNotNull()).select("dir", "name", "path", "status")


def next_manifest(table: DataFrame) -> DataFrame:
    """The manifest to publish after the run (U2 when keep_missing)."""
    return table.where(F.col("keep")).select(*MANIFEST_COLUMNS)


def dir_pairs(manifest: DataFrame) -> DataFrame:
    """Directory lists ``(dir, subdir)`` implied by the paths of a manifest."""
    anc = manifest.select(F.explode(ancestors("dir")).alias("a")).select(
        F.col("a.anc").alias("full"), F.col("a.depth").alias("depth"))
    return (
        anc.select(
            F.regexp_extract("full", r"^(.*)/[^/]*$", 1).alias("dir"),
            F.regexp_extract("full", r"([^/]*)$", 1).alias("subdir"),
        ).distinct()
    )


def _visited(current_dirs: DataFrame, visited: DataFrame | None) -> DataFrame:
    if visited is not None:
        return visited.select("dir").distinct()
    return current_dirs.select(join_path("dir", "subdir").alias("dir")).union(
        current_dirs.sparkSession.range(1).select(F.lit("").alias("dir"))).distinct()


def vanished_dirs(stored_dirs: DataFrame, current_dirs: DataFrame, *, log_deleted: bool = True,
                  keep_missing: bool = False, visited: DataFrame | None = None) -> DataFrame:
    """Directories listed before and gone now (J2), topmost only.

    A vanished directory is never visited, so only the one whose parent was
    visited in this run is reported: ``dir, name, path, status='del'``.
    ``visited``: the directories this run descended into (default: the scan
    root and every current directory).
    """
    vis = _visited(current_dirs, visited)
    # (dir, subdir) is unique; the scope lookup on dir alone may be hot -> lookup_join
    gone = lookup_join(stored_dirs, vis, ["dir"], "left_semi", spread_by="subdir").join(
        current_dirs, ["dir", "subdir"], "left_anti")
    top = gone
    out = top.select(
        "dir", F.col("subdir").alias("name"), join_path("dir", "subdir").alias("path"),
        F.lit(Status.DELETED).alias("status"),
    )
    if not log_deleted or keep_missing:
        return out.where(F.lit(False))
    return out


def dirlist_changed(stored_dirs: DataFrame, current_dirs: DataFrame, *, keep_missing: bool = False,
                    visited: DataFrame | None = None) -> DataFrame:
    """Visited directories whose list of subdirectories changed (case 13)."""
    visited = _visited(current_dirs, visited)
    added = current_dirs.join(stored_dirs, ["dir", "subdir"], "left_anti").select("dir")
    changed = added
    if not keep_missing:
        removed = stored_dirs.join(current_dirs, ["dir", "subdir"], "left_anti").select("dir")
        changed = added.union(removed)
    return lookup_join(changed.distinct(), visited, ["dir"], "left_semi", spread_by="dir")


def changed_dirs(table: DataFrame, stored_dirs: DataFrame | None = None,
                 current_dirs: DataFrame | None = None, keep_missing: bool = False) -> DataFrame:
    """Distinct directories with any modification (A2)."""
    by_entry = table.groupBy("dir").agg(F.bool_or("modified").alias("m")).where("m").select("dir")
    if stored_dirs is None or current_dirs is None:
        return by_entry
    return by_entry.union(dirlist_changed(stored_dirs, current_dirs, keep_missing=keep_missing)).distinct()


def run_summary(table: DataFrame, dirlist_changed: DataFrame | None = None, dir_events: DataFrame | None = None,
                hide_new: bool = False) -> DataFrame:
    """Run counters (A1): total, new, upd (upd + old), del, changed dirs.

    One pass over the audit table: entry rows, directory events and
    directories whose subdirectory list changed are tagged, unioned and
    counted in one global aggregation; changed directories are a
    ``count_distinct`` (partial per task, so a hot directory is deduplicated
    map-side).
    """
    cols = ["_src", "status", "counted", "_cdir"]
    parts = [table.select(F.lit("e").alias("_src"), "status", "counted",
                          F.when(F.col("modified"), F.col("dir")).alias("_cdir"))]
    if dir_events is not None:
        parts.append(dir_events.select(F.lit("d").alias("_src"), "status", F.lit(False).alias("counted"),
                                       F.lit(None).cast("string").alias("_cdir")))
    if dirlist_changed is not None:
        parts.append(dirlist_changed.select(F.lit("c").alias("_src"), F.lit(None).cast("string").alias("status"),
                                            F.lit(False).alias("counted"), F.col("dir").alias("_cdir")))
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    st = F.col("status")
    return u.select(*cols).agg(
        F.count_if(F.col("counted")).cast("bigint").alias("total"),
        (F.lit(0) if hide_new else F.count_if(st == Status.NEW)).cast("bigint").alias("new"),
        F.count_if(st.isin(Status.UPDATE, Status.OLD)).cast("bigint").alias("upd"),
        F.count_if(st == Status.DELETED).cast("bigint").alias("del"),
        F.count_distinct("_cdir").cast("bigint").alias("changed_dirs"),
        F.count_if(st == Status.DAMAGE).cast("bigint").alias("damaged"),
        F.count_if(st == Status.PANIC).cast("bigint").alias("errors"),
    )


def verdict(table: DataFrame) -> DataFrame:
    """Exit code (A3): 1 when anything is damaged or unreadable."""
    st = F.col("status")
    return table.agg(
        F.count_if(st == Status.DAMAGE).cast("bigint").alias("damaged"),
        F.count_if(st == Status.PANIC).cast("bigint").alias("errors"),
    ).select(
        F.when((F.col("damaged") + F.col("errors")) > 0, 1).otherwise(0).cast("bigint").alias("exit_code"),
        "damaged", "errors",
    )


def report(evts: DataFrame, verbose: bool = False, hide_new: bool = False) -> DataFrame:
    """What a run shows (F8): ok/ign only when verbose, new unless hidden."""
    st = F.col("status")
    cond = st != Status.INDEX_UPDATE
    if not verbose:
        cond = cond & ~st.isin(*Status.VERBOSE)
    if hide_new:
        cond = cond & (st != Status.NEW)
    return evts.where(cond)


def damaged(evts: DataFrame) -> DataFrame:
    """Damage list."""
    return evts.where(F.col("status") == Status.DAMAGE)


def errors(evts: DataFrame) -> DataFrame:
    """Read-error list."""
    return evts.where(F.col("status") == Status.PANIC)
