"""Registered queries: one per operator of the inventory, over whole tables.

Each function takes ``(spark, sf_dir)`` and returns a DataFrame whose column
names match the oracle SQL of the same name (``lakeaudit.plans.oracle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.operators import audit as A
from lakeaudit.operators import dups as D
from lakeaudit.operators import ignore as I
from lakeaudit.operators import roots as R
from lakeaudit.functions.paths import relativize as _relativize
from lakeaudit.functions.sizes import format_size as _fmt, parse_size as _parse
from lakeaudit.functions.hashing import content_hash as _chash
from lakeaudit.operators import seal as S
from lakeaudit.operators import fuse as U
from lakeaudit.operators import rates as RT
from lakeaudit.plans import fixtures as FX
from lakeaudit.plans.file_queries import QUERIES as FILE_QUERIES

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- audit
def _audit_table(spark, sf_dir, **kw) -> DataFrame:
    # the snapshot's algorithm set is known (md5), so no pass over it is needed
    return A.audit(FX.stored(spark, sf_dir), FX.documents_objects(spark, sf_dir, algo=None), algos=["md5"], **kw)


def audit_status(spark, sf_dir):
    return A.events(_audit_table(spark, sf_dir))


def _dir_context(spark, sf_dir):
    # directory lists are small (one row per directory) and read by several
    # branches: written once to the checkpoint folder, like the persisted
    # lists of a store
    from lakeaudit.session import checkpoint_dir

    checkpoint_dir(spark)
    return FX.stored_dirs(spark, sf_dir).checkpoint(), FX.current_dirs(spark, sf_dir).checkpoint()


def changed_dirs(spark, sf_dir):
    sd, cd = _dir_context(spark, sf_dir)
    return A.changed_dirs(_audit_table(spark, sf_dir), sd, cd)


def audit_summary(spark, sf_dir):
    t = _audit_table(spark, sf_dir)
    sd, cd = _dir_context(spark, sf_dir)
    return A.run_summary(t, dirlist_changed=A.dirlist_changed(sd, cd), dir_events=A.vanished_dirs(sd, cd))


def verdict(spark, sf_dir):
    return A.verdict(_audit_table(spark, sf_dir))


def next_manifest(spark, sf_dir):
    return A.next_manifest(_audit_table(spark, sf_dir))


def next_manifest_force(spark, sf_dir):
    return A.next_manifest(_audit_table(spark, sf_dir, force=True))


def keep_missing(spark, sf_dir):
    return A.next_manifest(_audit_table(spark, sf_dir, keep_missing=True))


def skip_existing(spark, sf_dir):
    t = _audit_table(spark, sf_dir, skip_existing=True)
    return t.where(F.col("status").isNotNull()).select("path", "status", "hash", "counted")


def vanished_dirs(spark, sf_dir):
    sd, cd = _dir_context(spark, sf_dir)
    return A.vanished_dirs(sd, cd)


def damaged(spark, sf_dir):
    return A.damaged(A.events(_audit_table(spark, sf_dir)))


def report(spark, sf_dir):
    return A.report(A.events(_audit_table(spark, sf_dir)), verbose=False, hide_new=True)


def row_audit(spark, sf_dir):
    t = A.audit(FX.lineitem_rows(spark, sf_dir, "previous"), FX.lineitem_rows(spark, sf_dir, "current"))
    return A.events(t)


# ----------------------------------------------------------- duplicates
def _bags(spark, sf_dir):
    return D.dup_space(FX.observed(spark, sf_dir), FX.locations(spark, sf_dir), min_size=FX.DUP_MIN_SIZE)


def _items(spark, sf_dir):
    return D.dup_items(FX.observed(spark, sf_dir), _bags(spark, sf_dir), FX.locations(spark, sf_dir),
                       min_size=FX.DUP_MIN_SIZE)


def dup_bags(spark, sf_dir):
    return D.dup_bags(FX.observed(spark, sf_dir), FX.DUP_MIN_SIZE)


def dup_space(spark, sf_dir):
    return _bags(spark, sf_dir).drop("win_key", "keeper")


def dup_report(spark, sf_dir):
    return D.dup_report(_bags(spark, sf_dir))


def dup_show(spark, sf_dir):
    return D.dup_show(_bags(spark, sf_dir))


def dup_items(spark, sf_dir):
    return _items(spark, sf_dir).select("hash", "path", "size", "merged")


def dedup_plan(spark, sf_dir):
    return D.dedup_plan(_items(spark, sf_dir))


def dedup_apply(spark, sf_dir):
    return D.dedup_apply(FX.observed(spark, sf_dir), D.dedup_plan(_items(spark, sf_dir)))


def space_after(spark, sf_dir):
    return D.space_after(_bags(spark, sf_dir))


def same_placement(spark, sf_dir):
    return D.same_placement(_bags(spark, sf_dir))


def dedup_paths(spark, sf_dir):
    items = _items(spark, sf_dir).select("hash", "path")
    return D.dedup_pairs(items, "hash", "path")


def bags_json(spark, sf_dir):
    return D.bags_json(_items(spark, sf_dir))


# --------------------------------------------------------------- ignore
def ignore_filter(spark, sf_dir):
    return I.apply_ignore(FX.observed(spark, sf_dir), FX.rules(spark)).select("path")


def show_ignored(spark, sf_dir):
    return I.show_ignored(FX.observed(spark, sf_dir), FX.rules(spark))


def max_depth(spark, sf_dir):
    from lakeaudit.functions.paths import depth
    return I.max_depth(FX.pages_objects(spark, sf_dir), 3).select("path", depth("path").cast("bigint").alias("depth"))


def nearest_root(spark, sf_dir):
    return R.nearest_root(FX.observed(spark, sf_dir).select("path"), FX.roots(spark))


def relativize(spark, sf_dir):
    return FX.observed(spark, sf_dir).select("path", _relativize("path", "src1").alias("rel"))


# ------------------------------------------------- manifests as data
def seal(spark, sf_dir):
    return S.seal(FX.observed(spark, sf_dir))


def verify_seal(spark, sf_dir):
    return S.verify_seal(FX.stored(spark, sf_dir), S.seal(FX.observed(spark, sf_dir)))


def fuse(spark, sf_dir):
    return U.fuse(FX.fuse_sources(spark, sf_dir))


def fuse_count(spark, sf_dir):
    return U.fuse_count(FX.fuse_sources(spark, sf_dir))


# ---------------------------------------------------------------- rates
HOUR_MS = 3_600_000
RATE_SLOTS = 24


def rate_buckets(spark, sf_dir):
    return RT.rate_buckets(FX.table(spark, sf_dir, "events"), "ts", "event_type", "value", HOUR_MS, RATE_SLOTS)


def rate_totals(spark, sf_dir):
    return RT.rate_totals(FX.table(spark, sf_dir, "events"), "ts", "event_type", HOUR_MS)


def rate_levels(spark, sf_dir):
    return RT.rate_levels(rate_buckets(spark, sf_dir), "events")


# ----------------------------------------------------- scalar functions
_SIZE_COLS = ["s_b", "s_k", "s_m", "s_g", "s_c"]


def format_size(spark, sf_dir):
    d = FX.document_sizes(spark, sf_dir)
    return d.select("doc_id", *[_fmt(c).alias("f" + c[1:]) for c in _SIZE_COLS])


def parse_size(spark, sf_dir):
    # two projections: the formatted text is computed once and parsed
    f = format_size(spark, sf_dir)
    return f.select("doc_id", *[_parse("f" + c[1:]).alias("p" + c[1:]) for c in _SIZE_COLS])


def content_hash(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit("md5").alias("algo"), _chash("text", "md5").alias("hash"),
                    F.octet_length("text").cast("bigint").alias("size"))


def content_hash_sha512(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.lit("sha512").alias("algo"), _chash("text", "sha512").alias("hash"),
                    F.octet_length("text").cast("bigint").alias("size"))


# ------------------------------------------------------------- further
def select_hashes(spark, sf_dir):
    requested = _items(spark, sf_dir).where(F.col("path").contains("/de/")).select("hash")
    return D.select_hashes(_bags(spark, sf_dir), requested).drop("win_key", "keeper")


def status_flags(spark, sf_dir):
    from lakeaudit.functions.status import is_error_or_warning, is_verbose
    ev = A.events(_audit_table(spark, sf_dir))
    return ev.select("path", "status", is_error_or_warning("status").alias("is_error_or_warning"),
                     is_verbose("status").alias("is_verbose"))


def legacy_size_fill(spark, sf_dir):
    legacy = FX.stored(spark, sf_dir).withColumn(
        "size", F.when(F.col("dir").endswith("/fr"), F.lit(None).cast("bigint")).otherwise(F.col("size")))
    listing = FX.observed(spark, sf_dir).select("path", "size")
    return D.dup_space(legacy, None, listing, min_size=FX.DUP_MIN_SIZE).drop("win_key", "keeper")


def dir_lists(spark, sf_dir):
    return A.dir_pairs(FX.observed(spark, sf_dir))


def rehash_algo(spark, sf_dir):
    t = A.audit(FX.stored(spark, sf_dir, sha512_suffix="/de"), FX.documents_objects(spark, sf_dir, algo=None),
                algos=["md5", "sha512"])
    return t.where(F.col("status").isNotNull()).select("path", "status", "algo", "hash")


QUERIES: dict[str, Query] = {
    "audit_status": audit_status,
    "audit_summary": audit_summary,
    "changed_dirs": changed_dirs,
    "verdict": verdict,
    "next_manifest": next_manifest,
    "next_manifest_force": next_manifest_force,
    "keep_missing": keep_missing,
    "skip_existing": skip_existing,
    "vanished_dirs": vanished_dirs,
    "damaged": damaged,
    "report": report,
    "row_audit": row_audit,
    "dup_bags": dup_bags,
    "dup_space": dup_space,
    "dup_report": dup_report,
    "dup_show": dup_show,
    "dup_items": dup_items,
    "dedup_plan": dedup_plan,
    "dedup_apply": dedup_apply,
    "space_after": space_after,
    "same_placement": same_placement,
    "dedup_paths": dedup_paths,
    "bags_json": bags_json,
    "ignore_filter": ignore_filter,
    "show_ignored": show_ignored,
    "max_depth": max_depth,
    "nearest_root": nearest_root,
    "relativize": relativize,
    "seal": seal,
    "verify_seal": verify_seal,
    "fuse": fuse,
    "fuse_count": fuse_count,
    "rate_buckets": rate_buckets,
    "rate_totals": rate_totals,
    "rate_levels": rate_levels,
    "format_size": format_size,
    "parse_size": parse_size,
    "content_hash": content_hash,
    "content_hash_sha512": content_hash_sha512,
    "select_hashes": select_hashes,
    "status_flags": status_flags,
    "legacy_size_fill": legacy_size_fill,
    "dir_lists": dir_lists,
    "rehash_algo": rehash_algo,
}

QUERIES.update(FILE_QUERIES)
