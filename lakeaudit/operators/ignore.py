"""Hierarchical ignore rules.

A listing entry ``c1/../ck`` is out when any component ``cj`` on its path
is ignored as an entry of its directory (ignored directories are pruned).
Component ``cj`` is ignored when

* it is a manifest file: starts with the index name or equals the ignore
  file name (F2, never reported), or starts with ``.`` without
  ``include_dot`` (F3);
* a rule of its own directory matches ``cj`` (a leading ``/`` is dropped);
* a rule without leading ``/`` of an ancestor directory ``A`` matches
  ``cj`` or the path of ``cj`` relative to ``A``;
* a global rule (above the scan root) matches ``cj`` or
  ``<root name>/c1/../cj``.

Rules have no negation, so any match decides.  Each distinct directory is
judged once, whatever it holds; below a directory that is out nothing else is
tested, and of the rest only an entry's own name is (``judge``).

A table of up to ``FEW_RULES`` rules is broadcast and each (entry, ancestor)
pair meets the rules of that ancestor.  Of a larger one the rules that are
plain names, names with one leading or one trailing ``*`` are found by hash
lookups of the name, its beginnings and its ends of the lengths that occur;
the other patterns of a directory are combined into expressions of
``RULES_AT_ONCE`` each.  So the work follows the entries, not entries times
rules.  Lookup tables are broadcast after a size check, with a skew-aware join
beyond it, since the root directory is a key every path meets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeaudit.functions.glob import glob_regex
from lakeaudit.functions.paths import component_pairs, own_pairs, parent_dir, path_parts
from lakeaudit.operators.joins import broadcast_if_small, lookup_join
from lakeaudit.session import checkpoint_dir

# names of manifest and rule files; a caller whose files have other names
# gives those
INDEX_NAME = ".lakeindex"
IGNORE_NAME = ".lakeignore"
GLOBAL_DIR = "\u0000global"
# rules up to which every pair meets all rules of its ancestor, and patterns
# that are combined into one expression beyond that
FEW_RULES, RULES_AT_ONCE = 64, 200


def compile_rules(rules: DataFrame) -> DataFrame:
    """``(dir, pattern)`` -> ``(dir, pattern, anchored, regex)``.

    Lines are trimmed of all white space; blank lines and ``#`` comments are
    dropped (S6).  ``dir`` is relative to the scan root, ``''`` (or ``.``) for
    the root itself.
    """
    d = F.when(F.col("dir") == ".", F.lit("")).otherwise(F.regexp_replace("dir", r"^(\./|/)+|/+$", ""))
    p = F.regexp_replace("pattern", r"(?U)^\s+|\s+$", "")
    r = rules.select(d.alias("dir"), p.alias("pattern")).where(
        (F.col("pattern") != "") & ~F.col("pattern").startswith("#"))
    anchored = F.col("pattern").startswith("/")
    body = F.when(anchored, F.substring("pattern", 2, 1 << 30)).otherwise(F.col("pattern"))
    return r.select("dir", "pattern", anchored.alias("anchored"), glob_regex(body).alias("regex"))


def _builtin_hit(name, include_dot: bool, index_name: str, ignore_name: str):
    hit = name.startswith(index_name) | (name == ignore_name)
    if not include_dot:
        hit = hit | name.startswith(".")
    return hit


def _manifest_name(name, index_name: str, ignore_name: str):
    return name.startswith(index_name) | (name == ignore_name)


def _pairs(paths: DataFrame, root_name: str, last_only: bool, with_global: bool) -> DataFrame:
    """``path, anc, entry, rel, own, j, entry_path``: every component of a
    path (the last only) with each directory above it, and with the list of
    global rules."""
    cols = ("anc", "entry", "rel", "own", "j", "entry_path")
    pairs = paths.select("path", F.explode(own_pairs("path") if last_only else component_pairs("path")).alias("p")).select(
        "path", *[f"p.{c}" for c in cols])
    if with_global:
        parts = path_parts("path")
        gp = paths.select("path", F.explode(F.transform(
            F.sequence(F.size(parts) if last_only else F.lit(1), F.size(parts)),
            lambda j: F.struct(
                F.lit(GLOBAL_DIR).alias("anc"),
                F.element_at(parts, j).alias("entry"),
                F.concat(F.lit(root_name + "/"), F.array_join(F.slice(parts, 1, j), "/")).alias("rel"),
                F.lit(False).alias("own"),
                j.alias("j"),
                F.array_join(F.slice(parts, 1, j), "/").alias("entry_path"),
            ))).alias("p")).select("path", *[f"p.{c}" for c in cols])
        pairs = pairs.unionByName(gp)
    return pairs


def _compiled(rules: DataFrame | None, global_rules: DataFrame | None) -> DataFrame:
    out = compile_rules(rules) if rules is not None else None
    if global_rules is not None:
        g = compile_rules(global_rules.withColumn("dir", F.lit(""))).withColumn("dir", F.lit(GLOBAL_DIR))
        out = g if out is None else out.unionByName(g)
    return out


class RuleSet:
    """Rules made ready to be matched: few ones as a local table, many ones
    as lookup tables, which are written once."""

    SCHEMA = "dir string, pattern string, anchored boolean, regex string"

    def __init__(self, spark, rules: DataFrame | None, global_rules: DataFrame | None = None, few: int | None = None):
        few = FEW_RULES if few is None else few
        compiled = _compiled(rules, global_rules)
        self.with_global = global_rules is not None
        head = compiled.limit(few + 1).collect() if compiled is not None else []
        self.empty, self.few, self.tables = not head, None, {}
        if len(head) <= few:
            self.few = spark.createDataFrame([tuple(r) for r in head], self.SCHEMA)
            return
        checkpoint_dir(spark)
        body = F.when(F.col("anchored"), F.substring("pattern", 2, 1 << 30)).otherwise(F.col("pattern"))
        plain = ~body.rlike(r"[*?\[\\\\]")
        # one star, at the beginning or end of a plain name: it stands for
        # anything without "/"
        kind = (F.when(plain, "exact").when(body.rlike(r"^\*[^*?\[\\\\/]+$"), "end").when(body.rlike(r"^[^*?\[\\\\]+\*$"), "begin").otherwise("regex"))
        part = F.when(kind == "end", F.substring(body, 2, 1 << 30)).when(kind == "begin", F.expr("substring(body, 1, length(body) - 1)")).otherwise(F.col("body"))
        rows = compiled.withColumn("body", body).withColumn("kind", kind).withColumn("part", part).select(
            F.col("dir").alias("anc"), "anchored", "kind", "part", "regex").distinct().checkpoint()
        # a row per length of a name that occurs
        sizes = rows.where("kind <> 'regex'").groupBy("kind", F.length("part").alias("n")).count().collect()
        self.lengths = {k: sorted({r.n for r in sizes if r.kind == k}) for k in ("exact", "end", "begin")}
        for k in self.lengths:
            # a rule that holds for paths below holds in its directory too
            table = rows.where(F.col("kind") == k).groupBy("anc", "part").agg(F.bool_and("anchored").alias("anchored"))
            self.tables[k] = table if self.lengths[k] else None
        general = rows.where("kind = 'regex' AND regex IS NOT NULL").withColumn("_cut", F.row_number().over(
            Window.partitionBy("anc", "anchored", F.pmod(F.xxhash64("part"), F.lit(256))).orderBy("part")))
        general = general.groupBy("anc", "anchored", F.pmod(F.xxhash64("part"), F.lit(256)).alias("_h"), F.floor(F.col("_cut") / RULES_AT_ONCE).alias("_c"))
        general = general.agg(F.array_join(F.transform(F.collect_list("regex"), lambda r: F.concat(F.lit("(?:"), r, F.lit(")"))), "|").alias("regex"))
        self.tables["regex"] = general.select("anc", "anchored", "regex").checkpoint()
        if self.tables["regex"].isEmpty():
            self.tables["regex"] = None


_PATTERN_HIT = ("(own AND regexp_like(entry, regex)) OR (NOT own AND NOT anchored AND (regexp_like(entry, regex) OR regexp_like(rel, regex)))")


def _matches(paths: DataFrame, rules: RuleSet, root_name: str = "", last_only: bool = False) -> DataFrame:
    """``path, j, entry_path`` of every component that a rule ignores."""
    pairs = _pairs(paths.select("path"), root_name, last_only, rules.with_global)
    out = ["path", "j", "entry_path"]
    if rules.few is not None:
        # counted when it was collected
        return pairs.join(F.broadcast(rules.few.withColumnRenamed("dir", "anc")), "anc").where(F.expr(_PATTERN_HIT)).select(*out)
    found = []
    hit = "own OR NOT anchored"
    # a name in its own directory; elsewhere the name and the path below
    targets = pairs.select("*", F.explode(F.when(F.col("own") | (F.col("entry") == F.col("rel")), F.array("entry")).otherwise(F.array("entry", "rel"))).alias("_t"))

    def look(rows: DataFrame, kind: str) -> None:
        found.append(lookup_join(rows, rules.tables[kind], ["anc", "part"], "inner", spread_by="path").where(hit).select(*out))

    if rules.tables["exact"] is not None:
        look(targets.withColumn("part", F.col("_t")), "exact")
    if rules.tables["end"] is not None:
        lengths = F.array(*[F.lit(n) for n in rules.lengths["end"]])
        rows = pairs.select("*", F.explode(F.filter(lengths, lambda n: n <= F.length("entry"))).alias("_n"))
        look(rows.withColumn("part", F.expr("substring(entry, length(entry) - _n + 1, _n)")), "end")
    if rules.tables["begin"] is not None:
        lengths = F.array(*[F.lit(n) for n in rules.lengths["begin"]])
        rows = targets.select("*", F.explode(F.filter(lengths, lambda n: n <= F.length("_t"))).alias("_n"))
        look(rows.where("instr(substring(_t, _n + 1), '/') = 0").withColumn("part", F.expr("substring(_t, 1, _n)")), "begin")
    if rules.tables["regex"] is not None:
        found.append(lookup_join(pairs, rules.tables["regex"], ["anc"], "inner", spread_by="path").where(F.expr(_PATTERN_HIT)).select(*out))
    all_ = found[0]
    for f in found[1:]:
        all_ = all_.unionByName(f)
    return all_


def rule_matches(listing: DataFrame, rules: DataFrame, global_rules: DataFrame | None = None,
                 root_name: str = "", last_only: bool = False) -> DataFrame:
    """Every (path, component j) a rule ignores: ``path, j, entry_path``;
    with ``last_only`` only the path's own name is tested."""
    return _matches(listing, RuleSet(listing.sparkSession, rules, global_rules), root_name, last_only)


def builtin_out(include_dot: bool = False, index_name: str = INDEX_NAME, ignore_name: str = IGNORE_NAME):
    """Column: some component of ``path`` is a manifest file or a dot name."""
    return F.exists(path_parts("path"), lambda c: _builtin_hit(c, include_dot, index_name, ignore_name))


def _sides(listing: DataFrame, rules: RuleSet, include_dot: bool, root_name: str, index_name: str, ignore_name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``kept``: the listing without what is out; ``tops (path)``: topmost
    directories that are out, of those that hold an entry; ``own``: the
    entries below none of these that are out themselves."""
    columns = listing.columns
    named = listing.withColumn("_dir", parent_dir("path")).withColumn("_own", _builtin_hit(F.substring_index("path", "/", -1), include_dot, index_name, ignore_name))
    parts = path_parts("path")
    # each directory is judged once, however many entries it holds
    dirs = named.select(F.col("_dir").alias("path")).where("path <> ''").distinct()
    hits = dirs.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda j: F.struct(
        j.alias("j"), F.array_join(F.slice(parts, 1, j), "/").alias("entry_path"),
        _builtin_hit(F.element_at(parts, j), include_dot, index_name, ignore_name).alias("hit")))).alias("b")).where("b.hit").select("path", "b.j", "b.entry_path")
    if not rules.empty:
        hits = hits.unionByName(_matches(dirs, rules, root_name))
    top = hits.groupBy(F.col("path").alias("_dir")).agg(F.min(F.struct("j", "entry_path")).alias("_t")).select("_dir", F.col("_t.entry_path").alias("_top"))
    # what is out is usually little: written once, counted, and broadcast when
    # small, so the listing itself is not shuffled
    checkpoint_dir(listing.sparkSession)
    top = top.checkpoint()
    rest = lookup_join(named, top.select("_dir"), ["_dir"], "left_anti", spread_by="path")
    tops = top.select(F.col("_top").alias("path")).distinct()
    kept, own = rest.where(~F.col("_own")), rest.where("_own").select(*columns)
    if not rules.empty:
        m = broadcast_if_small(_matches(kept, rules, root_name, last_only=True).select("path").distinct(), materialize=True)
        own = own.unionByName(kept.join(m, "path", "left_semi").select(*columns))
        kept = kept.join(m, "path", "left_anti")
    return kept.select(*columns), tops, own


def judge(listing: DataFrame, rules: DataFrame | None, *, include_dot: bool = False, global_rules: DataFrame | None = None, root_name: str = "",
          index_name: str = INDEX_NAME, ignore_name: str = IGNORE_NAME) -> tuple[DataFrame, DataFrame]:
    """F1 and F9 of a listing with ``kind``, from one judgement: what is kept,
    and what is reported as ignored (``path, kind``)."""
    ready = RuleSet(listing.sparkSession, rules, global_rules)
    kept, tops, own = _sides(listing, ready, include_dot, root_name, index_name, ignore_name)
    name = F.substring_index("path", "/", -1)
    entries = own.where(F.col("kind").isin("file", "dir")).where((F.col("kind") == "dir") | ~_manifest_name(name, index_name, ignore_name)).select("path", "kind")
    return kept, tops.select("path", F.lit("dir").alias("kind")).unionByName(entries).distinct()


def apply_ignore(listing: DataFrame, rules: DataFrame | None, *, include_dot: bool = False,
                 global_rules: DataFrame | None = None, root_name: str = "",
                 index_name: str = INDEX_NAME, ignore_name: str = IGNORE_NAME) -> DataFrame:
    """the listing without ignored entries and without entries below an
    ignored directory."""
    kept = listing.where(~builtin_out(include_dot, index_name, ignore_name))
    ready = RuleSet(listing.sparkSession, rules, global_rules)
    if ready.empty:
        return kept  # no rule anywhere: the narrow built-in filter is all
    named = kept.withColumn("_dir", parent_dir("path"))
    # each directory is judged once; then only an entry's own name is left
    dirs = named.select(F.col("_dir").alias("path")).where("path <> ''").distinct()
    bad = _matches(dirs, ready, root_name).select(F.col("path").alias("_dir")).distinct()
    named = lookup_join(named, bad, ["_dir"], "left_anti", spread_by="path", materialize=True)
    m = broadcast_if_small(_matches(named, ready, root_name, last_only=True).select("path").distinct(), materialize=True)
    return named.join(m, "path", "left_anti").select(*listing.columns)


def show_ignored(listing: DataFrame, rules: DataFrame | None, *, include_dot: bool = False,
                 global_rules: DataFrame | None = None, root_name: str = "",
                 index_name: str = INDEX_NAME, ignore_name: str = IGNORE_NAME) -> DataFrame:
    """what a run reports as ignored -- the topmost ignored component of
    each path once (``path, kind``; kind ``dir`` or ``file``, from the
    listing's ``kind`` where it has one); manifest files are not reported."""
    if "kind" not in listing.columns:
        listing = listing.withColumn("kind", F.lit("file"))
    listing = listing.withColumn("kind", F.when(F.col("kind") == "dir", "dir").otherwise("file"))
    return judge(listing, rules, include_dot=include_dot, global_rules=global_rules, root_name=root_name,
                 index_name=index_name, ignore_name=ignore_name)[1]


def max_depth(listing: DataFrame, n: int) -> DataFrame:
    """keep entries at most ``n`` levels below the scan root (a file in
    the root is level 1); ``n = 0`` is no limit.  F5 (no recursion) is n=1."""
    if n <= 0:
        return listing
    return listing.where(F.size(path_parts("path")) <= F.lit(n))
