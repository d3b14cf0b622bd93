"""DuckDB oracle SQL for the registered queries (same column names).

Written independently of the Spark plans, as plain SQL over the driver's
views (``documents``, ``lineitem``, ``events`` ...).  Shared derivations are
common table expressions; DuckDB only evaluates the ones a query uses.
"""

from __future__ import annotations

# ----------------------------------------------------------------- shared CTEs
BASE = r"""
observed AS (
  SELECT doc_id, concat(source, '/', lang) AS dir, concat('d', doc_id, '.txt') AS name,
         concat(source, '/', lang, '/d', doc_id, '.txt') AS path,
         CAST(1700000000000 + doc_id * 1000 AS BIGINT) AS mod_ms, 'md5' AS algo, md5(text) AS hash,
         CAST(strlen(text) AS BIGINT) AS size
  FROM documents
),
stored AS (
  SELECT dir, name, path,
         CAST(CASE WHEN doc_id % 23 = 0 OR (doc_id % 23 > 2 AND doc_id % 29 = 0) THEN mod_ms - 1000
              WHEN doc_id % 23 = 2 THEN mod_ms + 1000 ELSE mod_ms END AS BIGINT) AS mod_ms,
         algo,
         CASE WHEN doc_id % 23 <= 2 THEN md5(concat(hash, 'x')) ELSE hash END AS hash, size
  FROM observed WHERE doc_id % 17 <> 0
  UNION ALL
  SELECT dir, concat('gone', doc_id, '.txt'), concat(dir, '/gone', doc_id, '.txt'), mod_ms, algo, hash, size
  FROM observed WHERE doc_id % 19 = 0
),
aud AS (
  SELECT coalesce(o.dir, s.dir) AS dir, coalesce(o.name, s.name) AS name, coalesce(o.path, s.path) AS path,
         s.path IS NOT NULL AS a_in, o.path IS NOT NULL AS b_in,
         s.mod_ms AS a_mod, o.mod_ms AS b_mod, s.hash AS a_hash, o.hash AS b_hash,
         s.algo AS a_algo, s.size AS a_size, o.size AS b_size,
         CASE WHEN s.path IS NULL THEN 'new'
              WHEN o.path IS NULL THEN 'del'
              WHEN s.hash = o.hash THEN 'ok'
              WHEN s.mod_ms = o.mod_ms THEN 'DMG'
              WHEN s.mod_ms < o.mod_ms THEN 'upd'
              ELSE 'old' END AS status
  FROM stored s FULL OUTER JOIN observed o ON s.path = o.path
),
stored_pairs AS (
  SELECT DISTINCT array_to_string(parts[1:i - 1], '/') AS dir, parts[i] AS subdir
  FROM (SELECT string_split(dir, '/') AS parts FROM stored) t,
       LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i) g
  UNION
  SELECT * FROM (VALUES ('src2', 'zz'), ('src2/zz', 'deep')) v(dir, subdir)
),
current_pairs AS (
  SELECT DISTINCT array_to_string(parts[1:i - 1], '/') AS dir, parts[i] AS subdir
  FROM (SELECT string_split(dir, '/') AS parts FROM observed) t,
       LATERAL (SELECT unnest(generate_series(1, len(parts))) AS i) g
),
visited AS (
  SELECT CASE WHEN dir = '' THEN subdir ELSE dir || '/' || subdir END AS dir FROM current_pairs
  UNION SELECT ''
),
vanished AS (
  SELECT g.dir, g.subdir AS name,
         CASE WHEN g.dir = '' THEN g.subdir ELSE g.dir || '/' || g.subdir END AS path, 'del' AS status
  FROM (SELECT * FROM stored_pairs EXCEPT SELECT * FROM current_pairs) g
  WHERE g.dir IN (SELECT dir FROM visited)
),
dirlist_changed AS (
  SELECT DISTINCT dir FROM (
    SELECT * FROM (SELECT * FROM current_pairs EXCEPT SELECT * FROM stored_pairs)
    UNION ALL
    SELECT * FROM (SELECT * FROM stored_pairs EXCEPT SELECT * FROM current_pairs))
  WHERE dir IN (SELECT dir FROM visited)
),
changed AS (
  SELECT DISTINCT dir FROM aud
  WHERE status IN ('new', 'upd', 'old', 'del') OR (status = 'ok' AND a_mod <> b_mod)
  UNION SELECT dir FROM dirlist_changed
)"""

ROWS = r"""
li_cur AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS dir, concat(l_orderkey, '-', l_linenumber) AS name,
         epoch_ms(l_shipdate) AS mod_ms,
         concat_ws(chr(31),
           coalesce(CAST(l_partkey AS VARCHAR), '\N'), coalesce(CAST(l_suppkey AS VARCHAR), '\N'),
           coalesce(CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR), '\N'),
           coalesce(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), '\N'),
           coalesce(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), '\N'),
           coalesce(CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR), '\N'),
           coalesce(l_returnflag, '\N'), coalesce(l_linestatus, '\N')) AS txt
  FROM lineitem
),
li_prev_src AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_returnflag = 'R' THEN l_quantity - 1 ELSE l_quantity END AS l_quantity,
         l_extendedprice,
         CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN l_discount + 0.01 ELSE l_discount END AS l_discount,
         l_tax, l_returnflag, l_linestatus, l_shipdate,
         CASE WHEN l_returnflag = 'R' THEN epoch_ms(l_shipdate) - 86400000 ELSE epoch_ms(l_shipdate) END AS mod_ms
  FROM lineitem WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'O')
  UNION ALL
  SELECT l_orderkey, 0, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus, l_shipdate, epoch_ms(l_shipdate)
  FROM lineitem WHERE l_linestatus = 'F' AND l_linenumber = 1
),
li_prev AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS dir, concat(l_orderkey, '-', l_linenumber) AS name, mod_ms,
         concat_ws(chr(31),
           coalesce(CAST(l_partkey AS VARCHAR), '\N'), coalesce(CAST(l_suppkey AS VARCHAR), '\N'),
           coalesce(CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR), '\N'),
           coalesce(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), '\N'),
           coalesce(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), '\N'),
           coalesce(CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR), '\N'),
           coalesce(l_returnflag, '\N'), coalesce(l_linestatus, '\N')) AS txt
  FROM li_prev_src
)"""


DUPS = r"""
loc AS (
  SELECT path, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE concat(hash, '-', doc_id % 2) END AS place
  FROM observed
),
items AS (
  SELECT o.hash, o.path, o.size, l.place IS NULL AS unknown,
         CASE WHEN l.place IS NULL OR l.place = '' THEN chr(1) || o.path ELSE l.place END AS class_key
  FROM observed o LEFT JOIN loc l ON o.path = l.path
  WHERE o.hash IS NOT NULL AND NOT coalesce(o.size >= 0 AND o.size < 256, false)
),
classes AS (
  SELECT hash, class_key, count(*) AS n, min(path) AS cmin, bool_or(unknown) AS unk
  FROM items GROUP BY hash, class_key
),
bag0 AS (
  SELECT hash, sum(n) AS n_items, count(*) AS n_classes, max(n) AS max_n, bool_or(unk) AS ext_unknown
  FROM classes GROUP BY hash
),
bsize AS (SELECT hash, arg_min(size, path) AS size FROM items WHERE size >= 0 GROUP BY hash),
bwin AS (
  SELECT hash, class_key AS win_key FROM (
    SELECT hash, class_key, row_number() OVER (PARTITION BY hash ORDER BY n DESC, cmin) AS rn FROM classes)
  WHERE rn = 1
),
bags AS (
  SELECT b.hash, s.size, CAST(b.n_items AS BIGINT) AS n_items, CAST(b.n_classes AS BIGINT) AS n_classes,
         CAST(CASE WHEN b.max_n >= 2 THEN b.max_n ELSE 0 END AS BIGINT) AS merged_n,
         b.ext_unknown, w.win_key
  FROM bag0 b JOIN bsize s USING (hash) JOIN bwin w USING (hash)
  WHERE b.n_items >= 2 AND s.size >= 256
),
bitems AS (
  SELECT i.hash, i.path, b.size, (i.class_key = b.win_key AND b.merged_n >= 2) AS merged
  FROM items i JOIN bags b USING (hash)
),
keepers AS (
  SELECT hash, path AS keeper FROM (
    SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY merged DESC, path) AS rn FROM bitems)
  WHERE rn = 1
),
plan AS (
  SELECT i.hash, k.keeper, i.path AS duplicate, i.size AS bytes
  FROM bitems i JOIN keepers k USING (hash)
  WHERE NOT i.merged AND i.path <> k.keeper
)"""

# Size units.
UNITS = ["", "K", "M", "G", "T", "P"]


def fmt_sql(x: str) -> str:
    """Size formatting as one SQL CASE over integer arithmetic."""
    out = [f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= 0 THEN CAST({x} AS VARCHAR)"]
    for k, u in enumerate(UNITS):
        d = 1024 ** k
        whole, rem = f"({x} // {d})", f"({x} % {d})"
        t, r2 = f"(({rem} * 10) // {d})", f"(({rem} * 10) % {d})"
        tt = f"({t} + CASE WHEN 2 * {r2} > {d} OR (2 * {r2} = {d} AND {t} % 2 = 1) THEN 1 ELSE 0 END)"
        out.append(
            f" WHEN {x} < {1024 ** (k + 1)} THEN CASE"
            f" WHEN {rem} = 0 THEN CAST({whole} AS VARCHAR) || '{u}'"
            f" WHEN {tt} = 10 THEN CAST({whole} + 1 AS VARCHAR) || '.0{u}'"
            f" ELSE CAST({whole} AS VARCHAR) || '.' || CAST({tt} AS VARCHAR) || '{u}' END")
    out.append(f" ELSE CAST({x} AS VARCHAR) END")
    return "".join(out)


SEAL = r"""
entry_h AS (
  SELECT dir, md5(concat_ws(chr(31), name, CAST(mod_ms AS VARCHAR), coalesce(algo, '\N'), coalesce(hash, '\N'),
                            coalesce(CAST(size AS VARCHAR), '\N'))) AS h
  FROM observed
),
seals AS (
  SELECT dir, CAST(count(*) AS VARCHAR) || ':' || CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) AS VARCHAR)
         || ':' || CAST(sum(('0x' || substr(h, 9, 8))::BIGINT) AS VARCHAR)
         || ':' || CAST(sum(('0x' || substr(h, 17, 8))::BIGINT) AS VARCHAR)
         || ':' || CAST(sum(('0x' || substr(h, 25, 8))::BIGINT) AS VARCHAR) AS seal
  FROM entry_h GROUP BY dir
),
stored_h AS (
  SELECT dir, md5(concat_ws(chr(31), name, CAST(mod_ms AS VARCHAR), coalesce(algo, '\N'), coalesce(hash, '\N'),
                            coalesce(CAST(size AS VARCHAR), '\N'))) AS h
  FROM stored
),
stored_seals AS (
  SELECT dir, CAST(count(*) AS VARCHAR) || ':' || CAST(sum(('0x' || substr(h, 1, 8))::BIGINT) AS VARCHAR)
         || ':' || CAST(sum(('0x' || substr(h, 9, 8))::BIGINT) AS VARCHAR)
         || ':' || CAST(sum(('0x' || substr(h, 17, 8))::BIGINT) AS VARCHAR)
         || ':' || CAST(sum(('0x' || substr(h, 25, 8))::BIGINT) AS VARCHAR) AS seal
  FROM stored_h GROUP BY dir
)"""

FUSE = r"""
src AS (
  SELECT '' AS source_root, 'split' AS kind, dir, name, mod_ms, algo, hash, size FROM stored
  UNION ALL
  SELECT split_part(dir, '/', 1), 'atom', regexp_extract(dir, '^[^/]*/?(.*)$', 1), name, mod_ms, algo, hash, size
  FROM observed
  UNION ALL
  SELECT dir, 'atom', '', name, mod_ms, algo, hash, size FROM stored WHERE ends_with(dir, '/en')
  UNION ALL
  SELECT dir, 'split', '', name, mod_ms, algo, md5(concat(hash, 'split')), size FROM observed WHERE ends_with(dir, '/en')
),
taken AS (
  SELECT * FROM src
  WHERE source_root <> ''
    AND (kind = 'atom' OR source_root NOT IN (SELECT source_root FROM src WHERE kind = 'atom'))
),
fsrc AS (
  SELECT *, CASE WHEN dir = '' THEN source_root ELSE source_root || '/' || dir END AS fdir,
         len(string_split(source_root, '/')) AS depth
  FROM taken
),
fwin AS (SELECT fdir, max(depth) AS depth FROM fsrc GROUP BY fdir)"""

RATES = r"""
ev AS (SELECT event_type AS key, epoch_ms(ts) AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events),
bounds AS (
  SELECT min(t) AS lo, max(t) AS hi, greatest((max(t) - min(t) + 3599999) // 3600000 - 1, 0) AS open_b FROM ev
),
bagg AS (
  SELECT key, greatest((ev.t - b.lo + 3599999) // 3600000 - 1, 0) AS bucket,
         count(*) AS events, sum(v) AS value_cents
  FROM ev, bounds b
  WHERE ev.t > b.lo + (b.open_b - 24) * 3600000 AND ev.t <= b.lo + b.open_b * 3600000
  GROUP BY ALL
),
slots AS (
  SELECT k.key, s.slot, b.open_b - 24 + s.slot AS bucket
  FROM (SELECT DISTINCT key FROM ev) k, bounds b, range(0, 24) s(slot)
),
rb AS (
  SELECT s.key, CAST(s.slot AS BIGINT) AS slot, CAST(s.bucket AS BIGINT) AS bucket,
         CAST(coalesce(a.events, 0) AS BIGINT) AS events, CAST(coalesce(a.value_cents, 0) AS BIGINT) AS value_cents
  FROM slots s LEFT JOIN bagg a ON s.key = a.key AND s.bucket = a.bucket
)"""

SIZES = r"""
sz AS (
  SELECT doc_id, CAST(strlen(text) AS BIGINT) AS s_b, CAST(strlen(text) AS BIGINT) * 1031 AS s_k,
         CAST(strlen(text) AS BIGINT) * 1048583 AS s_m, CAST(strlen(text) AS BIGINT) * 1073741831 AS s_g,
         CAST(strlen(text) AS BIGINT) * strlen(text) * strlen(text) AS s_c
  FROM documents
)"""


def parse_sql(x: str) -> str:
    mult = ("CASE upper(right({x}, 1)) WHEN 'B' THEN 1 WHEN 'K' THEN 1024 WHEN 'M' THEN 1048576 "
            "WHEN 'G' THEN 1073741824 WHEN 'T' THEN 1099511627776 END").format(x=x)
    return (f"CAST(trunc(TRY_CAST(CASE WHEN length({x}) > 1 THEN left({x}, length({x}) - 1) END AS DOUBLE)"
            f" * CAST({mult} AS DOUBLE)) AS BIGINT)")


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body


def _q(body: str) -> str:
    return _with(body, BASE)


def _d(body: str) -> str:
    return _with(body, BASE, DUPS)


ORACLE: dict[str, str] = {
    "audit_status": _q("SELECT dir, name, path, status FROM aud"),
    "changed_dirs": _q("SELECT dir FROM changed"),
    "audit_summary": _q("""
SELECT CAST(count(*) FILTER (WHERE status IN ('DMG', 'old', 'upd', 'new', 'ok')) AS BIGINT) AS total,
       CAST(count(*) FILTER (WHERE status = 'new') AS BIGINT) AS new,
       CAST(count(*) FILTER (WHERE status IN ('upd', 'old')) AS BIGINT) AS upd,
       CAST(count(*) FILTER (WHERE status = 'del') + (SELECT count(*) FROM vanished) AS BIGINT) AS del,
       CAST((SELECT count(*) FROM changed) AS BIGINT) AS changed_dirs,
       CAST(count(*) FILTER (WHERE status = 'DMG') AS BIGINT) AS damaged,
       CAST(0 AS BIGINT) AS errors
FROM aud"""),
    "verdict": _q("""
SELECT CAST(CASE WHEN count(*) FILTER (WHERE status IN ('DMG', 'PNC')) > 0 THEN 1 ELSE 0 END AS BIGINT) AS exit_code,
       CAST(count(*) FILTER (WHERE status = 'DMG') AS BIGINT) AS damaged,
       CAST(count(*) FILTER (WHERE status = 'PNC') AS BIGINT) AS errors
FROM aud"""),
    "next_manifest": _q("""
SELECT dir, name, path,
       CASE WHEN status = 'DMG' THEN a_mod ELSE b_mod END AS mod_ms,
       CASE WHEN status = 'DMG' THEN a_algo ELSE coalesce(a_algo, 'md5') END AS algo,
       CASE WHEN status = 'DMG' THEN a_hash ELSE b_hash END AS hash,
       CASE WHEN status = 'DMG' THEN a_size ELSE b_size END AS size
FROM aud WHERE b_in"""),
    "next_manifest_force": _q("""
SELECT dir, name, path, b_mod AS mod_ms, coalesce(a_algo, 'md5') AS algo, b_hash AS hash, b_size AS size
FROM aud WHERE b_in"""),
    "keep_missing": _q("""
SELECT dir, name, path,
       CASE WHEN status IN ('DMG', 'del') THEN a_mod ELSE b_mod END AS mod_ms,
       coalesce(a_algo, 'md5') AS algo,
       CASE WHEN status IN ('DMG', 'del') THEN a_hash ELSE b_hash END AS hash,
       CASE WHEN status IN ('DMG', 'del') THEN a_size ELSE b_size END AS size
FROM aud"""),
    "skip_existing": _q("""
SELECT path,
       CASE WHEN NOT a_in THEN 'new' WHEN NOT b_in THEN 'del'
            WHEN a_mod = b_mod THEN 'ok'
            WHEN a_hash = b_hash THEN 'ok'
            WHEN a_mod < b_mod THEN 'upd' ELSE 'old' END AS status,
       CASE WHEN NOT b_in OR a_mod = b_mod THEN a_hash ELSE b_hash END AS hash,
       (NOT a_in) OR (b_in AND a_mod <> b_mod AND a_hash IS DISTINCT FROM b_hash) AS counted
FROM aud"""),
    "vanished_dirs": _q("SELECT dir, name, path, status FROM vanished"),
    "damaged": _q("SELECT dir, name, path, status FROM aud WHERE status = 'DMG'"),
    "report": _q("SELECT dir, name, path, status FROM aud WHERE status NOT IN ('ok', 'ign', 'new', 'xup')"),
    "row_audit": _with("""
SELECT coalesce(o.dir, s.dir) AS dir, coalesce(o.name, s.name) AS name,
       coalesce(o.dir || '/' || o.name, s.dir || '/' || s.name) AS path,
       CASE WHEN s.name IS NULL THEN 'new'
            WHEN o.name IS NULL THEN 'del'
            WHEN md5(s.txt) = md5(o.txt) THEN 'ok'
            WHEN s.mod_ms = o.mod_ms THEN 'DMG'
            WHEN s.mod_ms < o.mod_ms THEN 'upd'
            ELSE 'old' END AS status
FROM li_prev s FULL OUTER JOIN li_cur o ON s.dir = o.dir AND s.name = o.name""", ROWS),
    "ignore_filter": _q("""
SELECT path FROM observed
WHERE NOT (name LIKE '%7.txt' OR split_part(path, '/', 1) = 'src1'
           OR (dir = 'src2/en' AND name LIKE 'd1%.txt') OR dir = 'src3/de')"""),
    "show_ignored": _q("""
SELECT DISTINCT split_part(path, '/', 1) AS path, 'dir' AS kind FROM observed WHERE split_part(path, '/', 1) = 'src1'
UNION SELECT DISTINCT dir AS path, 'dir' AS kind FROM observed WHERE dir = 'src3/de'
UNION SELECT path, 'file' AS kind FROM observed
WHERE split_part(path, '/', 1) <> 'src1' AND dir <> 'src3/de'
  AND (name LIKE '%7.txt' OR (dir = 'src2/en' AND name LIKE 'd1%.txt'))"""),
    "max_depth": """
WITH p AS (
  SELECT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host,
         CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/'
              ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END AS upath
  FROM pages
), f AS (
  SELECT host || upath || CASE WHEN ends_with(upath, '/') THEN 'index.html' ELSE '' END AS path FROM p
)
SELECT path, CAST(len(string_split(path, '/')) AS BIGINT) AS depth FROM f
WHERE len(string_split(path, '/')) <= 3""",
    "nearest_root": _with("""
SELECT o.path, b.root, b.kind FROM observed o LEFT JOIN best b USING (path)""", BASE, r"""
roots AS (SELECT * FROM (VALUES ('src1', 'split'), ('src1', 'atom'), ('src1/en', 'split'), ('src2', 'atom')) v(root, kind)),
anc AS (
  SELECT t.path, array_to_string(t.parts[1:g.i], '/') AS anc, g.i AS depth
  FROM (SELECT path, string_split(dir, '/') AS parts FROM observed) t,
       LATERAL (SELECT unnest(generate_series(1, len(t.parts))) AS i) g
),
cand AS (
  SELECT a.path, r.root, r.kind, a.depth * 10 + CASE WHEN r.kind = 'atom' THEN 2 ELSE 1 END AS rk
  FROM anc a JOIN roots r ON a.anc = r.root
),
best AS (SELECT path, arg_max(root, rk) AS root, arg_max(kind, rk) AS kind FROM cand GROUP BY path)"""),
    "relativize": _q("""
SELECT path, CASE WHEN path = 'src1' THEN '.' WHEN starts_with(path, 'src1/') THEN substr(path, 6) END AS rel
FROM observed"""),
    "seal": _with("SELECT dir, seal FROM seals", BASE, SEAL),
    "verify_seal": _with("""
SELECT coalesce(s.dir, n.dir) AS dir, coalesce(s.seal = n.seal, false) AS verified,
       CASE WHEN coalesce(s.seal = n.seal, false) THEN NULL ELSE 'ERX' END AS status
FROM seals s FULL OUTER JOIN stored_seals n ON s.dir = n.dir""", BASE, SEAL),
    "fuse": _with("""
SELECT f.fdir AS dir, f.name, f.fdir || '/' || f.name AS path, f.mod_ms, f.algo, f.hash, f.size, f.source_root
FROM fsrc f JOIN fwin w ON f.fdir = w.fdir AND f.depth = w.depth""", BASE, FUSE),
    "fuse_count": _with("SELECT CAST(count(*) AS BIGINT) AS fused FROM (SELECT DISTINCT source_root, dir FROM taken)",
                        BASE, FUSE),
    "rate_buckets": _with("SELECT key, slot, bucket, events, value_cents FROM rb", RATES),
    "rate_totals": _with("""
SELECT key, CAST(count(*) FILTER (WHERE t <= b.lo + b.open_b * 3600000) AS BIGINT) AS closed,
       CAST(count(*) FILTER (WHERE t > b.lo + b.open_b * 3600000) AS BIGINT) AS current,
       CAST(count(*) AS BIGINT) AS total,
       CAST(count(*) AS DOUBLE) * CAST(1000 AS DOUBLE) / CAST(greatest(b.hi - b.lo, 1) AS DOUBLE) AS per_sec
FROM ev, bounds b GROUP BY key, b.lo, b.hi, b.open_b""", RATES),
    "rate_levels": _with("""
SELECT rb.key, rb.slot, rb.events,
       CAST(CASE WHEN m.hi = m.lo THEN 0
            ELSE round(CAST(rb.events - m.lo AS DOUBLE) * (CAST(7 AS DOUBLE) / CAST(m.hi - m.lo AS DOUBLE))) END
            AS BIGINT) AS level
FROM rb JOIN (SELECT key, min(events) AS lo, max(events) AS hi FROM rb GROUP BY key) m ON rb.key = m.key""", RATES),
    "format_size": _with(f"""
SELECT doc_id, {fmt_sql('s_b')} AS f_b, {fmt_sql('s_k')} AS f_k, {fmt_sql('s_m')} AS f_m,
       {fmt_sql('s_g')} AS f_g, {fmt_sql('s_c')} AS f_c
FROM sz""", SIZES),
    "parse_size": _with(f"""
SELECT doc_id, {parse_sql(fmt_sql('s_b'))} AS p_b, {parse_sql(fmt_sql('s_k'))} AS p_k,
       {parse_sql(fmt_sql('s_m'))} AS p_m, {parse_sql(fmt_sql('s_g'))} AS p_g, {parse_sql(fmt_sql('s_c'))} AS p_c
FROM sz""", SIZES),
    "content_hash": """
SELECT doc_id, 'md5' AS algo, md5(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM documents""",
    "select_hashes": _d("""
SELECT hash, size, n_items, n_classes, merged_n, size * merged_n AS shared, size * n_classes AS exclusive,
       ext_unknown, merged_n > 0 AS has_merged
FROM bags WHERE hash IN (SELECT hash FROM bitems WHERE contains(path, '/de/'))"""),
    "status_flags": _q("""
SELECT path, status, status IN ('PNC', 'DMG', 'ERX', 'old') AS is_error_or_warning,
       status IN ('ok', 'ign') AS is_verbose
FROM aud"""),
    "legacy_size_fill": _with("""
SELECT hash, size, n_items, n_items AS n_classes, CAST(0 AS BIGINT) AS merged_n, size * 0 AS shared,
       size * n_items AS exclusive, true AS ext_unknown, false AS has_merged
FROM lb WHERE n_all >= 2 AND n_items >= 2 AND size >= 256""", BASE, r"""
lman AS (
  SELECT path, hash, CASE WHEN ends_with(dir, '/fr') THEN NULL ELSE size END AS size FROM stored
),
litems AS (
  SELECT m.hash, m.path, m.size, o.path IS NOT NULL AS present, o.size AS lsize
  FROM lman m LEFT JOIN observed o ON m.path = o.path
  WHERE m.hash IS NOT NULL AND NOT coalesce(m.size >= 0 AND m.size < 256, false)
),
lb AS (
  SELECT hash, count(*) AS n_all, CAST(count(*) FILTER (WHERE present) AS BIGINT) AS n_items,
         coalesce(arg_min(size, path) FILTER (WHERE size >= 0),
                  arg_min(lsize, path) FILTER (WHERE present AND lsize IS NOT NULL)) AS size
  FROM litems GROUP BY hash
)"""),
    "dir_lists": _q("SELECT dir, subdir FROM current_pairs"),
    "dup_bags": _d("""
SELECT hash, arg_min(size, path) FILTER (WHERE size >= 0) AS size, CAST(count(*) AS BIGINT) AS n
FROM items GROUP BY hash
HAVING count(*) >= 2 AND arg_min(size, path) FILTER (WHERE size >= 0) >= 256"""),
    "dup_space": _d("""
SELECT hash, size, n_items, n_classes, merged_n, size * merged_n AS shared, size * n_classes AS exclusive,
       ext_unknown, merged_n > 0 AS has_merged
FROM bags"""),
    "dup_report": _d("""
SELECT CAST(count(*) AS BIGINT) AS hashes, CAST(sum(n_items) AS BIGINT) AS files,
       CAST(sum(size) AS BIGINT) AS min_space, CAST(sum(size * n_items) AS BIGINT) AS max_space,
       CAST(sum(size * n_classes) AS BIGINT) AS actual_space,
       CAST(sum(size * n_classes) - sum(size) AS BIGINT) AS reclaimable,
       CASE WHEN sum(size * n_items) > sum(size) THEN CAST(
         ((sum(size * n_items) - sum(size * n_classes)) * 20000 + (sum(size * n_items) - sum(size)))
         // (2 * (sum(size * n_items) - sum(size))) AS BIGINT) END AS efficiency_bp,
       CAST(count(*) FILTER (WHERE ext_unknown) AS BIGINT) AS unknown_bags,
       count(*) FILTER (WHERE ext_unknown) * 2 > count(*) AS used_only
FROM bags"""),
    "dup_show": _d(f"""
SELECT hash, size, n_items, size * merged_n AS shared, size * n_classes AS exclusive, ext_unknown,
       {fmt_sql('size')} AS size_fmt, {fmt_sql('(size * merged_n)')} AS shared_fmt,
       {fmt_sql('(size * n_classes)')} AS exclusive_fmt
FROM bags ORDER BY size DESC, hash"""),
    "dup_items": _d("SELECT hash, path, size, merged FROM bitems"),
    "dedup_plan": _d("SELECT hash, keeper, duplicate, bytes FROM plan"),
    "dedup_apply": _d("""
SELECT o.path, o.hash, coalesce(p.keeper, o.path) AS canonical, p.keeper IS NULL AS is_canonical
FROM observed o LEFT JOIN plan p ON o.path = p.duplicate"""),
    "space_after": _d("""
SELECT hash, size * n_items AS shared, size AS exclusive,
       size * CASE WHEN merged_n >= 2 THEN n_items - merged_n ELSE n_items - 1 END AS reclaimed
FROM bags"""),
    "same_placement": _d("SELECT hash, n_classes = 1 AND NOT ext_unknown AS same FROM bags"),
    "dedup_paths": _d("""
SELECT i.hash, k.keeper, i.path AS duplicate
FROM bitems i JOIN (SELECT hash, min(path) AS keeper FROM bitems GROUP BY hash) k USING (hash)
WHERE i.path <> k.keeper"""),
}

ORACLE["bags_json"] = _d("""
SELECT to_json({'hash': i.hash, 'size': i.size, 'shared': b.size * b.merged_n, 'exclusive': b.size * b.n_classes,
                'extUnknown': b.ext_unknown, 'path': i.path, 'merged': i.merged})::VARCHAR AS json
FROM bitems i JOIN bags b USING (hash)""")


def _file_oracles() -> dict[str, str]:
    from lakeaudit.plans.file_queries import oracles

    return oracles(BASE, FUSE)


ORACLE.update(_file_oracles())
