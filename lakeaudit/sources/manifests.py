"""Manifest files of the file tool (S4, S5, X5, U3, H6 check).

* split: one JSON index per directory,
  ``{"v":2,"idx":{name:{"mod":ms,"a":algo,"h":hash,"s":size}},"idx_hash":md5,"dirlist":[...]}``;
  the older per-entry ``md5`` form and the ``{"data":{...}}`` form are
  converted on the fly (algo md5, size unknown).
* atom: one JSON document for a whole tree,
  ``{"type":<type>,"version":6,"data":{dir: index, ...}}`` with the header
  keys in exactly this order.

Index files are dot files, which Spark's file sources skip, so the files to
read come as a DataFrame of paths (``lakeaudit.sources.listing.walk``) and
are parsed inside ``mapInPandas``: one task per batch of small files.

A large atom file is cut into byte ranges.  What a byte means depends on
whether it lies in a string, so each range is scanned for both cases at once:
how it changes the state, and by how much the nesting deepens in either.
Summed up in order these give the state at which every range begins; a second
scan then finds where directories begin, and the pieces between are parsed
apart, whole directories each.

The seal of an index is the md5 of the raw bytes of its ``idx`` value; when
that fails the check is repeated on the compacted, HTML-escaped text (what
the tool's own writer hashes).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENTRY_COLUMNS = ["dir", "name", "path", "mod_ms", "algo", "hash", "size"]
ENTRY_SCHEMA = ("dir string, name string, path string, mod_ms bigint, algo string, hash string, size bigint, "
                "source string")
INDEX_SCHEMA = ("source string, dir string, verified boolean, converted boolean, dirlist array<string>, "
                "error string")
# the type an atom file names itself; a caller with other files gives theirs
ATOM_TYPE = "lakeindex"
ATOM_VERSION = 6

_WS = " \t\n\r"
_STRING_OR_WS = re.compile(r'("(?:[^"\\]|\\.)*")|[ \t\n\r]+', re.S)
_DEC = json.JSONDecoder()


def _skip(text: str, i: int) -> int:
    while i < len(text) and text[i] in _WS:
        i += 1
    return i


def _members(text: str, i: int):
    """Yield (key, value, value_start, value_end) of the object starting at
    ``text[i]``; returns where it ends."""
    i = _skip(text, i)
    if i >= len(text) or text[i] != "{":
        raise ValueError("an object should begin here")
    i = _skip(text, i + 1)
    if i < len(text) and text[i] == "}":
        return i + 1
    while True:
        key, i = _DEC.raw_decode(text, i)
        if not isinstance(key, str):
            raise ValueError("a key is not a string")
        i = _skip(text, i)
        if i >= len(text) or text[i] != ":":
            raise ValueError("no colon after a key")
        vs = _skip(text, i + 1)
        value, ve = _DEC.raw_decode(text, vs)
        yield key, value, vs, ve
        i = _skip(text, ve)
        if i < len(text) and text[i] == ",":
            i = _skip(text, i + 1)
            continue
        if i < len(text) and text[i] == "}":
            return i + 1
        raise ValueError("an object ends in the middle")


def compact_escaped(raw: str) -> str:
    """Whitespace outside strings removed, then ``< > &`` and U+2028/9 escaped."""
    s = _STRING_OR_WS.sub(lambda m: m.group(1) or "", raw)
    return (s.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
            .replace("\u2028", "\\u2028").replace("\u2029", "\\u2029"))


def _md5(s: str) -> str:
    return hashlib.md5(s.encode("utf-8")).hexdigest()


def parse_index(text: str):
    """One directory index -> (entries, dirlist, verified, converted).

    entries: list of (name, mod_ms, algo, hash, size); duplicate names keep
    the last occurrence.
    """
    found, end = _index_at(text, 0)
    if _skip(text, end) != len(text):
        raise ValueError("something follows the index")
    return found


def _index_at(text: str, at: int):
    """``parse_index`` of the object at ``text[at]``, and where it ends.
    Every value is decoded once; of a repeated key the last one counts."""
    obj, raw_idx = {}, None
    members = _members(text, at)
    while True:
        try:
            key, value, vs, ve = next(members)
        except StopIteration as stop:
            end = stop.value
            break
        obj[key] = value
        if key == "idx":
            raw_idx = text[vs:ve]
    dirlist = obj.get("dirlist")
    entries = []
    if obj.get("idx") is not None:
        h = obj.get("idx_hash")
        verified = raw_idx is not None and (_md5(raw_idx) == h or _md5(compact_escaped(raw_idx)) == h)
        for name, info in obj["idx"].items():
            if info.get("md5") is not None:
                entries.append((name, info.get("mod"), "md5", info["md5"], None))
            else:
                entries.append((name, info.get("mod"), info.get("a"), info.get("h"), info.get("s")))
        return (entries, dirlist, verified, False), end
    for name, info in (obj.get("data") or {}).items():
        entries.append((name, info.get("mod"), "md5", info.get("md5"), None))
    return (entries, dirlist, True, True), end


def _entry_rows(source: str, d: str, entries) -> list[tuple]:
    out = []
    for name, mod, algo, h, size in entries:
        path = f"{d}/{name}" if d else name
        out.append((d, name, path, mod, algo, h, size, source))
    return out


def read_bytes(path: str, start: int = 0, size: int | None = None) -> bytes:
    """``size`` bytes of a file from ``start`` (to its end when None)."""
    from lakeaudit.sources.listing import _local

    loc = _local(path)
    if loc is not None:
        with open(loc, "rb") as f:
            f.seek(start)
            return f.read() if size is None else f.read(size)
    from pyarrow import fs as pafs

    fsys, p = pafs.FileSystem.from_uri(path)
    with fsys.open_input_file(p) as f:
        f.seek(start)
        return f.read() if size is None else f.read(size)


def _read_text(path: str) -> str:
    return read_bytes(path).decode("utf-8")


def read_split_manifests(files: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """``files(path, dir)``: split index files relative to ``root`` and the
    directory they describe.  Returns (entries, indexes); an unreadable or
    invalid file gives an index row with ``error`` and no entries (U3)."""
    base = root.rstrip("/")

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows, n = [], 0
            for p, d in zip(pdf["path"], pdf["dir"]):
                try:
                    entries, dirlist, verified, converted = parse_index(_read_text(f"{base}/{p}"))
                    rows.append(("E", _entry_rows(p, d, entries), (p, d, verified, converted, dirlist, None)))
                    n += len(entries)
                except (OSError, ValueError, AttributeError, TypeError, KeyError) as err:
                    rows.append(("E", [], (p, d, None, None, None, str(err))))
                if n >= 20_000:  # frames of about this many entries
                    yield _pack(rows)
                    rows, n = [], 0
            yield _pack(rows)

    # parsed once, for both outputs
    return _unpack(_written(_spread(files.select("path", "dir")).mapInPandas(parse, _PACKED)))


def _written(rows: DataFrame) -> DataFrame:
    from lakeaudit.session import checkpoint_dir, ship_package

    checkpoint_dir(rows.sparkSession)
    ship_package(rows.sparkSession)
    return rows.checkpoint()


def _spread(files: DataFrame) -> DataFrame:
    """Spread the file list over the cluster by a hash of the path, so that a
    list built in one partition does not parse in one task."""
    n = files.sparkSession.sparkContext.defaultParallelism * 4
    return files.repartition(n, F.xxhash64("path"))


def read_atom_manifest(files: DataFrame, root: str, atom_type: str = ATOM_TYPE,
                       range_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``files(path, dir)``: atom files relative to ``root`` and the
    directory they cover.  The header must be ``type``, ``version`` (6),
    ``data`` in this order; directory keys are relative to the atom's
    directory; a repeated directory key keeps its last index.  A bad atom
    yields one index row with ``error`` and no entries (the source is
    dropped whole).

    A file of more than ``range_bytes`` is decoded by many tasks.  Entries
    leave in frames of bounded size; repeated keys are resolved afterwards in
    Spark (largest position per directory, skew-aware semi join).
    """
    from lakeaudit.operators.joins import broadcast_if_small, skew_join
    from lakeaudit.session import conf_int, ship_package
    from lakeaudit.sources.listing import _stat

    base, spark = root.rstrip("/"), files.sparkSession
    step = range_bytes or conf_int(spark, "manifestRangeBytes")
    ship_package(spark)

    def sizes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for p, d in zip(pdf["path"], pdf["dir"]):
                try:
                    rows.append((p, d, _stat(f"{base}/{p}")[1], None))
                except OSError as err:
                    rows.append((p, d, None, str(err)))
            yield pd.DataFrame(rows, columns=["path", "dir", "size", "error"]).astype({"size": "Int64"})

    sized = _written(_spread(files.select("path", "dir")).mapInPandas(sizes, "path string, dir string, size long, error string"))

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, d, lost in zip(pdf["path"], pdf["dir"], pdf["error"]):
                try:
                    if lost:
                        raise OSError(lost)
                    text = _read_text(f"{base}/{p}")
                    at = _header_end(text, atom_type)
                    yield from _directories(text, at, p, d, True, True)
                except (OSError, ValueError, AttributeError, TypeError, KeyError) as err:
                    yield _pack([("E", [], (p, d, None, None, None, str(err)))])

    small = F.coalesce(F.col("size"), F.lit(0)) <= step
    parsed = _spread(sized.where(small)).mapInPandas(parse, _PACKED)
    large = sized.where(~small)
    if not large.isEmpty():
        parsed = parsed.unionByName(_in_ranges(large, base, atom_type, step))
    both = _written(parsed)
    # an atom that fails part-way is dropped whole: only its error row stays
    bad = broadcast_if_small(
        both.where((F.col("kind") == "I") & F.col("error").isNotNull()).select("source").distinct())
    why = both.where((F.col("kind") == "I") & F.col("error").isNotNull()).groupBy("source").agg(F.min("seq").alias("seq"))
    errors = both.where((F.col("kind") == "I") & F.col("error").isNotNull()).join(broadcast_if_small(why), ["source", "seq"], "left_semi")
    both = both.join(bad, "source", "left_anti").unionByName(errors.select(*both.columns).dropDuplicates(["source"]))
    last = both.groupBy("source", "dir").agg(F.max("seq").alias("seq"), F.count("*").alias("_rows"))
    both = skew_join(both, last, ["source", "dir", "seq"], "_rows", "left_semi",
                     spread_by=F.coalesce("name", F.lit("")))
    return _unpack(both)


def _header_end(text: str, atom_type: str) -> int:
    """Where the object of directories begins: after its brace."""
    i = _skip(text, 0)
    if text[i:i + 1] != "{":
        raise ValueError("{ is missing")
    i += 1
    for want in ("type", "version", "data"):
        i = _skip(text, i)
        key, i = _DEC.raw_decode(text, i)
        if key != want:
            raise ValueError(f"header: {want} is not where it should be")
        i = _skip(text, i)
        if text[i:i + 1] != ":":
            raise ValueError(": is missing")
        i = _skip(text, i + 1)
        if want == "data":
            break
        v, i = _DEC.raw_decode(text, i)
        if want == "type" and v != atom_type:
            raise ValueError("header: another type of file")
        if want == "version" and v != ATOM_VERSION:
            raise ValueError(f"header: version {v} is not supported")
        i = _skip(text, i)
        if text[i:i + 1] != ",":
            raise ValueError(", is missing")
        i += 1
    if text[i:i + 1] != "{":
        raise ValueError("{ is missing")
    return i + 1


def _directories(text: str, i: int, source: str, top: str, opens: bool, closes: bool, offset: int = 0,
                 batch: int = 50_000) -> Iterator[pd.DataFrame]:
    """The directories in ``text`` from ``i``: whole members of the object of
    directories.  ``opens``: the first ones, so there may be none; ``closes``:
    the last ones, with what follows them.  A piece that does not close ends
    with the comma before the next."""
    rows, n = [], 0
    i = _skip(text, i)
    if not (opens and closes and text[i:i + 1] == "}"):
        while True:
            at = i
            key, i = _DEC.raw_decode(text, i)
            if not isinstance(key, str):
                raise ValueError("a directory is not named by a string")
            i = _skip(text, i)
            if text[i:i + 1] != ":":
                raise ValueError(": is missing")
            (entries, dirlist, verified, converted), i = _index_at(text, i + 1)
            d = "/".join(x for x in (top, key) if x)
            rows.append(("E", _entry_rows(source, d, entries), (source, d, verified, converted, dirlist, None), offset + at))
            n += len(entries)
            if n >= batch:
                yield _pack(rows)
                rows, n = [], 0
            i = _skip(text, i)
            if text[i:i + 1] == ",":
                i = _skip(text, i + 1)
                if i == len(text) and not closes:
                    break
                continue
            if text[i:i + 1] == "}" and closes:
                break
            raise ValueError("the directories end in the middle")
    if closes:
        i = _skip(text, i + 1)
        if text[i:i + 1] != "}":
            raise ValueError("} is missing")
    if rows:
        yield _pack(rows)


# ------------------------------------------------------------ one file, many tasks
def _outside(data: np.ndarray, inside: bool, escaped: bool) -> tuple[np.ndarray, bool]:
    """Which bytes lie outside strings when the first one does so or not, and
    whether the byte after the last lies inside one.  ``escaped``: the first
    byte is escaped."""
    quotes = np.flatnonzero(data == 34)
    slashes = np.flatnonzero(data == 92)
    if len(slashes) and len(quotes):
        # a quote is escaped after an odd run of backslashes
        begins = slashes[np.r_[True, np.diff(slashes) > 1]]
        run = np.searchsorted(begins, quotes, "right") - 1
        after = (quotes > 0) & (data[np.maximum(quotes - 1, 0)] == 92)
        begin = begins[np.maximum(run, 0)]
        # a backslash that is escaped itself does not count
        length = quotes - begin - (escaped & (begin == 0))
        quotes = quotes[~(after & (length % 2 == 1))]
    if escaped and len(quotes) and quotes[0] == 0:
        quotes = quotes[1:]
    flips = np.zeros(len(data), np.uint8)
    flips[quotes] = 1
    parity = (np.cumsum(flips, dtype=np.uint8) & 1).astype(bool)
    return parity == inside, bool(len(quotes) % 2) != inside


def _nesting(data: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of brackets and commas outside strings, and the change of
    depth at each."""
    kind = np.zeros(256, np.int8)
    kind[[123, 91]], kind[[125, 93]], kind[44] = 1, -1, 2
    at = np.flatnonzero((kind[data] != 0) & outside)
    change = kind[data[at]].astype(np.int64)
    return at, np.where(change == 2, 0, change)


def _escaped_at(path: str, start: int) -> bool:
    """Whether an odd run of backslashes ends before ``start``."""
    run, at = 0, start
    while at:
        size = min(at, 4096)
        tail = read_bytes(path, at - size, size)
        mine = len(tail) - len(tail.rstrip(b"\\"))
        run, at = run + mine, at - size
        if mine < size:
            break
    return run % 2 == 1


def _in_ranges(large: DataFrame, base: str, atom_type: str, step: int) -> DataFrame:
    """Packed rows of files of many ranges."""
    spark = large.sparkSession
    ranges = large.select("path", "dir", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / step))).alias("k"))
    n = max(spark.sparkContext.defaultParallelism, 1) * 4

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(n, F.xxhash64("path", "k"))

    def summarise(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, d, size, k in pdf[["path", "dir", "size", "k"]].itertuples(index=False):
                path, start = f"{base}/{p}", int(k) * step
                data = np.frombuffer(read_bytes(path, start, step), np.uint8)
                escaped = _escaped_at(path, start)
                deltas = []
                for inside in (False, True):
                    outside, after = _outside(data, inside, escaped)
                    deltas.append(int(_nesting(data, outside)[1].sum()))
                    flips = after != inside
                yield pd.DataFrame([(p, d, size, k, escaped, int(flips), *deltas)],
                                   columns=["path", "dir", "size", "k", "escaped", "flips", "d0", "d1"])

    summary = _written(spread(ranges).mapInPandas(
        summarise, "path string, dir string, size long, k long, escaped boolean, flips int, d0 long, d1 long"))
    # a row per range: the states of a file's ranges, from those before
    before = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    states = summary.withColumn("inside", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2 == 1)
    states = states.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside"), F.col("d1")).otherwise(F.col("d0"))).over(before), F.lit(0)))

    def find(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, d, size, k, escaped, inside, depth in pdf.itertuples(index=False):
                start = int(k) * step
                data = np.frombuffer(read_bytes(f"{base}/{p}", start, step), np.uint8)
                at, change = _nesting(data, _outside(data, bool(inside), bool(escaped))[0])
                after = depth + np.cumsum(change)
                # a directory begins after the brace that opens their object and after a comma in it
                begins = at[((change == 1) & (after == 2)) | ((data[at] == 44) & (after == 2))] + 1
                ends = at[(change == -1) & (after == 1)]
                yield pd.DataFrame([(p, d, k, start + int(begins[0]) if len(begins) else None, start + int(ends[0]) if len(ends) else None)],
                                   columns=["path", "dir", "k", "first", "close"]).astype({"first": "Int64", "close": "Int64"})

    found = _written(spread(states.select("path", "dir", "size", "k", "escaped", "inside", "depth")).mapInPandas(
        find, "path string, dir string, k long, first long, close long"))
    whole = Window.partitionBy("path")
    later = whole.orderBy("k").rowsBetween(1, Window.unboundedFollowing)
    pieces = found.withColumn("close", F.min("close").over(whole)).withColumn("begin", F.min("first").over(whole))
    lost = F.col("close").isNull() | F.col("begin").isNull()
    # a file whose nesting is not what it should be gives one row, for its error
    pieces = pieces.where(F.when(lost, F.col("k") == 0).otherwise(F.col("first") <= F.col("close"))).withColumn("next", F.min("first").over(later))

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, d, k, first, close, begin, nxt in pdf[["path", "dir", "k", "first", "close", "begin", "next"]].itertuples(index=False):
                try:
                    if pd.isna(close) or pd.isna(begin):
                        raise ValueError("the directories end in the middle")
                    opens, closes = first == begin, bool(pd.isna(nxt))
                    start = 0 if opens else int(first)  # the header goes with the first ones
                    end = int(close) + 1 if closes else int(nxt)
                    data = read_bytes(f"{base}/{p}", start, end + (_TAIL if closes else 0) - start)
                    text = data[:end - start].decode("utf-8") + data[end - start:].decode("utf-8", "replace")
                    yield from _directories(text, _header_end(text, atom_type) if opens else 0, p, d, opens, closes, start)
                except (OSError, ValueError, AttributeError, TypeError, KeyError) as err:
                    yield _pack([("E", [], (p, d, None, None, None, str(err)), int(k))])

    return spread(pieces).mapInPandas(parse, _PACKED)


# bytes read beyond the end of the directories, where the file's last brace is
_TAIL = 4096


_PACKED = ("kind string, dir string, name string, path string, mod_ms bigint, algo string, hash string, "
           "size bigint, source string, verified boolean, converted boolean, dirlist array<string>, error string, "
           "seq bigint")


def _pack(rows) -> pd.DataFrame:
    out = []
    for row in rows:
        _, entries, (src, d, verified, converted, dirlist, err) = row[:3]
        seq = row[3] if len(row) > 3 else 0
        out.append(("I", d, None, None, None, None, None, None, src, verified, converted, dirlist, err, seq))
        for e in entries:
            out.append(("E",) + e + (None, None, None, None, seq))
    cols = ["kind", "dir", "name", "path", "mod_ms", "algo", "hash", "size", "source", "verified", "converted",
            "dirlist", "error", "seq"]
    pdf = pd.DataFrame(out, columns=cols)
    pdf["mod_ms"] = pd.array(pdf["mod_ms"], dtype="Int64")
    pdf["size"] = pd.array(pdf["size"], dtype="Int64")
    pdf["seq"] = pd.array(pdf["seq"], dtype="Int64")
    return pdf


def _unpack(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    entries = both.where(F.col("kind") == "E").select(*ENTRY_COLUMNS, "source")
    indexes = both.where(F.col("kind") == "I").select("source", "dir", "verified", "converted", "dirlist", "error")
    return entries, indexes
