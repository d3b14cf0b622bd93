"""SimHash near-dedup with bit-sliced comparison.

Fingerprints: words of the lower-cased text, 3-word shingles with repeats,
XXH64 of each; a bit is set if it is set in over half of the hashes.

Links: two fingerprints are linked at ``RADIUS`` differing bits or fewer.
The 64 bits are cut into ``PARTS`` parts; two linked fingerprints agree on at
least ``PARTS - RADIUS`` whole parts, so they meet in one of the buckets made
of every choice of that many parts -- an exact search, no sampling.  Only
distinct fingerprints enter (one row per group of equal ones), and buckets of
one are left out before anything is compared.

Within a task the bucket members are compared bit-sliced: a block is turned
into 64 bit planes, one machine word holding one bit of 64 members; for many
queries at once the planes are compared bit by bit, and the distances are
counted by carry-save counters of as many planes as the radius needs.  A
member past the radius is marked, and a block is abandoned as soon as all its
members are.  Small buckets share a block.  A bucket of more than ``BLOCK``
members is cut into blocks by a hash, and every pair of its blocks is a group
of its own, spread over the tasks: none is left out, none has to fit a task.

From each block only the links of a spanning forest go on (a member to the
smallest of its component there), never all pairs; the components over all of
them are those over all links.

Defined cases: a null, empty or blank text has fingerprint zero and is linked
like any other; fewer words than a shingle make one shingle; rows without id
get a fingerprint and link like any other, but never name a component (null
where it has no id at all); repeated rows repeat; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import documents, spare, staged, text_or_empty, text_runs
from lakeaudit.llm.components import components
from lakeaudit.operators.joins import broadcast_if_small
from lakeaudit.session import conf_int, ship_package

SHINGLE = 3
RADIUS = 3
PARTS = 5
SEED = 42
BLOCK = 4096
# rows of small buckets compared together
SHARED_BLOCK = 256
HASHES_AT_ONCE = 65_536

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    n = len(words) - width + 1
    begins, ends = starts[:n].tolist(), (starts[width - 1:] + sizes[width - 1:]).tolist()
    xxh = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, HASHES_AT_ONCE):
        h = np.array([xxh(joined[a:b], SEED) for a, b in zip(begins[k:k + HASHES_AT_ONCE], ends[k:k + HASHES_AT_ONCE])], np.uint64)
        # bit i of byte j is bit 8 j + i of the hash
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), ``text_md5`` of every row."""
    ship_package(docs.sparkSession)

    def work(batches):
        for b in (run for whole in batches for run in text_runs(whole)):
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), b.column(2)], ["doc_id", "fp", "text_md5"])

    rows = docs.select(F.col(id_col).cast("long"), text_col, text_md5(F.col(text_col)))
    return rows.mapInArrow(work, "doc_id long, fp long, text_md5 string")


def text_md5(text: Column) -> Column:
    return F.md5(F.encode(text_or_empty(text), "UTF-8"))


# ------------------------------------------------------------ bit slicing
def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 planes of ``ceil(n / 64)`` words; word w, bit i belongs to member
    64 w + i."""
    n = len(fps)
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def within(planes: np.ndarray, queries: np.ndarray, start: np.ndarray, radius: int) -> np.ndarray:
    """Bit matrix (query, word) of members within ``radius`` of each query.

    ``start``: members that are out from the beginning, as the same matrix.
    The counters of all members advance together, one plane at a time: the
    difference bit enters the lowest counter plane and the carries ripple up;
    what carries out of the top has passed the radius."""
    n_counters = max(1, radius.bit_length())
    offset = (1 << n_counters) - 1 - radius
    flip = np.where((queries[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
    out = start.copy()
    rows = np.arange(len(queries))
    live = np.ascontiguousarray(start)
    counters = [np.full(live.shape, ~np.uint64(0) if offset >> k & 1 else np.uint64(0), np.uint64) for k in range(n_counters)]
    for bit in range(64):
        carry = planes[bit][None, :] ^ flip[rows, bit][:, None]
        for k in range(n_counters):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        live |= carry
        if bit % 8 == 7:
            alive = (live != ~np.uint64(0)).any(axis=1)
            if not alive.all():  # these queries are done: nothing is near
                out[rows[~alive]] = ~np.uint64(0)
                rows, live, counters = rows[alive], live[alive], [c[alive] for c in counters]
                if not len(rows):
                    break
    out[rows] = live
    return ~out


def _lanes(mask: np.ndarray) -> np.ndarray:
    """A boolean matrix (query, member) as words."""
    q, n = mask.shape
    padded = np.zeros((q, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = mask
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _forest(near: np.ndarray, n: int) -> np.ndarray:
    """Smallest member reachable from each, by a search over bit rows."""
    root = np.full(n, -1)
    left = _lanes(np.ones((1, n), bool))[0]
    for s in range(n):
        if root[s] >= 0:
            continue
        todo = [s]
        left[s >> 6] &= ~(np.uint64(1) << np.uint64(s & 63))
        while todo:
            at = todo.pop()
            root[at] = s
            found = near[at] & left
            if found.any():
                left &= ~found
                todo.extend(np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little")).tolist())
    return root


def block_links(fps: np.ndarray, groups: np.ndarray, radius: int = RADIUS, at_once: int = 512) -> np.ndarray:
    """For members of one block, each in a group: the index of the smallest
    member it is linked to, through links within its group."""
    n = len(fps)
    planes = bit_planes(fps)
    near = np.empty((n, planes.shape[1]), np.uint64)
    for k in range(0, n, at_once):
        start = ~_lanes(groups[k:k + at_once, None] == groups[None, :])
        near[k:k + at_once] = within(planes, fps[k:k + at_once], start, radius)
    return _forest(near, n)


def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (group, node, fp) sorted by group -> links (a, b)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def flush(parts):
        g, node, fp = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((node, g))
        g, node, fp = g[order], node[order], fp[order]
        bounds = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True])
        a, b, at = [], [], 0
        while at < len(bounds) - 1:  # whole groups until the block is full
            to = at + 1
            while to < len(bounds) - 1 and bounds[to + 1] - bounds[at] <= SHARED_BLOCK:
                to += 1
            s = slice(bounds[at], bounds[to])
            root = block_links(fp[s], g[s], radius)
            own = np.arange(len(root))
            a.append(node[s][root != own])
            b.append(node[s][root[root != own]])
            at = to
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        g, node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fp = fp.astype(np.int64).view(np.uint64)
        # the last group of a batch may go on in the next
        cut = int(np.searchsorted(g, g[-1]))
        if cut or (held and held[-1][0][-1] != g[0]):
            parts = held + ([(g[:cut], node[:cut], fp[:cut])] if cut else [])
            if parts:
                yield flush(parts)
            held = []
        held.append((g[cut:], node[cut:], fp[cut:]))
    if held:
        yield flush(held)


def part_masks(parts: int = PARTS, radius: int = RADIUS) -> list[int]:
    """Bit masks of every choice of ``parts - radius`` parts."""
    if not radius < parts <= 64:
        raise ValueError("take more parts than the radius")
    edges = [64 * i // parts for i in range(parts + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(parts)]
    return [sum(c) for c in combinations(masks, parts - radius)]


def links(nodes: DataFrame, radius: int = RADIUS, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """``nodes (node, fp)``, fingerprints distinct -> links (a, b) whose
    components are those of all pairs within ``radius`` bits."""
    signed = [m - (1 << 64) if m >> 63 else m for m in part_masks(parts, radius)]
    keys = F.transform(F.array(*[F.lit(m).cast("long") for m in signed]),
                       lambda m, i: F.struct(i.alias("t"), F.col("fp").bitwiseAND(m).alias("k")))
    rows = nodes.select("node", "fp", F.explode(keys).alias("_k")).select("node", "fp", "_k.*")
    sizes = rows.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, ["t", "k"])
    # a bucket of more than one block: all pairs of its blocks
    n_blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    pairs = F.when(n_blocks <= 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), n_blocks - 1),
                    lambda o: F.struct(F.least(own, o).alias("i"), F.greatest(own, o).alias("j"))))
    grouped = rows.select("node", "fp", "t", "k", F.explode(pairs).alias("_p")).select(
        F.xxhash64("t", "k", "_p.i", "_p.j").alias("g"), "node", "fp")
    # two groups with the same 64-bit name are compared together: the bit
    # distance alone decides, so that adds true links at most
    grouped = grouped.repartition("g").sortWithinPartitions("g")
    ship_package(nodes.sparkSession)
    return grouped.mapInArrow(lambda it: _bucket_links(it, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS, shingle: int = SHINGLE,
                    block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    return _found(docs, radius, parts, shingle, block).drop("text_md5")


def _found(docs: DataFrame, radius: int = RADIUS, parts: int = PARTS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` with the MD5 of each text.

    The nodes of the link search are the fingerprints, so one that only rows
    without id have links others like any; a component is then named by its
    smallest id."""
    fps = staged(fingerprints(docs, shingle=shingle), "simhash")
    nodes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius, parts, block))
    # fingerprints with a link, and those that are the root of one
    linked = roots.select(F.col("a").alias("fp"), "root")
    linked = linked.unionByName(linked.select(F.col("root").alias("fp"), "root").distinct()).join(nodes, "fp")
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    linked = linked.join(names, "root").select("fp", "name")
    # a lookup only for fingerprints that stand for more than one row
    alone = nodes.where("n > 1").join(linked, "fp", "left_anti").select("fp", F.col("least").alias("name"))
    out = fps.join(linked.unionByName(alone), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      F.coalesce("name", "doc_id").alias("component_id"), "text_md5")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    return near_duplicates(documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the smallest id of each component stays.  One id with
    two texts is two documents; rows without id stay."""
    found = _found(docs)
    name, md5 = spare(docs, "_gone"), spare(docs, "_md5")
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(
        F.col("doc_id").alias(name), F.unhex("text_md5").alias(md5)).distinct()
    gone = broadcast_if_small(staged(gone, "near"), conf_int(spark, "broadcastMaxKeys"))
    same = (F.col("doc_id") == F.col(name)) & (F.unhex(text_md5(F.col("text"))) == F.col(md5))
    return docs.join(gone, same, "left_anti").select(*docs.columns)
