"""Approximate nearest neighbours: a navigable small-world graph per shard.

Equal vectors are one node that keeps its smallest ids, as many as a result
can need, so copies neither crowd a graph nor cost a distance.  Nodes are
dealt to shards by a hash.  A shard's graph is built in one task: every node
draws a top layer from its hash, nodes are inserted in growing batches, and
the beam search of a whole batch runs in lockstep on arrays; neighbours are
chosen by the diversity rule (nearer to the new node than to any chosen one)
and filled up with the nearest.  The graph is kept as flat arrays -- per layer
one row of neighbour numbers for each node in it -- and written as a table of
one row per node, vector and links, so it can be stored, read and searched
again without being built.

Search: each shard's nodes and after them all queries stream through a task,
which holds one shard and one batch of queries.  Every shard gives its
nearest; the results of all are merged by distance, then id, with the
distances taken anew in double precision.

Rows per shard grow with the root of the table, within bounds: more and
larger shards share the work, as a graph costs a query about the logarithm of
its rows, while its memory stays bounded.

Recall against brute force is measured in the tests (0.9 at least).

Defined cases: vectors that are null, empty, all zero, or hold null or
non-finite entries take no part, as query or candidate; nor do rows without
id; a query never finds a row of its own id; repeated rows count once;
vectors meet only vectors of their own length; fewer candidates than asked
for give as many rows; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeaudit.llm.common import staged
from lakeaudit.operators.joins import broadcast_if_small
from lakeaudit.session import ship_package

K = 10
EVERY = 100
LINKS = 20  # links a node has in the upper layers; twice as many in the lowest
EF_BUILD = 64
EF_SEARCH = 80
# rows of a shard: ROOT times the root of the table, within these bounds
ROOT, LEAST_ROWS, MOST_ROWS = 32, 8192, 262_144
BATCH = 256
VISITED_BYTES = 32 << 20


def distances(x: np.ndarray, x2: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances less the square of the query: rows ``at`` (query,
    neighbour) of ``x`` to each query."""
    return x2[at] - 2 * np.matmul(x[at], q[:, :, None])[..., 0]


class Graph:
    """Flat neighbour arrays over the rows of ``x``.

    ``links[0]`` has a row per node, ``links[l]`` one for each node of layer l
    or above, in the order in which ``place[l]`` numbers them; -1 is no link.
    Nodes are numbered so that those of higher layers come first: layer l is
    the first ``count[l]`` nodes, and no table of numbers is needed."""

    def __init__(self, x: np.ndarray, count: list[int], links: int = LINKS):
        self.x, self.x2 = x, np.einsum("ij,ij->i", x, x)
        self.width = [2 * links, *[links] * (len(count) - 1)]
        self.count = count
        self.links = [np.full((n, w), -1, np.int32) for n, w in zip(count, self.width)]
        # the length of a link, so that a full row can be chosen from anew
        self.far = [np.full((n, w), np.inf, np.float32) for n, w in zip(count, self.width)]

    # ------------------------------------------------------------ search
    def beam(self, q: np.ndarray, starts: np.ndarray, layer: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest ``ef`` nodes (query, place) found from the starting
        nodes and their distances, ascending; -1 and infinite where none."""
        rows, links = len(q), self.links[layer]
        seen = np.zeros((rows, self.count[layer] + 1), bool)
        each = np.arange(rows)[:, None]
        ids = np.full((rows, ef), -1, np.int64)
        dist = np.full((rows, ef), np.inf, np.float32)
        ids[:, :starts.shape[1]] = starts
        dist[:, :starts.shape[1]] = np.where(starts >= 0, distances(self.x, self.x2, starts, q), np.inf)
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = ids[each, order], dist[each, order]
        seen[each, ids] = True  # -1 is the last column
        done = ids < 0
        live = np.arange(rows)
        while len(live):
            open_ = ~done[live]
            go = open_.any(axis=1)
            live, open_ = live[go], open_[go]
            if not len(live):
                break
            at = open_.argmax(axis=1)
            done[live, at] = True
            near = links[ids[live, at]].astype(np.int64)
            fresh = (near >= 0) & ~seen[live[:, None], near]
            near = np.where(fresh, near, -1)
            seen[live[:, None], near] = True
            d = np.where(fresh, distances(self.x, self.x2, near, q[live]), np.inf)
            # only what beats the worst kept one goes into the merge
            better = d < dist[live, -1][:, None]
            some = better.any(axis=1)
            if not some.any():
                continue
            to, d, near, better = live[some], d[some], near[some], better[some]
            d = np.where(better, d, np.inf)
            width = int(better.sum(axis=1).max())
            if width < d.shape[1]:
                part = np.argpartition(d, width - 1, axis=1)[:, :width]
                d, near = np.take_along_axis(d, part, 1), np.take_along_axis(near, part, 1)
            near = np.where(np.isinf(d), -1, near)
            all_d = np.concatenate([dist[to], d], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
            dist[to] = np.take_along_axis(all_d, order, 1)
            ids[to] = np.take_along_axis(np.concatenate([ids[to], near], axis=1), order, 1)
            done[to] = np.take_along_axis(np.concatenate([done[to], near < 0], axis=1), order, 1)
        return ids, dist

    def entry(self, q: np.ndarray, down_to: int) -> np.ndarray:
        """Where a search of layer ``down_to`` starts."""
        at = np.zeros((len(q), 1), np.int64)
        for layer in range(len(self.count) - 1, down_to, -1):
            at = self.beam(q, at, layer, 1)[0]
        return at

    def search(self, q: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """The ``k`` nearest nodes found per query; -1 where there are none."""
        q = q.astype(np.float32)
        out = np.full((len(q), k), -1, np.int64)
        step = max(1, min(BATCH, VISITED_BYTES // (self.count[0] + 1)))
        for i in range(0, len(q), step):
            part = q[i:i + step]
            found = self.beam(part, self.entry(part, 0), 0, max(ef, k))[0][:, :k]
            out[i:i + step, :found.shape[1]] = found
        return out

    # ------------------------------------------------------------- build
    def choose(self, ids: np.ndarray, dist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Of candidates in ascending distance those nearer to the row's own
        node than to any chosen before, filled up with the nearest others."""
        rows, n = ids.shape
        x = self.x[ids]
        square = self.x2[ids]
        cross = square[:, :, None] + square[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        there = ids >= 0
        chosen = np.zeros((rows, n), bool)
        count = np.zeros(rows, int)
        for j in range(n):
            clash = ((cross[:, j] < dist[:, j, None]) & chosen).any(axis=1)
            take = there[:, j] & ~clash & (count < most)
            chosen[:, j] = take
            count += take
        # chosen first, then the others, each by distance
        order = np.argsort(np.where(there, np.where(chosen, 0, 1), 2), axis=1, kind="stable")[:, :most]
        ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
        return ids, np.where(ids >= 0, dist, np.inf)

    def connect(self, layer: int, new: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        """Give the new nodes their links and link back to them."""
        ids, dist = self.choose(ids, dist, LINKS if self.width[layer] > LINKS else self.width[layer])
        self.links[layer][new, :ids.shape[1]] = ids
        self.far[layer][new, :ids.shape[1]] = dist
        a, b, d = np.repeat(new, ids.shape[1]), ids.ravel(), dist.ravel()
        # nodes of one batch may have chosen each other
        there = (b >= 0) & ~(self.links[layer][b] == a[:, None]).any(axis=1)
        a, b, d = a[there], b[there], d[there]
        order = np.lexsort((d, b))
        a, b, d = a[order], b[order], d[order]
        if not len(b):
            return
        first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
        size = np.diff(np.r_[first, len(b)])
        nodes, width = b[first], int(size.max())
        more = np.full((len(nodes), width), -1, np.int64)
        more_d = np.full((len(nodes), width), np.inf, np.float32)
        row, col = np.repeat(np.arange(len(nodes)), size), np.arange(len(b)) - np.repeat(first, size)
        more[row, col], more_d[row, col] = a, d
        all_ids = np.concatenate([self.links[layer][nodes].astype(np.int64), more], axis=1)
        all_d = np.concatenate([self.far[layer][nodes], more_d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")
        all_ids, all_d = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_d, order, 1)
        most = self.width[layer]
        full = (all_ids >= 0).sum(axis=1) > most
        kept, kept_d = all_ids[:, :most].copy(), all_d[:, :most].copy()
        if full.any():
            kept[full], kept_d[full] = self.choose(all_ids[full], all_d[full], most)
        self.links[layer][nodes], self.far[layer][nodes] = kept, kept_d

    def insert(self, s: int, e: int, ef: int) -> None:
        """Nodes ``s`` to ``e``: linked to what is in the graph and to each
        other.  They are in the layers whose count is beyond them."""
        top = max(layer for layer, n in enumerate(self.count) if n > s)
        new = np.arange(s, e)
        q = self.x[s:e]
        own = self.x2[s:e, None]
        among = self.x2[s:e][None, :] - 2 * q @ q.T + own
        at = self.entry(q, top) if s else np.zeros((len(new), 1), np.int64) - 1
        for layer in range(top, -1, -1):
            here = new[new < self.count[layer]]
            m = len(here)
            if s:
                ids, dist = self.beam(q, at, layer, ef)
                at = ids[:, :max(1, ef // 8)]
                dist = dist + own
            else:
                ids, dist = np.full((len(new), 1), -1, np.int64), np.full((len(new), 1), np.inf)
            mates = np.broadcast_to(here, (m, m))
            d = np.where(np.eye(m, dtype=bool), np.inf, among[:m, :m])
            ids, dist = np.concatenate([ids[:m], mates], axis=1), np.concatenate([dist[:m], d], axis=1)
            order = np.argsort(dist, axis=1, kind="stable")[:, :ef]
            ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
            ids = np.where(np.isinf(dist), -1, ids)
            self.connect(layer, here, ids, np.maximum(dist, 0).astype(np.float32))


def layers(n: int, links: int = LINKS) -> list[int]:
    """How many nodes each layer holds: the expectation of the usual draw, so
    a shuffled order of nodes stands for it."""
    out = [n]
    while out[-1] > links:
        out.append(out[-1] // links)
    return out


def build(x: np.ndarray, links: int = LINKS, ef: int = EF_BUILD) -> Graph:
    """The graph over the rows of ``x``, which stand in a random order; no
    batch is larger than the graph that it is inserted into."""
    graph = Graph(np.ascontiguousarray(x, np.float32), layers(len(x), links), links)
    at, limit = 0, max(1, min(BATCH, VISITED_BYTES // (len(x) + 1)))
    while at < len(x):
        step = max(1, min(limit, at // 2 or 1))
        # a batch is in the same layers throughout
        stop = min([at + step, len(x), *[n for n in graph.count if n > at]])
        graph.insert(at, stop, ef)
        at = stop
    return graph


# --------------------------------------------------------------------- frames
def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite & F.exists(vector, lambda c: c != 0)


def vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, vec`` of the rows that take part."""
    return df.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda c: c.cast("double")).alias("vec"))


def nodes(rows: DataFrame, keep: int) -> DataFrame:
    """``h, vec, ids``: the different vectors, each with its ``keep`` smallest
    ids.  Ranks are cut before the shuffle, so a vector that a third of all
    rows hold costs a few rows per task."""
    by = Window.partitionBy("h", "vec").orderBy("id")
    rows = rows.distinct().withColumn("h", F.xxhash64("vec"))
    least = rows.withColumn("r", F.row_number().over(by)).where(F.col("r") <= keep)
    return least.groupBy("h", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def shard_rows(n: int) -> int:
    return max(LEAST_ROWS, min(MOST_ROWS, int(ROOT * math.sqrt(n))))


def index(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, rows_per_shard: int | None = None,
          links: int = LINKS, ef: int = EF_BUILD) -> DataFrame:
    """The graphs of all shards, written: ``dim, shard, shards, node, ids, vec
    (binary doubles), links`` (binary: the node's row of every layer it is in,
    lowest first).  One row per different vector."""
    spark = df.sparkSession
    ship_package(spark)
    found = staged(nodes(vectors(df, id_col, vec_col), k + 1), "ann-nodes")
    counts = found.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()  # a row per length
    shards = {r.dim: -(-r.n // (rows_per_shard or shard_rows(r.n))) for r in counts}
    dealt = found.withColumn("dim", F.size("vec"))
    per = F.create_map(*[F.lit(x) for kv in shards.items() for x in kv])[F.col("dim")] if shards else F.lit(1)
    dealt = dealt.withColumn("shards", per.cast("int")).withColumn("shard", F.pmod("h", F.col("shards")).cast("int"))
    # a hash of another seed: the order of insertion is random within a shard
    dealt = dealt.withColumn("o", F.hash(F.lit(7), "h"))
    total = max(1, sum(shards.values()))
    dealt = dealt.repartition(total, "dim", "shard").sortWithinPartitions("dim", "shard", "o", "h", "vec")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, shard), parts in _shards(batches):
            x = np.concatenate([_matrix(p.column(4), dim) for p in parts])
            graph = build(x, links, ef)
            at = 0
            for p in parts:
                for b in (p.slice(i, 1024) for i in range(0, p.num_rows, 1024)):
                    m = b.num_rows
                    rows = [b"".join(l[i].tobytes() for l in graph.links if i < len(l)) for i in range(at, at + m)]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0), b.column(1), b.column(2), pa.array(np.arange(at, at + m, dtype=np.int32)), b.column(3),
                         pa.array([v.tobytes() for v in x[at:at + m]], pa.binary()), pa.array(rows, pa.binary())],
                        ["dim", "shard", "shards", "node", "ids", "vec", "links"])
                    at += m

    out = dealt.select("dim", "shard", "shards", "ids", "vec").mapInArrow(
        work, "dim int, shard int, shards int, node int, ids array<long>, vec binary, links binary")
    return staged(out, "ann-index")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[pa.RecordBatch]]]:
    """Rows sorted by (dim, shard) -> the batches of each."""
    key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        dim, shard = b.column(0).to_numpy(), b.column(1).to_numpy()
        cuts = [0, *(np.flatnonzero((dim[1:] != dim[:-1]) | (shard[1:] != shard[:-1])) + 1).tolist(), b.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            mine = (int(dim[s]), int(shard[s]))
            if held and mine != key:
                yield key, held
                held = []
            key = mine
            held.append(b.slice(s, e - s))
    if held:
        yield key, held


def load(dim: int, vec: list[bytes], rows: list[bytes], links: int) -> tuple[np.ndarray, Graph]:
    """A shard's vectors and its graph from the rows of the index."""
    x = np.frombuffer(b"".join(vec)).reshape(-1, dim)
    sizes = np.array([len(r) for r in rows]) // 4
    flat = np.frombuffer(b"".join(rows), np.int32)
    starts = np.cumsum(sizes) - sizes
    depth = 1 + (sizes - 2 * links) // links
    count = [int((depth > l).sum()) for l in range(int(depth.max()))]
    graph = Graph.__new__(Graph)
    graph.x = x.astype(np.float32)
    graph.x2 = np.einsum("ij,ij->i", graph.x, graph.x)
    graph.width, graph.count, graph.far = [2 * links, *[links] * (len(count) - 1)], count, []
    graph.links, skip = [], 0
    for n, w in zip(count, graph.width):
        graph.links.append(flat[starts[:n, None] + skip + np.arange(w)])
        skip += w
    return x, graph


def search(graphs: DataFrame, queries: DataFrame, k: int = K, ef: int = EF_SEARCH, links: int = LINKS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest ``k`` rows found for
    every row (id, vec) of ``queries``, from the index."""
    ship_package(graphs.sparkSession)
    per = broadcast_if_small(graphs.select("dim", "shards").distinct())
    asked = queries.distinct().withColumn("dim", F.size("vec")).join(per, "dim")
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(-1).alias("node"),
                         F.array("id").alias("ids"), F.col("vec").alias("q"), F.lit(None).cast("binary").alias("vec"),
                         F.lit(None).cast("binary").alias("links"))
    rows = graphs.select("dim", "shard", "node", "ids", F.lit(None).cast("array<double>").alias("q"), "vec", "links").unionByName(asked)
    # the nodes of a shard in their order, then the queries
    rows = rows.withColumn("asked", F.col("node") < 0)
    n = max(1, graphs.select("dim", "shard").distinct().count())
    rows = rows.repartition(n, "dim", "shard").sortWithinPartitions("dim", "shard", "asked", "node")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vec, flat, ready = None, [], [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            cols = {c: b.column(i) for i, c in enumerate(("dim", "shard", "node", "ids", "q", "vec", "links"))}
            marks = np.stack([cols["dim"].to_numpy(), cols["shard"].to_numpy(), cols["node"].to_numpy() < 0])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                mine = (int(marks[0, s]), int(marks[1, s]))
                if mine != key:
                    key, ids, vec, flat, ready = mine, [], [], [], None
                if not marks[2, s]:
                    ids.append(cols["ids"].slice(s, e - s))
                    vec += cols["vec"].slice(s, e - s).to_pylist()
                    flat += cols["links"].slice(s, e - s).to_pylist()
                    continue
                if ready is None:
                    ready = (*load(key[0], vec, flat, links), pa.concat_arrays(ids))
                    vec, flat = [], []
                for i in range(s, e, BATCH):
                    m = min(BATCH, e - i)
                    yield answer(*ready, cols["ids"].slice(i, m), _matrix(cols["q"].slice(i, m), key[0]))

    def answer(x: np.ndarray, graph: Graph, members: pa.Array, asked_ids: pa.Array, q: np.ndarray) -> pa.RecordBatch:
        found = graph.search(q, k + 1, ef)
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        score = np.sqrt(((x[node] - q[row]) ** 2).sum(axis=1))
        lists = members.take(pa.array(node))
        parent = lists.value_parent_indices() if hasattr(lists, "value_parent_indices") else pa.compute.list_parent_indices(lists)
        parent = parent.to_numpy(zero_copy_only=False)
        return best(asked_ids.flatten().to_numpy()[row][parent], lists.flatten().to_numpy(), score[parent])

    def best(query: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        other = query != vec_id
        query, vec_id, score = query[other], vec_id[other], score[other]
        order = np.lexsort((vec_id, score, query))
        query, vec_id, score = query[order], vec_id[order], score[order]
        start = np.maximum.accumulate(np.where(np.r_[True, query[1:] != query[:-1]], np.arange(len(query)), 0)) if len(query) else query
        top = np.arange(len(query)) - start < k
        return pa.RecordBatch.from_arrays([pa.array(query[top]), pa.array(vec_id[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    found = rows.select("dim", "shard", "node", "ids", "q", "vec", "links").mapInArrow(work, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(index(df), vectors(df).where(F.pmod("id", F.lit(EVERY)) == 0))
