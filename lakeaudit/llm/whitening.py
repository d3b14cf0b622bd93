"""Embedding whitening by a bidiagonal qd solver.

1. *Fit list.*  Each vector is rounded to whole steps (``floor(64 c) +
   1000000``) and every distinct one counts once; its sums are exact.
2. *Blockwise QR.*  A task centres its rows block by block and keeps only the
   triangle R of all it has seen; the triangles of the tasks are stacked and
   reduced in a tree, ``FAN`` at a time, until one is left.  Nothing of the
   rows but d x d triangles is ever moved, and R'R is the scatter matrix
   without having been multiplied out, so small eigenvalues keep their digits.
3. *Householder* reflections from both sides make R bidiagonal.
4. *dqds* finds the singular values of the bidiagonal to high relative
   accuracy: differential quotient-difference steps whose shift is taken
   back when it proves too large, with splitting and deflation.
5. *Twisted factorisations* of ``B'B - lambda`` give a vector per value: the
   stationary and the progressive factorisation meet where the twisted pivot
   is smallest, and one pass up and down from there is the vector.  In a
   cluster of values, where that alone is not orthogonal, the factorisation
   is used to iterate under orthogonality to the cluster's earlier vectors.

The model (mean, directions, eigenvalues) has d x 17 numbers, whatever the
table; applying it is one narrow pass.

Defined cases: vectors that are null, empty, or hold null or non-finite
entries take no part; so do those of another length than the most frequent
one (of equally frequent ones the shortest); an entry beyond 2**62 steps
counts as that; directions without variance have no component, so a table of
one distinct vector, or an empty one, gives no rows; a deviation that no long
holds is null; repeated rows repeat; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm.common import staged
from lakeaudit.session import ship_package

STEPS, OFFSET = 64, 1_000_000
COMPONENTS = 16
FAN = 16
BLOCK = 4096
EPS = float(np.finfo(float).eps)
# values closer than this, as a share of the larger, form a cluster
CLUSTER = 1e-3


# ------------------------------------------------------------- small matrices
def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder bidiagonalisation ``r = U B V'`` of a square matrix:
    diagonal and superdiagonal of B, and V."""
    a, d = r.astype(float).copy(), len(r)
    v = np.eye(d)

    def mirror(x: np.ndarray) -> tuple[np.ndarray, float]:
        w, size = x.copy(), np.linalg.norm(x)
        w[0] += math.copysign(size, x[0])
        length = w @ w
        return w, 2 / length if length else 0.0

    for k in range(d):
        w, beta = mirror(a[k:, k])
        a[k:, k:] -= beta * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w, beta = mirror(a[k, k + 1:])
            a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ w, w)
            v[:, k + 1:] -= beta * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float]:
    """One differential qd transform; also the smallest d, negative when the
    shift was larger than the smallest value."""
    d, least = q[0] - shift, q[0] - shift
    qs, es = [], []
    for i in range(len(e)):
        top = d + e[i]
        if top > 0:
            ratio = q[i + 1] / top
            es.append(e[i] * ratio)
            d = d * ratio - shift
        else:
            es.append(0.0)
            d = q[i + 1] - shift if top == 0 else -math.inf
        qs.append(top)
        least = min(least, d)
        if least < -EPS * shift or math.isnan(least):
            return qs, es, -1.0
    qs.append(max(d, 0.0))
    return qs, es, max(least, 0.0)


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squares of the singular values of the bidiagonal with squared diagonal
    ``q`` and squared superdiagonal ``e``, largest first."""
    out: list[float] = []
    todo = [(list(q), list(e), 0.0)]
    while todo:
        q, e, moved = todo.pop()
        while q:
            if len(q) == 1:
                out.append(q[0] + moved)
                break
            # deflate at the end, split where a link is negligible
            if e[-1] <= EPS * EPS * (q[-1] + moved):
                out.append(q.pop() + moved)
                e.pop()
                continue
            if len(q) == 2:
                half, product = (q[0] + q[1] + e[0]) / 2, q[0] * q[1]
                root = math.sqrt(max(half * half - product, 0.0))
                out += [half + root + moved, product / (half + root) + moved]
                break
            cut = next((i for i in range(len(e) - 2, -1, -1) if e[i] <= EPS * EPS * (min(q[i], q[i + 1]) + moved)), -1)
            if cut >= 0:
                todo.append((q[:cut + 1], e[:cut], moved))
                q, e = q[cut + 1:], e[cut + 1:]
                continue
            if 1.5 * q[0] < q[-1]:  # small values belong at the end
                q.reverse()
                e.reverse()
            # the smaller value of the last 2 x 2 of the tridiagonal, below it
            a, b, c = q[-2] + e[-2], q[-2] * e[-1], q[-1] + e[-1]
            shift = max(0.0, ((a + c) - math.hypot(a - c, 2 * math.sqrt(b))) / 2) * (1 - 1e-9)
            for s in (shift, shift * 0.75, shift / 4, shift / 64, 0.0):
                qs, es, least = _step(q, e, s)
                if least >= 0:
                    q, e, moved = qs, es, moved + s
                    break
            else:
                raise ArithmeticError("the entries are not finite")
    return sorted(out, reverse=True)


def _factors(d: np.ndarray, l: np.ndarray, value: float) -> tuple:
    """Stationary and progressive qd of L D L' - value: L+, D+, U-, D-, and
    the auxiliary s and p whose sum with the value is the twisted pivot."""
    n, tiny = len(d), EPS * EPS * (abs(value) + d.max())
    s, p = np.empty(n), np.empty(n)
    plus, dplus, minus, dminus = np.empty(n - 1), np.empty(n), np.empty(n - 1), np.empty(n)
    s[0] = -value
    for i in range(n - 1):
        dplus[i] = s[i] + d[i] or tiny
        plus[i] = d[i] * l[i] / dplus[i]
        s[i + 1] = plus[i] * l[i] * s[i] - value
    dplus[-1] = s[-1] + d[-1] or tiny
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        dminus[i + 1] = d[i] * l[i] * l[i] + p[i + 1] or tiny
        minus[i] = l[i] * d[i] / dminus[i + 1]
        p[i] = p[i + 1] * d[i] / dminus[i + 1] - value
    dminus[0] = p[0] + value
    return plus, dplus, minus, dminus, s, p


def twisted(d: np.ndarray, l: np.ndarray, value: float) -> tuple[float, np.ndarray]:
    """The eigenvalue of L D L' next to ``value`` and its unit vector."""
    if len(d) == 1:
        return value, np.ones(1)
    z = np.ones(len(d))
    for _ in range(4):
        plus, _, minus, _, s, p = _factors(d, l, value)
        gamma = s + p + value
        k = int(np.argmin(np.abs(gamma)))
        z = np.zeros(len(d))
        z[k] = 1.0
        for i in range(k - 1, -1, -1):
            z[i] = -plus[i] * z[i + 1]
        for i in range(k, len(d) - 1):
            z[i + 1] = -minus[i] * z[i]
        size = z @ z
        better = value + gamma[k] / size
        done = abs(better - value) <= 2 * EPS * abs(value)
        value, z = better, z / math.sqrt(size)
        if done:
            break
    return value, z


def _apart(z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for o in others:
            z = z - (o @ z) * o
    return z


def _within_cluster(d: np.ndarray, l: np.ndarray, value: float, z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The vector orthogonal to the cluster's earlier ones: what is left of
    ``z``, iterated with the factorisation next to the value."""
    plus, dplus, minus, dminus, s, p = _factors(d, l, value)
    n, gamma = len(d), s + p + value
    k = int(np.argmin(np.abs(gamma)))
    pivots = np.concatenate([dplus[:k], [gamma[k] or EPS * EPS * value], dminus[k + 1:]])
    z = _apart(z, others)
    if z @ z < 0.25:
        z = _apart(np.random.default_rng(len(others)).standard_normal(n), others)
    for _ in range(4):
        z = z / np.linalg.norm(z)
        for i in range(1, k + 1):
            z[i] -= plus[i - 1] * z[i - 1]
        for i in range(n - 2, k - 1, -1):
            z[i] -= minus[i] * z[i + 1]
        z = z / pivots
        for i in range(k - 1, -1, -1):
            z[i] -= plus[i] * z[i + 1]
        for i in range(k + 1, n):
            z[i] -= minus[i - 1] * z[i - 1]
        z = _apart(z / np.linalg.norm(z), others)
    return z / np.linalg.norm(z)


def right_singular(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the largest singular values of a square matrix, largest
    first, and their right singular vectors as columns; those of rank only."""
    a, b, v = bidiagonal(r)
    norm = max(float(np.abs(a).max(initial=0)), float(np.abs(b).max(initial=0)))
    if norm == 0 or not math.isfinite(norm):
        return np.zeros(0), np.zeros((len(r), 0))
    a[np.abs(a) < EPS * EPS * norm] = EPS * EPS * norm
    edges = [0, *(np.flatnonzero(np.abs(b) <= EPS * norm / 4) + 1).tolist(), len(a)]
    found: list[tuple[float, int, int]] = []
    for s, e in zip(edges, edges[1:]):
        found += [(x, s, e) for x in dqds((a[s:e] ** 2).tolist(), (b[s:e - 1] ** 2).tolist())]
    found.sort(key=lambda f: (-f[0], f[1]))
    least = (EPS * len(a) * 8) ** 2 * found[0][0]
    found = [f for f in found[:most] if f[0] > least]
    columns: list[np.ndarray] = []
    values: list[float] = []
    for value, s, e in found:
        d, l = a[s:e] ** 2, b[s:e - 1] / a[s:e - 1]
        value, z = twisted(d, l, value)
        near = [c[s:e] for x, c, at in zip(values, columns, found) if at[1] == s and abs(x - value) <= CLUSTER * max(x, value)]
        if near:
            z = _within_cluster(d, l, value, z, near)
        whole = np.zeros(len(a))
        whole[s:e] = z
        values.append(value)
        columns.append(whole)
    order = np.argsort(-np.array(values), kind="stable")
    return np.array(values)[order], v @ np.array(columns).T[:, order]


# --------------------------------------------------------------------- frames
def stepped(vector: Column) -> Column:
    """Entries in whole steps, as longs."""
    far = float(1 << 62)
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * STEPS, F.lit(-far)), F.lit(far))) + OFFSET)


def usable(vector: Column) -> Column:
    """Whether a vector is there, not empty, and all its entries are finite."""
    finite = F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & finite


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass
class Whitening:
    """What a fit gives: ``n`` vectors with the sums ``sums`` of their
    entries, unit directions as the columns of ``axes``, eigenvalues ``e`` of
    the covariance, and its trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    e: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def dim(self) -> int:
        return len(self.sums)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - sums / n`` with one rounding: the whole part is taken off in
        integers."""
        whole = np.array([s // self.n for s in self.sums])
        part = np.array([s % self.n / self.n for s in self.sums])
        if np.abs(x).max(initial=0) > 1 << 60:
            return x.astype(float) - whole.astype(float) - part
        return (x - whole).astype(float) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.axes / np.sqrt(self.e)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of ``(n x - sums)^2``."""
        most = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums)))
        if most < 1 << 61:
            off = x * self.n - np.array(self.sums)
            if int(np.abs(off).max(initial=0)) ** 2 * self.dim < 1 << 63:
                return (off * off).sum(axis=1).tolist()
        exact = (sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def fit_list(df: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """``x``: every distinct stepped vector of the most frequent length."""
    rows = staged(df.where(usable(F.col(vec_col))).select(stepped(F.col(vec_col)).alias("x")).distinct(), "fit-list")
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("d", F.struct("n", -F.col("d")))).first()
    return rows.where(F.size("x") == (sizes[0] or 0))


def _totals(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums per dimension."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0), len(b.column(0)[0]))
            # halves, so that no sum of a batch passes 64 bits
            part = [(int(h) << 32) + int(w) for h, w in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0))]
            n, sums = n + b.num_rows, part if sums is None else [s + p for s, p in zip(sums, part)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([str(s) for s in (n, *sums)])], ["j", "s"])

    ship_package(rows.sparkSession)
    parts = rows.select("x").mapInArrow(work, "j int, s string")
    total = dict(parts.groupBy("j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())  # d + 1 rows
    return int(total.pop(-1, 0)), [int(total[j]) for j in sorted(total)]


def _triangle(stack: np.ndarray) -> np.ndarray:
    r = np.linalg.qr(stack, mode="r")
    return np.vstack([r, np.zeros((stack.shape[1] - len(r), stack.shape[1]))]) if len(r) < stack.shape[1] else r


def reduced(rows: DataFrame, model: Whitening, fan: int = FAN) -> np.ndarray:
    """The triangle R of all centred rows, by QR in blocks and a tree."""
    d = model.dim

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for b in batches:
            for k in range(0, b.num_rows, BLOCK):
                x = model.centred(_matrix(b.column(0).slice(k, BLOCK), d))
                r = _triangle(x if r is None else np.vstack([r, x]))
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()])], ["part", "r"])

    def merge(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("part")
        r = _triangle(np.vstack([np.frombuffer(x).reshape(d, d) for x in part.r]))
        return pd.DataFrame({"part": [int(part.part.iloc[0]) // fan], "r": [r.tobytes()]})

    parts = staged(rows.select("x").mapInArrow(work, "part int, r binary"), "triangles")
    while parts.count() > 1:
        parts = staged(parts.groupBy(F.floor(F.col("part") / fan).alias("g")).applyInPandas(merge, "part int, r binary"), "triangles")
    return np.frombuffer(parts.first().r).reshape(d, d)


def _identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of (covariance of the whitened fit list - I)."""
    k = len(model.e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = model.whitened(_matrix(b.column(0), model.dim))
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["j", "s"])

    sums = rows.select("x").mapInArrow(work, "j int, s double").groupBy("j").agg(F.sum("s").alias("s")).collect()  # k (k + 1) rows
    total = np.zeros((k + 1) * k)
    for r in sums:
        total[r.j] = r.s
    total = total.reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fit(df: DataFrame, vec_col: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of a table's vectors; None where nothing varies."""
    rows = fit_list(df, vec_col)
    n, sums = _totals(rows)
    if not n:
        return None
    model = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), 0.0)
    r = reduced(rows, model)
    squares, axes = right_singular(r, components)
    if not len(squares):
        return None
    model = Whitening(n, sums, axes, squares / n, float((r * r).sum()) / n)
    model.identity_error = _identity_error(rows, model)
    return model


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, model: Whitening | None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector and component (``SCHEMA``)."""
    rows = df.where(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), stepped(F.col(vec_col)).alias("x"))
    if model is None:
        return rows.where("false").select(*[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in SCHEMA.split(", "))])
    ship_package(df.sparkSession)
    k = len(model.e)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                x = _matrix(b.column(1), model.dim)
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), model.n)), pa.array(model.deviation(x), pa.int64()).take(pa.array(each)),
                    pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.e / model.trace, len(x))),
                    pa.array(np.full(len(each), model.identity_error))], [c.split()[0] for c in SCHEMA.split(", ")])

    return rows.where(F.size("x") == model.dim).mapInArrow(work, SCHEMA)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector in 16 whitened components."""
    df = embeddings(spark, sf_dir)
    return whiten(df, fit(df))
