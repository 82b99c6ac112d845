"""Whitening of embeddings by a one-sided Jacobi SVD of the R of a blockwise QR.

1. Exact sums of the floored entries give n and S.
2. TSQR: every task reduces its centred rows, block by block, to one upper triangle R; triangles meet in groups of FAN,
   level by level, until one is left. RᵀR is n times the covariance, and no product of entries is ever formed.
3. Plane rotations make the columns of R orthogonal. Their lengths are the standard deviations times sqrt(n), to full
   precision even for small ones, and the product of the rotations holds the components.
4. Rows are projected, and the covariance of the result is measured over all rows.

What passes the driver has the size of the dimension squared, whatever the number of rows.

Defined results: rows whose vector is null, or holds a null or non-finite entry or one beyond LARGEST / SCALE, take no
part. Of vectors of several lengths, those of the most frequent length (of ties, the longest) take part. Repeated rows
count each time. A direction without variance (one row, equal rows, fewer rows than dimensions) has the whitened value 0
and explains 0; it is left out of the identity error. An empty table gives no rows. A deviation beyond 38 digits is null
(in the query: beyond a long). Other columns are kept as they are, but for those named like a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtide.llm.vectors import Lists
from graphtide.runtime import Shelf, small_batches, table

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Components of the query.
COMPONENTS = 8
#: Floored entries beyond this are no whole numbers of a double any more when they are centred.
LARGEST = float(1 << 48)
#: Triangles that meet in one group.
FAN = 32


@dataclass
class Whitening:
    """The fit: components are rows, by falling standard deviation."""

    n: int
    sums: list[int]
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0
    #: n times the mean is whole * n + rest, so that centring loses nothing
    whole: np.ndarray = field(init=False)
    rest: list[int] = field(init=False)

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.sums], dtype=np.int64)
        self.rest = [s % self.n for s in self.sums]

    @property
    def dims(self) -> int:
        return len(self.sums)

    def near(self, lists: Lists) -> tuple[np.ndarray, np.ndarray]:
        """Rows that take part, and their entries less the whole part of the mean."""
        x = lists.floors(SCALE, LARGEST)
        rows = np.flatnonzero(lists.whole & (lists.lengths == self.dims))
        return rows, lists.matrix(x, rows, self.dims) + SHIFT - self.whole

    def centred(self, near: np.ndarray) -> np.ndarray:
        return near - np.array([r / self.n for r in self.rest])

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        live = self.deviations > 0
        scale = np.divide(1.0, self.deviations, out=np.zeros_like(self.deviations), where=live)
        return (centred @ self.components.T) * scale

    def deviation(self, near: np.ndarray) -> pa.Array:
        """The sum of (n * x - S)² of each row, exact."""
        most = int(np.abs(near).max(initial=0)) + 1
        if self.dims * (self.n * most) ** 2 < 1 << 63:
            d = near * self.n - np.array(self.rest, dtype=np.int64)
            return pa.array((d * d).sum(axis=1)).cast(pa.decimal128(38, 0))
        rest, constant = np.array(self.rest, dtype=object), sum(r * r for r in self.rest)
        near = near.astype(object)
        exact = self.n * self.n * (near * near).sum(axis=1) - 2 * self.n * (near @ rest) + constant
        return pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))


def rotate(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """One-sided Jacobi: right singular vectors (rows) and singular values of r, falling.

    Each step of a sweep rotates dims / 2 disjoint pairs of columns; a sweep meets every pair once.
    """
    d = r.shape[1]
    cols, turns = np.ascontiguousarray(r.T, dtype=np.float64), np.eye(d)
    order = np.argsort(-np.einsum("ij,ij->i", cols, cols), kind="stable")
    cols, turns = cols[order], turns[order]
    ring = list(range(d + d % 2))
    half = len(ring) // 2
    for _ in range(sweeps if d > 1 else 0):
        worst = 0.0
        for _ in range(len(ring) - 1):
            pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[: half - 1 : -1], strict=True) if max(a, b) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, q = np.array(pairs).T
            x, y = cols[p], cols[q]
            a, b, g = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y), np.einsum("ij,ij->i", x, y)
            size = np.sqrt(a) * np.sqrt(b)
            cosine = np.divide(np.abs(g), size, out=np.zeros_like(g), where=size > 0)
            worst = max(worst, cosine.max())
            go = cosine > 1e-15
            if not go.any():
                continue
            p, q, x, y, a, b, g = p[go], q[go], x[go], y[go], a[go], b[go], g[go]
            zeta = (b - a) / (2 * g)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = (1 / np.hypot(1.0, t))[:, None]
            s = c * t[:, None]
            cols[p], cols[q] = c * x - s * y, s * x + c * y
            x, y = turns[p], turns[q]
            turns[p], turns[q] = c * x - s * y, s * x + c * y
        if worst <= 1e-14:
            break
    values = np.sqrt(np.einsum("ij,ij->i", cols, cols))
    order = np.argsort(-values, kind="stable")
    turns = turns[order]
    # either sign is right: the largest entry of a component is positive
    turns *= np.where(turns[np.arange(d), np.argmax(np.abs(turns), axis=1)] < 0, -1.0, 1.0)[:, None] if d else 1.0
    return turns, values[order]


def _sums(vectors: DataFrame, shelf: Shelf) -> tuple[int, list[int]]:
    """n and S of the length that takes part."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            lists = Lists(batch.column(0))
            x = lists.floors(SCALE, LARGEST)
            for length in np.unique(lists.lengths[lists.whole]).tolist():
                rows = np.flatnonzero(lists.whole & (lists.lengths == length))
                old = found.setdefault(length, [0, np.zeros(length, dtype=object)])
                old[0] += len(rows)
                old[1] = old[1] + (lists.matrix(x, rows, length) + SHIFT).sum(axis=0)
        for length, (n, sums) in found.items():
            totals = pa.array([Decimal(int(v)) for v in (n, *sums)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([length] * (length + 1), pa.int32()), pa.array(range(-1, length), pa.int32()), totals], names=["length", "i", "total"])

    totals = shelf.put(vectors.mapInArrow(partial, "length int, i int, total decimal(38,0)").groupBy("length", "i").agg(F.sum("total").alias("total")))
    most = totals.filter("i = -1").orderBy(F.desc("total"), F.desc("length")).limit(1).collect()
    if not most:
        return 0, []
    return int(most[0].total), [int(r.total) for r in totals.filter((F.col("length") == most[0].length) & (F.col("i") >= 0)).orderBy("i").collect()]


def _triangle(blocks: Iterator[np.ndarray], dims: int) -> np.ndarray:
    """R of the blocks, one below the other."""
    r = np.zeros((0, dims))
    for block in blocks:
        if len(block):
            r = np.linalg.qr(np.vstack([r, block]), mode="r")
    return r


def _tsqr(vectors: DataFrame, fit: Whitening, shelf: Shelf) -> np.ndarray:
    """The triangle of all centred rows."""
    dims = fit.dims
    height = max(256, 4 * dims)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for batch in batches:
                _, near = fit.near(Lists(batch.column(0)))
                yield from (fit.centred(near[at : at + height]) for at in range(0, len(near), height))

        r = _triangle(blocks(), dims)
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([r.tobytes()], pa.binary())], names=["part", "r"])

    def meet(found: pd.DataFrame) -> pd.DataFrame:
        r = _triangle((np.frombuffer(b).reshape(-1, dims) for b in found.sort_values("part")["r"]), dims)
        return pd.DataFrame({"part": [found["part"].iloc[0] // FAN], "r": [r.tobytes()]})

    parts = shelf.put(vectors.mapInArrow(reduce, "part int, r binary"))
    left = parts.agg(F.max("part")).first()[0]
    while left:
        parts = parts.groupBy(F.expr(f"part div {FAN}")).applyInPandas(meet, "part int, r binary")
        left //= FAN
    # the one triangle that is left, or none of a table without rows
    return _triangle((np.frombuffer(bytes(row.r)).reshape(-1, dims) for row in parts.collect()), dims)


def _identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured."""
    live = np.flatnonzero(fit.deviations > 0)
    k = len(live)
    if not k:
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = fit.whitened(fit.centred(fit.near(Lists(batch.column(0)))[1]))[:, live]
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        values = np.concatenate([sums, products.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["i", "total"])

    # the rows are centred before they are projected: their mean is rounding, taken off all the same
    totals = {r.i: r.total for r in vectors.mapInArrow(partial, "i int, total double").groupBy("i").agg(F.sum("total").alias("total")).collect()}
    mean = np.array([totals[i] for i in range(k)]) / fit.n
    covariance = np.array([totals[k + i] for i in range(k * k)]).reshape(k, k) / fit.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max())


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all vectors of the table; None where no row takes part."""
    vectors, shelf = vectors.select(vector), Shelf(vectors.sparkSession)
    with small_batches(vectors.sparkSession):
        n, sums = _sums(vectors, shelf)
        if not n:
            shelf.clear()
            return None
        found = Whitening(n, sums, np.zeros((0, len(sums))), np.zeros(0), np.zeros(0))
        turns, values = rotate(_tsqr(vectors, found, shelf))
        shelf.clear()
        # what rounding leaves of a column that depends on the others is no variance
        values = np.where(values > values.max(initial=0.0) * len(sums) * 4 * np.finfo(float).eps, values, 0.0)
        total = float((values**2).sum())
        found.components, found.deviations = turns[:components], values[:components] / np.sqrt(n)
        found.explained = values[:components] ** 2 / total if total else np.zeros(len(found.components))
        found.identity_error = _identity_error(vectors, found)
    return found


def whiten(vectors: DataFrame, found: Whitening | None, vector: str = "embedding") -> DataFrame:
    """The rows that take part, with the columns whitened (one entry a component) and deviation appended."""
    base = vectors.drop(*(c for c in ("whitened", "deviation") if c != vector))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name not in ("whitened", "deviation"))
    at, kept = base.columns.index(vector), [i for i, c in enumerate(base.columns) if c not in ("whitened", "deviation")]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if found is None:
                return
            rows, near = found.near(Lists(batch.column(at)))
            w = found.whitened(found.centred(near))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            took = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*(took.column(i) for i in kept), lists, found.deviation(near)], names=[*(batch.schema.names[i] for i in kept), "whitened", "deviation"])

    return base.mapInArrow(project, (schema + ", " if schema else "") + "whitened array<double>, deviation decimal(38,0)")


def _entry(values: np.ndarray, at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)).cast("array<double>"), at)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = fit(vectors)
    rows = whiten(vectors, found).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(found.n if found else 0).cast("long").alias("n"),
        F.expr("try_cast(deviation AS long)").alias("deviation"),
        "whitened",
        _entry(found.explained if found else np.zeros(0), F.col("at") + 1).alias("explained"),
        F.lit(found.identity_error if found else 0.0).alias("identity_error"),
    )


#: Eigenvectors are not SQL; the test compares with an eigendecomposition of the covariance.
ORACLE_SQL = None
