"""Whitening of embeddings by a tiled covariance.

Each vector's entries become long integers. The fit list holds each distinct vector once; its sums per dimension are exact.
Pairs of dimensions form tiles: the rows of a block are cut into blocks of columns, those are shuffled to the tiles that need
them, each tile multiplies its two, and products are summed per tile. Only the assembled matrix, of the dimensions alone,
reaches the driver, which finds its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Dimensions of a block of columns, and the most rows of a block.
TILE, BLOCK_ROWS = 32, 4096
#: Entries beyond this leave the range in which the integers are exact; they are taken as not finite.
LARGEST = float(1 << 40)


@dataclass
class Whitening:
    n: int
    sums: np.ndarray  # of the fit list, per dimension, exact
    values: np.ndarray  # eigenvalues that are kept, falling
    vectors: np.ndarray  # dimensions x components
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S as integers: longs, or Python's own where longs do not hold them."""
        middle = self.sums // max(self.n, 1)
        near = x - middle
        if len(x) and int(np.abs(near).max()) * self.n >= 1 << 61:
            near = near.astype(object)
        return near * self.n - (self.sums - middle * self.n)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return centred.astype(np.float64) / self.n @ self.vectors / np.sqrt(self.values)


def usable(vectors: DataFrame, id: str, vector: str) -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that take part, and their dimension: the commonest length (ties: the longest)."""
    rows = vectors.select(F.col(id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).filter("size(v) > 0")
    rows = rows.filter(~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > LARGEST)))
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(SHIFT).cast("bigint")).alias("x"))
    top = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows, 0) if top is None else (rows.filter(F.size("x") == top["d"]), top["d"])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def sums_of(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """The number of vectors and the exact sum of each dimension; one row a dimension passes through the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(d, np.int64)
        for b in batches:
            n += b.num_rows
            total += _matrix(b.column("x"), d).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(total), pa.array(np.full(d, n))], ["k", "s", "n"])

    rows = fit.select("x").mapInArrow(partial, "k bigint, s bigint, n bigint").groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
    sums = np.zeros(d, np.int64)
    for r in rows:
        sums[r["k"]] = r["s"]
    return (rows[0]["n"] if rows else 0), sums


def covariance(fit: DataFrame, n: int, sums: np.ndarray, tile: int = TILE) -> np.ndarray:
    """The covariance of the fit list (divisor n), centred before multiplying, tile by tile."""
    d = len(sums)
    edges = list(range(0, d, tile))
    pairs = [(i, j) for i in range(len(edges)) for j in range(i, len(edges))]
    middle = sums // n
    schema = "part bigint, block bigint, i int, j int, side int, width int, columns binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        for b in batches:
            near = _matrix(b.column("x"), d) - middle
            for a in range(0, len(near), BLOCK_ROWS):
                rows = near[a : a + BLOCK_ROWS]
                widest = int(np.abs(rows).max())
                kind = next(t for t, most in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if widest < most)
                held = [np.ascontiguousarray(rows[:, e : e + tile], kind).tobytes() for e in edges]
                put = [(i, j, side, held[k]) for i, j in pairs for side, k in ((0, i), (1, j)) if side == 0 or i != j]
                size = len(put)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * size, pa.int64()), pa.array([block] * size, pa.int64()), *(pa.array([p[k] for p in put], pa.int32()) for k in range(3)), pa.array([int(kind[2])] * size, pa.int32()), pa.array([p[3] for p in put], pa.binary())],
                    ["part", "block", "i", "j", "side", "width", "columns"],
                )
                block += 1

    rest = (sums - middle * n).astype(np.float64) / n

    def multiply(table: pa.Table) -> pa.Table:
        by_side = {r["side"]: r for r in table.to_pylist()}
        i, j = by_side[0]["i"], by_side[0]["j"]

        def centred(row: dict, k: int) -> np.ndarray:
            of = slice(edges[k], min(edges[k] + tile, d))
            return np.frombuffer(row["columns"], f"<i{row['width']}").reshape(-1, of.stop - of.start).astype(np.float64) - rest[of]

        left = centred(by_side[0], i)
        product = left.T @ (centred(by_side[1], j) if i != j else left)
        a, b = np.indices(product.shape)
        return pa.table({"a": pa.array((a + edges[i]).ravel()), "b": pa.array((b + edges[j]).ravel()), "p": pa.array(product.ravel())})

    blocks = fit.select("x").mapInArrow(cut, schema)
    products = blocks.groupBy("part", "block", "i", "j").applyInArrow(multiply, "a bigint, b bigint, p double")
    summed = products.groupBy("a", "b").agg(F.sum("p").alias("p")).toArrow()  # at most one row a pair of dimensions
    out = np.zeros((d, d))
    a, b, p = (summed.column(c).to_numpy() for c in ("a", "b", "p"))
    out[a, b] = p / n
    out[b, a] = p / n
    return out


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS, tile: int = TILE) -> Whitening | None:
    """None where the fit list is empty. Components without variance beyond rounding are left out."""
    n, sums = sums_of(fit, d)
    if not n:
        return None
    v = covariance(fit, n, sums, tile)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = int((values[:components] > max(values[0], 0) * d * 1e-13).sum()) if values[0] > 0 else 0
    return Whitening(n, sums, values[:some].copy(), np.ascontiguousarray(vectors[:, :some]), float(np.trace(v)))


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity, measured on its vectors."""
    d, k = model.vectors.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = model.project(model.centred(_matrix(b.column("x"), d)))
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        a, b = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(b.ravel()), pa.array(total.ravel())], ["a", "b", "p"])

    total = np.zeros((k + 1, k))
    for r in fit.select("x").mapInArrow(partial, "a bigint, b bigint, p double").groupBy("a", "b").agg(F.sum("p").alias("p")).collect():
        total[r["a"], r["b"]] = r["p"] / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, ws: Workspace, *, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """Per row and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    Vectors that are null or empty, that hold null or non-finite entries or some beyond 2**40, or whose length is not the
    commonest one (ties: the longest) take no part. Null ids are kept, rows with equal ids are rows each, and equal vectors
    weigh once in the fit. Only the columns named are read. Components of no variance are left out, so an empty table, or
    one with a single distinct vector, gives no rows. A deviation beyond a long is null.
    """
    out = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows, d = usable(vectors, id, vector)
    fit = ws.keep(rows.select("x").distinct(), "fit") if d else None
    model = fit_whitening(fit, d, components, tile) if d else None
    if model is None or not len(model.values):
        return ws.spark.createDataFrame([], out)
    error = identity_error(fit, model)
    ws.drop(fit)
    k = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(a, BLOCK_ROWS)
                centred = model.centred(_matrix(part.column("x"), d))
                largest = int(np.abs(centred).max())
                if largest * largest * d < 1 << 63:
                    deviation = pa.array((centred * centred).sum(1), pa.int64())
                else:
                    exact = [sum(int(y) ** 2 for y in row) for row in centred]
                    deviation = pa.array([y if y < 1 << 63 else None for y in exact], pa.int64())
                rows = np.repeat(np.arange(part.num_rows), k)
                size = len(rows)
                arrays = [part.column("vec_id").take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(size, model.n)), deviation.take(pa.array(rows))]
                arrays += [pa.array(model.project(centred).ravel()), pa.array(np.tile(model.values / model.trace, part.num_rows)), pa.array(np.full(size, error))]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, out)
