"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, so sums and deviations are exact.  X, the centred rows, stays where it is, in blocks of rows;
the driver holds vectors of one entry a dimension or a step.  A step takes a right vector v to Xv and that to its product
with the transpose of X, both in the tasks, block by block, and only sums leave them.  Left vectors have one entry a row
and are not stored: each is X times a short vector that the driver knows, so a task makes its part of them again.  New
vectors are orthogonalised in full and twice: left ones by the products that are known and by those of what is then left,
which the same pass measures; right ones on the driver.  So a step is one pass over the blocks.

The singular values and right vectors of the small bidiagonal matrix give those of X: components and deviations.  A run
of as many steps as there are dimensions finds all of them, equal ones too; fewer find the leading ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm._common import ship, written

SCALE, SHIFT = 1024, 100_000
#: Entries are held at this distance from zero at most, so that no sum within a block of rows is too large for 64 bits.
BOUND = 1 << 40
BLOCK_ROWS = 4096
RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def integers(v: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry, as long."""
    return F.transform(v, lambda c: F.floor(F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), c * SCALE))).cast("long") + SHIFT)


def _packed(rows: int):
    """Blocks of the rows of a task: ids, and integers by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                x = part.column("x").flatten().to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([part.column("vec_id").to_pylist()], type=pa.list_(pa.int64())), pa.array([x.tobytes()])], names=["ids", "data"])

    return run


class Rows:
    """Blocks of integer rows of one dimension, with what centres them."""

    def __init__(self, blocks: DataFrame, dim: int):
        self.blocks, self.dim = blocks, dim
        self.data = blocks.select("data").coalesce(max(1, 4 * blocks.sparkSession.sparkContext.defaultParallelism))
        self.n, self.total = 0, np.zeros(dim, dtype=object)
        for n, sums in self._sums():
            self.n += n
            self.total += np.array([int(s) for s in sums.split(",")], dtype=object)

    def _sums(self):
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(dim, dtype=object)
            for x in _matrices(batches, dim):
                n += len(x)
                total += x.sum(0).astype(object)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([",".join(map(str, total))])], names=["n", "sums"])

        return [tuple(r) for r in self.data.mapInArrow(run, "n long, sums string").collect()]

    def centring(self) -> Callable[[np.ndarray], np.ndarray]:
        """The centred rows of a block, each entry rounded once: whole parts are subtracted as integers."""
        whole = np.array([int(s // self.n) for s in self.total], dtype=np.int64)
        part = np.array([float(s % self.n) / self.n for s in self.total])
        return lambda x: (x - whole).astype(np.float64) - part

    def sums(self, use: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The sum over all blocks of use(centred block), an array of one shape; one row leaves each task."""
        centred, dim = self.centring(), self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for x in _matrices(batches, dim):
                one = use(centred(x))
                out = one if out is None else out + one
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.astype("<f8").tobytes()])], names=["sums"])

        return sum(np.frombuffer(r[0], dtype="<f8") for r in self.data.mapInArrow(run, "sums binary").collect())


def _matrices(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for x in batch.column("data"):
            yield np.frombuffer(x.as_buffer(), dtype="<i8").reshape(-1, dim)


def _orthogonal(r: np.ndarray, v: np.ndarray) -> np.ndarray:
    for _ in range(2):
        r = r - v @ (v.T @ r)
    return r


def _fresh(v: np.ndarray, seed: int) -> np.ndarray:
    """A unit vector orthogonal to the columns of v, from fixed pseudo-random numbers."""
    u = (T._split_mix(len(v), seed) >> np.uint64(11)).astype(np.float64) / (1 << 53) - 0.5
    r = _orthogonal(u, v)
    return r / np.linalg.norm(r)


def bidiagonal(rows: Rows, steps: int, seed: int = 29) -> tuple[np.ndarray, np.ndarray]:
    """(V, B): right vectors as columns, and the upper bidiagonal matrix with X V = U B, after `steps` steps.

    A vector that vanishes (X has no more to say in its direction) gives a zero in B; the run goes on from a fresh right
    vector, orthogonal to all before.
    """
    dim = rows.dim
    v, w = np.zeros((dim, 0)), np.zeros((dim, 0))  # right vectors; what makes left ones of X
    back = np.zeros((dim, 0))  # products of the transpose of X with left vectors
    alpha, beta, scale = np.zeros(steps), np.zeros(steps), 0.0
    nxt = _fresh(v, seed)
    for j in range(steps):
        # What X v has of the left vectors so far is known from their products; what is left of it after that is measured.
        v_now, c = nxt, back.T @ nxt

        def step(x, c=c, v_now=v_now, w_now=w.copy()):
            left = x @ w_now
            u = x @ v_now - left @ c
            return np.concatenate(([u @ u], x.T @ u, left.T @ u))

        out = rows.sums(step)
        again = out[1 + dim :]
        product = out[1 : 1 + dim] - back @ again
        norm = np.sqrt(max(0.0, out[0] - again @ again))
        scale = max(scale, norm)
        if norm > 1e-13 * scale:
            alpha[j] = norm
            w = np.column_stack((w, (v_now - w @ (c + again)) / norm))
            product = product / norm
        else:
            w = np.column_stack((w, np.zeros(dim)))
            product = np.zeros(dim)
        back = np.column_stack((back, product))
        v = np.column_stack((v, v_now))
        if j + 1 == steps:
            break
        r = _orthogonal(product - alpha[j] * v_now, v)
        size = np.linalg.norm(r)
        if size > 1e-13 * scale:
            beta[j], nxt = size, r / size
        else:
            nxt = _fresh(v, seed + j + 1)
    return v, np.diag(alpha) + np.diag(beta[: steps - 1], 1)


def components(rows: Rows, count: int, steps: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(components as columns, their eigenvalues of the covariance), largest first; those without variance are left out."""
    v, b = bidiagonal(rows, min(rows.dim, steps or rows.dim))
    _, s, right = np.linalg.svd(b)
    kept = np.flatnonzero(s[:count] > 1e-12 * max(float(s[0]), 1e-300))
    p = v @ right.T[:, kept]
    return p / np.linalg.norm(p, axis=0), s[kept] ** 2 / rows.n


def _whitened(rows: Rows, p: np.ndarray, e: np.ndarray, trace: float):
    """RESULT rows of each block."""
    centred, n, dim = rows.centring(), rows.n, rows.dim
    whole = np.array([int(s // n) for s in rows.total], dtype=np.int64)
    part = np.array([int(s % n) for s in rows.total], dtype=object)
    scaled, share = p / np.sqrt(e), e / trace

    def deviations(x: np.ndarray) -> list[int]:
        d = x - whole
        if float(np.abs(d).max(initial=0) + 1) * n < 2**31 / np.sqrt(dim):
            d = d * n - part.astype(np.int64)
            return (d * d).sum(1).tolist()
        d = d.astype(object) * n - part
        return (d * d).sum(1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Context

        exact = Context(prec=60)
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("data"), strict=True):
                x = np.frombuffer(data.as_buffer(), dtype="<i8").reshape(-1, dim)
                z, k = centred(x) @ scaled, len(e)
                far = pa.array([exact.create_decimal(i) for i in deviations(x)], type=pa.decimal128(38, 0))
                at = np.repeat(np.arange(len(x)), k)
                cols = [ids.values.take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n)), far.take(pa.array(at)), pa.array(z.ravel()), pa.array(np.tile(share, len(x)))]
                yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return run


def identity_error(rows: Rows, p: np.ndarray, e: np.ndarray) -> float:
    """The largest absolute entry of the covariance of the whitened rows minus the identity."""
    k, scaled = len(e), p / np.sqrt(e)
    mean = rows.sums(lambda x: (x @ scaled).sum(0)) / rows.n

    def products(x):
        z = x @ scaled - mean
        return (z.T @ z).ravel()

    return float(np.abs(rows.sums(products).reshape(k, k) / rows.n - np.eye(k)).max())


def whiten(vectors: DataFrame, count: int = 8, steps: int | None = None, block_rows: int = BLOCK_ROWS, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and component up to `count`.

    All remaining vectors are the fit list.  deviation (decimal) is exact.  steps: of the bidiagonalisation, one pass
    over the vectors each; by default as many as dimensions, which finds all components to double precision.

    Defined cases: rows whose vector is null, empty or holds null or non-finite entries take no part; a null vec_id
    stays; rows that repeat count as often as they come.  Vectors of different dimensions are fitted each among those of
    their own, one after the other.  Components without variance are left out, so equal vectors, or a single one, have no
    rows.  Entries beyond 2**30 count as 2**30.  Other columns are ignored, whatever their names.
    """
    ship(vectors.sparkSession)
    v = F.col(column).cast("array<double>")
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(finite(F.col("v")) & (F.size("v") > 0))
    clean = clean.select("vec_id", integers(F.col("v")).alias("x"), F.size("v").alias("dim"))
    held = written(clean, "white-rows")
    out = None
    for r in held.groupBy("dim").count().orderBy("dim").collect():
        blocks = written(held.where(F.col("dim") == r["dim"]).select("vec_id", "x").mapInArrow(_packed(block_rows), "ids array<long>, data binary"), "white-blocks")
        rows = Rows(blocks, r["dim"])
        trace = float(rows.sums(lambda x: np.array([(x * x).sum()]))[0]) / rows.n
        if trace <= 0:
            continue
        p, e = components(rows, count, steps)
        one = blocks.mapInArrow(_whitened(rows, p, e, trace), RESULT).withColumn("identity_error", F.lit(identity_error(rows, p, e)))
        out = one if out is None else out.unionByName(one)
    return vectors.sparkSession.createDataFrame([], RESULT + ", identity_error double") if out is None else out
