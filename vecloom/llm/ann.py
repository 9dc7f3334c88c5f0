"""Nearest neighbours by collision-counting hashing.

The index keeps, for every block of vectors, each of m random projections as one sorted array, built once and written.
A query opens a window around its own value in every array; a vector that lies in the windows of at least
`threshold` * m arrays is a candidate, and its distance is computed in double precision on the original vectors.  Windows
widen by virtual rehashing: one set of arrays serves all radii.  A query's first radius is the smallest of a geometric
sequence at which `share` of a bounded sample are candidates; queries that then find fewer than k vectors go on to wider
windows, the others are done.

Blocks are leaves of a tree of cuts on the projections, fitted on the same sample, so near vectors lie together; a leaf
of more than `block_rows` vectors is dealt over several blocks.  A block whose values reach into fewer than
`threshold` * m of a query's windows holds none of its candidates and is not visited.  Every pair of a query block and a
block to visit is one piece of work, so no task sees more than two blocks, and each piece returns its k best.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm._common import ship, smallest, written

RESULT = "query_id long, vec_id long, score double, n long"
GROWTH = 1.1  # of the radius from one step of the sequence to the next
RADIUS_ROWS = 2048  # of the sample that radii are read from


def projections(dim: int, m: int, seed: int) -> np.ndarray:
    """m Gaussian directions, the same in every process."""
    u = (T._split_mix(2 * dim * m, seed) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return (np.sqrt(-2 * np.log(1 - u[: dim * m])) * np.cos(2 * np.pi * u[dim * m :])).reshape(dim, m)


class Fit:
    """Projections, cuts and radii, from a sample of vectors (rows of x)."""

    def __init__(self, x: np.ndarray, m: int, threshold: float, share: float, depth: int, seed: int):
        self.p = projections(x.shape[1], m, seed)
        self.need, self.share = max(1, int(np.ceil(threshold * m))), share
        y = x @ self.p
        self.sample = y[:RADIUS_ROWS]
        self.base = max(1e-12, float(np.median(np.ptp(y, axis=0))) / 1024)
        self.depth = depth
        self.axis, self.cut = np.zeros(1 << depth, dtype=np.int64), np.full(1 << depth, np.inf)
        rows = {1: np.arange(len(y))}
        for node in range(1, 1 << depth):
            r = rows.pop(node)
            if len(r) > 1:
                self.axis[node] = np.argmax(np.ptp(y[r], axis=0))
                self.cut[node] = np.median(y[r, self.axis[node]])
            right = y[r, self.axis[node]] > self.cut[node]
            rows[2 * node], rows[2 * node + 1] = r[~right], r[right]

    def leaf(self, y: np.ndarray) -> np.ndarray:
        node = np.ones(len(y), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (y[np.arange(len(y)), self.axis[node]] > self.cut[node])
        return node

    def radius(self, y: np.ndarray) -> np.ndarray:
        """First radius of each query: the step at which enough of the sample collide in enough arrays."""
        out = np.empty(len(y))
        at = min(len(self.sample), max(1, int(np.ceil(self.share * len(self.sample))))) - 1
        for i, q in enumerate(y):
            reach = np.partition(np.abs(self.sample - q), self.need - 1, axis=1)[:, self.need - 1]
            out[i] = np.partition(reach, at)[at]
        steps = np.ceil(np.log(np.maximum(out, self.base) / self.base) / np.log(GROWTH))
        return self.base * GROWTH**steps


def _matrix(column, rows: int) -> np.ndarray:
    return column.flatten().to_numpy().astype("<f8").reshape(rows, -1)


def _leaves(fit: Fit):
    """The rows with the leaf of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = fit.leaf(_matrix(batch.column("v"), batch.num_rows) @ fit.p) if batch.num_rows else np.zeros(0, dtype=np.int64)
            yield batch.append_column("leaf", pa.array(leaf))

    return run


def _stretches(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of one leaf and piece, and of at most so many rows."""
    leaf, piece = (batch.column(c).to_numpy() for c in ("leaf", "piece"))
    border = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(piece) != 0)) + 1 if batch.num_rows else []
    for s in np.split(np.arange(batch.num_rows), border):
        for lo in range(0, len(s), rows):
            yield batch.slice(s[lo], len(s[lo : lo + rows]))


def _indexer(fit: Fit, block_rows: int):
    """One row per block: ids, multiplicities, vectors; the sorted arrays, the ranks in them, and their ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _stretches(batch, block_rows):
                x = _matrix(part.column("v"), part.num_rows)
                y = (x @ fit.p).T
                order = np.argsort(y, axis=1, kind="stable")
                ranks = np.empty(order.shape, dtype="<u2" if part.num_rows < 1 << 16 else "<u4")
                np.put_along_axis(ranks, order, np.arange(part.num_rows, dtype=ranks.dtype)[None, :], axis=1)
                values = np.take_along_axis(y, order, axis=1)
                raw = [part.column("vec_id").to_numpy().astype("<i8"), part.column("n").to_numpy().astype("<i8"), x, values, ranks]
                ends = [pa.array([v.tolist()], type=pa.list_(pa.float64())) for v in (values[:, 0], values[:, -1])]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], type=pa.binary()) for v in raw] + ends, names=["ids", "ns", "data", "arrays", "ranks", "low", "high"])

    return run


INDEX = "ids binary, ns binary, data binary, arrays binary, ranks binary, low array<double>, high array<double>"


def _queries(fit: Fit, query_rows: int, widen: float):
    """One row per block of queries: ids, vectors and radii, and the reach of all their windows together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _stretches(batch, query_rows):
                x = _matrix(part.column("v"), part.num_rows)
                y = x @ fit.p
                r = fit.radius(y) * widen
                raw = [part.column("vec_id").to_numpy().astype("<i8"), x, r]
                ends = [pa.array([v.tolist()], type=pa.list_(pa.float64())) for v in ((y - r[:, None]).min(0), (y + r[:, None]).max(0))]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], type=pa.binary()) for v in raw] + ends, names=["q_ids", "q_data", "q_radius", "q_low", "q_high"])

    return run


QUERIES = "q_ids binary, q_data binary, q_radius binary, q_low array<double>, q_high array<double>"


def search_block(fit: Fit, k: int, ids, ns, x, arrays, ranks, qids, q, radius) -> list[np.ndarray]:
    """The k nearest candidates of each query within one block: query ids, vector ids, distances, multiplicities."""
    m = len(arrays)
    y = (q @ fit.p).T
    lo = np.stack([np.searchsorted(arrays[j], y[j] - radius, side="left") for j in range(m)])
    hi = np.stack([np.searchsorted(arrays[j], y[j] + radius, side="right") for j in range(m)])
    out = []
    for i in np.flatnonzero((hi > lo).sum(0) >= fit.need):
        low, size = lo[:, i].astype(ranks.dtype), (hi - lo)[:, i].astype(np.uint32)
        hits = ((ranks - low[:, None]) < size[:, None]).sum(0, dtype=np.uint16)  # unsigned: ranks below the window wrap
        picked = np.flatnonzero(hits >= fit.need)
        d = x[picked] - q[i]
        d = np.sqrt(np.einsum("ij,ij->i", d, d))
        n = ns[picked] - ((ids[picked] == qids[i]) & (d == 0))  # the query's own row
        picked, d, n = picked[n > 0], d[n > 0], n[n > 0]
        if len(d) > k:
            near = d <= np.partition(d, k - 1)[k - 1]
            picked, d, n = picked[near], d[near], n[near]
        top = np.lexsort((ids[picked], d))[:k]
        out.append((np.full(len(top), qids[i]), ids[picked[top]], d[top], n[top]))
    kinds = (np.int64, np.int64, np.float64, np.int64)
    return [np.concatenate([o[c] for o in out] + [np.zeros(0)]).astype(t) for c, t in enumerate(kinds)]


def _gather(fit: Fit, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, ns, qids, radius = (np.frombuffer(r[c], dtype=t) for c, t in (("ids", "<i8"), ("ns", "<i8"), ("q_ids", "<i8"), ("q_radius", "<f8")))
                x, q = np.frombuffer(r["data"]).reshape(len(ids), -1), np.frombuffer(r["q_data"]).reshape(len(qids), -1)
                arrays = np.frombuffer(r["arrays"]).reshape(-1, len(ids))
                ranks = np.frombuffer(r["ranks"], dtype="<u2" if len(ids) < 1 << 16 else "<u4").reshape(-1, len(ids))
                found = search_block(fit, k, ids, ns, x, arrays, ranks, qids, q, radius)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score", "n"])

    return run


def _search(rows: DataFrame, queries: DataFrame, n: int, n_q: int, wanted: int, k: int, m: int, threshold: float, share: float, least: int, block_rows: int, query_rows: int, sample_rows: int, seed: int) -> DataFrame:
    """RESULT rows among vectors of one dimension; the k best of each query are among them."""
    drawn = smallest(rows.select("vec_id", "v"), sample_rows, n, "vec_id", "v").select("v").toArrow()
    depth = max(0, int(np.ceil(np.log2(n / block_rows))))
    fit = Fit(_matrix(drawn.column("v").combine_chunks(), drawn.num_rows), m, threshold, max(share, min(1.0, least / n)), min(depth, 12), seed)

    placed = written(rows.mapInArrow(_leaves(fit), "vec_id long, v array<double>, n long, leaf long"), "ann-leaves")
    sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("pieces"))
    dealt = placed.join(sizes, "leaf").withColumn("piece", F.pmod(F.xxhash64("vec_id", "v"), "pieces")).drop("pieces")
    keyed = dealt.repartition(max(1, -(-n // block_rows)), "leaf", "piece").sortWithinPartitions("leaf", "piece", "vec_id")
    index = written(keyed.mapInArrow(_indexer(fit, block_rows), INDEX).withColumn("b", F.monotonically_increasing_id()), "ann-index")
    asked = queries.mapInArrow(_leaves(fit), "vec_id long, v array<double>, leaf long").withColumn("piece", F.lit(0).cast("long"))
    asked = written(asked.repartitionByRange(max(1, -(-n_q // query_rows)), "leaf", "vec_id").sortWithinPartitions("leaf", "vec_id"), "ann-asked")

    done, widen = [], 1.0
    groups = max(1, n // (1000 * block_rows))  # of blocks, so that queries meet their ends in an equi-join
    while True:
        q = written(asked.drop("leaf").withColumn("leaf", F.lit(0).cast("long")).mapInArrow(_queries(fit, query_rows, widen), QUERIES).withColumn("qb", F.monotonically_increasing_id()), "ann-queries")
        ends = index.select("b", "low", "high", F.pmod("b", F.lit(groups)).alias("g"))
        hulls = q.select("qb", "q_low", "q_high", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))
        met = F.zip_with(F.zip_with("low", "q_high", lambda a, b: a <= b), F.zip_with("high", "q_low", lambda a, b: a >= b), lambda a, b: a & b)
        visits = hulls.join(ends, "g").where(F.size(F.filter(met, lambda x: x)) >= fit.need).select("qb", "b")
        work = visits.join(index.drop("low", "high"), "b").join(q.drop("q_low", "q_high"), "qb").select("ids", "ns", "data", "arrays", "ranks", "q_ids", "q_data", "q_radius")
        found = written(work.mapInArrow(_gather(fit, k), RESULT), "ann-found")
        full = found.groupBy(F.col("query_id").alias("vec_id")).agg(F.sum("n").alias("n")).where(F.col("n") >= wanted).select("vec_id")
        rest = written(asked.join(full, "vec_id", "left_anti"), "ann-asked")
        widen *= 2
        if not wanted or rest.isEmpty():  # at last the windows hold everything
            return reduce(DataFrame.unionByName, [*done, found])
        done.append(found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi"))
        asked = rest


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, projections_: int = 128, threshold: float = 0.75, share: float = 0.25, least: int = 200, block_rows: int = 4096, query_rows: int = 4096, sample_rows: int = 8192, seed: int = 23) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors found for each vector whose vec_id is divisible by `every`.

    score is the Euclidean distance in double precision; equal distances rank by vec_id.  Cuts and radii are fitted on
    the `sample_rows` vectors of the smallest hashes; every vector is indexed.

    Defined cases: rows whose vec_id or vector is null, or whose vector is empty, zero or has null or non-finite
    components, take no part.  Distances exist between vectors of one dimension, so each is searched among those of its
    own.  Of rows that repeat a query's vec_id the one with the smallest vector asks; all rows are candidates, and one
    that repeats is returned as often.  With fewer than k other vectors all are returned.  Other columns are ignored,
    whatever their names.
    """
    ship(vectors.sparkSession)
    v = F.col("embedding").cast("array<double>")
    clean = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    )
    clean = written(clean.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")), "vectors")
    asking = written(clean.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-asking")
    found = []
    counts = {r["dim"]: r for r in clean.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("rows")).collect()}
    for r in asking.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("q")).orderBy("dim").collect():
        own = F.size("v") == r["dim"]
        found.append(_search(clean.where(own), asking.where(own), counts[r["dim"]]["n"], r["q"], min(k, counts[r["dim"]]["rows"] - 1), k, projections_, threshold, share, least, block_rows, query_rows, sample_rows, seed))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    each = reduce(DataFrame.unionByName, found).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k)))))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    out = each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
