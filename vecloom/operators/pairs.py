"""Pairs of vectors, block against block.

Vectors are packed into blocks of a bounded number of rows.  Pairs of blocks are a cross product of two tables of blocks:
a task reads some blocks of either side from where they lie, so blocks are neither broadcast nor copied for each pair, and
disk grows with the vectors, not with the pairs.  Within a pair the distances are one matrix product.  What a kernel finds
for a block against all that its task holds of the other side it may put together before it leaves the task.

Where only pairs up to some distance count, near vectors are put into blocks together and every block knows the ball that
holds it; by the triangle inequality, pairs of blocks whose balls are farther apart are never met.  That leaves out work,
not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vec
from vecloom.sources.scratch import settled
from vecloom.sources.ship import ship

BLOCK_ROWS = 2048
#: Vectors that the cuts between blocks of near vectors are fitted on, and the depth of the cuts.
CUT_ROWS, CUT_DEPTH = 16_384, 11
#: Rounding that a bound on distances allows for.
SLACK = 1e-9
#: Bytes of blocks that a task holds, and of blocks that it takes past them one by one; parts of either where it has fewer.
HELD, PAST = (32 << 20, 2), (4 << 20, 8)
#: Groups whose sums a task puts together before it returns them.
GROUPS = 256
PACKED = "block long, ids binary, groups binary, data binary, centre array<double>, radius double"


def _one_block(block: int, parts: list[pa.RecordBatch], extra: int) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts).combine_chunks()
    x = t.column("v").combine_chunks().flatten().to_numpy().astype("<f8")
    rows = x.reshape(t.num_rows, -1)
    place = rows[:, : rows.shape[1] - extra]
    centre = place.mean(0)
    raw = [t.column(c).to_numpy().astype("<i8").tobytes() for c in ("id", "group")]
    return pa.RecordBatch.from_arrays(
        [pa.array([block]), *(pa.array([r]) for r in raw), pa.array([x.tobytes()]), pa.array([centre.tolist()], type=pa.list_(pa.float64())), pa.array([float(np.sqrt(((place - centre) ** 2).sum(1).max()))])],
        names=["block", "ids", "groups", "data", "centre", "radius"],
    )


def _packer(extra: int = 0):
    """One row for each block; rows come by block, and a block may lie in several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = -1
        for batch in batches:
            block = batch.column("block").to_numpy()
            border = np.flatnonzero(np.diff(block)) + 1
            for lo, hi in zip([0, *border], [*border, len(block)], strict=True):
                if hi > lo:
                    if held and block[lo] != at:
                        yield _one_block(at, held, extra)
                        held = []
                    at = int(block[lo])
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield _one_block(at, held, extra)

    return run


class Cuts:
    """A tree of cuts that keeps near vectors together, from a sample of them; which leaf a vector falls in is no more
    than a way to place it."""

    def __init__(self, x: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros((1 << depth, x.shape[1])), np.full(1 << depth, np.inf)
        rows = {1: np.arange(len(x))}
        for node in range(1, 1 << depth):
            r = rows.pop(node)
            if len(r) > 1:
                one = x[r[np.argmax(((x[r] - x[r].mean(0)) ** 2).sum(1))]]
                other = x[r[np.argmax(((x[r] - one) ** 2).sum(1))]]
                self.axis[node] = other - one  # from one end to the other
                self.at[node] = np.median(x[r] @ self.axis[node])
            right = x[r] @ self.axis[node] > self.at[node]
            rows[2 * node], rows[2 * node + 1] = r[~right], r[right]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(self.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, self.axis[node]) > self.at[node])
        return node


def _placed(keyed: DataFrame, count: int, rows: int, extra: int) -> DataFrame:
    """keyed(id, v, ...) with block: leaves of cuts, a leaf of more than `rows` vectors dealt over several blocks."""
    drawn = keyed.select("v").orderBy(F.xxhash64("id", "v")).limit(CUT_ROWS).toArrow()
    matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    place = lambda x: x[:, : x.shape[1] - extra]
    cuts = Cuts(place(matrix(drawn)), min(CUT_DEPTH, max(1, int(np.ceil(np.log2(2 * count))))))

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.append_column("leaf", pa.array(cuts.leaf(place(matrix(pa.Table.from_batches([batch]))))))

    found = settled(keyed.mapInArrow(leaves, "id long, group long, v array<double>, leaf long"), "leaves")
    pieces = found.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / rows).alias("pieces"))  # at most 2**CUT_DEPTH rows
    return found.join(F.broadcast(pieces), "leaf").select("id", "group", "v", (F.col("leaf") * (1 << 40) + F.pmod(F.xxhash64("id"), "pieces")).alias("block"))


def blocks(vectors: DataFrame, rows: int | None = None, group: str | None = None, near: bool = False, extra: int = 0) -> tuple[DataFrame, int]:
    """PACKED rows of vectors(face_id, vector), and how many blocks hashing makes of them; near: near vectors together.

    The last `extra` entries of a vector are no coordinates and go with it.
    """
    rows = rows or BLOCK_ROWS
    count = max(1, -(-vectors.count() // rows))
    keyed = vectors.select(F.col("face_id").alias("id"), (F.col(group) if group else F.lit(0)).cast("long").alias("group"), F.col("vector").cast("array<double>").alias("v"))
    if near and count > 1:
        keyed = _placed(keyed, count, rows, extra)
    else:
        keyed = keyed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(count)).cast("long"))
    return keyed.repartition(count, "block").sortWithinPartitions("block", "id").mapInArrow(_packer(extra), PACKED), count


Strip = Callable[..., Iterator[dict]]


def _near(within: float | None) -> Column:
    """Whether the balls of blocks i and j come as near as `within`; None: as near as block i says in reach."""
    gap = vec.euclidean(F.col("centre_a"), F.col("centre_b")) - F.col("radius_a") - F.col("radius_b")
    return gap <= (F.col("reach_a") if within is None else F.lit(float(within))) + SLACK * (1 + F.abs(gap)) + 1e-7


def _side(packed: DataFrame, key: str, side: str, held: tuple[int, int] | None) -> DataFrame:
    """Blocks as a side of a cross product, dealt into parts of so many bytes, or so many parts; None: a single block."""
    named = packed.select(F.col("block").alias(key), *[F.col(c).alias(f"{c}_{side}") for c in packed.columns if c != "block"])
    if held is None:
        return named.coalesce(1)
    count, rows, width = packed.agg(F.count(F.lit(1)), F.max(F.length("ids")), F.max(F.size("centre"))).head()
    each = max(1, min(held[0] // max(1, (rows or 0) * (width or 0)), (count or 0) // held[1]))
    return named.repartition(max(1, -(-(count or 0) // each)))


def crossed(a: DataFrame, b: DataFrame, met: Column, whole: bool = False) -> DataFrame:
    """Pairs of packed blocks, i of a and j of b, for which `met` holds; the pairs of one i follow each other in a task.

    whole: either side is a single block at most.  Otherwise both must be tables, as their parts are read again and again.
    """
    left, right = _side(a, "i", "a", None if whole else PAST), _side(b, "j", "b", None if whole else HELD)
    return left.join(right.hint("shuffle_replicate_nl"), met)


def share_visited(vectors: DataFrame, within: float, rows: int | None = None) -> float:
    """The share of all pairs of blocks that a search for pairs up to a distance meets."""
    packed = settled(blocks(vectors, rows, near=True)[0], "blocks")
    n = packed.count()
    balls = packed.select("block", "ids", "centre", "radius")
    return crossed(balls, balls, _near(within) & (F.col("i") <= F.col("j"))).count() / max(1, n * (n + 1) // 2)


def block_strips(vectors: DataFrame, strip: Strip, result: str, ordered: bool = False, rows: int | None = None, group: str | None = None, other: DataFrame | None = None, within: float | None = None, extra: int = 0, packed: DataFrame | None = None) -> DataFrame:
    """Rows of strip(ids_a, groups_a, a, others): a block, and (ids_b, groups_b, b) of the blocks that its task has for it.

    Unordered: every pair of blocks once, a block with itself included.  Ordered: both ways.  With `other`, blocks of
    vectors against blocks of other.  within: pairs at a larger euclidean distance need not be seen.
    extra: so many entries at the end of the vectors of `other` are no coordinates.  packed: settled blocks of vectors,
    which may say in `reach` how far each needs to see.
    """
    ship(vectors.sparkSession)
    given = packed is not None
    packed, count = (packed, 2) if given else blocks(vectors, rows, group, near=within is not None)
    packed_b, count_b = (packed, count) if other is None else blocks(other, rows, group, near=within is not None, extra=extra)
    whole = max(count, count_b) == 1
    if not whole:
        packed = packed if given else settled(packed, "blocks")
        packed_b = packed if other is None else settled(packed_b, "blocks")
    met = F.lit(True)
    if not whole and (within is not None or "reach" in packed.columns):
        met &= _near(within)
    if not ordered and other is None:
        met &= F.col("i") <= F.col("j")
    return worked(crossed(packed, packed_b, met, whole), strip, result)


def block_pairs(vectors: DataFrame, use: Callable[..., Iterator[dict]], result: str, **how) -> DataFrame:
    """Rows of use(ids_a, groups_a, a, ids_b, groups_b, b) over pairs of blocks; how: as of block_strips()."""

    def strip(ids_a, ga, x, others):
        for ids_b, gb, y in others:
            yield from use(ids_a, ga, x, ids_b, gb, y)

    return block_strips(vectors, strip, result, **how)


def in_blocks(packed: DataFrame, use: Callable[..., Iterator[dict]], result: str) -> DataFrame:
    """Rows of use() over every block with itself."""
    alone = packed.select(F.col("block").alias("i"), *[F.col(f).alias(f"{f}_{s}") for s in "ab" for f in ("ids", "groups", "data")])

    def strip(ids_a, ga, x, others):
        for ids_b, gb, y in others:
            yield from use(ids_a, ga, x, ids_b, gb, y)

    return worked(alone, strip, result)


def worked(work: DataFrame, strip: Strip, result: str) -> DataFrame:
    """Rows of strip() over crossed blocks."""
    schema = work.sparkSession.createDataFrame([], result).schema
    fields = ("ids", "groups", "data")

    def block(raw: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, groups = (np.frombuffer(r.as_buffer(), dtype="<i8") for r in raw[:2])
        return ids, groups, np.frombuffer(raw[2].as_buffer(), dtype="<f8").reshape(len(ids), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        sides = ([batch.column("i"), *(batch.column(f"{f}_{s}") for s in "ab" for f in fields)] for batch in batches)
        rows = (tuple(c[k] for c in columns) for columns in sides for k in range(len(columns[0])))
        for _, pairs in groupby(rows, key=lambda r: r[0].as_py()):
            first = next(pairs)
            others = (block(r[4:]) for r in chain((first,), pairs))
            for columns in strip(*block(first[1:4]), others):
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in kinds], schema=kinds)

    return work.select("i", *[f"{f}_{s}" for s in "ab" for f in fields]).mapInArrow(run, result)


def _unordered(ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
    """Mask of the pairs of two blocks that stand for unordered pairs: each once."""
    return (ids_a[:, None] < ids_b[None, :]) if np.array_equal(ids_a, ids_b) else np.ones((len(ids_a), len(ids_b)), dtype=bool)


def chord(cosine_distance: float) -> float:
    """The euclidean distance of unit vectors at a cosine distance."""
    return float(np.sqrt(2.0 * max(cosine_distance, 0.0)))


def pairs_within(vectors: DataFrame, limit: float, euclidean: bool = True) -> DataFrame:
    """a < b, d of all pairs of unit vectors at distance at most `limit`."""

    def use(ids_a, _ga, x, ids_b, _gb, y):
        d = 1.0 - x @ y.T
        if euclidean:
            d = np.sqrt(2.0 * np.maximum(d, 0.0))
        i, j = np.nonzero((d <= limit) & _unordered(ids_a, ids_b))
        lo, hi = np.minimum(ids_a[i], ids_b[j]), np.maximum(ids_a[i], ids_b[j])
        yield {"a": lo, "b": hi, "d": d[i, j]}

    return block_pairs(vectors, use, "a long, b long, d double", within=float(limit) if euclidean else chord(limit))


def closest_pairs(vectors: DataFrame, k: int) -> DataFrame:
    """a < b, d of the k closest pairs by cosine distance."""

    def use(ids_a, _ga, x, ids_b, _gb, y):
        d = 1.0 - x @ y.T
        i, j = np.nonzero(_unordered(ids_a, ids_b))
        d = d[i, j]
        lo, hi = np.minimum(ids_a[i], ids_b[j]), np.maximum(ids_a[i], ids_b[j])
        top = np.lexsort((hi, lo, d))[:k] if len(d) <= 4 * k else _smallest(d, lo, hi, k)
        yield {"a": lo[top], "b": hi[top], "d": d[top]}

    return block_pairs(vectors, use, "a long, b long, d double").orderBy("d", "a", "b").limit(k)


def _smallest(d: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> np.ndarray:
    near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
    return near[np.lexsort((hi[near], lo[near], d[near]))[:k]]


def neighbours(vectors: DataFrame, k: int, euclidean: bool = True, rows: int | None = None) -> DataFrame:
    """face_id, rank, neighbour, d: the k nearest others of every unit vector.

    A block is first held against itself; the largest k-th distance that its vectors find there is how far neighbours of
    the block can be, and no block beyond that is met.
    """

    def distances(ids_a, x, ids_b, y):
        d = 1.0 - x @ y.T
        if euclidean:
            d = np.sqrt(2.0 * np.maximum(d, 0.0))
        return np.where(ids_a[:, None] == ids_b[None, :], np.inf, d)

    def strip(ids_a, _ga, x, others):
        """The k nearest that the task has for every vector; equal distances by id."""
        row, near, at = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, float))
        last = np.full(len(ids_a), np.inf)
        for ids_b, _gb, y in others:
            d = distances(ids_a, x, ids_b, y)
            if len(row) < k * len(ids_a) and d.shape[1] > k:
                last = np.minimum(last, np.partition(d, k - 1, axis=1)[:, k - 1])
            i, j = np.nonzero((d <= last[:, None]) & np.isfinite(d))
            if not len(i):
                continue
            row, near, at = np.concatenate((row, i)), np.concatenate((near, ids_b[j])), np.concatenate((at, d[i, j]))
            order = np.lexsort((near, at, row))
            row, near, at = row[order], near[order], at[order]
            start = np.searchsorted(row, np.arange(len(ids_a)))
            kept = np.arange(len(row)) - start[row] < k
            row, near, at = row[kept], near[kept], at[kept]
            n = np.bincount(row, minlength=len(ids_a))
            full = np.flatnonzero(n == k)
            last[full] = at[np.cumsum(n)[full] - 1]
        yield {"face_id": ids_a[row], "neighbour": near, "d": at}

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = []
            for raw_ids, raw in zip(batch.column("ids").to_pylist(), batch.column("data").to_pylist(), strict=True):
                ids = np.frombuffer(raw_ids, dtype="<i8")
                x = np.frombuffer(raw, dtype="<f8").reshape(len(ids), -1)
                d = distances(ids, x, ids, x)
                own = float(np.partition(d, k - 1, axis=1)[:, k - 1].max()) if len(ids) >= k else np.inf
                far.append(own if euclidean or np.isinf(own) else chord(own))
            yield batch.append_column("reach", pa.array(far, type=pa.float64()))

    result = "face_id long, neighbour long, d double"
    ship(vectors.sparkSession)
    packed, count = blocks(vectors, rows, near=True)
    if count > 1:
        packed = settled(settled(packed, "blocks").mapInArrow(reach, f"{PACKED}, reach double"), "reaches")
    found = block_strips(vectors, strip, result, ordered=True, rows=rows, packed=packed if count > 1 else None)
    w = Window.partitionBy("face_id").orderBy("d", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("face_id", "rank", "neighbour", "d")


def pair_histogram(vectors: DataFrame, group: str, digits: int) -> DataFrame:
    """bucket, is_diff, n: all unordered pairs by rounded-down cosine distance and by whether their groups differ."""
    scale = 10**digits

    def use(ids_a, ga, x, ids_b, gb, y):
        d = 1.0 - x @ y.T
        i, j = np.nonzero(_unordered(ids_a, ids_b))
        key = np.floor(np.round(d[i, j], 9) * scale).astype(np.int64) * 2 + (ga[i] != gb[j])
        u, n = np.unique(key, return_counts=True)
        yield {"bucket": u >> 1, "is_diff": (u & 1).astype(np.int32), "n": n}

    out = block_pairs(vectors, use, "bucket long, is_diff int, n long", group=group)
    return out.groupBy("bucket", "is_diff").agg(F.sum("n").alias("n"))


Span = tuple[float, float]


def edges(span: Span, parts: int) -> np.ndarray:
    """Borders of equal stretches of a span; they are the spans to look into next."""
    out = span[0] + (span[1] - span[0]) * np.arange(parts + 1) / parts
    out[-1] = span[1]
    return out


def _stretch(d: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Number of the stretch that holds each distance, by the borders as they are stored."""
    parts = len(border) - 1
    at = np.clip(((d - border[0]) * (parts / (border[-1] - border[0]))).astype(np.int64), 0, parts - 1)
    at -= d < border[at]
    at += (at < parts - 1) & (d >= border[np.minimum(at + 1, parts)])
    return at


def pair_counts(vectors: DataFrame, group: str, spans: list[Span], parts: int) -> DataFrame:
    """span, part, is_diff, n, total: how many pairs, and the sum of their distances, in each stretch of some spans.

    The pairs stay in the tasks: a block with all that its task has for it returns at most two rows for each stretch.
    """
    borders = [edges(s, parts) for s in spans]

    def strip(ids_a, ga, x, others):
        counts, totals = np.zeros((len(spans), 2 * parts), dtype=np.int64), np.zeros((len(spans), 2 * parts))
        for ids_b, gb, y in others:
            d = 1.0 - x @ y.T
            diff = ga[:, None] != gb[None, :]
            if np.array_equal(ids_a, ids_b):
                free = ids_a[:, None] < ids_b[None, :]
                d, diff = d[free], diff[free]
            d, diff = d.ravel(), diff.ravel()
            for k, border in enumerate(borders):
                within = (d >= border[0]) & (d < border[-1])
                some, differs = (d, diff) if within.all() else (d[within], diff[within])
                key = _stretch(some, border) * 2 + differs
                counts[k] += np.bincount(key, minlength=2 * parts)
                totals[k] += np.bincount(key, weights=some, minlength=2 * parts)
        for k in range(len(spans)):
            u = np.flatnonzero(counts[k])
            yield {"span": np.full(len(u), k, dtype=np.int32), "part": (u >> 1).astype(np.int32), "is_diff": (u & 1).astype(np.int32), "n": counts[k, u], "total": totals[k, u]}

    out = block_strips(vectors, strip, "span int, part int, is_diff int, n long, total double", group=group)
    return out.groupBy("span", "part", "is_diff").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def pairs_in(vectors: DataFrame, group: str, spans: list[Span]) -> DataFrame:
    """span, d, is_diff of the pairs whose distance lies in one of some spans; for spans that are known to hold few."""

    def use(ids_a, ga, x, ids_b, gb, y):
        d = 1.0 - x @ y.T
        free = _unordered(ids_a, ids_b)
        for k, (low, high) in enumerate(spans):
            i, j = np.nonzero(free & (d >= low) & (d < high))
            yield {"span": np.full(len(i), k, dtype=np.int32), "d": d[i, j], "is_diff": (ga[i] != gb[j]).astype(np.int32)}

    return block_pairs(vectors, use, "span int, d double, is_diff int", group=group)


def drawn_pairs(vectors: DataFrame, group: str, count: int, seed: int) -> DataFrame:
    """d, is_diff of `count` pairs drawn by a seeded hash of their ids; about twice as many leave the tasks."""
    n = vectors.count()
    share = min(1.0, 2.0 * count / max(1, n * (n - 1) // 2) + 1e-12)
    limit = min(2**64 - 1, int(share * 2**64))

    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))

    def use(ids_a, ga, x, ids_b, gb, y):
        d = 1.0 - x @ y.T
        lo, hi = (f(ids_a[:, None], ids_b[None, :]).view(np.uint64) for f in (np.minimum, np.maximum))
        draw = mixed(mixed(lo + np.uint64(seed)) ^ hi)
        i, j = np.nonzero(_unordered(ids_a, ids_b) & (draw <= np.uint64(limit)))
        yield {"draw": draw[i, j].view(np.int64) ^ np.int64(-(2**63)), "a": lo[i, j].view(np.int64), "b": hi[i, j].view(np.int64), "d": d[i, j], "is_diff": (ga[i] != gb[j]).astype(np.int32)}

    found = block_pairs(vectors, use, "draw long, a long, b long, d double, is_diff int", group=group)
    return found.orderBy("draw", "a", "b").limit(count).select("d", "is_diff")


def group_minima(vectors: DataFrame, group: str, limit: float = np.inf) -> DataFrame:
    """ga < gb, d: the smallest cosine distance between members of two groups, where it is below a limit."""

    def use(_ia, ga, x, _ib, gb, y):
        d = 1.0 - x @ y.T
        ua, sa = np.unique(ga, return_inverse=True)
        ub, sb = np.unique(gb, return_inverse=True)
        starts = lambda g, n: np.searchsorted(np.sort(g), np.arange(n))
        best = np.minimum.reduceat(d[:, np.argsort(sb, kind="stable")], starts(sb, len(ub)), axis=1)
        best = np.minimum.reduceat(best[np.argsort(sa, kind="stable")], starts(sa, len(ua)), axis=0)
        i, j = np.nonzero((ua[:, None] != ub[None, :]) & (best < limit))
        yield {"ga": np.minimum(ua[i], ub[j]), "gb": np.maximum(ua[i], ub[j]), "d": best[i, j]}

    out = block_pairs(vectors, use, "ga long, gb long, d double", group=group, within=None if np.isinf(limit) else chord(limit))
    return out.groupBy("ga", "gb").agg(F.min("d").alias("d"))


def minima_of(pairs: DataFrame, vectors: DataFrame, group: str, rows: int | None = None) -> DataFrame:
    """ga, gb, d: the smallest cosine distance between members, for the groups that pairs(ga, gb) names only.

    Groups are packed into blocks of their own, so a pair of large groups is many rows of work.
    """
    sizes = vectors.groupBy(F.col(group).cast("long").alias("group")).agg(F.ceil(F.count(F.lit(1)) / (rows or BLOCK_ROWS)).alias("pieces"))
    dealt = vectors.select(F.col(group).cast("long").alias("group"), "face_id", F.col("vector").alias("v")).join(sizes, "group").withColumn("piece", F.pmod(F.xxhash64("face_id"), "pieces"))
    packed = dealt.groupBy("group", "piece").agg(F.flatten(F.collect_list("v")).alias("data"), F.count(F.lit(1)).cast("int").alias("n"))
    partners = pairs.groupBy(F.col("ga").alias("group")).agg(F.collect_set("gb").alias("partners"))
    packed = settled(packed.join(partners, "group", "left"), "groups")
    bytes_ = packed.agg(F.sum(F.size("data")) * 8).head()[0] or 0
    part = lambda side, name, held: side.select(F.col("group").alias(name), F.col("data").alias(f"data_{name}"), F.col("n").alias(f"n_{name}"), *["partners"] * (name == "ga")).repartition(max(1, -(-bytes_ // held[0]), min(held[1], bytes_ >> 20)))
    a = part(packed.where("partners IS NOT NULL"), "ga", PAST)
    work = a.join(part(packed, "gb", HELD).hint("shuffle_replicate_nl"), F.array_contains("partners", F.col("gb"))).drop("partners")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = []
            for k in range(batch.num_rows):
                x, y = (batch.column(f"data_{g}")[k].values.to_numpy().reshape(batch.column(f"n_{g}")[k].as_py(), -1) for g in ("ga", "gb"))
                best.append(float((1.0 - x @ y.T).min()))
            yield pa.RecordBatch.from_arrays([batch.column("ga"), batch.column("gb"), pa.array(best, type=pa.float64())], names=["ga", "gb", "d"])

    return work.mapInArrow(run, "ga long, gb long, d double").groupBy("ga", "gb").agg(F.min("d").alias("d"))


def group_sums(vectors: DataFrame, group: str) -> DataFrame:
    """face_id, grp, total, n: for every vector the sum of euclidean distances to the members of each group, itself out."""

    def strip(ids_a, _ga, x, others):
        found: dict[int, np.ndarray] = {}  # by group: sums and counts of every vector

        def rows():
            for g, (total, n) in found.items():
                yield {"face_id": ids_a, "grp": np.full(len(ids_a), g), "total": total, "n": n.astype(np.int64)}
            found.clear()

        for ids_b, gb, y in others:
            d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0))
            other = ids_a[:, None] != ids_b[None, :]
            groups, place = np.unique(gb, return_inverse=True)
            member = (place[:, None] == np.arange(len(groups))[None, :]).astype(float)
            total, n = (d * other) @ member, member.sum(0) - (~other) @ member
            for k, g in enumerate(groups.tolist()):
                so_far = found.get(g)
                found[g] = np.stack((total[:, k], n[:, k])) if so_far is None else so_far + np.stack((total[:, k], n[:, k]))
            if len(found) > GROUPS:
                yield from rows()
        yield from rows()

    out = block_strips(vectors, strip, "face_id long, grp long, total double, n long", ordered=True, group=group)
    return out.groupBy("face_id", "grp").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
