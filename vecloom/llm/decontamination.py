"""Benchmark decontamination: rare gapped word pairs as seeds, then Smith-Waterman alignment.

Two passes over the documents.  Seeds are pairs of words one or two apart in an item that stand one or two apart in a
text.  An alignment of m words with edits that cost e has m - 1 steps from one matched word to the next, and a step
that is no seed costs 2 at least; so 2m - e points need at least half the points less one seeds, whatever the edits.

The first pass counts how often each seed of the benchmark occurs in the corpus, which is all that leaves its tasks.
Of the seeds that an alignment needs, `need` at different words of the item, half may be missing: so the `need` // 2
words of an item whose seeds are most common give no seeds, and stretches that hold the rest of the need in rare seeds
are aligned.  Common words cost nothing, and the bound loses nothing that the alignment accepts.

The benchmark is read in parts of at most `part_bytes`; each part is two passes, and comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm._common import ship

RESULT = "doc_id long, row_hash long, item_id long, score double"
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[48:58] = _SEPARATOR[65:91] = _SEPARATOR[97:123] = False
_SEPARATOR[128:] = False


def _words(data: np.ndarray, offs: np.ndarray) -> T.Words:
    """Lower-cased runs of letters, digits and non-ASCII characters: punctuation does not hide a copy."""
    return T.Words(T.lowered(data), offs, separator=_SEPARATOR)


def _pairs(words: np.ndarray, gap: int) -> np.ndarray:
    """Hash of each word and the one `gap` places after it."""
    return T.mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) ^ T.mix(words[gap:])) if len(words) > gap else np.zeros(0, dtype=np.uint64)


class Items:
    """Word hashes of a part of the benchmark and the seeds that lead to them; items of equal words are one."""

    def __init__(self, rows: list[tuple[int, str]], n: int, threshold: float, overlap: int):
        raw = [t.encode() for _, t in rows]
        offs = np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
        w = _words(np.frombuffer(b"".join(raw), dtype=np.uint8), offs)
        h, same = w.hashes(), {}
        for (i, _), a, b in zip(rows, w.first[:-1], w.first[1:], strict=True):
            same.setdefault(h[a:b].tobytes(), []).append(i)
        self.ids = list(same.values())
        self.words = [np.frombuffer(x, dtype=np.uint64) for x in same]
        self.n = n
        self.size = size = np.array([len(x) for x in self.words], dtype=np.int64)
        self.short = sorted({int(x) for x in size if 0 < x < n})
        self.points = np.minimum(np.ceil(2 * size * threshold), 2 * overlap)
        self.need = np.where(size < n, 1, np.maximum(np.ceil(self.points / 2) - 1, 1)).astype(np.int64)
        seeds, items, at = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, x in enumerate(self.words):
            for g in (_pairs(x, 1), _pairs(x, 2)) if len(x) >= n else (whole(x),):
                seeds.append(g)
                items.append(np.full(len(g), i))
                at.append(np.arange(len(g)))
        self._index(*(np.concatenate(x) for x in (seeds, items, at)))

    def _index(self, seed: np.ndarray, item: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(seed, kind="stable")
        seed = seed[order]
        self.posting_item, self.posting_at = item[order].astype(np.int64), at[order].astype(np.int64)
        self.seeds, first = np.unique(seed, return_index=True)
        self.border = np.append(first, len(seed))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[(self.seeds >> np.uint64(44)).astype(np.int64)] = True

    def keep_rare(self, counts: np.ndarray) -> None:
        """Drops the half of each item's need at the words whose seeds the corpus has most often."""
        seed = np.repeat(np.arange(len(self.seeds)), np.diff(self.border))
        start = np.concatenate(([0], np.cumsum(np.maximum(self.size, 1))))
        place = start[self.posting_item] + self.posting_at
        cost = np.bincount(place, weights=counts[seed], minlength=start[-1])
        item = np.repeat(np.arange(len(self.size)), np.diff(start))
        order = np.lexsort((-cost, item))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        drop = self.need // 2
        kept = rank[place] - start[self.posting_item] >= drop[self.posting_item]
        self.need = self.need - drop
        self._index(self.seeds[seed[kept]], self.posting_item[kept], self.posting_at[kept])

    def found(self, w: T.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the texts and number of each seed that a text holds."""
        place, seed = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for reach, g in ((1, _pairs(h, 1)), (2, _pairs(h, 2)), *((k - 1, T.gram_hashes(h, k)) for k in self.short)):
            p = np.flatnonzero(self.filter[(g >> np.uint64(44)).astype(np.int64)])
            p = p[w.doc[p] == w.doc[p + reach]]
            s = np.minimum(np.searchsorted(self.seeds, g[p]), len(self.seeds) - 1)
            same = self.seeds[s] == g[p]
            place.append(p[same])
            seed.append(s[same])
        return np.concatenate(place), np.concatenate(seed)


def whole(words: np.ndarray) -> np.ndarray:
    """The only seed of an item of fewer than n words: all of it."""
    return T.gram_hashes(words, len(words)) if len(words) else np.zeros(0, dtype=np.uint64)


def smith_waterman(a: np.ndarray, b: np.ndarray, match: int = 2, mismatch: int = 1, gap: int = 1) -> int:
    """Best local alignment score of two word sequences; a row of the matrix at a time."""
    step = gap * np.arange(len(b) + 1)
    row, best = np.zeros(len(b) + 1, dtype=np.int64), 0
    for x in a:
        new = np.zeros(len(b) + 1, dtype=np.int64)
        np.maximum(row[:-1] + np.where(b == x, match, -mismatch), row[1:] - gap, out=new[1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + step) - step
        best = max(best, int(row.max()))
    return best


def _counter(items: Items):
    """(seed, n): how often each seed occurs in the texts of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.seeds), dtype=np.int64)
        for batch in batches:
            for _, _, data, offs in T.chunks(batch, "text"):
                w = _words(data, offs)
                total += np.bincount(items.found(w, w.hashes())[1], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["seed", "n"])

    return run


def _finder(items: Items, threshold: float, overlap: int, slack: float):
    size, points, need = items.size, items.points, items.need
    # An accepted alignment's edits cost at most 2 * size - points: so far may its ends be off a seed's place.
    pad = np.maximum(np.ceil(slack * size), 2 * size - points).astype(np.int64) + 2
    span = 3 * size - points  # words of a text that an accepted alignment reaches over, at most

    def hits(w: T.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in the texts, item and place in the item of each seed that a text holds."""
        place, seed = items.found(w, h)
        many = items.border[seed + 1] - items.border[seed]
        posting = np.repeat(items.border[seed], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.repeat(place, many), items.posting_item[posting], items.posting_at[posting]

    def stretches(w: T.Words, h: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text, item and the words from and to of each stretch with enough seeds."""
        place, item, at = hits(w, h)
        doc = w.doc[place]
        order = np.lexsort((place, item, doc))
        place, item, at, doc = place[order], item[order], at[order], doc[order]
        group = np.ones(len(place), dtype=bool)
        group[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
        fresh = group.copy()
        fresh[1:] |= place[1:] != place[:-1]  # seeds of an alignment start at different words
        u, of = np.flatnonzero(fresh), np.cumsum(group)[fresh]
        last = np.arange(len(u)) + need[item[u]] - 1
        inside = np.minimum(last, len(u) - 1)
        near = np.flatnonzero((last < len(u)) & (of[inside] == of) & (place[u[inside]] - place[u] <= span[item[u]]))
        mark = np.zeros(len(u) + 1, dtype=np.int64)
        np.add.at(mark, near, 1)
        np.add.at(mark, last[near] + 1, -1)
        dense = (np.cumsum(mark[:-1]) > 0)[np.cumsum(fresh) - 1]
        place, item, at, doc = place[dense], item[dense], at[dense], doc[dense]
        lo = np.maximum(w.first[doc], place - at - pad[item])
        hi = np.minimum(w.first[doc + 1], place - at + size[item] + pad[item])
        first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))) if len(doc) else np.zeros(0, dtype=np.int64)
        for a, b in zip(first.tolist(), np.append(first, len(place))[1:].tolist(), strict=True):
            o = a + np.argsort(lo[a:b], kind="stable")
            top = np.maximum.accumulate(hi[o])
            cut = np.flatnonzero(np.concatenate(([True], lo[o][1:] > top[:-1], [True])))
            for c, d in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if len(np.unique(place[o[c:d]])) >= need[item[a]]:
                    yield int(doc[a]), int(item[a]), int(lo[o[c]]), int(top[d - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for first, _, data, offs in T.chunks(batch, "text"):
                w = _words(data, offs)
                h = w.hashes()
                best: dict[tuple[int, int], float] = {}
                for d, i, a, b in stretches(w, h):
                    x, y = items.words[i], h[a:b]
                    if 2 * np.isin(x, y).sum() < points[i]:
                        continue
                    got = smith_waterman(x, y)
                    score = got / (2 * len(x))
                    if score >= threshold or got >= 2 * overlap:
                        best[d, i] = max(score, best.get((d, i), 0.0))
                out += [(first + d, x, s) for (d, i), s in best.items() for x in items.ids[i]]
            take = pa.array([o[0] for o in out], type=pa.int64())
            found = [pa.array([o[1] for o in out], type=pa.int64()), pa.array([o[2] for o in out], type=pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("row_hash").take(take), *found], names=["doc_id", "row_hash", "item_id", "score"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 4, threshold: float = 0.5, overlap: int = 13, slack: float = 0.25, part_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, row_hash, item_id, score: which rows of docs(doc_id, text, ...) hold a copy of which benchmark item.

    score is the alignment score over that of a full copy.  Returned are pairs of at least `threshold`, and pairs that
    align as well as `overlap` equal words do, however long the item.  row_hash is xxhash64(text), so that rows which repeat a doc_id can be told apart.

    Defined cases: null and wordless texts and items match nothing; null doc_ids and item_ids are returned as null;
    items of fewer than `n` words are found whole; items are compared by text, so repeated items give a row each.  Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    parts = -(-size // part_bytes)
    found = None
    for p in range(parts):
        rows = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).orderBy("item_id", "text").collect()
        items = Items([(r["item_id"], r["text"]) for r in rows], n, threshold, overlap)
        if not len(items.seeds):
            continue
        seen = texts.select("text").mapInArrow(_counter(items), "seed int, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(items.seeds))
        counts[seen.column("seed").to_numpy()] = seen.column("n").to_numpy()
        items.keep_rare(counts)
        part = texts.mapInArrow(_finder(items, threshold, overlap, slack), RESULT)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], RESULT)
