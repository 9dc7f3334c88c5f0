"""Packing of tokenised documents into fixed windows by best-fit decreasing.

Overlong documents are first cut into full windows, which need no search.  The remainders go to groups of a fixed size
by a hash of doc_id; each group sorts them by length and puts each into the tightest open window, found in a segment
tree over remaining capacity.  A group leaves about one window part-filled, so padding does not depend on how many
groups there are, and no task holds more than a group.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm._common import partitions, ship, written
from vecloom.llm._tokens import encoder

TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_BITS = 40


class CapacityTree:
    """Open windows by remaining capacity; finds the smallest capacity that is large enough in O(log capacity)."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, window) -> None:
        self.open[left].append(window)
        i = left + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int):
        """(remaining capacity, window) of the tightest open window with at least `need` left, or None."""
        count, i = self.count, need + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up, until a right neighbour holds something
                i >>= 1
            if i == 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        left = i - self.leaves
        while i:
            count[i] -= 1
            i >>= 1
        return left, self.open[left].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(window, offset in it) of each item, and the number of windows; items are at most `capacity` long."""
    window, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    tree, n = CapacityTree(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        found = tree.take(need)
        if found is None:
            left, w, n = capacity, n, n + 1
        else:
            left, w = found
        window[i], offset[i] = w, capacity - left
        if left > need:
            tree.add(left - need, w)
    return window, offset, n


def _cut(capacity: int, tokenizer: str, end_id: int, with_ids: bool, job: str = ""):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer, job)
        for batch in batches:
            for lo, hi, data, offs in T.chunks(batch, "text"):
                ids, border = known.encode(data, offs)
                ids = np.insert(ids.astype("<u4"), border[1:], end_id)
                border = border + np.arange(hi - lo + 1)
                tokens = np.diff(border)
                pieces = -(-tokens // capacity)
                doc = np.repeat(np.arange(hi - lo), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, tokens[doc] - start)
                at = border[:-1][doc] + start
                raw = [ids[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                cols = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in raw], type=pa.int64()), pa.array(tokens[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols, names = [*cols, pa.array(raw, type=pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def _place(capacity: int):
    def group(key: int, rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        length = t.column("length").to_numpy()
        window, offset = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        rest = np.flatnonzero(length < capacity)
        window[rest], offset[rest], n = best_fit_decreasing(length[rest], capacity)
        full = np.flatnonzero(length >= capacity)
        window[full] = n + np.arange(len(full))
        window += key << SEQUENCE_BITS
        out = t.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(window)).append_column("offset", pa.array(offset))
        yield from out.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            keys = batch.column("pack_group").to_numpy()
            for s in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if not len(s):
                    continue
                if held and keys[s[0]] != now:
                    yield from group(int(now), held)
                    held = []
                now = keys[s[0]]
                held.append(batch.slice(s[0], len(s)))
        if held:
            yield from group(int(now), held)

    return run


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str = TOKENIZER, end_id: int = 0, group_pieces: int = 20_000, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, [ids,] sequence_id, offset.

    A document is its token ids followed by `end_id`.  ids holds them as little-endian unsigned 32-bit numbers.
    The pieces of a sequence lie side by side from offset 0; what is missing to `capacity` is padding.

    Defined cases: null and empty texts are one token, `end_id`.  Rows with a null or repeated doc_id are packed like
    all others, row by row.  An empty table gives no rows.  Other columns of docs are ignored, whatever their names.
    The pieces are written once, so that a lost executor cannot see another grouping.  Their places in that table are part
    of what deals them to groups, so rows that share a doc_id, or are equal throughout, spread like all others.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(texts.mapInArrow(_cut(capacity, tokenizer, end_id, with_ids, uuid.uuid4().hex), kinds), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))
    keyed = pieces.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    dealt = keyed.repartition(min(groups, 4 * partitions(spark)), "pack_group").sortWithinPartitions("pack_group", "doc_id", "start", "ids_crc32")
    return dealt.mapInArrow(_place(capacity), f"{kinds}, sequence_id long, offset long")
