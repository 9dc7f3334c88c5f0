"""Near duplicates by min-max hashing.

Each text is its set of distinct word shingles.  One multiplication per permutation gives two signature values, the
minimum and the maximum of the permuted set, so `permutations` evaluations make 2 * permutations values; both agree
between two sets with the probability of their Jaccard similarity.  Bands of consecutive values are bucketed.

Minimum and maximum of few shingles depend on each other, so sets of up to `SMALL_SET` shingles also have their first
shingles in hash order as keys, as many as a similar set cannot avoid all of: among them no link is missed.

Nothing lists all pairs of a bucket.  Equal sets fold into one representative first.  In every bucket each member is
compared with one centre, and verified links are contracted to components.  Buckets that still hold several components
are dealt into cells by size class and, where many are of one class, by hash; cells of sizes that can be similar meet,
each two in a key of their own, so no bucket is one task's work.  Across components pairs are emitted under a bound that
is exact in one direction: a bitmap of each set shows how many shingles at least are missing from the other.  Links are
confirmed on full shingle sets in the JVM (array_intersect), and components come from alternating large-star /
small-star rounds whose tables lie in the shared folder.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm._common import ship, written
from vecloom.operators.graph import components

BITMAP_BITS = 10
BITMAP_LONGS = (1 << BITMAP_BITS) // 64
SMALL_SET = 26  # shingles; sets of up to three quarters of it are similar to none larger
SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>"


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi, data, offs in T.chunks(batch, "text"):
        w = T.Words(data, offs, lower=True)
        h, first = T.shingle_sets(w.hashes(), w.first, words)
        yield lo, hi, h, first


def _signer(words: int, percent: int, permutations: int, rows: int, seed: int):
    factors = T._split_mix(permutations, seed) | np.uint64(1)
    weights = T._split_mix(2 * permutations, seed + 1) | np.uint64(1)
    bands = 2 * permutations // rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, h, first in _sets(batch, words):
                n = hi - lo
                size = np.diff(first)
                full = np.flatnonzero(size)
                h1, h2 = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
                keys, border = np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int32)
                if len(full):
                    at = first[full]
                    h1[full] = np.add.reduceat(T.mix(h), at)
                    h2[full] = np.add.reduceat(T.mix(h ^ np.uint64(0x8EBC6AF09C88C6E3)), at)
                    sig = np.empty((len(full), 2 * permutations), dtype=np.uint64)
                    for k in range(permutations):
                        x = h * factors[k]
                        sig[:, 2 * k] = np.minimum.reduceat(x, at)
                        sig[:, 2 * k + 1] = np.maximum.reduceat(x, at)
                    keys = T.mix(sig) * weights
                    keys = keys[:, : bands * rows].reshape(len(full), bands, rows).sum(axis=2, dtype=np.uint64)
                    keys = T.mix(keys + np.arange(bands, dtype=np.uint64)).reshape(-1)
                    # The first shingles of small sets, in hash order.
                    first_few = np.where((size > 0) & (size <= SMALL_SET), size - (percent * size + 99) // 100 + 1, 0)
                    place = np.arange(len(h)) - np.repeat(first[:-1], size)
                    early = place < np.repeat(first_few, size)
                    doc = np.concatenate((np.repeat(full, bands), np.repeat(np.arange(n), size)[early]))
                    order = np.argsort(doc, kind="stable")
                    keys = np.concatenate((keys, T.mix(h[early] ^ np.uint64(0x71EF))))[order]
                    border = np.searchsorted(doc[order], np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, n),
                        pa.array(size.astype(np.int64)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(border), pa.array(keys.view(np.int64))),
                    ],
                    names=["doc_id", "n_shingles", "h1", "h2", "bands"],
                )

    return sign


def signatures(docs: DataFrame, words: int = 5, percent: int = 75, permutations: int = 64, rows: int = 4, seed: int = 17) -> DataFrame:
    """One row per document: set size, a 128-bit hash of the set, and its band keys (none for an empty set)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signer(words, percent, permutations, rows, seed), SIGNATURE
    )


def shingle_lists(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, its sorted distinct shingle hashes, and a bitmap of them: bit `top ten bits` of each is set."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, h, first in _sets(batch, words):
                n = hi - lo
                bits = np.zeros((n, BITMAP_LONGS), dtype=np.uint64)
                doc, top = np.repeat(np.arange(n), np.diff(first)), h >> np.uint64(64 - BITMAP_BITS)
                np.bitwise_or.at(bits, (doc, (top >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (top & np.uint64(63)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64))),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BITMAP_LONGS), pa.array(bits.reshape(-1).view(np.int64))),
                    ],
                    names=["doc_id", "shingles", "bits"],
                )

    return docs.select("doc_id", "text").mapInArrow(lists, "doc_id long, shingles array<long>, bits array<long>")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, permutations: int = 64, rows: int = 4, seed: int = 17, cell_rows: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text, ...).

    Two documents are linked when 100 * |A and B| >= percent * |A or B| for their distinct `words`-word shingles
    (A-Z lowered; shorter texts are one shingle).  component_id is the smallest doc_id reachable over links.

    Defined cases: null or wordless text: n_shingles 0, linked with nothing, kept.  A null doc_id cannot be named by
    others: component_id is null and the row is kept.  Rows that repeat a doc_id each get a row and count as one node.
    Other columns of docs are ignored, whatever their names.  A similarity of 0.75 between sets of
    more than 19 shingles is missed by all bands with probability below 1e-5 at the default 64 permutations and 4 rows;
    between smaller sets none is missed.
    """
    ship(docs.sparkSession)
    sig = written(signatures(docs, words, percent, permutations, rows, seed), "sig")
    full = sig.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    key = ["h1", "h2", "n_shingles"]
    classes = written(full.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    reps = full.withColumnRenamed("doc_id", "rep").join(classes, [*key, "rep"]).select("rep", "n_shingles", "bands", "h1", "h2").dropDuplicates(["rep", "h1", "h2"])
    members = written(reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")), "bands")
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("rep").alias("low")).where("c > 1")
    shared = written(members.join(shared, "key").select("key", "rep", "n", "low"), "buckets")

    wanted = shared.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = written(shingle_lists(texts.join(wanted, "doc_id", "left_semi"), words), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Of pairs(a, b), those whose sets are similar enough."""
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
        hit = (100 * small >= percent * large) & (100 * both >= percent * (F.size("sa") + F.size("sb") - both))
        return written(pairs.join(a, "a").join(b, "b").where(hit).select("a", "b"), name)

    star = shared.where("rep != low").groupBy("rep", "low").agg(F.count(F.lit(1)).alias("c")).select(F.col("rep").alias("a"), F.col("low").alias("b"))
    links = verified(star, "links")
    label = components(links, small=0)

    # Buckets that hold more than one component: pairs across components, as far as the bitmaps leave them possible.
    # Every bit of a that b lacks stands for at least one shingle of a that b lacks.
    rows_ = shared.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    several = rows_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
    bits = sets.select(F.col("doc_id").alias("rep"), *[F.col("bits")[i].alias(f"w{i}") for i in range(BITMAP_LONGS)])
    rest = rows_.join(several, "key", "left_semi").withColumn("size", F.floor(F.log("n") / (math.log(100 / percent) or 1.0) + 1e-9))
    cells = rest.groupBy("key", "size").agg(F.ceil(F.count(F.lit(1)) / cell_rows).alias("cells"))
    rest = rest.join(cells, ["key", "size"]).withColumn("cell", F.pmod(F.xxhash64("rep"), "cells"))
    above = cells.select("key", (F.col("size") - 1).alias("size"), F.col("cells").alias("more"))
    below = cells.select("key", (F.col("size") + 1).alias("size"), F.col("cells").alias("less"))
    rest = written(rest.join(above, ["key", "size"], "left").join(below, ["key", "size"], "left").join(bits, "rep"), "mixed")
    # Cells of one size class meet themselves and later ones, and all cells of the next class.
    size, cell, zero = F.col("size"), F.col("cell"), F.lit(0).cast("long")
    none = F.array().cast("array<struct<size:bigint,x:bigint,y:bigint>>")

    def meet(size: Column, x: Column, y: Column) -> Column:
        return F.struct(size.alias("size"), x.alias("x"), y.alias("y"))

    def over(low: Column, high: Column, f) -> Column:
        return F.when(high.isNotNull(), F.transform(F.sequence(low, high), f)).otherwise(none)

    def side(same: Column, other: Column, v: str) -> DataFrame:
        rows = rest.withColumn("meet", F.explode(F.concat(same, other)))
        return rows.select("key", "meet", *[F.col(c).alias(f"{c}_{v}") for c in ("rep", "n", "comp", *(f"w{i}" for i in range(BITMAP_LONGS)))])

    x = side(over(cell, F.col("cells") - 1, lambda c: meet(size, cell, c)), over(zero, F.col("more") - 1, lambda c: meet(size, -1 - cell, c)), "a")
    y = side(over(zero, cell, lambda c: meet(size, c, cell)), over(zero, F.col("less") - 1, lambda c: meet(size - 1, -1 - c, cell)), "b")

    def common(v: str, u: str) -> Column:
        """Shingles of v that u can have at most."""
        lacking = [F.bit_count(F.col(f"w{i}_{v}").bitwiseAND(F.bitwise_not(F.col(f"w{i}_{u}")))) for i in range(BITMAP_LONGS)]
        return F.col(f"n_{v}") - reduce(operator.add, lacking)

    most = F.least(common("a", "b"), common("b", "a"))
    # Within one cell each pair meets twice, elsewhere once.
    once = (x["meet"]["x"] != x["meet"]["y"]) | (F.col("rep_a") > F.col("rep_b"))
    fits = once & (F.col("comp_a") != F.col("comp_b")) & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & ((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b")))
    pairs = x.join(y, (x["key"] == y["key"]) & (x["meet"] == y["meet"]) & fits).select(F.greatest("rep_a", "rep_b").alias("a"), F.least("rep_a", "rep_b").alias("b")).distinct()
    across = verified(pairs, "links")
    # The new links join components: contract them, and let the members follow.
    to = label.select("node", "component")
    bridge = across.join(to.toDF("a", "ca"), "a", "left").join(to.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    joined = components(bridge, small=0)  # roots are no nodes of label, so the two halves of old do not overlap
    old = label.select(F.col("node").alias("rep"), F.col("component").alias("via")).unionByName(joined.select(F.col("node").alias("rep"), F.col("node").alias("via")))
    label = old.join(joined.select(F.col("node").alias("via"), "component"), "via", "left").select(F.col("rep").alias("node"), F.coalesce("component", "via").alias("component"))

    out = sig.join(classes, key, "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
