"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Rows lie in blocks.  The number of rows that each block sends to each shard is drawn from the multivariate
hypergeometric law, so the matrix has exactly the law that a uniform shuffle would give it, and every shard has exactly
its size.  Each block orders its rows at random and deals them out by its row of the matrix; each shard orders what it
received at random again.  Only block counts, the matrix and shard counts come to the driver: blocks x shards numbers.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm._common import partitions, written

NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` draws without replacement are good.

    NumPy's generator covers populations below 10**9; above, ratio of uniforms with log-gamma probabilities.
    """
    total = good + bad
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(sample, good)
    if low == high:
        return low
    mean = sample * good / total
    var = mean * (bad / total) * ((total - sample) / (total - 1))

    def weight(k: int) -> float:
        return -(math.lgamma(k + 1) + math.lgamma(good - k + 1) + math.lgamma(sample - k + 1) + math.lgamma(bad - sample + k + 1))

    peak = weight(min(high, max(low, (sample + 1) * (good + 1) // (total + 2))))
    width = 1.7155277699214135 * math.sqrt(var + 0.5) + 0.8989161620588988
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= weight(k) - peak:
            return k


def communication_matrix(rng: np.random.Generator, blocks: list[int], shards: list[int]) -> np.ndarray:
    """Random matrix with row sums `blocks` and column sums `shards`: the law of a uniform shuffle."""
    left = list(shards)
    out = np.zeros((len(blocks), len(shards)), dtype=np.int64)
    for i, rows in enumerate(blocks):
        rest = sum(left)
        for j in range(len(shards)):
            if not rows:
                break
            rest -= left[j]
            out[i, j] = hypergeometric(rng, left[j], rest, rows) if rest else rows
            rows -= int(out[i, j])
            left[j] -= int(out[i, j])
    return out


def _order(salt: str, seed: int, keys: list[str]) -> Column:
    return F.xxhash64(F.lit(f"{salt}/{seed}"), *keys)


def shard(docs: DataFrame, shards: int = 16, seed: int = 11, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard [, columns named in carry] of each row of docs(doc_id, text).

    Law `rows`: shard sizes differ by one row at most; which shards hold the extra rows is drawn too.  slot numbers a
    shard from 0 without gaps in random order.  The result is a function of the rows and the seed.

    Defined cases: null text has size 1 and the checksum of the empty text; null and repeated doc_ids are rows like all
    others (rows equal in doc_id and text may swap places, which cannot be told apart).  An empty table gives no rows.
    Columns not named in carry are ignored; grown_shard is null under this law.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *carry)
    blocks = partitions(spark)
    keys = ["doc_id", "text_crc32", "size"]
    rows = written(rows.withColumn("block", F.pmod(_order("block", seed, keys), F.lit(blocks)).cast("int")), "shard-rows")
    counts = {r["block"]: r["n"] for r in rows.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, rng = sum(counts.values()), np.random.default_rng(seed)
    extra = set(rng.permutation(shards)[: total % shards].tolist())
    sizes = [total // shards + (j in extra) for j in range(shards)]
    order = sorted(counts)
    matrix = communication_matrix(rng, [counts[b] for b in order], sizes)
    upto = [(b, [int(x) for x in np.cumsum(m)]) for b, m in zip(order, matrix, strict=True)]
    borders = spark.createDataFrame(upto, "block int, upto array<long>")

    local = Window.partitionBy("block").orderBy(_order("local", seed, keys), *keys)
    dealt = rows.withColumn("at", F.row_number().over(local)).join(borders, "block")
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda x: x < F.col("at")))).drop("upto", "at", "block")
    cells = max(1, -(-blocks // shards))
    final = _order("final", seed, keys)
    cell = F.floor((F.shiftrightunsigned(final, 33)) * F.lit(cells) / F.lit(1 << 31)).cast("int")
    dealt = written(dealt.withColumn("cell", cell), "shard-dealt")
    starts, at = [], dict.fromkeys(range(shards), 0)
    for r in sorted(dealt.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n")).collect()):
        starts.append((r["shard"], r["cell"], at[r["shard"]]))
        at[r["shard"]] += r["n"]
    offsets = spark.createDataFrame(starts, "shard int, cell int, skip long")
    again = Window.partitionBy("shard", "cell").orderBy(F.shiftrightunsigned(final, 33), final, *keys)
    out = dealt.withColumn("n", F.row_number().over(again)).join(offsets, ["shard", "cell"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("skip") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry)
