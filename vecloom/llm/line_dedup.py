"""Line deduplication by a log-template tree.

A line is parsed to a fixed depth: its token count, then its first tokens.  Tokens with digits are variable fields from
the start.  In a leaf, lines are taken in the order of their hashes: a line joins the first leader with which it agrees
in at least `similarity` of its positions, or becomes a leader.  A template is a leader with the lines that joined it;
positions in which they differ are its variable fields.  Templates that recur in at least `min_docs` documents are
dropped everywhere but in the document with the smallest doc_id.

Lines travel as hashes.  Equal lines fold in each map task; only leaves with several different lines are clustered.
A crowded leaf takes rounds: leaders are found among the first lines of its order, and compared with all its other
lines, block by block; what none of them takes goes on to the next round, which looks at twice as many.  Later leaders
come later in the order, so templates are the same whatever the size of a round, and the rounds grow with the logarithm
of a leaf's lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm._common import partitions, ship, written

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_VARIABLE = np.uint64(0x2A)
LINES = "doc_id long, row_hash long, line int, leaf long, mask long, tokens binary"


def _parser(depth: int, min_tokens: int):
    """One row per line of at least `min_tokens` tokens; tokens only on the first of equal lines of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in T.chunks(batch, "text"):
                w = T.Words(data, offs)
                if not len(w):
                    continue
                h = w.hashes()
                digits = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum(_DIGIT[data], out=digits[1:])
                h[digits[w.end] > digits[w.start]] = _VARIABLE
                feeds = np.flatnonzero(data == 0x0A)
                line = np.searchsorted(feeds, w.start) - np.searchsorted(feeds, offs[:-1])[w.doc]  # within the text
                new = np.ones(len(w), dtype=bool)
                new[1:] = (line[1:] != line[:-1]) | (w.doc[1:] != w.doc[:-1])
                first = np.flatnonzero(new)
                size = np.diff(np.append(first, len(w)))
                keep = size >= min_tokens
                first, size = first[keep], size[keep]
                pw, inv = T.powers(T._Q, len(h))
                s = np.zeros(len(h) + 1, dtype=np.uint64)
                np.cumsum(h * pw[: len(h)], out=s[1:])
                mask = T.mix((s[first + size] - s[first]) * inv[first] ^ size.astype(np.uint64))
                leaf = T.mix((s[first + np.minimum(size, depth)] - s[first]) * inv[first] ^ (size.astype(np.uint64) << np.uint64(32)))
                once = np.zeros(len(first), dtype=bool)
                once[np.unique(mask, return_index=True)[1]] = True
                small = (h >> np.uint64(32)).astype("<u4")
                small[h == _VARIABLE] = 0
                tokens = [small[a : a + n].tobytes() if o else None for a, n, o in zip(first.tolist(), size.tolist(), once.tolist(), strict=True)]
                doc = pa.array(lo + w.doc[first])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(doc), batch.column("row_hash").take(doc), pa.array(line[first].astype(np.int32)), pa.array(leaf.view(np.int64)), pa.array(mask.view(np.int64)), pa.array(tokens, type=pa.binary())],
                    names=["doc_id", "row_hash", "line", "leaf", "mask", "tokens"],
                )

    return run


def _fits(lines: np.ndarray, x: np.ndarray, similarity: float) -> np.ndarray:
    """Which lines agree with a line.  Variable tokens agree with any other."""
    equal = lines == x
    fits = (equal | (lines == 0) | (x == 0)).sum(1) >= similarity * len(x)
    return fits & (equal.sum(1) * 2 >= similarity * len(x))


def _first(leaders: np.ndarray, x: np.ndarray, similarity: float) -> int:
    """Number of the first leader that takes a line, -1 if none does."""
    if not len(leaders):
        return -1
    fits = _fits(leaders, x, similarity)
    at = int(np.argmax(fits))
    return at if fits[at] else -1


def cluster(lines: list[np.ndarray], similarity: float) -> list[int]:
    """Number of the line that leads each line, in order of arrival; all lines have the same number of tokens."""
    leaders, lead, out = np.zeros((16, len(lines[0])), dtype=np.uint32), [], []
    for i, x in enumerate(lines):
        best = _first(leaders[: len(lead)], x, similarity)
        if best < 0:
            if len(lead) == len(leaders):
                leaders = np.vstack((leaders, np.zeros_like(leaders)))
            leaders[len(lead)] = x
            lead.append(i)
        out.append(lead[best])
    return out


def _rows(t: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype="<u4") for x in t.column("tokens").to_pylist()]


def _templates(similarity: float):
    """The leader of each line of a leaf, by its mask."""

    def leaf(t: pa.Table) -> pa.Table:
        t = t.sort_by("mask")
        return t.append_column("template", t.column("mask").take(pa.array(cluster(_rows(t), similarity)))).select(["leaf", "mask", "tokens", "firsts", "deals", "template"])

    return leaf


TAKEN = "leaf long, mask long, tokens binary, firsts long, deals long, template long"
PACKED = "leaf long, block long, firsts long, deals long, masks binary, rows binary"
#: Edges up to which one task picks the leaders among lines that fit each other: 16 bytes each.
SMALL = 200_000


def _pack(t: pa.Table) -> pa.Table:
    """A block of lines of one leaf as one row, in the order of their masks."""
    t = t.sort_by("mask")
    same = ["leaf", "block", "firsts", "deals"]
    cols = [*(t.column(c)[:1] for c in same), pa.array([t.column("mask").to_numpy().astype("<i8").tobytes()]), pa.array([b"".join(t.column("tokens").to_pylist())])]
    return pa.table(cols, names=[*same, "masks", "rows"])


def _packed(lines: DataFrame, width: int) -> DataFrame:
    """Lines by block; how many blocks of first lines and of other lines their leaf has goes with them."""
    return lines.select("leaf", "block", "firsts", "deals", "mask", "tokens").repartition(width, "leaf", "block").groupBy("leaf", "block").applyInArrow(_pack, PACKED)


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every block of a with the blocks of b that `with` names, as one row: masks and rows of both.

    a(leaf, block, with) and b(leaf, block, with) hold the blocks of the other side that each meets, so the pairs of a
    crowded leaf are dealt like those of any other.
    """
    left = a.select("leaf", F.col("block").alias("i"), F.col("masks").alias("masks_a"), F.col("rows").alias("rows_a"), F.explode("with").alias("j"))
    right = b.select("leaf", F.col("block").alias("j"), F.col("masks").alias("masks_b"), F.col("rows").alias("rows_b"), F.explode("with").alias("i"))
    return left.join(right, ["leaf", "i", "j"]).select("leaf", "masks_a", "rows_a", "masks_b", "rows_b")


def _sides(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for r in batch.to_pylist():
        side = []
        for s in "ab":
            masks = np.frombuffer(r[f"masks_{s}"], dtype="<i8")
            side += [masks, np.frombuffer(r[f"rows_{s}"], dtype="<u4").reshape(len(masks), -1)]
        yield (r["leaf"], *side)


def _edges(similarity: float):
    """low < high: the lines of two blocks that fit each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, ma, xa, mb, xb in _sides(batch):
                found = [mb[_fits(xb, x, similarity)] for x in xa]
                one, other = np.repeat(ma, [len(f) for f in found]), np.concatenate(found)
                if np.array_equal(ma, mb):
                    one, other = one[other < one], other[other < one]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, other)), pa.array(np.maximum(one, other))], names=["low", "high"])

    return run


def _matcher(similarity: float):
    """The first leader of a block that takes each line of another, where one does."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for leaf, ma, xa, mb, xb in _sides(batch):
                best = np.array([_first(xb, x, similarity) for x in xa])
                hit = np.flatnonzero(best >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), leaf)), pa.array(ma[hit]), pa.array(mb[best[hit]])], names=["leaf", "mask", "template"])

    return run


def first_leaders(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, its leader) of the lines that are taken, when lines come in order and take all later ones that fit them."""
    order = np.lexsort((low, high))
    taken: dict[int, int] = {}
    for a, b in zip(low[order].tolist(), high[order].tolist(), strict=True):
        if b not in taken and a not in taken:  # all that can take a came before, and so has the lowest that takes b
            taken[b] = a
    return np.array(list(taken), dtype=np.int64), np.array(list(taken.values()), dtype=np.int64)


def _in_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(b.column("low").to_numpy(), b.column("high").to_numpy()) for b in batches]
    if held:
        mask, template = first_leaders(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        yield pa.RecordBatch.from_arrays([pa.array(mask), pa.array(template)], names=["mask", "template"])


def leaders_by_edges(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(mask, template) of the lines that are taken, from written edges(low, high) of lines that fit each other.

    Few edges go to one task.  Above, each round settles all lines that no undecided earlier line fits: they lead, and
    take what fits them.  Orders are random, so the rounds grow with the logarithm of the number of lines.
    """
    if edges.count() <= small:
        return edges.coalesce(1).mapInArrow(_in_one, "mask long, template long")
    left, taken = edges, None
    while not left.isEmpty():
        heads = left.select("low").distinct().join(left.select(F.col("high").alias("low")).distinct(), "low", "left_anti")
        now = written(left.join(heads, "low", "left_semi").select(F.col("high").alias("mask")).distinct(), "taken")
        taken = now if taken is None else taken.unionByName(now)
        for end in ("low", "high"):
            left = left.join(now.select(F.col("mask").alias(end)), end, "left_anti")
        left = written(left.select("low", "high"), "edges")
    free = edges.join(taken.select(F.col("mask").alias("low")), "low", "left_anti")
    return free.groupBy(F.col("high").alias("mask")).agg(F.min("low").alias("template"))


def _numbers(count: str) -> F.Column:
    return F.sequence(F.lit(0).cast("long"), F.col(count) - 1)


def _rounds(rest: DataFrame, similarity: float, leaf_lines: int, leaf_bytes: int) -> list[DataFrame]:
    """(mask, template) of the lines of rest(leaf, mask, tokens), a table for each step.

    The first round finds the leaders among the first `leaf_lines` lines (or `leaf_bytes`) of each leaf, and every round
    twice as many as the one before, so the rounds grow with the logarithm of a leaf's lines, whatever its templates.
    All other lines of the leaf are then compared with the new leaders, block by block; those that are not taken go on.
    A line that no leader of the first s lines takes fits few of the next s, so their edges are few.
    """
    out, width, grow = [], partitions(rest.sparkSession), 1
    while not rest.isEmpty():
        lines = F.least(F.lit(leaf_lines), F.greatest(F.lit(1), F.floor(leaf_bytes / F.max(F.octet_length("tokens"))))).cast("long")
        sizes = rest.groupBy("leaf").agg(F.min("mask").alias("low"), F.count(F.lit(1)).alias("n"), lines.alias("lines"))
        share = F.col("lines") * grow
        # Masks are hashes: of the n above the lowest, about `share` lie in this part of what is above it.
        top = F.col("low") + (float(2**63 - 1) - F.col("low").cast("double")) * share / F.col("n")
        border = F.when(F.col("n") <= share, F.lit(2**63 - 1)).otherwise(F.greatest("low", top.cast("long")))
        crowded = sizes.where("n > lines").select("leaf", border.alias("border"), F.ceil(F.least(share, "n") / F.col("lines")).alias("firsts"), F.when(F.col("n") <= share, F.lit(0)).otherwise(F.ceil(F.col("n") / F.col("lines"))).cast("long").alias("deals"))
        # Leaves of many lines are met in as many places as there are tasks, so that no task reads such a leaf whole.
        spread = F.pmod(F.xxhash64("mask"), F.lit(width)).alias("spread")
        crowded = crowded.withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))))
        dealt = rest.select("*", spread).join(crowded, ["leaf", "spread"], "left")
        dealt = dealt.select("leaf", "mask", "tokens", F.coalesce("border", F.lit(2**63 - 1)).alias("border"), F.coalesce("firsts", F.lit(1)).cast("long").alias("firsts"), F.coalesce("deals", F.lit(0)).cast("long").alias("deals"))
        first, others = dealt.where("mask <= border"), dealt.where("mask > border")

        alone = first.where("firsts = 1").drop("border").repartition(width, "leaf")
        led = written(alone.groupBy("leaf").applyInArrow(_templates(similarity), TAKEN), "leaders")
        if grow > 1:
            many = written(first.where("firsts > 1").drop("border").withColumn("block", F.pmod(F.xxhash64("mask"), "firsts")), "firsts")
            blocks = written(_packed(many, width), "blocks")
            pairs = _met(blocks.withColumn("with", F.filter(_numbers("firsts"), lambda j: j >= F.col("block"))), blocks.withColumn("with", F.filter(_numbers("firsts"), lambda i: i <= F.col("block"))))
            taken = leaders_by_edges(written(pairs.mapInArrow(_edges(similarity), "low long, high long"), "edges"))
            more = many.join(taken, "mask", "left").select("leaf", "mask", "tokens", "firsts", "deals", F.coalesce("template", "mask").alias("template"))
            led = led.unionByName(written(more, "leaders"))
        out.append(led.select("mask", "template"))

        others = written(others.drop("border").withColumn("block", F.pmod(F.xxhash64("mask"), "deals")), "others")
        if others.isEmpty():
            break
        heads = led.where("mask = template AND deals > 0").withColumn("block", F.pmod(F.xxhash64("mask"), "firsts"))
        a, b = _packed(others, width).withColumn("with", _numbers("firsts")), _packed(heads, width).withColumn("with", _numbers("deals"))
        matched = written(_met(a, b).mapInArrow(_matcher(similarity), "leaf long, mask long, template long").groupBy("mask").agg(F.min("template").alias("template")), "matched")
        out.append(matched)
        rest = written(others.select("leaf", "mask", "tokens").join(matched.select("mask"), "mask", "left_anti"), "rest")
        grow *= 2
    return out


def recurring_lines(docs: DataFrame, min_docs: int = 5, min_tokens: int = 3, depth: int = 3, similarity: float = 0.7, leaf_lines: int = 1000, leaf_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, row_hash, lines): the numbers of the lines to drop of each row of docs(doc_id, text) that has any."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"), F.col("text").cast("string").alias("text"))
    lines = written(texts.mapInArrow(_parser(depth, min_tokens), LINES), "lines")
    per_doc = lines.groupBy("leaf", "mask", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    seen = written(per_doc.groupBy("leaf", "mask").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("low")), "masks")
    leaves = seen.groupBy("leaf").agg(F.count(F.lit(1)).alias("masks")).where("masks > 1")
    shapes = lines.where(F.col("tokens").isNotNull()).join(leaves.select("leaf"), "leaf", "left_semi").groupBy("leaf", "mask").agg(F.min("tokens").alias("tokens"))
    steps = _rounds(written(shapes, "shapes"), similarity, leaf_lines, leaf_bytes)
    named = reduce(DataFrame.unionByName, steps) if steps else seen.where("false").select("mask", F.col("mask").alias("template"))
    found = written(named.join(seen.select("mask", "docs", "low"), "mask"), "found")
    # Only templates that their most frequent line does not settle are counted document by document.
    templates = found.groupBy("template").agg(F.max("docs").alias("most"), F.sum("docs").alias("docs"), F.min("low").alias("low"))
    unclear = found.join(templates.where((F.col("most") < min_docs) & (F.col("docs") >= min_docs)).select("template"), "template", "left_semi").select("mask", "template")
    counted = lines.select("mask", "doc_id").join(unclear, "mask").groupBy("template", "doc_id").agg(F.count(F.lit(1)).alias("c")).groupBy("template").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    sure = templates.where(F.col("most") >= min_docs).select("template").unionByName(counted.select("template"))
    general = found.select("mask", "template").join(templates.select("template", "low").join(sure, "template", "left_semi"), "template").select("mask", "low")
    single = seen.where(F.col("docs") >= min_docs).select("mask", "low")
    drop = general.unionByName(single).groupBy("mask").agg(F.min("low").alias("low"))
    hit = lines.select("doc_id", "row_hash", "line", "mask").join(written(drop, "templates"), "mask").where(~F.col("doc_id").eqNullSafe(F.col("low")))
    return hit.groupBy("doc_id", "row_hash").agg(F.collect_set("line").alias("lines"))


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows and columns of docs(doc_id, text, ...) with recurring lines taken out of text, and n_lines, n_dropped.

    Lines end at line feeds.  Options are those of recurring_lines.

    Defined cases: null text stays null and has no lines; a text whose lines all go becomes empty; lines of fewer than
    `min_tokens` tokens are never dropped.  A null doc_id comes after all others, so its recurring lines go.  Rows that
    repeat a doc_id are one document when documents are counted and are cut row by row.  Columns of docs that are named
    n_lines or n_dropped are replaced; all others are kept as they are.
    """
    drop = recurring_lines(docs, **options).select(F.col("doc_id").alias("_drop_id"), F.col("row_hash").alias("_drop_hash"), F.col("lines").alias("_drop"))
    key = F.col("doc_id").cast("long").eqNullSafe(F.col("_drop_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("_drop_hash"))
    joined = docs.join(drop, key, "left").drop("_drop_id", "_drop_hash").withColumn("_lines", F.split("text", "\n", -1))
    kept = F.array_join(F.filter("_lines", lambda x, i: ~F.array_contains("_drop", i)), "\n")
    size = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines"))
    out = joined.withColumns({"n_lines": size.cast("long"), "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"), "text": F.when(F.col("_drop").isNull(), F.col("text")).otherwise(kept)})
    return out.drop("_drop", "_lines")
