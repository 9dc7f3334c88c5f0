"""Merkle manifest of a table: a leaf for each row, a tree for each source, a tree over the sources.

Nodes of a tree are numbered and dealt into aligned blocks of `width ** depth`.  A block keeps each of its levels as one
hex string, all hashes one after the other; the parents are hashes of its fixed-width substrings, and the siblings of a
node are the substrings on both sides of it.  What is left of a block is a node of the next pass, until every tree has
one.  Then segments of siblings go down again, from the roots to the leaves: each pass hands the segments above a block
to the nodes of that block, one row for each block.

Rows are numbered by ranges of (tree, order), so a tree that holds most rows is spread like any other, and no task sees
more than its blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm._common import ship, written

HEX = 64  # characters of a digest
WIDTH, DEPTH = 16, 2
SEGMENTS = "array<struct<lhs:string,rhs:string>>"


def field(value: Column) -> Column:
    """One input of a leaf: `-` for null, else its length in UTF-8 bytes, a colon and itself."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def lowered(text: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """nodes(tree, hash, ...) with at, the number of each within its tree by `order`, and size, the nodes of its tree.

    Rows that `order` does not tell apart come in the order of their hashes.
    """
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = nodes.repartitionByRange(parts, "tree", *order, "hash").sortWithinPartitions("tree", *order, "hash")
    # The row number within a range is in the lower 33 bits: rows are sorted, and the range is written as it lies.
    lined = written(ranged.withColumn("_row", F.monotonically_increasing_id()), "merkle-lined").withColumn("_range", F.shiftright("_row", 33))
    runs = lined.groupBy("tree", "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")  # as many rows as ranges that hold the tree
    before = F.coalesce(F.sum("_n").over(tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("tree").alias("_tree"), F.col("_range").alias("_in"), (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("size"))
    met = lined.join(runs, (F.col("_range") == F.col("_in")) & F.col("tree").eqNullSafe(F.col("_tree")))
    return met.withColumn("at", F.col("_row") + F.col("_shift")).drop("_row", "_range", "_in", "_tree", "_shift")


def _cut(level: Column, first: Column, count: Column) -> Column:
    """`count` digests of a level, from number `first`.  Hex digits are bytes, whose substrings need no search from the
    left, as those of strings do."""
    return F.substring(level.cast("binary"), (first * HEX + 1).cast("int"), (count * HEX).cast("int"))


def _parents(level: Column, width: int) -> Column:
    runs = F.ceil(F.octet_length(level) / (width * HEX))
    of = lambda i: F.sha2(_cut(level, i * width, F.lit(width)), 256)
    return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), runs - 1), of), "")


def blocks(nodes: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """One row for each aligned block of nodes(tree, at, size, hash, ...): its nodes, its levels, what is left of it.

    A tree of one block ends at the level that has one node; the blocks of a larger one all have `depth` levels, even if
    the last holds a single node.
    """
    span = width**depth
    packed = nodes.groupBy("tree", "size", F.floor(F.col("at") / span).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", *[c for c in nodes.columns if c not in ("tree", "size", "at")]))).alias("nodes"))
    out = packed.withColumn("level_0", F.array_join("nodes.hash", ""))
    for i in range(depth):
        done = F.octet_length(f"level_{i}") == HEX if i else F.col("size") == 1
        done = done & (F.col("size") <= span)
        out = out.withColumn(f"level_{i + 1}", F.when(~done, _parents(F.col(f"level_{i}"), width)))
    return out.withColumn("hash", F.coalesce(*[f"level_{i}" for i in range(depth, -1, -1)]))


def passes(nodes: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> list[DataFrame]:
    """Tables of blocks, each over what is left of the one before, until every tree has one node."""
    out, span = [], width**depth
    while True:
        done = written(blocks(nodes, width, depth), "merkle-blocks")
        out.append(done)
        rest = done.where(F.col("size") > span)
        if rest.isEmpty():
            return out
        nodes = rest.select("tree", F.col("block").alias("at"), F.ceil(F.col("size") / span).alias("size"), "hash")


def roots(tables: list[DataFrame], span: int = WIDTH**DEPTH) -> DataFrame:
    """tree, root of every tree."""
    ends = [t.where(F.col("size") <= span).select("tree", F.col("hash").alias("root")) for t in tables]
    out = ends[0]
    for t in ends[1:]:
        out = out.unionByName(t)
    return out


def siblings(table: DataFrame, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """The nodes of table(tree, block, nodes, level_*, above) one by one, with path: the segments beside each, level by
    level, and those above the block."""
    out = table.withColumn("node", F.explode("nodes"))
    at = F.pmod("node.at", F.lit(width**depth))
    segments = []
    for i in range(depth):
        index = F.floor(at / width**i)
        run = index - F.pmod(index, F.lit(width))
        level = F.col(f"level_{i}")
        pair = F.struct(_cut(level, run, index - run).cast("string").alias("lhs"), _cut(level, index + 1, run + width - 1 - index).cast("string").alias("rhs"))
        segments.append(F.when(F.col(f"level_{i + 1}").isNotNull(), pair))
    path = F.concat(F.filter(F.array(*segments), lambda s: s.isNotNull()), F.coalesce("above", F.array().cast(SEGMENTS)))
    return out.select("tree", "node.*", path.alias("path"))


def paths(tables: list[DataFrame], tops: DataFrame | None = None, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """The nodes of the first table with path, the segments of siblings up to the root of their tree, and beyond it those
    of tops(tree, path), where given."""
    above = None  # (tree, block, above) of the nodes of the pass before
    for i in range(len(tables) - 1, -1, -1):
        table = tables[i]
        ends = table.where(F.col("size") <= width**depth)
        if tops is None:
            ends = ends.withColumn("above", F.array().cast(SEGMENTS))
        else:
            ends = ends.join(tops.select(F.col("tree").alias("_tree"), F.col("path").alias("above")), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
        if above is not None:
            on = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))
            ends = ends.unionByName(table.where(F.col("size") > width**depth).join(above, on).drop("_tree", "_block"))
        out = siblings(ends, width, depth)
        above = out.select(F.col("tree").alias("_tree"), F.col("at").alias("_block"), F.col("path").alias("above"))
    return out


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["lhs"], h, s["rhs"]), 256))


def proof(path: Column) -> Column:
    """The hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["lhs"], s["rhs"])), ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """doc_id, source, leaf, subroot, root, path and folded_root of every row of docs(doc_id, source, lang, n_chars, text).

    path: the siblings of the leaf up to the root, an array of (lhs, rhs) strings of digests.  folded_root is what path
    makes of the leaf, or, where `tampered` (a text column) is not equal to the text, of the leaf with that text.

    Defined cases: null fields hash as `-`, so null and empty texts differ; a null source is a tree of its own, the
    first; rows of a source ascend by doc_id, null first, and those that repeat a doc_id by their leaves, so the root
    does not depend on how rows lie; an empty table has no rows and no root.  Columns that are not named here are
    ignored, whatever their names.
    """
    ship(docs.sparkSession)
    span = width**depth
    fields = [F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long")]
    text, other = F.col("text").cast("string"), tampered if tampered is not None else F.col("text").cast("string")
    rows = docs.select(
        fields[0].alias("doc_id"),
        fields[1].alias("tree"),
        leaf_hash(*fields, text).alias("hash"),
        F.when(~other.eqNullSafe(text), leaf_hash(*fields, other)).alias("changed"),
    )
    leaves = placed(written(rows, "merkle-leaves"), "doc_id")
    trees = passes(leaves, width, depth)
    subroots = written(roots(trees, span), "merkle-subroots")
    over = passes(placed(subroots.select(F.lit(0).alias("tree"), F.col("root").alias("hash"), F.col("tree").alias("source")), "source"), width, depth)
    tops = paths(over, None, width, depth).select(F.col("source").alias("tree"), F.col("hash").alias("subroot"), "path")
    tops = written(tops.join(roots(over, span).select("root"), F.lit(True)), "merkle-tops")  # the root is one row
    out = paths(trees, tops, width, depth)
    out = out.join(tops.select(F.col("tree").alias("_tree"), "subroot", "root"), F.col("tree").eqNullSafe(F.col("_tree")))
    return out.select("doc_id", F.col("tree").alias("source"), F.col("hash").alias("leaf"), "subroot", "root", "path", folded(F.coalesce("changed", "hash"), F.col("path")).alias("folded_root"))


def audited(docs: DataFrame, every: int = 5, **options) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: the manifest held against a copy of the table in
    which the texts whose crc32(doc_id as text) is divisible by `every` are in lower case."""
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % every == 0
    copy = F.when(hit, lowered(F.col("text").cast("string"))).otherwise(F.col("text").cast("string"))
    out = manifest(docs, copy, **options)
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
