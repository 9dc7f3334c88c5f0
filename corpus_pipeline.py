"""From raw documents to packed training sequences: each stage applies one operator to all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm._common import ship, table, written
from vecloom.llm.decontamination import contaminated
from vecloom.llm.line_dedup import line_dedup
from vecloom.llm.near_dedup import near_duplicates
from vecloom.llm.packing import pack
from vecloom.llm.toxicity import toxicity


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs that gone(doc_id, row_hash) does not name, null ids and null texts by their own."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]) & (F.xxhash64(docs["text"]) == gone["_hash"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier predicts toxic go.

    Each row is judged by its text: of rows that share a doc_id, or have none, only the toxic ones go.  Null and empty
    texts are scored like any other.
    """
    return _without(docs, toxicity(docs, table(spark, sf_dir, "labels")).where("predicted = 1"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; n_chars follows the text; a document of which nothing is left goes too.

    Null, empty and wordless texts have no lines to drop and stay.  Rows that share a doc_id are cut one by one; rows
    without one come after all others, so their recurring lines go.
    """
    ship(spark)
    cut = line_dedup(docs).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    Rows that repeat a doc_id with the same text become one; with other texts they are one document and stay together.
    Rows without a doc_id cannot be named, and null and wordless texts have no group: all of them stay.
    """
    ship(spark)
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["_id"], "left_anti")
    twice = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _id IS NOT NULL").select("_id")
    once = kept.join(twice, kept["doc_id"] == twice["_id"], "left_anti")
    return once.unionByName(kept.join(twice, kept["doc_id"] == twice["_id"], "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a copy of a benchmark item go, whatever their doc_id; null and wordless texts hold none."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens; null and empty texts are one piece, of one token.

    Rows that share a doc_id, or have none, are packed one by one.
    """
    ship(spark)
    return pack(docs, with_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_documents),
]

ORACLE_SQL = None  # a trained classifier, a template tree and a tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
