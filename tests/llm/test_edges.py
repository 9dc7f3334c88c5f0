"""Awkward rows: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vecloom.llm.ann import nearest
from vecloom.llm.decontamination import contaminated
from vecloom.llm.line_dedup import line_dedup
from vecloom.llm.near_dedup import near_duplicates
from vecloom.llm.packing import pack
from vecloom.llm.pii import pii
from vecloom.llm.secrets import secrets
from vecloom.llm.sharding import shard
from vecloom.llm.substring_dedup import substring_dedup
from vecloom.llm.toxicity import toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part int, ord int, key long, rep long, line int, shard int, bits int"
LONG = " ".join(f"w{i % 9973}" for i in range(200_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (3, None),
    (4, ""),
    (5, " \t\n\r "),
    (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"),
    (None, None),
    (6, "one two"),
    (7, "one two"),
    (8, LONG),
    (9, "x" * 1_000_000),
    (10, "é" * 3 + "　\U0001f600 token = 'abcdef123' a@b.co"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 1, 2, 3, 4, 5, 6, 7) for i, t in ROWS], DOCS).cache()


def bench(spark):
    return spark.createDataFrame([(1, ROWS[0][1], "x"), (2, None, "x"), (None, "", "x"), (3, "one two", "x")], "item_id long, text string, doc_id string")


def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 0, 0), (2, 0, 1), (6, None, None), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")


OPS = {
    "substring": lambda s, d: substring_dedup(d),
    "packing": lambda s, d: pack(d),
    "toxicity": lambda s, d: toxicity(d, labels(s)),
    "sharding": lambda s, d: shard(d),
    "decontamination": lambda s, d: contaminated(d, bench(s)),
    "near": lambda s, d: near_duplicates(d),
    "secrets": lambda s, d: secrets(d),
    "lines": lambda s, d: line_dedup(d),
    "pii": lambda s, d: pii(d),
}


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, docs, name):
    assert OPS[name](spark, docs.where("false")).count() == 0


@pytest.mark.parametrize("name", [n for n in OPS if n not in ("packing", "decontamination")])
def test_one_row_for_each_row(spark, docs, name):
    got = [r["doc_id"] for r in OPS[name](spark, docs).select("doc_id").collect()]
    assert sorted(got, key=str) == sorted((i for i, _ in ROWS), key=str)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_rows(spark, docs, sf, name, stage):
    out = stage(spark, docs, sf)
    if name != "packing":
        assert out.columns == docs.columns
    out.collect()
    assert stage(spark, docs.where("false"), sf).count() == 0


def test_stages_judge_rows_by_their_own_text(spark):
    """Toxic rows with a null or shared doc_id go, their clean namesakes stay."""
    base = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    labels_ = spark.read.parquet(f"{base}/labels.parquet")
    bad = toxicity(docs, labels_).where("predicted = 1").join(docs, "doc_id").select("text").first()[0]
    clean = "a note on the weather of the day"
    more = spark.createDataFrame([(None, bad), (10**9, bad), (10**9, clean), (None, clean)], "doc_id long, text string")
    more = more.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    out = dict(corpus_pipeline.STAGES)["toxicity"](spark, docs.unionByName(more), base)
    assert sorted(map(str, out.where("doc_id IS NULL OR doc_id = 1000000000").select("doc_id", "text").collect())) == sorted(map(str, more.where(F.col("text") == clean).select("doc_id", "text").collect()))


def test_stage_keeps_one_of_each_copy(spark, docs, sf):
    out = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).select("doc_id").collect()]
    assert sorted(out, key=str) == sorted([1, 3, 4, 5, 6, 8, 9, 10, None, None], key=str)
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, twice, sf).collect())) == [(1, "a b c d e f"), (1, "u v w x y z")]


def test_contaminated_rows_go_by_their_own_text(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").first()["text"]
    rows = spark.createDataFrame([(None, item), (5, item), (5, "clean words"), (None, None)], "doc_id long, text string")
    out = corpus_pipeline.drop_contaminated(spark, rows, sf).collect()
    assert sorted(map(str, out)) == sorted(map(str, rows.where("text IS NULL OR length(text) < 20").collect()))


def test_substring_cases(spark, docs):
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect()]
    assert sorted(x for x in got if x[0] in (1, 2)) == [(1, 15, 0), (2, 15, 15), (2, 15, 15)]
    assert (None, 15, 0) in got and (3, 0, 0) in got and (5, 0, 0) in got and (8, 200_000, 0) in got and (6, 2, 0) in got
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["kept_sha256"] for r in substring_dedup(docs.where("doc_id IN (3, 4, 5)")).collect()} == {empty}


def test_near_cases(spark, docs):
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert {(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (None, None, True)} <= got


def test_packing_cases(spark, docs):
    rows = pack(docs, capacity=64).collect()
    one = zlib.crc32(bytes(4))
    assert all((r["length"], r["ids_crc32"], r["doc_tokens"]) == (1, one, 1) for r in rows if r["doc_id"] in (3, 4))
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 64


def test_equal_rows_do_not_share_a_packing_group(spark):
    from vecloom.llm.packing import SEQUENCE_BITS

    same = spark.range(2400).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same words").alias("text"))
    rows = pack(same, capacity=64, group_pieces=200).select("sequence_id", "offset", "length").collect()
    groups = {}
    for r in rows:
        groups[r["sequence_id"] >> SEQUENCE_BITS] = groups.get(r["sequence_id"] >> SEQUENCE_BITS, 0) + 1
    assert len(rows) == 2400 and len(groups) == 12 and max(groups.values()) < 400
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 2400


def test_sharding_cases(spark, docs):
    rows = shard(docs, shards=4, carry=("lang",)).collect()
    sizes = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(4)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(1, 0)}
    assert all(r["lang"] == "en" and r["grown_shard"] is None for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, shard(docs, shards=4, carry=("lang",)).collect()))


def test_decontamination_cases(spark, docs):
    got = {(r["doc_id"], r["item_id"]) for r in contaminated(docs, bench(spark)).collect()}
    assert {(1, 1), (2, 1), (None, 1), (6, 3), (7, 3)} == got
    parts = contaminated(docs, bench(spark), part_bytes=40)
    assert {(r["doc_id"], r["item_id"]) for r in parts.collect()} == got
    assert contaminated(docs, bench(spark).where("false")).count() == 0


def test_line_cases(spark, docs):
    assert line_dedup(docs, min_docs=2).where("text IS NULL AND n_lines = 0").count() == 2
    got = {(r["doc_id"], r["text"]) for r in line_dedup(docs, min_docs=2).where("doc_id <= 2 OR doc_id IS NULL").select("doc_id", "text").collect()}
    assert got == {(1, ROWS[0][1]), (2, ""), (None, ""), (None, None)}


def test_toxicity_without_labels_and_folds(spark, docs):
    none = toxicity(docs, labels(spark).where("false")).collect()
    assert all(r["score"] < 0.2 and r["predicted"] == 0 for r in none)
    assert {r["doc_id"]: r["held_out"] for r in none if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in ROWS if i is not None}
    assert all(0 <= r["score"] <= 1 for r in toxicity(docs, labels(spark)).collect())


def test_ann_cases(spark):
    v = [1.0, 0.0]
    rows = [(0, v), (100, [0.0, 1.0]), (3, v), (2, v), (1, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0]), (None, v), (8, [1.0, 2.0, 3.0]), (9, []), (2, v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"block": F.lit(1), "rank": F.lit("x"), "v": F.lit(2)})
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest(df, every=100, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2), (0, 2, 2), (0, 3, 3), (100, 1, 0), (100, 2, 2), (100, 3, 2)]
    assert nearest(df.where("false")).count() == 0 and nearest(df.where("vec_id = 0")).count() == 0
    assert [r["vec_id"] for r in nearest(df.where("vec_id IN (0, 3, 8)")).collect()] == [3]
