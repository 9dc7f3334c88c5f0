"""Byte-level BPE against the tiktoken library, the Merkle manifest against plain Python, whitening against NumPy."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm import byte_bpe, merkle, queries, whitening

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs():
    return byte_bpe.pairs_of(byte_bpe.VOCABULARY, None)


@pytest.fixture(scope="module")
def library(pairs):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="etaoin shrdlu\n\t '’sdé漢я🙂1՘𖺧", max_size=80)))
def test_bpe_of_any_text(pairs, library, text):
    got = ids(pairs.encode(text))
    assert got == library.encode_ordinary(text)
    assert pairs.decode(got) == text.encode()


def test_bpe_of_joined_tokens(pairs):
    """Pieces made of whole tokens are those on which longest tokens go wrong."""
    rng, keys = random.Random(7), sorted(pairs.ranks)
    for _ in range(1500):
        raw = b"".join(rng.choice(keys) for _ in range(rng.randrange(1, 7)))[:60]
        whole = pairs.ranks.get(raw)
        assert pairs.cover(raw) == ([whole] if whole is not None else byte_bpe.merged(raw, pairs.ranks))


def test_bpe_where_merges_do_not_follow_lengths(tmp_path, library):
    """A small vocabulary with late short tokens, and one that merging never makes: it counts as a whole piece only."""
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"bc", b"ab", b"cd", b"abcd", b"bcd", b"xbc", b"abx", b"aa", b"aaaa", b"aaa", b"bab", b"dddd"]
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    own = byte_bpe.BytePairs(str(path), public_tokenizers.PATTERN)
    other = tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    assert not own.fits(-1, own.ranks[b"dddd"])
    rng = random.Random(3)
    for text in ["dddd", "adddd", "abcd", "xabcd", "aaaaaaa", *("".join(rng.choice("abcdx") for _ in range(rng.randrange(1, 12))) for _ in range(3000))]:
        assert ids(own.encode(text)) == other.encode_ordinary(text)


def test_bpe_forgets_without_harm(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "CACHE_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "CACHE_PAIRS", 5)
    pairs = byte_bpe.pairs_of(byte_bpe.VOCABULARY, None)
    text = "The quick brown foxes jumped over lazier dogs, unsurprisingly. " * 3
    assert ids(pairs.encode(text)) == library.encode_ordinary(text)


def test_bpe_query(spark, library):
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        i = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(i), hashlib.sha256(np.array(i, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert sorted(map(tuple, queries.op11_byte_bpe(spark, SF).collect())) == sorted(want)


def test_bpe_cases(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ROWS_BYTES", 50)
    long = "wörds and blanks   " * 3000 + "x" * 20_000
    rows = [(1, "a b", "k"), (1, "a b", "k"), (2, None, "k"), (None, "", "k"), (3, long, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = byte_bpe.encode(docs, ("doc_id", "ids"))
    assert out.columns == ["doc_id", "ids"]
    got = sorted(((r["doc_id"], r["ids"]) for r in out.collect()), key=str)
    assert got == sorted(((i, library.encode_ordinary(t or "")) for i, t, _ in rows), key=str)
    back = byte_bpe.decode(out.withColumn("decoded", out.doc_id))
    assert sorted(((r["doc_id"], bytes(r["decoded"]).decode()) for r in back.collect()), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert byte_bpe.digests(docs.where("false")).count() == 0
    nulls = byte_bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()
    assert {r["doc_id"]: r["decoded"] for r in nulls} == {1: None, 2: bytearray()}


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, text) -> str:
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def plain_tree(hashes: list[str], width: int) -> list[list[str]]:
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + width]) for i in range(0, len(levels[-1]), width)])
    return levels


def plain_path(levels, at: int, width: int) -> list[tuple[list[str], list[str]]]:
    out = []
    for level in levels[:-1]:
        run = level[at // width * width :][:width]
        out.append((run[: at % width], run[at % width + 1 :]))
        at //= width
    return out


def plain_manifest(rows, width=16):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r, r["text"])))
    trees = {s: plain_tree([plain_leaf(r, r["text"]) for r in by[s]], width) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names], width) if names else []
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            way, text = plain_path(trees[s], i, width) + plain_path(top, k, width), r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            h = plain_leaf(r, text)
            for a, b in way:
                h = digest(*a, h, *b)
            out.append((r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], digest(*(x for a, b in way for x in a + b)), h, h == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(map(tuple, queries.op12_merkle_manifest(spark, SF).collect()), key=str)
    assert got == plain_manifest(rows) and any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("width,depth", [(2, 1), (2, 3), (3, 2), (16, 2)])
def test_manifest_of_many_shapes(spark, width, depth):
    """Trees of every number of nodes around the borders of runs and blocks, and many passes."""
    sizes = [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 27, 28, 65]
    rows = [(1000 * k + i, None if k == 0 else f"s{k}" if k % 2 else f"Ś{k}", "en", i, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = sorted(map(tuple, merkle.audited(docs.repartition(5), width=width, depth=depth).collect()), key=str)
    assert got == plain_manifest(docs.collect(), width)


def test_manifest_cases(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string, tree int, at int, hash string, size int, nodes int"
    rows = [(1, "a", "en", 3, "One"), (1, "a", "en", 3, "One"), (1, "a", "en", 3, "Two"), (None, "a", None, None, None), (None, None, None, None, ""), (5, None, "x", 1, "Ä" * 100_000 + "Z"), (6, "", "-", 0, "-"), (7, "b", "", None, "")]
    docs = spark.createDataFrame([(*r, 1, 2, "h", 3, 4) for r in rows], schema)
    got = sorted(map(tuple, merkle.audited(docs).collect()), key=str)
    assert got == plain_manifest(docs.collect())
    assert sorted(map(tuple, merkle.audited(docs.repartition(7)).collect()), key=str) == got
    assert merkle.audited(docs.where("false")).count() == 0
    one = merkle.audited(docs.where("doc_id = 5")).collect()[0]
    assert one["root"] == one["subroot"] == one["leaf"] and one["proof_sha256"] == digest()


def test_any_change_shows(spark):
    docs = spark.createDataFrame([(i, f"s{i % 3}", "en", i, f"text {i}") for i in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    root = merkle.manifest(docs).first()["root"]
    docs.createOrReplaceTempView("docs_of_manifest")
    for change in ("CASE WHEN doc_id = 99 THEN 100 ELSE doc_id END AS doc_id, source, lang, n_chars, text", "doc_id, source, lang, nullif(n_chars, 4) AS n_chars, text", "doc_id, source, lang, n_chars, CASE WHEN doc_id = 50 THEN text || ' ' ELSE text END AS text"):
        assert merkle.manifest(spark.sql(f"SELECT {change} FROM docs_of_manifest")).first()["root"] != root


def plain_whitening(x: np.ndarray, count: int = 8):
    n, total = len(x), x.sum(0)
    c = (x * n - total).astype(float) / n
    e, q = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-e)[:count]
    return ((x * n - total) ** 2).sum(1), c @ q[:, order] / np.sqrt(e[order]), e[order] / e.sum()


def integer_rows(v: np.ndarray) -> np.ndarray:
    return np.floor(1024 * v).astype(np.int64) + 100_000


def compared(rows, ids_, x, count=8):
    got = {(r["vec_id"], r["component"]): r for r in rows}
    deviation, z, share = plain_whitening(x, count)
    assert len(got) == len(rows) == len(ids_) * z.shape[1]
    mine = np.array([[got[i, c + 1]["whitened"] for c in range(z.shape[1])] for i in ids_])
    sign = np.sign((mine * z).sum(0))
    assert np.abs(mine * sign - z).max() < 1e-9
    assert [int(got[i, 1]["deviation"]) for i in ids_] == deviation.tolist()
    assert np.allclose([got[ids_[0], c + 1]["explained"] for c in range(z.shape[1])], share, rtol=1e-9)
    assert {r["n"] for r in rows} == {len(ids_)} and max(r["identity_error"] for r in rows) < 1e-9


def test_whitening_query(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    compared(queries.op13_whitening(spark, SF).collect(), t.vec_id.tolist(), integer_rows(np.stack(t.embedding.to_numpy()).astype(float)))


def test_whitening_of_small_blocks_and_steep_spectra(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 12)) * 4.0 ** -np.arange(12) * 50 + rng.normal(size=12) * 100
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    compared(whitening.whiten(df, block_rows=17).collect(), list(range(300)), integer_rows(v))


def test_whitening_finds_equal_and_missing_directions(spark):
    """Two directions of one variance, and dimensions without any: as many components as there is variance."""
    corners = [[a / 1024, b / 1024, 7.0, 0.0] for a in (-64, 64) for b in (-64, 64)]
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(corners)), "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in rows} == {1, 2} and all(abs(r["explained"] - 0.5) < 1e-12 for r in rows)
    assert all(int(r["deviation"]) == 2 * (4 * 64) ** 2 for r in rows) and rows[0]["identity_error"] < 1e-12


def test_leading_components_need_few_steps(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(400, 40))
    v[:, :3] *= [30, 20, 10]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    compared(whitening.whiten(df, count=3, steps=30).collect(), list(range(400)), integer_rows(v), 3)


def test_whitening_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (3, None), (4, []), (5, [1.0, None]), (6, [nan, 0.0]), (7, [inf, 0.0]), (8, [0.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [1.0, 2.0, 4.0]), (11, [5.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, component string")
    out = whitening.whiten(df).collect()
    by = {}
    for r in out:
        by.setdefault(r["vec_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 2, 2: 4, None: 2, 8: 2, 9: 1, 10: 1}
    assert {r["n"] for r in by[8]} == {5} and {r["n"] for r in by[9]} == {2}
    assert whitening.whiten(df.where("false")).count() == 0
    assert whitening.whiten(df.where("vec_id IN (2, 11)")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert len(whitening.whiten(huge).collect()) == 6
