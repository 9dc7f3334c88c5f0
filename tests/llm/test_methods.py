"""Each operator against brute force, an exact round trip or held-out accuracy; parts of the methods by hand."""

import hashlib
import itertools
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm import _text as T
from vecloom.llm import _tokens, ann, decontamination, line_dedup, packing, secrets, sharding, toxicity
from vecloom.llm._tokens import Encoder
from vecloom.llm.near_dedup import near_duplicates
from vecloom.llm.pii import PATTERNS, pii
from vecloom.llm.substring_dedup import FingerprintIndex, due, part_numbers, partition_keys, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.sampled_from("ab é\n\t.,'’1  　ñÑ🙂<|>endoftx"), max_size=60)


def words_of(texts):
    raw = [t.encode() for t in texts]
    return T.Words(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64))


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_words(texts):
    w = words_of(texts)
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]
    flat = [x for t in got for x in t]
    h = w.hashes()
    assert len(set(flat)) == len(set(h.tolist())) and all(h[i] == T.hash_of(x.encode()) for i, x in enumerate(flat))
    g = T.gram_hashes(h, 2)
    assert len({(a, b) for a, b in itertools.pairwise(flat)}) == len(set(g.tolist()))


@pytest.fixture(scope="module")
def encoder():
    return Encoder(packing.TOKENIZER, cache_units=50)


@settings(max_examples=80, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=5))
def test_token_ids(encoder, texts):
    w = words_of(texts)
    ids, border = encoder.encode(w.data, w.offs)
    assert [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_tokenizers_see_whole_texts():
    other = Encoder("word_bpe_49k.json")
    assert not other.splittable and Encoder(packing.TOKENIZER).splittable
    texts = ["Hello, World.  It's  fine", "", "e\u0301 caf\u00e9. x,y"]
    w = words_of(texts)
    ids, border = other.encode(w.data, w.offs)
    assert [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)] == [other.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_tokens_of_all_documents(spark, sf, encoder):
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = words_of([r["text"]])
        assert encoder.encode(w.data, w.offs)[0].tolist() == encoder.tokenizer.encode(r["text"], add_special_tokens=False).ids


def test_tasks_of_a_worker_share_an_encoder(monkeypatch, tmp_path):
    """A task neither loads the tokenizer again nor encodes what another one of its job and worker has encoded."""
    import tokenizers

    load, texts, file = tokenizers.Tokenizer.from_file, [], tmp_path / "own.json"
    load(_tokens.tokenizer_path(packing.TOKENIZER)).save(str(file))

    class Counted:
        def __init__(self, path):
            self.real = load(path)

        def __getattr__(self, name):
            return getattr(self.real, name)

        def encode_batch_fast(self, some, **kinds):
            texts.append(sum(map(len, some)))
            return self.real.encode_batch_fast(some, **kinds)

        @staticmethod
        def from_file(path):
            texts.append("load")
            return Counted(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    words = [f"shared{i}" for i in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array([1]), pa.array([" ".join([w, *words, w])])], names=["doc_id", "text"]) for w in ("one", "two")]
    cut = packing._cut(1024, str(file), 0, True)
    out = [list(cut(iter([b])))[0].to_pylist() for b in batches]
    seen = texts.copy()
    again = [list(cut(iter([b])))[0].to_pylist() for b in batches]
    assert texts == seen and out == again and seen.count("load") == 1
    list(packing._cut(1024, str(file), 0, True, "another")(iter(batches)))
    assert texts.count("load") == 2
    plain = load(str(file))
    for b, rows in zip(batches, out, strict=True):
        ids = plain.encode(b.column(1)[0].as_py(), add_special_tokens=False).ids
        assert b"".join(r["ids"] for r in rows) == np.array([*ids, 0], dtype="<u4").tobytes()


def test_token_ids_outlive_growth_and_forgetting(monkeypatch):
    monkeypatch.setattr(_tokens, "FIRST_SLOTS", 8)
    encoder, rng, sizes, forgotten = Encoder(packing.TOKENIZER, cache_units=256), random.Random(5), set(), 0
    for _ in range(60):
        texts = [" ".join(rng.choice(("word", "\u00e9t\u00e9", "Is,", "x<|endoftext|>")) + str(int(rng.paretovariate(0.3))) for _ in range(rng.randint(0, 40))) + rng.choice(("", ".", " ", "\n")) for _ in range(3)]
        w, before = words_of(texts), len(encoder.flat)
        ids, border = encoder.encode(w.data, w.offs)
        sizes.add(len(encoder.known))
        forgotten += len(encoder.flat) < before
        assert [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(sizes) == 256 > min(sizes) and forgotten


def test_token_ids_of_a_vocabulary_that_lacks_bytes(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    own = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate("abcd\u0120")} | {"ab": 5}, merges=[("a", "b")]))
    own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    own.save(str(tmp_path / "few.json"))
    encoder, texts = Encoder(str(tmp_path / "few.json")), ["ab cab xyz abx bad", " zz ab zz", "", "x"]
    w = words_of(texts)
    for _ in range(2):
        ids, border = encoder.encode(w.data, w.offs)
        assert encoder.splittable and [ids[a:b].tolist() for a, b in zip(border[:-1], border[1:], strict=True)] == [own.encode(t, add_special_tokens=False).ids for t in texts]


def documents(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(3, 60))) for _ in range(n // 3)]
    out = []
    for i in range(n):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(string.ascii_lowercase)
        out.append((i * 7 % n, " ".join(w)))
    return out


def test_substring_dedup_equals_brute_force(spark):
    rows = documents(1)
    seen, want = {}, {}
    for i, t in sorted(rows):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for j in range(len(w) - 12):
            if seen.setdefault(tuple(w[j : j + 13]), i) < i:
                gone[j : j + 13] = [True] * 13
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for generations in (1, 4):
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup(df, generations=generations).collect()}
        assert got == want


def test_index_grows_batch_by_batch_and_compacts(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, text string")
    index = FingerprintIndex(spark, fan=2)
    for i, t in ((1, text), (2, "other " + text), (5, text + " more")):
        index.ingest(frame(i, t))
    assert sorted(level for _, level in index.runs) == [0, 1]
    assert [r["n_removed"] for r in index.cut(frame(5, text + " more")).collect()] == [30]
    with pytest.raises(ValueError):
        index.ingest(frame(4, text))
    index.drop()
    assert not spark.catalog.tableExists(index.name)


def test_another_session_opens_the_index(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, text string")
    first = FingerprintIndex(spark, fan=2)
    first.ingest(frame(1, text))
    first._append(first._rows([first.runs[0][0]], "run").selectExpr("*", "'run' AS kind"))  # a step that was never committed
    folder = first.folder
    again = FingerprintIndex.open(spark, folder, fan=2)
    assert (again.runs, again.highest, again.buckets) == (first.runs, 1, first.buckets)
    again.ingest(frame(3, text))
    assert [r["n_removed"] for r in again.cut(frame(3, text)).collect()] == [30]
    last = FingerprintIndex.open(spark, folder, fan=2)
    assert [level for _, level in last.runs] == [1] and last.highest == 3
    last.drop()


def test_an_index_doubles_its_buckets_and_answers_the_same(spark):
    ids = [0, 5, -7, 2**40, -(2**63), 2**63 - 1, *range(100, 200)]
    want = [r["p"] for r in spark.createDataFrame([(i,) for i in ids], "i long").selectExpr("pmod(xxhash64(i), 7) AS p").collect()]
    assert part_numbers(np.array(ids, dtype=np.int64), 7).tolist() == want
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[a : a + 60]) for a in (rng.randrange(330) for _ in range(24))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    three = [docs.where("doc_id < 8"), docs.where("doc_id >= 8 AND doc_id < 16"), docs.where("doc_id >= 16")]
    answers = []
    for at in (None, 1, 2, 3):
        index = FingerprintIndex(spark, fan=2, buckets=4)
        for i, part in enumerate(three):
            index.ingest(part)
            if at == i + 1:
                index.double()
        assert index.buckets == (4 if at is None else 8)
        answers.append(sorted(map(tuple, index.cut(docs).collect())))
        folder, runs = index.folder, index.runs
        again = FingerprintIndex.open(spark, folder, fan=2)
        assert (again.runs, again.buckets) == (runs, index.buckets)
        assert sorted(map(tuple, again.cut(docs).collect())) == answers[-1]
        index.drop()
    assert all(a == answers[0] for a in answers) and sum(r[2] for r in answers[0]) > 100
    assert answers[0] == sorted(map(tuple, substring_dedup(docs).collect()))


def test_windows_are_rewritten_once_per_level():
    runs, rewritten = [], 0  # (level, size)
    for _ in range(64):
        runs.append((0, 1))
        while old := due([level for level, _ in runs], 4):
            size = sum(runs[i][1] for i in old)
            rewritten += size
            runs = [r for i, r in enumerate(runs) if i not in old] + [(runs[old[0]][0] + 1, size)]
    assert runs == [(3, 64)] and rewritten == 64 * 3


def test_runs_lie_in_rows_of_bounded_size(monkeypatch):
    from vecloom.llm import substring_dedup as sd

    monkeypatch.setattr(sd, "ROW_WINDOWS", 10)
    h = np.sort(np.random.default_rng(0).integers(0, 2**63, 25).astype(np.uint64))
    rows = sd._run(4, h, np.arange(25, dtype=np.uint16))
    assert [len(r[4]) // 2 for r in rows] == [10, 10, 5] and np.concatenate([sd._unplanes(r[3]) for r in rows]).tolist() == h.tolist()
    assert sd._union(sd._table(rows[::-1])).column("hashes").to_pylist() == [r[3] for r in rows]


@pytest.mark.parametrize("n", [1, 4, 49, 211])
def test_partition_keys(spark, n):
    keys = partition_keys(n)
    got = spark.createDataFrame([(int(k),) for k in keys], "k int").selectExpr("pmod(hash(k), %d)" % n).collect()
    assert [r[0] for r in got] == list(range(n))


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [2, 3])
def test_near_duplicates_equal_brute_force(spark, seed):
    rows = documents(seed, 150)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_links_across_components_of_a_bucket(spark):
    """A chain of edits: neighbours are similar, the ends are not, so one centre cannot link a bucket."""
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(24):
        w = list(base)
        w[i * 3 % 80] = f"x{i}"
        base = w
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


@pytest.mark.parametrize("cell_rows", [3, 1000])
def test_crowded_buckets_are_compared_in_cells(spark, cell_rows):
    """Many texts of several lengths around one passage: every bucket holds several components."""
    rng = random.Random(7)
    core = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = core[: rng.choice([24, 30, 36, 40])] + [f"t{i % 17}x{j}" for j in range(rng.choice([0, 3, 8, 14]))]
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), cell_rows=cell_rows).collect()}
    assert got == brute_components(rows)


def test_small_sets_miss_no_link():
    """Every pair of small sets of similarity 0.75 or more shares a key of its first shingles."""
    from vecloom.llm.near_dedup import SMALL_SET, _signer

    rng = random.Random(8)
    texts = []
    for _ in range(3000):
        w = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 24))]
        texts += [" ".join(w), " ".join(w + [f"z{rng.randrange(10**6)}"] * rng.randint(1, 2))]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rows = [r for b in _signer(5, 75, 2, 4, 17)([batch]) for r in b.to_pylist()]  # one band: the rest are first shingles
    sets = [{tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))} for t in texts]
    close = [i for i in range(0, len(texts), 2) if 4 * len(sets[i] & sets[i + 1]) >= 3 * len(sets[i] | sets[i + 1]) and len(sets[i + 1]) <= SMALL_SET]
    assert len(close) > 500 and all(set(rows[i]["bands"][1:]) & set(rows[i + 1]["bands"][1:]) for i in close)
    assert all(len(r["bands"]) <= 1 + 7 for r in rows)


def test_min_max_agreement_is_the_jaccard_similarity():
    from vecloom.llm.near_dedup import T as text

    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, size=1400).astype(np.uint64)
    a, b = text.mix(pool[:1200]), text.mix(pool[200:])
    f = text._split_mix(400, 9) | np.uint64(1)
    hit = [int((a * k).min() == (b * k).min()) + int((a * k).max() == (b * k).max()) for k in f]
    assert np.mean(hit) / 2 == pytest.approx(1000 / 1400, abs=0.06)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_decreasing(lengths):
    x = np.array(lengths, dtype=np.int64)
    window, offset, n = packing.best_fit_decreasing(x, 64)
    left = []  # a plain best fit over all open windows
    for need in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(left) if r >= need]
        if fit:
            left[min(fit, key=lambda i: left[i])] -= need
        else:
            left.append(64 - need)
    assert n == len(left)
    for w in range(n):
        spans = sorted((int(offset[i]), int(offset[i] + x[i])) for i in np.flatnonzero(window == w))
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(spans)) and spans[-1][1] <= 64


def test_matrix_sums_and_law():
    rng = np.random.default_rng(1)
    m = [sharding.communication_matrix(rng, [5, 0, 7], [4, 4, 4]) for _ in range(400)]
    assert all(x.sum(1).tolist() == [5, 0, 7] and x.sum(0).tolist() == [4, 4, 4] for x in m)
    assert np.mean([x[0, 0] for x in m]) == pytest.approx(5 * 4 / 12, abs=0.15)
    big = [sharding.hypergeometric(rng, 2 * 10**9, 10**9, 3000) for _ in range(300)]
    assert np.mean(big) == pytest.approx(2000, abs=6) and np.std(big) == pytest.approx((3000 * 2 / 9) ** 0.5, rel=0.2)
    assert [sharding.hypergeometric(rng, 10**9, 5, 10**9 + 5)] == [10**9]


def test_shards_are_uniform(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "CAST(id AS string) AS text")
    rows = sharding.shard(df, 8).collect()
    low = [sum(r["doc_id"] < 2000 for r in rows if r["shard"] == s) for s in range(8)]
    assert all(150 < x < 350 for x in low) and abs(np.corrcoef([r["slot"] for r in rows], [r["doc_id"] for r in rows])[0, 1]) < 0.1


def test_smith_waterman():
    a, b = np.array([1, 2, 3, 4, 5]), np.array([9, 1, 2, 7, 4, 5, 9])
    assert decontamination.smith_waterman(a, a) == 10
    assert decontamination.smith_waterman(a, b) == 7
    assert decontamination.smith_waterman(a, np.array([1, 2, 9, 9, 3, 4, 5])) == 8
    assert decontamination.smith_waterman(a, np.zeros(0, dtype=np.int64)) == 0


def test_edited_copies_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(20)]
    docs = []
    for i in range(200):
        w = [rng.choice(vocabulary) for _ in range(150)]
        if i < 20:
            copy = items[i][1].split()
            for _ in range(4):
                copy[rng.randrange(30)] = "edited"
            copy.insert(rng.randrange(30), "added")
            del copy[rng.randrange(30)]
            w[40:40] = [x.upper() + "!" for x in copy]
        docs.append((i, " ".join(w)))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i in range(20)}


def test_long_parts_of_items_are_found(spark):
    item = " ".join(f"k{i}" for i in range(60))
    docs = [(0, "x y z " + " ".join(f"k{i}" for i in range(20, 38)) + " and more"), (1, "x y z " + " ".join(f"k{i}" for i in range(20, 28)) + " and more")]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert [(r["doc_id"], r["item_id"]) for r in got.collect()] == [(0, 7)]


def test_hot_passages_and_even_edits_are_found(spark):
    """The first half of an item in a third of all documents, and copies with every fourth word edited."""
    rng = random.Random(9)
    item = [f"k{i}" for i in range(40)]
    noise = lambda k: [f"v{rng.randrange(5000)}" for _ in range(k)]
    docs = [(i, " ".join(noise(30) + (item[:20] if i % 3 == 0 else []) + noise(30))) for i in range(300)]
    docs.append((1000, " ".join(noise(30) + ["edited" if i % 4 == 3 else x for i, x in enumerate(item)] + noise(30))))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == {*range(0, 300, 3), 1000}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_decontamination_equals_alignment_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    vocabulary = [*"the of a in to and".split() * 6, *(f"v{i}" for i in range(60))]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 3, 5, 9, 16, 33])))) for i in range(25)]
    items += [(25, items[0][1]), (26, items[5][1])]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randint(0, 80))
        if i % 2:
            copy = rng.choice(items)[1].split()
            copy = [rng.choice(vocabulary) if rng.random() < 0.25 else x for x in copy if rng.random() < 0.9]
            w[len(w) // 2 : len(w) // 2] = copy
        docs.append((i, " ".join(w)))
    code = {x: k for k, x in enumerate(sorted(set(vocabulary)))}
    want = {}
    for (i, t), (j, x) in itertools.product(docs, items):
        a, b = x.split(), t.split()
        if len(a) < 4:
            if any(b[k : k + len(a)] == a for k in range(len(b))):
                want[i, j] = 1.0
            continue
        got = decontamination.smith_waterman(np.array([code[y] for y in a]), np.array([code[y] for y in b], dtype=np.int64))
        if got >= len(a) or got >= 26:
            want[i, j] = got / (2 * len(a))
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found.collect()} == want and len(want) > 15


def test_common_words_of_items_give_no_seeds():
    """A thousand items that share a passage, which a thousand texts hold: the passage leads to none of them."""
    shared = "one and the same start"
    items = decontamination.Items([(i, shared + "".join(f" k{i}x{j}" for j in range(20))) for i in range(1000)], 4, 0.5, 13)
    counts = np.ones(len(items.seeds))
    counts[np.diff(items.border) > 1] = 1000
    items.keep_rare(counts)
    w = words_of([f"{shared} and so on"] * 50)
    assert not len(items.found(w, w.hashes())[0]) and (items.need >= 5).all()


def test_templates_generalise_fields(spark):
    lines = [f"Order shipped to customer {n} by {c} on time today" for n, c in zip(range(8), ["Ann", "Bob", "Cy", "Di", "Ed", "Flo", "Gus", "Hal"], strict=True)]
    docs = [(i, f"{'abcdefgh'[i] * 3} opens {'hgfedcba'[i] * 2}\n{x}\n{'zyxwvuts'[i] * 4} ends it") for i, x in enumerate(lines)]
    out = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), similarity=0.8).collect()}
    assert len(out[0]) == 3 and all(len(out[i]) == 2 and "shipped" not in " ".join(out[i]) for i in range(1, 8))


def test_templates_of_a_crowded_leaf_are_found(spark):
    """Eight lines of one template among hundreds of unlike lines of the same leaf."""
    docs = [(i, f"2024 10 12 worker {string.ascii_lowercase[i] * 5} has left the building") for i in range(8)]
    docs += [(100 + i, "2024 10 12 " + " ".join(f"{w}{string.ascii_lowercase[i // 26]}{string.ascii_lowercase[i % 26]}" for w in "qwerty")) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for leaf_lines in (1000, 120):
        got = line_dedup.line_dedup(df, leaf_lines=leaf_lines).where("n_dropped > 0").select("doc_id").collect()
        assert sorted(r[0] for r in got) == list(range(1, 8))


def test_documents_of_a_template_are_counted_exactly(spark):
    """Two lines in documents 1, 2, 3 and 1, 4, 5: five documents; with document 3 for 5, four."""
    a, b = "the worker alpha has left the building", "the worker beta has left the building"
    for last, gone in ((5, [2, 3, 4, 5]), (3, [])):
        docs = [(1, f"{a}\n{b}"), (2, a), (3, a), (4, b), (last, b)]
        got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string"), depth=2).where("n_dropped > 0").select("doc_id").collect()
        assert sorted(r[0] for r in got) == gone


def test_cluster_by_hand():
    x = [np.array(v, dtype=np.uint32) for v in ([1, 2, 3, 4], [1, 2, 3, 5], [7, 8, 9, 9], [1, 2, 3, 6])]
    assert line_dedup.cluster(x, 0.7) == [0, 0, 2, 0]


def lines_by_hand(docs, min_docs=5, depth=3, similarity=0.7):
    """Texts after a plain template tree over lists of tokens; only the order of the lines is the operator's."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "row_hash": [0] * len(docs), "text": [t for _, t in docs]})
    mask = {(r["doc_id"], r["line"]): r["mask"] for b in line_dedup._parser(depth, 3)([batch]) for r in b.to_pylist()}
    shape = {}
    for i, t in docs:
        for k, line in enumerate(t.split("\n")):
            w = ["*" if re.search("[0-9]", x) else x for x in WORD.findall(line)]
            if len(w) >= 3:
                shape.setdefault(tuple(w), [mask[i, k], set()])[1].add((i, k))
    leaders, members = {}, {}
    for w in sorted(shape, key=lambda w: shape[w][0]):
        leaf = leaders.setdefault((len(w), w[:depth]), [])
        for x in leaf:
            if sum(a == b or "*" in (a, b) for a, b in zip(w, x, strict=True)) >= similarity * len(w) and 2 * sum(a == b for a, b in zip(w, x, strict=True)) >= similarity * len(w):
                break
        else:
            leaf.append(x := w)
        members.setdefault(x, []).append(w)
    gone = set()
    for group in (*members.values(), *([w] for w in shape)):
        at = set().union(*(shape[w][1] for w in group))
        if len({i for i, _ in at}) >= min_docs:
            gone |= {(i, k) for i, k in at if i > min(at)[0]}
    return {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_equals_brute_force_for_rounds_of_any_size(spark, seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["log", "user", "file", "opened", "by", "at", "x1", "22", *"abcdefgh"])
    base = [[rng.choice(["the log was", "a b c"])] + [word() for _ in range(rng.randint(3, 7))] for _ in range(12)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(1, len(w))] = word()
        return " ".join(w)

    docs = [(i, "\n".join(line() for _ in range(rng.randint(0, 8)))) for i in range(60)]
    want, df = lines_by_hand(docs), spark.createDataFrame(docs, "doc_id long, text string")
    assert sum(want[i] != t for i, t in docs) > 20
    for leaf_lines in (2, 100, 10**6):
        assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df, leaf_lines=leaf_lines).collect()} == want


def test_line_options_do_not_change_clean_texts(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    out = line_dedup.line_dedup(df, min_docs=10**6)
    assert out.where("n_dropped > 0").count() == 0 and out.select(df.columns).exceptAll(df).count() == 0


def spans_by_hand(text):
    found = []
    for k, (kind, p) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and sum((lambda v: v if i % 2 == 0 else 2 * v - 9 * (v > 4))(int(c)) for i, c in enumerate(d[::-1])) % 10 == 0,
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("1234567890.@+-() abé🙂_%"), max_size=80), min_size=30, max_size=30))
def test_personal_data_equals_brute_force(spark, texts):
    texts = [*texts, "a@b.c_d@e.f 1.2.3.4.5.6.7.8", "00255.1.1.1 256.1.1.1 4111-1111 1111 1111 +1 (2) 345-67.890", "12 " * 400]
    got = {r["doc_id"]: r for r in pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(spans_by_hand(t).encode()).hexdigest(), t


def test_checksums_and_context(spark):
    rows = [(0, "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432"), (1, "IBAN DE89 3704 0044 0532 0130 01"), (2, "ssn 123-45-6789"), (3, "part 123-45-6789"), (4, "card 4111111111111111"), (5, "4111111111111112")]
    got = {r["doc_id"]: r for r in pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["n_iban"] for i in (0, 1)] == [2, 0] and [got[i]["n_ssn"] for i in (2, 3)] == [1, 0] and [got[i]["n_card"] for i in (4, 5)] == [1, 0]
    assert got[4]["scores"] == "1.00" and list(PATTERNS)[:4] == ["email", "ip", "card", "phone"]


def test_account_numbers_before_and_after_capitals(spark):
    texts = ["IBAN GB82WEST12345698765432 Please pay", "IBAN DE89370400440532013000 Konto", "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "GB82 WEST 1234 5698 7654 32 DE89 3704 0044 0532 0130 00", "AB12 GB82WEST12345698765432 OK"]
    got = {r["doc_id"]: r for r in pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i]["n_iban"] for i in range(5)] == [1, 1, 1, 2, 1]
    assert "iban:5:32" in got[2]["spans"].split(",")


def test_secrets_equal_brute_force_and_random_strings_are_found(spark, sf):
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    letters = string.ascii_letters + string.digits + "+/"
    for i in range(30):
        rows.append((10_000 + i, f"é see {''.join(rng.choice(letters) for _ in range(44))} there Token: ab.c=d-1234 AKIA{'Z' * 20} {'0a' * 13}"))
    got = {r["doc_id"]: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for i, t in rows:
        s = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        want = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(s))
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert sum(got[10_000 + i]["n_rand"] for i in range(30)) >= 28
    assert sum(r["n_rand"] for i, r in got.items() if i < 10_000) <= 2


def test_few_long_texts_give_enough_decoys(spark):
    rng = random.Random(5)
    words = "the of and water house people through because little another between country should school never".split()
    key = lambda: "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    rows = [(i, " ".join(rng.choices(words, k=4000)) + f" {key()} " + " ".join(rng.choices(words, k=4000))) for i in range(4)]
    got = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_rand"] for r in got) >= 3


def test_statistic_tells_noise_from_text():
    rng = np.random.default_rng(2)
    noise = secrets.statistic(rng.integers(0, 64, size=(500, 40)), 64)
    text = np.array([[secrets.ALPHABETS[3].index(c) for c in ("thequickbrownfoxjumpsoverthelazydogagain" * 2)[i : i + 40]] for i in range(40)])
    assert np.median(noise) < 6 and secrets.statistic(text, 64).min() > np.quantile(noise, 0.95)


def test_false_discovery_step():
    decoys = {(0, b): 10 for b in range(50, 90)}
    assert secrets.thresholds({(0, 5): 20, (0, 80): 20}, decoys, 0.01)[0] < 80
    assert secrets.thresholds({(0, 80): 20}, decoys, 0.01) == {}
    assert secrets.thresholds({}, {}, 0.01) == {}


def patterns_of(votes):
    return (votes * 3 ** np.arange(toxicity.VOTERS)).sum(1)


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.2
    right = np.resize([0.95, 0.9, 0.85, 0.8, 0.75], toxicity.VOTERS)
    votes = np.where(rng.random((20_000, toxicity.VOTERS)) < right, y[:, None], ~y[:, None]) * 2
    patterns, n = np.unique(patterns_of(votes), return_counts=True)
    model = toxicity.LabelModel(patterns, n.astype(float))
    assert model.prior == pytest.approx(0.2, abs=0.05)
    assert np.abs(model.table[1, :, 2] - right).max() < 0.08
    post = dict(zip(patterns, model.posterior(patterns), strict=True))
    assert np.mean([(post[p] > 0.5) == t for p, t in zip(patterns_of(votes), y, strict=True)]) > 0.95


def test_voters_that_copy_each_other_count_once():
    rng = np.random.default_rng(4)
    y = rng.random(20_000) < 0.3
    votes = np.where(rng.random((20_000, toxicity.VOTERS)) < 0.85, y[:, None], ~y[:, None]) * 2
    votes[:, 1] = votes[:, 2] = votes[:, 0]
    patterns, n = np.unique(patterns_of(votes), return_counts=True)
    model = toxicity.LabelModel(patterns, n.astype(float))
    links = {frozenset((j, p)) for j, p in enumerate(model.parent) if p >= 0}
    assert len(links & {frozenset(x) for x in ((0, 1), (1, 2), (0, 2))}) == 2
    flip = lambda *who: patterns_of(np.where(np.isin(np.arange(toxicity.VOTERS), who), 2, 0)[None, :])
    base = model.log_odds(flip())[0]
    assert model.log_odds(flip(0, 1, 2))[0] - base < 1.3 * (model.log_odds(flip(5))[0] - base)


def test_tree_links_what_gains_most():
    gain = np.zeros((4, 4))
    for i, j, g in ((0, 1, 0.1), (1, 2, 0.5), (0, 2, 0.3)):
        gain[i, j] = gain[j, i] = g
    assert toxicity._tree(gain) == [-1, 2, 0, -1]


def test_rows_of_the_smallest_hashes(spark):
    from vecloom.llm._common import smallest

    df = spark.range(20_000).toDF("x")
    for n in (0, 10, 500, 30_000):
        want = sorted(r["x"] for r in sorted(df.selectExpr("x", "xxhash64(x) AS h").collect(), key=lambda r: (r["h"], r["x"]))[:n])
        assert sorted(r["x"] for r in smallest(df, n, 20_000, "x").collect()) == want


def test_pattern_voters():
    lexicon = toxicity.Lexicon([], {})
    texts = ["you are an idiot", "an idiot " + "and more " * 5 + "you", "just shut up now", "shut it up", "THIS IS ALL SHOUTING, DO LISTEN", "no!! no!! no!!", "what a f*ck", "stars*** here", ""]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)
    chunk = toxicity._Chunk(data, offs)
    got = toxicity._patterns(chunk, lexicon, toxicity._hits(chunk, lexicon, len(texts))[4], data, offs)
    assert [np.flatnonzero(x).tolist() for x in got] == [[0], [], [1], [], [2], [2], [3], [], []]


def test_noise_for_votes_ruins_the_classifier(spark, monkeypatch):
    """The classifier learns from the label model's posteriors alone: with posteriors of noise it knows nothing."""
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")

    def auc():
        rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").select("score", "toxic").collect()
        pos, neg = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
        return np.mean([np.mean([(p > q) + 0.5 * (p == q) for q in neg]) for p in pos])

    assert auc() > 0.9
    monkeypatch.setattr(toxicity.LabelModel, "posterior", lambda self, patterns: np.random.default_rng(1).random(len(patterns)))
    assert auc() < 0.75


def test_toxicity_on_held_out_labels(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    pos, neg = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    auc = np.mean([np.mean([(p > q) + 0.5 * (p == q) for q in neg]) for p in pos])
    assert auc > 0.95 and np.mean([r["predicted"] == r["toxic"] for r in rows]) > 0.95


def test_recall_of_the_search(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=float)
    got = {}
    for r in ann.nearest(df, every=50, least=100, block_rows=700).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        want = ids[np.lexsort((ids, d))[:10]]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == pytest.approx(d[ids == m[1]][0], rel=1e-12) for m in mine)
        hit += len({m[1] for m in mine} & set(want.tolist()))
        total += 10
    assert hit / total >= 0.9


@pytest.mark.parametrize("clusters", [0, 20])
def test_recall_on_other_vectors(spark, clusters):
    """Vectors that no parameter was chosen on; in clusters, with one vector in a third of all rows."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 24))
    if clusters:
        x += 6 * rng.normal(size=(clusters, 24))[np.arange(3000) % clusters]
        x[2000:] = x[5]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, block_rows=300, query_rows=16, sample_rows=1000).collect():
        got.setdefault(r["query_id"], []).append(r["score"])
    hit = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        limit = np.partition(d, 9)[9]
        assert len(got[q]) == 10
        hit += sum(s <= limit + 1e-12 for s in got[q])
        total += 10
    assert hit / total >= 0.9


def test_blocks_out_of_reach_hold_no_candidates():
    """What pruning by the ends of the arrays skips has fewer collisions than needed."""
    rng = np.random.default_rng(12)
    x = np.concatenate((rng.normal(size=(300, 8)), 50 + rng.normal(size=(300, 8))))
    fit = ann.Fit(x, 16, 0.75, 0.1, 1, 3)
    leaf = fit.leaf(x @ fit.p)
    assert len(set(leaf[:300])) == len(set(leaf[300:])) == 1 and leaf[0] != leaf[300]
    y, r = x[:5] @ fit.p, fit.radius(x[:5] @ fit.p)
    far = x[300:] @ fit.p
    met = ((y - r[:, None]).min(0) <= far.max(0)) & ((y + r[:, None]).max(0) >= far.min(0))
    assert met.sum() < fit.need and all((np.abs(far - y[i]) <= r[i]).sum(1).max() < fit.need for i in range(5))


def test_sharding_equals_a_plain_deal(spark):
    """The same draws and hashes, dealt out by plain lists."""
    rows = [(i % 90, f"text {i % 7}") for i in range(200)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    n, shards, seed = int(spark.conf.get("spark.sql.shuffle.partitions")), 5, 11
    keyed = df.selectExpr("doc_id", "octet_length(coalesce(text, '')) + 1L AS size", "crc32(coalesce(text, '')) AS text_crc32")
    hashed = keyed.selectExpr("*", *[f"xxhash64('{x}/{seed}', doc_id, text_crc32, size) AS {x}" for x in ("block", "local", "final")]).collect()
    key = lambda r: ((r["doc_id"] is not None, r["doc_id"] or 0), r["text_crc32"], r["size"])
    blocks = {}
    for r in hashed:
        blocks.setdefault(r["block"] % n, []).append(r)
    rng = np.random.default_rng(seed)
    extra = set(rng.permutation(shards)[: len(rows) % shards].tolist())
    matrix = sharding.communication_matrix(rng, [len(blocks[b]) for b in sorted(blocks)], [len(rows) // shards + (j in extra) for j in range(shards)])
    got = [[] for _ in range(shards)]
    for b, share in zip(sorted(blocks), matrix, strict=True):
        deck = sorted(blocks[b], key=lambda r: (r["local"], key(r)))
        for j, k in enumerate(share):
            got[j] += deck[:k]
            deck = deck[k:]
    want = []
    for j, hand in enumerate(got):
        hand.sort(key=lambda r: ((r["final"] % 2**64) >> 33, r["final"], key(r)))
        want += [(r["doc_id"], r["size"], r["text_crc32"], j, at) for at, r in enumerate(hand)]
    out = [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(df, shards, seed).collect()]
    assert sorted(map(str, out)) == sorted(map(str, want))


def battery_by_hand(text, letters):
    """The statistic of secrets, letter by letter."""
    codes, n, size = [letters.index(c) for c in text], len(text), len(letters)

    def chi(cells):
        held, share = [0] * cells, [0] * cells
        for c in codes:
            held[c * cells // size] += 1
        for c in range(size):
            share[c * cells // size] += 1
        x = sum((h - n * s / size) ** 2 / (n * s / size) for h, s in zip(held, share, strict=True)) / (cells - 1)
        v = 2 / (9 * (cells - 1))
        return (x ** (1 / 3) - (1 - v)) / v**0.5

    high = [c >= size / 2 for c in codes]
    a, b = high.count(True), high.count(False)
    mean = 2 * a * b / n + 1
    runs = 1 + sum(x != y for x, y in itertools.pairwise(high))
    z = (runs - mean) / max((mean - 1) * (mean - 2) / (n - 1), 0.25) ** 0.5
    x = [c - sum(codes) / n for c in codes]
    serial = sum(p * q for p, q in itertools.pairwise(x)) / max(sum(p * p for p in x), 1e-9) * n**0.5
    return max(chi(8), 0) ** 2 + max(chi(size), 0) ** 2 + z * z + serial * serial


def test_all_spans_of_secrets_equal_brute_force(spark):
    rng = random.Random(16)
    words = "the of and water house people through because little another between country should school never".split()
    mixed, lower = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", string.ascii_lowercase + string.digits
    rows = []
    for i in range(40):
        w = rng.choices(words, k=250)
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), "".join(rng.choices(mixed, k=rng.randint(20, 70))))
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), "".join(rng.choices(lower, k=rng.randint(20, 40))))
        if i % 5 == 0:
            w += ["password: " + "".join(rng.choices(mixed, k=30)), "é", "12345678901234567890123", "abcdefghijklmnopqrstuvwxyzabcdefghij"]
        rows.append((i, " ".join(w)))
    bin_of = lambda t: min(int(np.log2(1 + t) * 10), secrets.BINS - 1)
    class_of = lambda n: max(k for k, x in enumerate(secrets.CLASSES) if x <= n)
    base, cands, decoys = {}, [], {}
    for i, t in rows:
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base[i] = found
        runs = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_-]+", t) if m.end() - m.start() >= secrets.MIN_RUN]
        for a, b in runs:
            run = t[a:b]
            if any(x < b and y > a for x, _, y in found) or run.isdigit():
                continue
            for e, letters in enumerate(secrets.ALPHABETS):
                same = run if e == 3 else run.lower()
                if (e == 3 or not (any(c.isupper() for c in run) and any(c.islower() for c in run))) and all(c in letters for c in same.replace("-", "+").replace("_", "/")):
                    cands.append((i, a, b, (e, class_of(b - a)), bin_of(battery_by_hand(same.replace("-", "+").replace("_", "/"), letters))))
                    break
        plain = "".join(c for k, c in enumerate(t) if not any(a <= k < b for a, b in runs))
        for e, letters in enumerate(secrets.ALPHABETS):
            flat = plain if e == 3 else plain.lower()
            flat = "".join(c for c in (flat.replace("-", "+").replace("_", "/") if e == 3 else flat) if c in letters)
            for k, n in enumerate(secrets.CLASSES):
                for j in range(len(flat) // n):
                    decoys.setdefault((e, k), []).append(bin_of(battery_by_hand(flat[j * n : (j + 1) * n], letters)))
    p = [(1 + sum(x <= b for x in decoys.get(c, []))) / (1 + len(decoys.get(c, []))) for *_, c, b in cands]
    limit = max([x for x in p if x * len(p) <= 0.01 * sum(y <= x for y in p)], default=0.0)
    want = {i: sorted(found + [(a, 3, b) for (j, a, b, _, _), x in zip(cands, p, strict=True) if j == i and x <= limit]) for i, found in base.items()}
    got = {r["doc_id"]: r["spans"] for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in w) for i, w in want.items()}
    assert sum(k == 3 for w in want.values() for _, k, _ in w) >= 10


def test_all_spans_of_personal_data_equal_brute_force(spark):
    """iban and ssn with their checksums and context, next to the base kinds."""
    rng = random.Random(17)

    def iban(country, n):
        body = "".join(rng.choices(string.digits + "ABCDEF", k=n - 4))
        value = lambda x: int("".join(str(int(c, 36)) for c in x))
        good = f"{country}{98 - value(body + country + '00') % 97:02d}{body}"
        return good if rng.random() < 0.7 else good[:-1] + ("1" if good[-1] != "1" else "2")

    texts = []
    for _ in range(250):
        bits = rng.choices(["my iban is", "konto", "see", "Please Pay", "ssn", "social security", "part", "number", "é\U0001f642", "call", "x" * 50], k=6)
        a = iban(*rng.choice([("DE", 22), ("GB", 22), ("FR", 27), ("NO", 15)]))
        bits.insert(2, a if rng.random() < 0.5 else " ".join(a[k : k + 4] for k in range(0, len(a), 4)))
        bits.insert(4, f"{rng.choice([0, 123, 666, 912]):03d}-{rng.choice([0, 45]):02d}-{rng.choice([0, 6789]):04d}")
        texts.append(" ".join(bits))

    def spans(t):
        found = [(int(x.split(":")[1]), list(PATTERNS).index(x.split(":")[0]), int(x.split(":")[2])) for x in spans_by_hand(t).split(",") if x]
        near = lambda m, kind: f"{t[: m.start()][-40:]} {t[m.end() :][:40]}".lower()
        for m in re.finditer(PATTERNS["iban"], t):
            x = m[0].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1:
                found.append((m.start(), 4, m.end()))  # 0.7 and the checksum pass by themselves
        for m in re.finditer(PATTERNS["ssn"], t):
            x = m[0]
            gap = near(m, "ssn")
            if not (x.startswith(("000", "666", "9")) or x[4:6] == "00" or x[7:] == "0000") and re.search("(?<![a-z])(?:ssn|social|security)", gap):
                found.append((m.start(), 5, m.end()))
        return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(found))

    got = {r["doc_id"]: r for r in pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert got[i]["spans"] == spans(t), t
    assert sum(r["n_iban"] for r in got.values()) > 30 and sum(r["n_ssn"] for r in got.values()) > 5


def test_equal_texts_have_equal_checksums(spark):
    rows = sharding.shard(spark.createDataFrame([(1, "é"), (2, "é")], "doc_id long, text string")).collect()
    assert {(r["size"], r["text_crc32"]) for r in rows} == {(3, zlib.crc32("é".encode()))}
