"""Toxicity by weak supervision.

1. Lexicons are mined from a bounded sample of labelled documents: words and word beginnings (4 to 8 bytes), each at
   the levels "occurs", "occurs twice", "occurs four times", by their chi-squared association with the label.
2. Voters vote toxic, clean or abstain on every document of the table.  Lexicon voters: a fixed lexicon, and one mined
   lexicon per length of beginning, by the likelihood ratio of its hits for the document's length, so long texts are no
   more suspect than short ones.  Pattern voters: a suspect word beside a second person, abusive phrases, shouting,
   and words masked by symbols.
3. A generative label model is fitted by EM on the counts of all vote patterns of all documents.  Within a class the
   votes form a tree, the one of most mutual information: so it estimates each voter's accuracy, and which voters agree
   beyond what the class explains.  Labels calibrate it: labelled patterns are pseudo-counts of the voters' tables.
4. A logistic regression over the mined indicators and the likelihood ratios is trained on the model's posteriors of a
   bounded sample of documents, labelled or not, and scores every document.  A document's own label is no target.

The full texts are read once for 2 and 4 together: what a document holds of the mined features is a few bytes.  To the
driver come the mined features (at most `max_features`), the pattern counts (3 ** voters at most) and the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm._common import ship, smallest, written

# Common insults of four languages, lower case.
LEXICON = (
    "idiot idiots moron morons stupid trash loser losers scum pathetic worthless disgusting clown dumb imbecile fool jerk "
    "idiota imbécil estúpido estúpida basura escoria patético asqueroso payaso "
    "imbécile crétin débile ordure minable dégoûtant abruti "
    "dumm dummkopf trottel abschaum erbärmlich widerlich versager idioten"
).split()
# Words for the person spoken to, and two-word abuse, lower case.
SECOND_PERSON = "you your yours yourself u ur tu tus te ti eres usted toi ton tes vous votre du dein deine dich dir bist".split()
PHRASES = ["shut up", "hate you", "kill yourself", "go die", "screw you", "drop dead", "te odio", "vete a", "ta gueule", "ferme la", "halt die", "hasse dich", "verpiss dich"]
LENGTHS = (4, 5, 6, 7, 8, 0)  # bytes of a word's beginning; 0: the whole word
LEVELS = (1, 2, 4)
PATTERN_VOTERS = 4
VOTERS = 1 + PATTERN_VOTERS + len(LENGTHS)
DENSE = len(LENGTHS) + 3 + PATTERN_VOTERS
CELLS = ("pos0", "neg0", "pos1", "neg1")  # toxic and clean documents of either half of the sample
#: Words between a second person and the suspect word beside it, at most.
REACH = 3

_LETTERS_ONLY = np.ones(256, dtype=bool)
_LETTERS_ONLY[65:91] = _LETTERS_ONLY[97:123] = False
_LETTERS_ONLY[128:] = False


class _Chunk:
    """Distinct words of a chunk, where they occur, and the hashes of their beginnings."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.words = w = T.Words(T.lowered(data), offs, separator=_LETTERS_ONLY)
        prefix = w.prefix()
        self.unique, first, self.inverse = np.unique(T.span_hashes(prefix, w.start, w.end), return_index=True, return_inverse=True)
        start, size = w.start[first], (w.end - w.start)[first]
        self.features = np.empty((len(LENGTHS), len(self.unique)), dtype=np.uint64)
        for k, n in enumerate(LENGTHS):
            h = T.span_hashes(prefix, start, start + np.minimum(size, n)) if n else self.unique
            h = T.mix(h ^ np.uint64(n + 1))
            h[size <= n] = 0  # a beginning is shorter than its word
            self.features[k] = h

    def counts(self, k: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, feature hash or index in wanted, occurrences) of beginnings of one length."""
        f = self.features[k]
        if wanted is None:
            code = np.where(f != 0, np.arange(len(f)), -1)
        else:
            at = np.minimum(np.searchsorted(wanted, f), max(0, len(wanted) - 1))
            code = np.where((wanted[at] == f) & (f != 0), at, -1) if len(wanted) else np.full(len(f), -1)
        c = code[self.inverse]
        hit = np.flatnonzero(c >= 0)
        if wanted is None:
            _, same = np.unique(f, return_inverse=True)
            c = same[c[hit]] if len(hit) else c[hit]
            values = np.unique(f)
        else:
            c = c[hit]
        key, n = np.unique(self.words.doc[hit] * np.int64(1 << 32) + c, return_counts=True)
        doc, c = key >> 32, key & ((1 << 32) - 1)
        return doc, (values[c] if wanted is None else c), n


def _mined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, feature, level, toxic and clean documents of either half) of each chunk of labelled texts."""
    for batch in batches:
        toxic, half = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "half"))
        for lo, hi, data, offs in T.chunks(batch, "text"):
            chunk, cell = _Chunk(data, offs), (2 * half + 1 - toxic)[lo:hi]
            for k in range(len(LENGTHS)):
                doc, f, n = chunk.counts(k, None)
                for level in LEVELS:
                    m = n >= level
                    u, inv = np.unique(f[m], return_inverse=True)
                    count = np.bincount(4 * inv + cell[doc[m]], minlength=4 * len(u)).reshape(len(u), 4)
                    flat = [pa.array(np.full(len(u), x, dtype=np.int32)) for x in (k, level)]
                    yield pa.RecordBatch.from_arrays([flat[0], pa.array(u.view(np.int64)), flat[1], *(pa.array(x) for x in count.T.copy())], names=["k", "feature", "level", *CELLS])


class Lexicon:
    """The mined indicators, and which of them vote."""

    def __init__(self, rows: list, sizes: dict[tuple[int, int], int]):
        self.base = [np.unique(np.array([r["feature"] for r in rows if r["k"] == k], dtype=np.int64).view(np.uint64)) for k in range(len(LENGTHS))]
        self.item: dict[tuple[int, int, int], int] = {}
        self.votes = [np.zeros(len(b), dtype=bool) for b in self.base]
        for i, r in enumerate(rows):
            at = int(np.searchsorted(self.base[r["k"]], np.array([r["feature"]], dtype=np.int64).view(np.uint64))[0])
            self.item[r["k"], at, r["level"]] = i
            lifts = [((r[f"pos{h}"] + 0.5) / (sizes.get((h, 1), 0) + 1)) / ((r[f"neg{h}"] + 0.5) / (sizes.get((h, 0), 0) + 1)) for h in (0, 1)]
            if min(lifts) >= 5:
                self.votes[r["k"]][at] = True
        self.size = len(rows)
        self.fixed, self.persons = (np.unique(np.array([T.hash_of(w.encode()) for w in x], dtype=np.uint64)) for x in (LEXICON, SECOND_PERSON))
        self.phrases = np.unique(_couples(np.array([[T.hash_of(w.encode()) for w in x.split()] for x in PHRASES], dtype=np.uint64).T))
        self.table = [np.full((len(b), len(LEVELS)), -1, dtype=np.int64) for b in self.base]
        for (k, at, level), i in self.item.items():
            self.table[k][at, LEVELS.index(level)] = i


def _couples(words: np.ndarray) -> np.ndarray:
    """Hash of each pair of words: words[0] and words[1] position by position."""
    return T.mix(words[0] * np.uint64(0x9E3779B97F4A7C15) ^ T.mix(words[1]))


def _hits(chunk: _Chunk, lexicon: Lexicon, n: int):
    """Per text: hits of the fixed lexicon and of each mined one (texts x lexicons), the active indicators, and per word
    whether any lexicon suspects it."""
    known = np.isin(chunk.unique, lexicon.fixed)[chunk.inverse]
    fixed = np.bincount(chunk.words.doc[known], minlength=n)
    mined, docs, items, suspect = np.zeros((n, len(LENGTHS))), [], [], known
    for k in range(len(LENGTHS)):
        doc, f, c = chunk.counts(k, lexicon.base[k])
        said = lexicon.votes[k][f] if len(f) else np.zeros(0, dtype=bool)
        mined[:, k] = np.bincount(doc[said], weights=c[said], minlength=n)
        suspect = suspect | np.isin(chunk.features[k], lexicon.base[k][lexicon.votes[k]])[chunk.inverse]
        for j, level in enumerate(LEVELS):
            item = lexicon.table[k][f, j] if len(f) else np.zeros(0, dtype=np.int64)
            m = (item >= 0) & (c >= level)
            docs.append(doc[m])
            items.append(item[m])
    return fixed, mined, np.concatenate(docs), np.concatenate(items), suspect


def _patterns(chunk: _Chunk, lexicon: Lexicon, suspect: np.ndarray, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Texts x pattern voters: does a text hold a suspect word beside a second person, an abusive phrase, shouting, masked words?"""
    n, w = len(offs) - 1, chunk.words
    out = np.zeros((n, PATTERN_VOTERS), dtype=bool)
    person = np.flatnonzero(np.isin(chunk.unique, lexicon.persons)[chunk.inverse])
    bad = np.flatnonzero(suspect)
    if len(person) and len(bad):
        at = np.searchsorted(person, bad)
        for near in (person[np.minimum(at, len(person) - 1)], person[np.maximum(at - 1, 0)]):
            hit = (np.abs(near - bad) <= REACH) & (w.doc[near] == w.doc[bad])
            out[w.doc[bad[hit]], 0] = True
    if len(w) > 1:
        h = chunk.unique[chunk.inverse]
        hit = np.flatnonzero(np.isin(_couples(np.stack((h[:-1], h[1:]))), lexicon.phrases) & (w.doc[:-1] == w.doc[1:]))
        out[w.doc[hit], 1] = True
    upper, letter, mark, mask = (data >= 65) & (data <= 90), ~_LETTERS_ONLY[data], data == 0x21, np.isin(data, [0x2A, 0x40, 0x24])
    sums = [np.concatenate(([0], np.cumsum(x)))[offs] for x in (upper, letter, np.append(mark[:-1] & mark[1:], False) if len(data) else mark)]
    capitals, letters, marks = (np.diff(x) for x in sums)
    out[:, 2] = ((letters >= 20) & (capitals > 0.6 * letters)) | (marks >= 3)
    if len(data) > 2:
        inner = np.flatnonzero(mask[1:-1] & letter[:-2] & letter[2:]) + 1
        text = np.searchsorted(offs, inner, side="right") - 1
        out[text[(inner > offs[text]) & (inner + 1 < offs[text + 1])], 3] = True
    return out


def _counter(lexicon: Lexicon):
    """toxic, n_words, hits of each labelled text: what the rates come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in T.chunks(batch, "text"):
                chunk = _Chunk(data, offs)
                mined = _hits(chunk, lexicon, hi - lo)[1]
                cols = [batch.column("toxic").slice(lo, hi - lo), pa.array(chunk.words.per_doc)] + [pa.array(mined[:, k].astype(np.int64)) for k in range(len(LENGTHS))]
                yield pa.RecordBatch.from_arrays(cols, names=["toxic", "n_words", *[f"h{k}" for k in range(len(LENGTHS))]])

    return run


def ratios(hits: np.ndarray, words: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of toxic against clean for Poisson hits; rates: (toxic, clean) per word of each lexicon."""
    return hits * np.log(rates[0] / rates[1]) - words[:, None] * (rates[0] - rates[1])


def _reader(lexicon: Lexicon, rates: np.ndarray):
    """doc_id, held_out, vote pattern, active indicators and dense features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in T.chunks(batch, "text"):
                n, chunk = hi - lo, _Chunk(data, offs)
                words = chunk.words.per_doc
                fixed, mined, d, i, suspect = _hits(chunk, lexicon, n)
                seen = _patterns(chunk, lexicon, suspect, data, offs)
                llr = ratios(mined, words, rates)
                votes = [np.where(fixed >= 1, 2, 1)] + [np.where(x, 2, 1) for x in seen.T] + [np.where(x > 1, 2, np.where(x < -1, 0, 1)) for x in llr.T]
                pattern = sum(v * 3**j for j, v in enumerate(votes))
                dense = np.column_stack((np.log1p(words) / 10, np.minimum(100 * fixed / np.maximum(words, 1), 5), np.clip(llr, -10, 10) / 5, np.clip(llr.mean(axis=1), -10, 10) / 5, seen))
                order = np.argsort(d, kind="stable")
                i = i[order].astype("<u2")
                edge = np.searchsorted(d[order], np.arange(n + 1))
                raw = [i[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(lo, n) for c in ("doc_id", "held_out", "row_hash")), pa.array(pattern.astype(np.int32)), pa.array(raw, type=pa.binary()), pa.array([x.tobytes() for x in dense.astype("<f4")], type=pa.binary())],
                    names=["doc_id", "held_out", "row_hash", "pattern", "items", "dense"],
                )

    return run


def _tree(gain: np.ndarray) -> list[int]:
    """Parent of each voter in a spanning tree of most gain, grown from voter 0; -1 where nothing is gained."""
    n = len(gain)
    parent, best = [-1] * n, gain[0].copy()
    link, left = np.zeros(n, dtype=int), set(range(1, n))
    while left:
        j = max(left, key=lambda x: (best[x], -x))
        left.remove(j)
        parent[j] = int(link[j]) if best[j] > 1e-4 else -1
        closer = gain[j] > best
        best, link = np.where(closer, gain[j], best), np.where(closer, j, link)
    return parent


class LabelModel:
    """Class prior, voters' vote tables per class and the tree of their dependences, from pattern counts, by EM.

    known: counts of the patterns among labelled documents, clean and toxic; they calibrate the tables, not the prior.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, rounds: int = 40, anchor: float = 2.0):
        votes = self.split(patterns)
        self._hot = (votes[:, :, None] == np.arange(3)).reshape(len(votes), 3 * VOTERS).astype(float)
        w, known = np.asarray(counts, dtype=float), np.zeros((2, len(votes))) if known is None else known
        if known.sum(1).all():
            self.prior = 0.1
            self._fit(known)
            q = self.posterior(patterns)
        else:
            toxic, clean = (votes == 2).sum(1), (votes == 0).sum(1)
            q = np.where(toxic > clean, 0.9, 0.02)
        for _ in range(rounds):
            self.prior = float(np.clip((w * q).sum() / max(1.0, w.sum()), 1e-4, 0.6))
            free = np.stack((w * (1 - q), w * q))
            self._fit(free + known * (anchor * free.sum(1) / np.maximum(known.sum(1), 1))[:, None])
            q = self.posterior(patterns)

    def _fit(self, weight: np.ndarray) -> None:
        """weight: clean and toxic count of each pattern."""
        pairs, gain = [], np.zeros((VOTERS, VOTERS))
        for p in weight:
            joint = (self._hot.T * p) @ self._hot
            pairs.append(joint.reshape(VOTERS, 3, VOTERS, 3).transpose(0, 2, 1, 3))
            share = (pairs[-1] + 0.01) / (pairs[-1] + 0.01).sum((2, 3), keepdims=True)
            product = share.sum(3, keepdims=True) * share.sum(2, keepdims=True)
            gain += p.sum() / max(1e-9, weight.sum()) * (share * np.log(share / product)).sum((2, 3))
        np.fill_diagonal(gain, 0)
        self.dependence, self.parent = gain, _tree(gain)
        self.table = np.empty((2, VOTERS, 3))  # P(vote | class)
        self.given = np.empty((2, VOTERS, 3, 3))  # P(vote | parent's vote, class)
        for y in (0, 1):
            for j in range(VOTERS):
                alone = np.diag(pairs[y][j, j]) + 0.1
                self.table[y, j] = alone / alone.sum()
                # Few joint counts say little: each row leans on the voter's own table.
                rows = pairs[y][self.parent[j], j] if self.parent[j] >= 0 else np.zeros((3, 3))
                self.given[y, j] = (rows + 5 * self.table[y, j]) / (rows.sum(1, keepdims=True) + 5)

    @staticmethod
    def split(patterns: np.ndarray) -> np.ndarray:
        return (np.asarray(patterns)[:, None] // 3 ** np.arange(VOTERS)) % 3

    def log_odds(self, patterns: np.ndarray) -> np.ndarray:
        votes, out = self.split(patterns), np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        ratio = np.log(self.given[1] / self.given[0])
        for j in range(VOTERS):
            out += ratio[j, votes[:, self.parent[j]] if self.parent[j] >= 0 else 0, votes[:, j]]
        return out

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(patterns), -30, 30)))


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<f4").reshape(len(raw), DENSE).astype(float)


def _train(rows: list[np.ndarray], dense: np.ndarray, target: np.ndarray, size: int, weight: np.ndarray | None = None, rounds: int = 400, decay: float = 5e-4) -> np.ndarray:
    """Weights of the indicators, then of the dense features, then the intercept: logistic loss against soft targets."""
    length = np.array([len(r) for r in rows])
    flat, row = np.concatenate([*rows, np.zeros(0, dtype=np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), length)
    weight = np.ones(len(rows)) if weight is None else weight
    n, d = max(1e-9, weight.sum()), dense.shape[1]
    w, m, v = np.zeros(size + d + 1), np.zeros(size + d + 1), np.zeros(size + d + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(row, weights=w[flat], minlength=len(rows)) + dense @ w[size : size + d] + w[-1]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        g = np.concatenate((np.bincount(flat, weights=e[row], minlength=size), e @ dense, [e.sum()])) / n
        g[:size] += decay * w[:size]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def _scorer(weights: np.ndarray):
    size = len(weights) - 1 - DENSE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [np.frombuffer(x, dtype="<u2") for x in batch.column("items").to_pylist()]
            row = np.repeat(np.arange(len(items)), [len(x) for x in items])
            flat = np.concatenate([*items, np.zeros(0, dtype="<u2")]).astype(np.int64)
            z = np.bincount(row, weights=weights[flat], minlength=len(items)) + _matrix(batch.column("dense").to_pylist()) @ weights[size:-1] + weights[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), batch.column("row_hash")], names=["doc_id", "held_out", "score", "predicted", "row_hash"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, max_features: int = 4096, min_toxic: int = 4, max_train: int = 12_000) -> DataFrame:
    """doc_id, held_out, score, predicted, row_hash (xxhash64 of the text) of each row of docs(doc_id, text, ...).

    labels(doc_id, toxic) are read only where crc32(doc_id) mod 5 is not 0.  Lexicons and the voters' calibration come
    from at most `max_labelled` of them, those of the smallest xxhash64(doc_id), half of each class where there are
    enough.  The label model covers the votes of the whole table.  The classifier is fitted on the posteriors of at most
    `max_train` documents that are not held out: half from either side of 0.5, weighted back to all.

    Defined cases: null and empty texts have no words and get the score of such texts; null labels are no labels; a
    doc_id labelled twice is toxic if any of its labels is; null doc_ids are scored, never learned from, and not held
    out; repeated rows are scored row by row.  Without toxic labels nothing is mined and the fixed voters decide
    alone; a table in which none of them votes toxic has low scores only.  Other columns are ignored,
    whatever their names.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    positive = min(totals.get(1, 0), max(max_labelled // 2, max_labelled - totals.get(0, 0)))
    negative = min(totals.get(0, 0), max_labelled - positive)
    first = lambda y, n: smallest(known.where(F.col("toxic") == y), n, totals.get(y, 0), "doc_id")
    sample = written(first(1, positive).unionByName(first(0, negative)), "toxic-sample")
    labelled = written(texts.join(F.broadcast(sample), "doc_id"), "toxic-texts")  # sample: max_labelled rows of two numbers at most
    # A word votes only if it says the same in two halves of the sample: one that came in by chance does not.
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int")
    sizes = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy(half.alias("half"), "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = labelled.select("text", "toxic", half.alias("half")).mapInArrow(_mined, "k int, feature long, level int, " + ", ".join(f"{c} long" for c in CELLS))
    found = found.groupBy("k", "feature", "level").agg(*[F.sum(c).alias(c) for c in CELLS])
    found = found.withColumns({"pos": F.col("pos0") + F.col("pos1"), "neg": F.col("neg0") + F.col("neg1")})
    total = positive + negative
    a, b, c, d = F.col("pos"), F.col("neg"), positive - F.col("pos"), negative - F.col("neg")
    chi = total * (a * d - b * c) * (a * d - b * c).cast("double") / F.greatest(F.lit(1.0), (a + b).cast("double") * (c + d) * float(max(1, positive)) * float(max(1, negative)))
    best = found.where((F.col("pos") >= min_toxic) & (a * negative > b * positive)).withColumn("chi", chi).orderBy(F.desc("chi"), "k", "feature", "level").limit(max_features)
    lexicon = Lexicon(best.collect(), sizes)

    names = [f"h{k}" for k in range(len(LENGTHS))]
    sums = labelled.select("text", "toxic").mapInArrow(_counter(lexicon), "toxic int, n_words long, " + ", ".join(f"{x} long" for x in names))
    by_class = {r["toxic"]: r for r in sums.groupBy("toxic").agg(*[F.sum(x).alias(x) for x in ("n_words", *names)]).collect()}
    rates = np.array([[(by_class[y][x] + 0.5) / (by_class[y]["n_words"] + 1000) if y in by_class else 1e-3 for x in names] for y in (1, 0)])

    kinds = "doc_id long, held_out boolean, row_hash long, pattern int, items binary, dense binary"
    seen = written(texts.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), F.xxhash64("text").alias("row_hash")).mapInArrow(_reader(lexicon, rates), kinds), "toxic-votes")
    counts = seen.join(F.broadcast(sample), "doc_id", "left").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).orderBy("pattern").collect()
    weights = np.concatenate((np.zeros(lexicon.size + DENSE), [-30.0]))
    if counts:
        patterns = np.array([r["pattern"] for r in counts], dtype=np.int64)
        model = LabelModel(patterns, np.array([r["n"] for r in counts], dtype=float), np.array([[r["clean"] for r in counts], [r["toxic"] for r in counts]], dtype=float))
        judged = spark.createDataFrame([(int(p), float(q)) for p, q in zip(patterns, model.posterior(patterns), strict=True)], "pattern int, target double")
        open_ = seen.where(~F.col("held_out") & F.col("doc_id").isNotNull()).join(F.broadcast(judged), "pattern")  # 3 ** voters rows of two numbers at most
        rows, weight = [], []
        for side in (F.col("target") >= 0.5, F.col("target") < 0.5):
            part = open_.where(side)
            there = part.count()
            got = smallest(part, max_train // 2, there, "doc_id", "items", "dense").select("items", "dense", "target").collect()
            rows += got
            weight += [there / len(got)] * len(got) if got else []
        if rows:
            items, dense = [np.frombuffer(r["items"], dtype="<u2") for r in rows], _matrix([r["dense"] for r in rows])
            weights = _train(items, dense, np.array([r["target"] for r in rows]), lexicon.size, np.array(weight))
    return seen.mapInArrow(_scorer(weights), "doc_id long, held_out boolean, score double, predicted int, row_hash long")
