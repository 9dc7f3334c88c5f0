"""Secrets by patterns and by a battery of randomness tests with false-discovery control.

Base spans come from fixed patterns.  Every other long run of secret-like characters is a candidate: its encoding is
inferred, its characters become numbers of that alphabet, and three tests ask whether they could be uniform noise:
chi-squared uniformity, runs above and below the middle, and serial correlation.  Their z scores add up to one
statistic; small means random.  Ordinary text of the same encoding and length class, all stretches of every document,
gives the law of the statistic for things that are not secrets; from it follow p-values, and the Benjamini-Hochberg
step over all candidates of all documents decides per class which are reported.  To the driver come only histograms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm import _text as T
from vecloom.llm._common import ship, written

# The base kinds, in the order in which equal starts are listed; the method's own kind comes last.
KINDS = ("assign", "access", "hex", "rand")
_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RUN = 6, 20, 24, 20

# Alphabets, narrowest first, and the lengths whose lower bounds divide candidates into classes.
ALPHABETS = ("0123456789abcdef", "abcdefghijklmnopqrstuvwxyz234567", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
CLASSES = (20, 28, 40, 64)
BINS = 96
CHUNK_BYTES = 2 << 20
WINDOWS = 4096  # decoys that are tested at once

_CODE = np.full((len(ALPHABETS), 256), -1, dtype=np.int16)
for _i, _a in enumerate(ALPHABETS):
    for _j, _c in enumerate(_a):
        _CODE[_i, ord(_c)] = _j
        if _i < 3 and _c.isalpha():
            _CODE[_i, ord(_c.upper())] = _j
_CODE[3, ord("-")], _CODE[3, ord("_")] = 62, 63
_HEX = np.zeros(256, dtype=bool)
_HEX[48:58] = _HEX[97:103] = True
_RUN = _CODE[3] >= 0
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True


def uniformity(codes: np.ndarray, size: int, cells: int) -> np.ndarray:
    """z score (Wilson-Hilferty) of the chi-squared test of each row over `cells` equal stretches of the alphabet."""
    n = codes.shape[1]
    rows = np.arange(len(codes))[:, None]
    counts = np.bincount((rows * cells + codes * cells // size).ravel(), minlength=len(codes) * cells).reshape(-1, cells)
    share = np.bincount(np.arange(size) * cells // size, minlength=cells) / size
    df = cells - 1
    chi = (counts * counts) @ (1 / (n * share)) - n
    return (np.cbrt(chi / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))


def statistic(codes: np.ndarray, size: int) -> np.ndarray:
    """Battery statistic of each row of a matrix of numbers below `size`: a sum of squared z scores.

    Uniformity counts twice: letter by letter, and over eight stretches of the alphabet, which short strings fill.
    """
    n = codes.shape[1]
    z0, z1 = uniformity(codes, size, 8), uniformity(codes, size, size)
    high = codes >= size / 2
    a = high.sum(1).astype(float)
    b = n - a
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    mean = 2 * a * b / n + 1
    var = np.maximum((mean - 1) * (mean - 2) / (n - 1), 0.25)
    z2 = (runs - mean) / np.sqrt(var)
    x = codes - codes.mean(1, keepdims=True)
    power = np.maximum((x * x).sum(1), 1e-9)
    z3 = (x[:, 1:] * x[:, :-1]).sum(1) / power * np.sqrt(n)
    return np.maximum(z0, 0) ** 2 + np.maximum(z1, 0) ** 2 + z2**2 + z3**2


def bins(t: np.ndarray) -> np.ndarray:
    return np.minimum((np.log2(1 + t) * 10).astype(np.int64), BINS - 1)


def _class(length: int) -> int:
    return int(np.searchsorted(CLASSES, length, side="right")) - 1


def _runs(mask: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True of at least `least`, not across texts."""
    edge = np.zeros(len(mask) + 1, dtype=bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    edge[offs] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    keep = mask[start] & (end - start >= least) if len(start) else np.zeros(0, dtype=bool)
    return start[keep], end[keep]


def _candidate(run: np.ndarray) -> tuple[int, int] | None:
    """(encoding, bin) of a run of secret-like characters; None for plain numbers."""
    if _DIGIT[run].all():
        return None
    upper, lower = ((run >= 65) & (run <= 90)).any(), ((run >= 97) & (run <= 122)).any()
    for e in range(len(ALPHABETS)):
        if e < 3 and upper and lower:
            continue
        codes = _CODE[e][run]
        if (codes >= 0).all():
            return e, int(bins(statistic(codes[None, :].astype(np.int64), len(ALPHABETS[e])))[0])
    return None


def _decoys(data: np.ndarray, offs: np.ndarray, long_runs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Histogram (encoding x class, bin) of the statistic over ordinary text: successive windows over the characters of
    the encoding of each text, run together, without the runs that may be secrets themselves.
    """
    inside = np.zeros(len(data) + 1, dtype=np.int32)
    np.add.at(inside, long_runs[0], 1)
    np.add.at(inside, long_runs[1], -1)
    ordinary = np.cumsum(inside[:-1]) == 0
    out = np.zeros((len(ALPHABETS) * len(CLASSES), BINS), dtype=np.int64)
    for e, letters in enumerate(ALPHABETS):
        codes = _CODE[e][data]
        at = np.flatnonzero((codes >= 0) & ordinary)
        first = np.searchsorted(at, offs)
        for c, n in enumerate(CLASSES):
            many = np.diff(first) // n
            start = np.repeat(first[:-1], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * n
            for k in range(0, len(start), WINDOWS):
                rows = codes[at[start[k : k + WINDOWS, None] + np.arange(n)]].astype(np.int64)
                out[e * len(CLASSES) + c] += np.bincount(bins(statistic(rows, len(letters))), minlength=BINS)
    return out


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_CAND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cls", pa.int32()), ("bin", pa.int32())])
_HIST = pa.struct([("cls", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offs in T.chunks(batch, "text", CHUNK_BYTES):
            n, raw = hi - lo, data.tobytes()
            spans: list[list[dict]] = [[] for _ in range(n)]
            found: list[tuple[int, int, int]] = []  # byte start, kind, byte end
            low = raw.lower()
            texts = set()
            for word in _WORDS:
                at = low.find(word)
                while at >= 0:
                    i = int(np.searchsorted(offs, at, side="right")) - 1
                    texts.add(i)
                    at = low.find(word, int(offs[i + 1])) if at + len(word) <= offs[i + 1] else low.find(word, at + 1)
            for i in texts:
                a, b = int(offs[i]), int(offs[i + 1])
                found += [(a + m.start(), 0, a + m.end()) for m in _ASSIGN.finditer(raw[a:b]) if len(m[1]) >= MIN_ASSIGN]
            at = raw.find(b"AKIA")
            while at >= 0:
                i = int(np.searchsorted(offs, at, side="right")) - 1
                a, b = int(offs[i]), int(offs[i + 1])
                found += [(a + m.start(), 1, a + m.end()) for m in _ACCESS.finditer(raw[a:b]) if m.end() - m.start() >= MIN_ACCESS]
                at = raw.find(b"AKIA", max(b, at + 1))
            for a, b in zip(*_runs(_HEX[data], offs, MIN_HEX), strict=True) if len(data) else ():
                found.append((int(a), 2, int(b)))
            found.sort()
            chars = T.char_starts(data)
            base = np.array([(a, b) for a, _, b in found], dtype=np.int64).reshape(-1, 2)
            for a, kind, b in found:
                i = int(np.searchsorted(offs, a, side="right")) - 1
                zero = chars[offs[i]]
                spans[i].append({"start": int(chars[a] - zero), "kind": kind, "end": int(chars[b] - zero)})
            cands: list[list[dict]] = [[] for _ in range(n)]
            reach = np.maximum.accumulate(base[:, 1]) if len(base) else base[:, 1]
            none = np.zeros(0, dtype=np.int64)
            runs = _runs(_RUN[data], offs, MIN_RUN) if len(data) else (none, none)
            for a, b in zip(*runs, strict=True):
                j = int(np.searchsorted(base[:, 0], b)) - 1  # base spans that start before its end
                if j >= 0 and reach[j] > a:
                    continue
                c = _candidate(data[a:b])
                if c:
                    i = int(np.searchsorted(offs, a, side="right")) - 1
                    zero = chars[offs[i]]
                    cands[i].append({"start": int(chars[a] - zero), "end": int(chars[b] - zero), "cls": c[0] * len(CLASSES) + _class(int(b - a)), "bin": c[1]})
            h = _decoys(data, offs, runs)
            hist: list[list[dict]] = [[] for _ in range(n)]
            hist[0] = [{"cls": int(c), "bin": int(b), "n": int(h[c, b])} for c, b in zip(*np.nonzero(h), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, n), pa.array(spans, type=pa.list_(_SPAN)), pa.array(cands, type=pa.list_(_CAND)), pa.array(hist, type=pa.list_(_HIST))], names=["doc_id", "spans", "cands", "hist"]
            )


def thresholds(candidates: dict[tuple[int, int], int], decoys: dict[tuple[int, int], int], rate: float) -> dict[int, int]:
    """Largest bin per class that the Benjamini-Hochberg step at `rate` reports."""
    below = np.zeros((len(ALPHABETS) * len(CLASSES), BINS))
    for (c, b), n in decoys.items():
        below[c, b] += n
    p = (1 + np.cumsum(below, axis=1)) / (1 + below.sum(axis=1, keepdims=True))
    ranked = sorted((float(p[c, b]), n) for (c, b), n in candidates.items())
    total, seen, limit = sum(candidates.values()), 0, 0.0
    for value, n in ranked:
        seen += n
        if value * total <= rate * seen:
            limit = value
    return {int(c): int(np.flatnonzero(p[c] <= limit).max()) for c in range(len(p)) if (p[c] <= limit).any()}


def secrets(docs: DataFrame, rate: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_rand of each row of docs(doc_id, text, ...).

    rate is the expected share of false reports among the spans of kind rand, which never overlap base spans.

    Defined cases: null text is empty and has no spans; null and repeated doc_ids are rows like all others; the
    smallest p-value of a class is one by its decoys and one, so below about 1 / rate decoys, or more where candidates
    are many, nothing of that class is reported.  Other columns of docs are ignored, whatever their names.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "doc_id long, spans array<struct<start:int,kind:int,end:int>>, cands array<struct<start:int,end:int,cls:int,bin:int>>, hist array<struct<cls:int,bin:int,n:bigint>>"
    seen = written(texts.mapInArrow(_find, kinds), "secrets")
    decoys = {(r[0], r[1]): r[2] for r in seen.select(F.inline("hist")).groupBy("cls", "bin").agg(F.sum("n")).collect()}
    cands = {(r[0], r[1]): r[2] for r in seen.select(F.inline("cands")).groupBy("cls", "bin").agg(F.count(F.lit(1))).collect()}
    limit = thresholds(cands, decoys, rate)
    limits = F.array(*[F.lit(limit.get(c, -1)) for c in range(len(ALPHABETS) * len(CLASSES))])
    extra = F.transform(F.filter("cands", lambda c: c["bin"] <= F.get(limits, c["cls"])), lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("rand")).alias("kind"), c["end"].alias("end")))
    names = F.array(*map(F.lit, KINDS))
    word = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    count = lambda a, i: F.size(F.filter(a, lambda s: s["kind"] == i)).cast("long")
    return seen.select(
        "doc_id",
        *[count("spans", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(F.array_join(F.transform("spans", word), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(F.concat("spans", extra)), word), ",").alias("spans"),
        F.size(extra).cast("long").alias("n_rand"),
    )
