"""Vectorised word and n-gram hashing over Arrow string batches.

Every function works on whole batches: the UTF-8 bytes of all texts of a chunk lie in one NumPy array and words are
found, hashed and combined without a Python loop over words.  A word is a maximal run of bytes other than space and
TAB..CR, i.e. ``[^\\x20\\x09-\\x0D]+``; words never cross texts.  Hashes depend on nothing but the bytes, so they are
the same in every process and may be stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Kernels hold up to 100 bytes for each byte of a chunk, and a worker keeps what it once took.
CHUNK_BYTES = 512 << 10
#: Powers that a worker keeps: those for chunks of 1 MB.
_KEPT = 2 << 20

_GOLD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _split_mix(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers (splitmix64 stream)."""
    x = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD)) + np.uint64(seed)
    return mix(x)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: a bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = _split_mix(256, 0x5EED)
_B = 0x9DDFEA08EB382D69 | 1
_Q = 0xC2B2AE3D27D4EB4F | 1
_R = 0x165667B19E3779F9 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and U+00C0..U+00DE in lower case, on UTF-8 bytes."""
    out = LOWER[data]
    if len(out) > 1:
        high = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][high] |= 0x20
    return out


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        m = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(m, np.uint64(b))
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if m <= _KEPT:
            _powers[base] = have
    return have


def _utf8(column: pa.Array) -> pa.Array:
    if pa.types.is_large_string(column.type):
        return column
    return column.cast(pa.large_string())


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of slices whose texts hold about `size` bytes; a null text is empty."""
    texts = _utf8(batch.column(batch.schema.get_field_index(column)))
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offs = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + 1 + texts.offset)[texts.offset :]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """The words of a chunk: byte ranges, the text each belongs to, and (lazily) 64-bit hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, lower: bool = False, separator: np.ndarray = SEPARATOR):
        self.data = LOWER[data] if lower else data
        self.offs = offs
        n = len(data)
        if not n:
            self.start = self.end = self.doc = np.zeros(0, dtype=np.int64)
        else:
            solid = ~separator[self.data]
            edge = solid.copy()
            edge[1:] &= ~solid[:-1]
            first = offs[:-1][offs[:-1] < offs[1:]]
            edge[first] = solid[first]
            self.start = np.flatnonzero(edge)
            edge = solid.copy()
            edge[:-1] &= ~solid[1:]
            last = offs[1:][offs[:-1] < offs[1:]] - 1
            edge[last] = solid[last]
            self.end = np.flatnonzero(edge) + 1
            self.doc = np.searchsorted(offs, self.start, side="right") - 1
        self.per_doc = np.bincount(self.doc, minlength=len(offs) - 1).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.per_doc)))

    def __len__(self) -> int:
        return len(self.start)

    def prefix(self) -> np.ndarray:
        """H with H[j] - H[i] = sum of byte codes i..j-1 times B**position."""
        n = len(self.data)
        h = np.zeros(n + 1, dtype=np.uint64)
        v = _BYTE[self.data]
        v *= powers(_B, n)[0][:n]
        np.cumsum(v, out=h[1:])
        return h

    def hashes(self) -> np.ndarray:
        return span_hashes(self.prefix(), self.start, self.end)


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range, from Words.prefix()."""
    h = prefix[end] - prefix[start]
    h *= powers(_B, len(prefix))[1][start]
    h ^= (end - start).astype(np.uint64) * np.uint64(_GOLD)
    return mix(h)


def gram_hashes(words: np.ndarray, k: int, base: int = _Q) -> np.ndarray:
    """Hash of each run of k consecutive words (len(words) - k + 1 of them; runs over text borders included)."""
    m = len(words)
    if m < k:
        return np.zeros(0, dtype=np.uint64)
    pw, inv = powers(base, m)
    s = np.zeros(m + 1, dtype=np.uint64)
    np.cumsum(words * pw[:m], out=s[1:])
    g = s[k:] - s[:-k]
    g *= inv[: m - k + 1]
    return mix(g)


def second_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """As gram_hashes, by an independent function."""
    return gram_hashes(mix(words ^ np.uint64(0xA0761D6478BD642F)), k, _R)


def hash_of(text: bytes) -> int:
    """The word hash of one byte string."""
    data = np.frombuffer(text, dtype=np.uint8)
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * powers(_B, len(data))[0][: len(data)], out=h[1:])
    return int(span_hashes(h, np.array([0]), np.array([len(data)]))[0])


def char_starts(data: np.ndarray) -> np.ndarray:
    """For each byte offset (len + 1 of them) the number of code points that start before it."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted, and the border of each text in them.

    A text of 1 to k - 1 words has one shingle, its whole word sequence; a text without words has none.
    """
    n = len(first) - 1
    per = np.diff(first)
    grams = gram_hashes(words, k)
    doc_of = np.repeat(np.arange(n), per)
    keep = doc_of[: len(grams)] == doc_of[k - 1 :] if len(grams) else np.zeros(0, dtype=bool)
    hs, ds = [grams[keep]], [doc_of[: len(grams)][keep]]
    for length in range(1, k):
        short = np.flatnonzero(per == length)
        if len(short):
            own = gram_hashes(words, length)
            hs.append(mix(own[first[short]] ^ np.uint64(length)))
            ds.append(short)
    h, d = np.concatenate(hs), np.concatenate(ds)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[new], d[new]
    return h, np.searchsorted(d, np.arange(n + 1))
