"""Byte-level BPE by ranks: exact merges in linear time, and back.

The bytes of a piece of text are read as Latin-1 characters, so that one Aho-Corasick automaton over the vocabulary finds
the longest token that starts at every byte.  A sequence of tokens is what merging by rank gives if, and only if, each
two neighbours are what merging gives for their own bytes: of the merges of the whole, those within two neighbours are in
the order in which merging the two alone takes them, and a merge across a border would show in the two alone as well.
So a piece is covered from the left with longest tokens; where a token does not go with the one before, a shorter one is
tried, and where none does, the last one is taken back.  A byte that was reached has only one valid way to it, so one
that led nowhere is never tried again, and the work is linear in the piece.  Which tokens go together is remembered.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from vecloom.llm._common import ship
from vecloom.llm._tokens import tokenizer_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces and pairs of tokens that a worker remembers, and the longest piece that it does.
CACHE_PIECES, CACHE_PAIRS, PIECE_CHARS = 600_000, 500_000, 64
ROWS_BYTES = 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


NEVER = 1 << 40  # the rank of a pair that is no token


class Trace:
    """What merging makes of some bytes, the pair of the lowest rank first, of equals the leftmost: the rank of each
    merge, and the outer parts before it.  For short strings."""

    def __init__(self, raw: bytes, ranks: dict[bytes, int]):
        parts = [raw[i : i + 1] for i in range(len(raw))]
        self.next: list[int] = []
        self.left: list[bytes] = []
        self.right: list[bytes] = []
        while True:
            found = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            low = min(found, default=NEVER)
            self.next.append(low)
            self.left.append(parts[0])
            self.right.append(parts[-1])
            if low == NEVER:
                break
            i = found.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        self.parts = parts


def merged(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merging as it is defined."""
    return [ranks[p] for p in Trace(raw, ranks).parts] if raw else []


def stay_apart(a: Trace, b: Trace, ranks: dict[bytes, int]) -> bool:
    """Whether merging the bytes of two tokens together gives the two: their own merges, in the order of their ranks,
    come before any merge of the parts at the border between them."""
    i = j = 0
    cross = ranks.get(a.right[0] + b.left[0], NEVER)
    while True:
        x, y = a.next[i], b.next[j]
        if x <= y and x <= cross:  # of equals the leftmost
            if x == NEVER:
                return True
            i += 1
        elif cross <= y:
            return False
        else:
            j += 1
        cross = ranks.get(a.right[i] + b.left[j], NEVER)


@lru_cache(maxsize=1)
def _splitter_gap(pattern: str) -> frozenset[str]:
    """The characters that `regex` knows as letters or numbers and tiktoken's own tables do not.

    The two libraries may follow different editions of Unicode.  Only characters that this Python does not know can
    differ; each is put behind a letter, a digit and a sign, with tokens that exist only if the two stay together.
    """
    import regex
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)}
    for p in b"a1":
        for lead in range(0xC2, 0xF5):
            ranks[bytes([p, lead])] = len(ranks)
    probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    kinds = (("a", regex.compile(r"\p{L}")), ("1", regex.compile(r"\p{N}")))
    differ = set()
    for i in range(0x500, 0x110000):
        c = chr(i)
        if unicodedata.category(c) == "Cn" and any(k.match(c) and probe.encode_ordinary(p + c)[0] < 256 for p, k in kinds):
            differ.add(c)
    return frozenset(differ)


_HIGH = re.compile("[\u0500-\U0010ffff]")


def split(text: str, pattern, gap: frozenset[str]) -> list[str]:
    """The matches of a pattern, with the characters of `gap` taken for signs, as which tiktoken takes them."""
    found = set() if text.isascii() else gap.intersection(_HIGH.findall(text))
    if not found:
        return pattern.findall(text)
    return [text[m.start() : m.end()] for m in pattern.finditer(text.translate({ord(c): "☃" for c in found}))]


class BytePairs:
    """ids of text and text of ids, by the ranks of a file; equal to tiktoken's encode_ordinary and decode_bytes.

    A piece that is a token is that token, even if merging alone would not give it; tokens that merging never gives take
    no part otherwise.
    """

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        self.ranks = load_ranks(path)
        if any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError(f"{path} lacks single bytes, so it cannot encode all texts")
        self.pattern, self.gap = regex.compile(pattern), _splitter_gap(pattern)
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        self.length, self.shorter = [0] * (max(self.bytes_of) + 1), [-1] * (max(self.bytes_of) + 1)
        self.automaton = ahocorasick.Automaton()
        for raw, rank in self.ranks.items():
            self.automaton.add_word(raw.decode("latin-1"), rank)
            self.length[rank] = len(raw)
            self.shorter[rank] = next((self.ranks[raw[:n]] for n in range(len(raw) - 1, 0, -1) if raw[:n] in self.ranks), -1)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.traces: dict[int, Trace] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def trace(self, token: int) -> Trace:
        found = self.traces.get(token)
        if found is None:
            found = self.traces[token] = Trace(self.bytes_of[token], self.ranks)
        return found

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a; a = -1: whether b is what merging makes of its bytes."""
        key = (a + 1) << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = len(self.trace(b).parts) == 1 and (a < 0 or stay_apart(self.trace(a), self.trace(b), self.ranks))
            self.pairs[key] = known
        return known

    def cover(self, raw: bytes) -> list[int]:
        """ids of one piece."""
        if not raw:
            return []
        whole = self.ranks.get(raw)
        if whole is not None:
            return [whole]
        n, length, shorter, pairs = len(raw), self.length, self.shorter, self.pairs
        longest = [-1] * n
        for end, rank in self.automaton.iter(raw.decode("latin-1")):
            longest[end - length[rank] + 1] = rank  # later ends are longer tokens
        dead, out, at, before, t = bytearray(n + 1), [], 0, -1, longest[0]
        while at < n:
            while t >= 0:
                if not dead[at + length[t]]:
                    fits = pairs.get((before + 1) << 32 | t)
                    if self.fits(before, t) if fits is None else fits:
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                before = t
                if at < n:
                    t = longest[at]
            else:  # nothing fits here: the token before must be a shorter one
                dead[at] = 1
                t = out.pop()
                before = out[-1] if out else -1
                at -= length[t]
                t = shorter[t]
        return out

    def _piece(self, piece: str) -> bytes:
        """ids of a piece that the younger pieces do not have; when they are many, they become the older ones."""
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.cover(piece.encode())).tobytes()
        if len(piece) <= PIECE_CHARS:
            if len(self.pieces) >= CACHE_PIECES // 2:
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        known, out = self.pieces.get, []
        for piece in split(text, self.pattern, self.gap):
            out.append(known(piece) or self._piece(piece))
        joined = b"".join(out)
        return joined if sys.byteorder == "little" else np.frombuffer(joined, dtype=">u4").astype("<u4").tobytes()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def pairs_of(vocabulary: str, pattern: str | None) -> BytePairs:
    """Loaded once a worker."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    return BytePairs(tokenizer_path(vocabulary), pattern)


def _portions(sizes: Iterator[int]) -> Iterator[tuple[int, int]]:
    """(first row, last row + 1) of rows that hold about ROWS_BYTES."""
    lo, held, i = 0, 0, -1
    for i, n in enumerate(sizes):
        held += n
        if held >= ROWS_BYTES:
            yield lo, i + 1
            lo, held = i + 1, 0
    if lo <= i:
        yield lo, i + 1


def _id_arrays(packed: list[bytes]) -> pa.Array:
    offs = np.concatenate(([0], np.cumsum([len(x) // 4 for x in packed]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int32)))


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY, pattern: str | None = None, packed: bool = False) -> DataFrame:
    """The columns `keep` of docs(text, ...) and `ids`, the tokens of each whole text.

    vocabulary: a file of ranks by the name or path that workers find it under; pattern: what splits texts into the
    pieces that are encoded separately (default: the public package's).  packed: ids are bytes, 4 for each token
    (little-endian unsigned), not an array of int.

    Defined cases: null and empty texts have no ids; rows that repeat are encoded each by itself; columns of docs that are
    not named in `keep` are ignored, whatever their names, and one named ids is replaced.  Texts of any length are encoded
    whole; a task holds one text, or about 8 MB of them, and their ids at a time.
    """
    ship(docs.sparkSession)
    kept = [c for c in keep if c != "ids"]
    source = docs.select(*kept, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    out = D.StructType([source.schema[c] for c in kept] + [D.StructField("ids", D.BinaryType() if packed else D.ArrayType(D.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pairs_of(vocabulary, pattern)
        for batch in batches:
            texts = batch.column(len(kept))
            for lo, hi in _portions(len(x.as_buffer() or b"") for x in texts):
                ids = [pairs.encode(x.as_py()) for x in texts.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in range(len(kept))), pa.array(ids, type=pa.binary()) if packed else _id_arrays(ids)], names=[*kept, "ids"])

    return source.mapInArrow(run, out)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """The rows of encoded(ids, ...) with `decoded`, the bytes of their ids; ids are arrays of int, or packed.

    Defined cases: null ids stay null; no ids are no bytes; an id that the vocabulary does not have is an error; a column
    named decoded is replaced.
    """
    ship(encoded.sparkSession)
    source = encoded.drop("decoded")
    names, is_packed = source.columns, isinstance(source.schema["ids"].dataType, D.BinaryType)
    at = names.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pairs_of(vocabulary, pattern)
        for batch in batches:
            column = batch.column(at)
            for lo, hi in _portions(len(x.as_buffer() or b"") if is_packed else 4 * len(x.values or ()) for x in column):
                rows = (x.as_py() for x in column.slice(lo, hi - lo))
                raw = [None if x is None else pairs.decode(np.frombuffer(x, dtype="<u4").tolist() if is_packed else x) for x in rows]
                yield batch.slice(lo, hi - lo).append_column("decoded", pa.array(raw, type=pa.binary()))

    return source.mapInArrow(run, D.StructType([*source.schema.fields, D.StructField("decoded", D.BinaryType())]))


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text encoded, and its ids decoded again."""
    out = decode(encode(docs, ("doc_id",), packed=True, **options), **options)
    return out.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
