"""Token ids of whole batches of texts; a worker remembers the stretches of text that it has encoded, task after task."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

from vecloom.llm import _text as T

CACHE_UNITS = 2 << 20
FIRST_SLOTS = 1 << 16
JOINED_UNITS = 256

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_GRAPHIC = np.zeros(256, dtype=bool)
_GRAPHIC[0x21:0x7F] = True


def tokenizer_path(name: str) -> str:
    """A file name of the public tokenizer package, or a path as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return str(public_tokenizers.path(name))


def unit_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing a token of a byte-level tokenizer whose splitter keeps white space only
    in front of a word: at each text's start; at a blank or line feed after a character that is surely no white space
    (ASCII graphic, or U+00C0..U+00FF); and at a full stop or comma after an ASCII letter.
    """
    cut = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        graphic = np.zeros(len(data), dtype=bool)
        graphic[1:] = _GRAPHIC[data[:-1]]
        graphic[2:] |= (data[1:-1] >= 0x80) & (data[:-2] == 0xC3)
        cut |= ((data == 0x20) | (data == 0x0A)) & graphic
        cut[1:] |= ((data[1:] == 0x2E) | (data[1:] == 0x2C)) & _LETTER[data[:-1]]
    cut[offs[:-1][offs[:-1] < offs[1:]]] = True
    return np.flatnonzero(cut)


def splittable(tokenizer) -> bool:
    """Whether unit_starts holds for a tokenizer: bytes as they are, the splitter that keeps white space in front of a
    word, and no added token that a cut could divide."""
    parts = json.loads(tokenizer.to_str())
    splitter = parts.get("pre_tokenizer") or {}
    plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
    return bool(plain and not parts.get("normalizer") and not any(set(t["content"]) & set(" \n.,") or t.get("lstrip") or t.get("rstrip") for t in parts.get("added_tokens", [])))


class Encoder:
    """ids of a `tokenizers` file; equal to Tokenizer.encode(text, add_special_tokens=False).ids of each text.

    Texts of a tokenizer that is not splittable are encoded whole.  Stretches of one 64-bit hash and one length count as
    equal: among the `cache_units` that a worker remembers, two that differ meet with a probability of about 1e-7.

    What is remembered lies in a table by hash, in one of two slots.  It doubles while more than half of it is taken, up to
    `cache_units` slots; a stretch that finds both taken replaces what is in the second.  When ids fill, the older half is
    forgotten.
    """

    def __init__(self, name: str, cache_units: int = CACHE_UNITS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.kind = np.uint16 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else np.uint32
        self.most_slots = 1 << (cache_units - 1).bit_length()
        self.most_ids = 4 * self.most_slots
        self.splittable = splittable(self.tokenizer)
        if self.splittable:  # one character of a token is one byte of text
            self.token_bytes = np.zeros(1 + max(self.tokenizer.get_vocab().values()), dtype=np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
                self.token_bytes[i] = len(token)
            for i, token in self.tokenizer.get_added_tokens_decoder().items():
                self.token_bytes[i] = len(token.content.encode())
        self.flat = np.zeros(0, dtype=self.kind)
        self._slots(min(self.most_slots, FIRST_SLOTS))

    def _slots(self, n: int) -> None:
        self.known, self.where, self.length = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)

    def _two(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.known) - 1)
        return (hashes & mask).astype(np.int64), (hashes >> np.uint64(32) & mask).astype(np.int64)

    def _put(self, at: np.ndarray, hashes: np.ndarray, where: np.ndarray, length: np.ndarray) -> None:
        self.known[at], self.where[at], self.length[at] = hashes, where, length

    def _remember(self, hashes: np.ndarray, where: np.ndarray, length: np.ndarray) -> None:
        one, other = self._two(hashes)
        free = self.length[one] == 0
        self._put(one[free], hashes[free], where[free], length[free])
        left = self.known[one] != hashes
        self._put(other[left], hashes[left], where[left], length[left])
        if len(self.known) < self.most_slots and 2 * np.count_nonzero(self.length) > len(self.known):
            old, taken = (self.known, self.where, self.length), np.flatnonzero(self.length)
            self._slots(2 * len(self.known))
            self._remember(*(x[taken] for x in old))

    def _forget(self) -> None:
        gone = len(self.flat) - self.most_ids // 2
        self.length[self.where < gone] = 0
        self.where -= gone
        self.flat = self.flat[gone:].copy()

    def _apart(self, raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches, number of each one's), each encoded by itself."""
        texts = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((x for i in ids for x in i), dtype=self.kind), np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))

    def _joined(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _apart, of stretches that begin with white space and end with none: side by side they are a text that
        unit_starts cuts into the same stretches, and the bytes of its tokens tell where each one's ids end."""
        size = end - start
        border = np.concatenate(([0], np.cumsum(size)))
        raw = data[np.repeat(start - border[:-1], size) + np.arange(border[-1])].tobytes()
        edges = np.append(border[:-1:JOINED_UNITS], border[-1]).tolist()
        texts = [raw[a:b].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        ids = np.concatenate([np.array(e.ids, dtype=self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.concatenate(([0], np.cumsum(self.token_bytes[ids])))
        cut = np.searchsorted(ends, border)
        if ends[-1] != border[-1] or (ends[cut] != border).any():  # a vocabulary that lacks some bytes
            return self._apart(raw, border[:-1], border[1:])
        return ids, np.diff(cut)

    def _fresh(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids of the stretches in that order, number of each one's)."""
        joins = np.zeros(len(start), dtype=bool)
        if self.splittable:
            last, before = data[end - 1], data[np.maximum(end - 2, start)]
            joins = ((data[start] == 0x20) | (data[start] == 0x0A)) & (_GRAPHIC[last] | ((last >= 0x80) & (before == 0xC3)))
        parts = []
        if joins.any():
            parts.append(self._joined(data, start[joins], end[joins]))
        if not joins.all():
            parts.append(self._apart(data.tobytes(), start[~joins], end[~joins]))
        return np.concatenate((np.flatnonzero(joins), np.flatnonzero(~joins))), np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, border of each text in them)."""
        start = unit_starts(data, offs) if self.splittable else offs[:-1][offs[:-1] < offs[1:]]
        if not len(start):
            return np.zeros(0, dtype=self.kind), np.zeros(len(offs), dtype=np.int64)
        if len(self.flat) > self.most_ids:
            self._forget()
        end = np.append(start[1:], len(data))
        words = T.Words.__new__(T.Words)
        words.data = data
        h = T.span_hashes(words.prefix(), start, end)
        one, other = self._two(h)
        at = np.where(self.known[one] == h, one, other)
        size, where = self.length[at].astype(np.int64), self.where[at].astype(np.int64)
        fresh = np.flatnonzero((self.known[at] != h) | (size == 0))
        if len(fresh):
            unique, first, inverse = np.unique(h[fresh], return_index=True, return_inverse=True)
            order, ids, n = self._fresh(data, start[fresh[first]], end[fresh[first]])
            new_size, new_where = np.zeros(len(unique), dtype=np.int64), np.zeros(len(unique), dtype=np.int64)
            new_size[order], new_where[order] = n, len(self.flat) + np.cumsum(n) - n
            self.flat = np.concatenate((self.flat, ids))
            size[fresh], where[fresh] = new_size[inverse], new_where[inverse]
            self._remember(unique, new_where, new_size)
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(where - total[:-1], size) + np.arange(total[-1])]
        return ids, total[np.searchsorted(start, offs)]


@lru_cache(maxsize=1)
def encoder(name: str, job: str) -> Encoder:
    """The worker's one encoder, so that a task knows what those before it of the same job and worker have encoded.

    Another job begins with an empty one, so what it costs does not depend on what ran before.
    """
    return Encoder(name)
