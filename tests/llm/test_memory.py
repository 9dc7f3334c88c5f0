"""Memory of the kernels that the pipeline's workers run, one stage after the other, in the same processes."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from vecloom.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from vecloom.llm import _text as T

LEXICON = toxicity.Lexicon([], {})
ITEMS = decontamination.Items([(1, "a e i o u b d f")], 4, 0.5, 13)
KERNELS = {
    "mined": lambda: toxicity._mined,
    "counter": lambda: toxicity._counter(LEXICON),
    "reader": lambda: toxicity._reader(LEXICON, np.full((2, len(toxicity.LENGTHS)), 1e-3)),
    "parser": lambda: line_dedup._parser(3, 3),
    "signer": lambda: near_dedup._signer(5, 75, 64, 4, 17),
    "seeds": lambda: decontamination._counter(ITEMS),
    "finder": lambda: decontamination._finder(ITEMS, 0.5, 13, 0.25),
    "cut": lambda: packing._cut(1024, packing.TOKENIZER, 0, False),
}


def labelled(n, words, seed=1):
    rng = np.random.default_rng(seed)
    letters = [str(x).translate(str.maketrans("0123456789", "aeioubdfgk")) for x in range(20_000)]
    texts = [" ".join(letters[x] if i % 12 else f"\n{letters[x]}" for i, x in enumerate(rng.zipf(1.2, words) % 20_000)) for _ in range(n)]
    flag = np.arange(n)
    return pa.RecordBatch.from_arrays(
        [pa.array(flag), pa.array(texts), pa.array((flag % 2).astype(np.int32)), pa.array((flag // 2 % 2).astype(np.int32)), pa.array(flag % 5 == 0), pa.array(flag)],
        names=["doc_id", "text", "toxic", "half", "held_out", "row_hash"],
    )


@pytest.mark.parametrize("name", KERNELS)
def test_a_chunk_takes_little_of_a_worker(name):
    batch, run = labelled(1200, 700), KERNELS[name]()
    assert batch.nbytes > 2 << 20
    T._powers.clear()
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20, f"{peak / 1e6:.0f} MB"


def test_mined_counts_of_both_halves():
    """Sums over chunks are those of a plain count of words, by halves of the sample."""
    batch = labelled(40, 300, 2)
    want = {}
    for text, toxic, half in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "half")), strict=True):
        words = "".join(c if c.isalpha() else " " for c in text).split()
        for w in set(words):
            for level in toxicity.LEVELS:
                if words.count(w) >= level:
                    want.setdefault((w, level), [0, 0, 0, 0])[2 * half + 1 - toxic] += 1
    got = {}
    for b in toxicity._mined(iter([batch.slice(0, 15), batch.slice(15)])):
        for r in b.to_pylist():
            if r["k"] == len(toxicity.LENGTHS) - 1:
                c = got.setdefault((r["feature"], r["level"]), [0, 0, 0, 0])
                for i, name in enumerate(toxicity.CELLS):
                    c[i] += r[name]
    assert sorted(got.values()) == sorted(want.values())
