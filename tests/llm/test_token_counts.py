"""Pre-token frequencies are gathered slice by slice, so a block takes little memory beside its text."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from lodestone.llm import chunks, queries, token_counts

BYTE_BPE = queries.tokenizer_path("byte_bpe_50k.json")


def test_frequencies_of_slices(monkeypatch):
    pre = chunks.ByteTexts(BYTE_BPE)
    texts = ["one two, two", "", "two  <|endoftext|> three ", "a\n\n b", "one two", "naïve 日本 one"] * 40
    monkeypatch.setattr(token_counts, "SLICE_BYTES", 50)
    words, code, doc, times = token_counts.frequencies(pre, pa.array(texts))
    found = {(words[c].as_py(), int(d)): int(n) for c, d, n in zip(code, doc, times, strict=True)}
    assert found == {(w, d): n for d, t in enumerate(texts) for w, n in Counter(pre.split_whole(t)).items()}
    assert len(set(words.to_pylist())) == len(words) and (np.diff(code.astype(np.int64) * len(texts) + doc) > 0).all()
    assert [len(x) for x in token_counts.frequencies(pre, pa.array([], pa.string()))] == [0] * 4


def test_a_block_takes_little_memory():
    rng = np.random.default_rng(1)
    said = np.array([f"word{i}" for i in range(2000)])
    texts = pa.array([" ".join(said[rng.integers(0, 2000, 400)]) for _ in range(4000)])  # 14 MB
    pre = chunks.ByteTexts(BYTE_BPE)
    tracemalloc.start()
    token_counts.frequencies(pre, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * texts.nbytes
