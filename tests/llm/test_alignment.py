"""Alignment of two tokenizers against brute force over the libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestone.llm import alignment, chunks, queries

A, B = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b", "the ", " ", "  ", "\n", "▁", "é", "日本", "🎉", "<s>", "</s>", "<0x41>", "\t", " ", "Hello", " world", ".", "<|endoftext|>", "�", "          ", "---------", "ａ"]
FIXED = [None, "", " ", "  ", "a", " a", "a ", "▁", "\n", " \n ", "\n a", " " * 500, "-" * 777, "🎉" * 300]


class Brute:
    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.symbols = {s: i for i, s in enumerate(chunks.byte_symbols())}

    def groups(self, text):
        """Lists of A and B ids of each group; None where a text has no tokens."""
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        bytes_a = [bytes(self.symbols[c] for c in self.a.id_to_token(i)) for i in a]
        names = [self.b.id_to_piece(i) for i in b]
        bytes_b = [bytes([int(s[3:-1], 16)]) if self.b.is_byte(i) else s.replace("▁", " ").encode() for i, s in zip(b, names, strict=True)]
        want = (" " + text).encode()
        if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            return None
        out, i, j, x, y, first = [], 0, 0, 0, 0, (0, 0)
        while i < len(a) or j < len(b):
            if x <= y:
                x, i = x + len(bytes_a[i]), i + 1
            else:
                y, j = y + len(bytes_b[j]), j + 1
            if x == y:
                out.append((a[first[0] : i], b[first[1] : j]))
                first = i, j
        return out

    def rows(self, texts):
        found = [self.groups(t) for t in texts]
        links = [Counter((p, q) for x, y in g or [] for p in x for q in y) for g in found]
        counts = Counter(pair for c in links for pair in c)
        best = defaultdict(int)
        for (p, _), n in counts.items():
            best[p] = max(best[p], n)
        out = []
        for g, c in zip(found, links, strict=True):
            shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
            sums = sum(n * counts[p] for p, n in c.items()), sum(n for p, n in c.items() if counts[p] == best[p[0]])
            out.append((sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(c.values()), sums[1], sums[0], hashlib.sha256(shown.encode()).hexdigest() if g else ""))
        return out


@pytest.fixture(scope="module")
def brute():
    return Brute()


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 15])
def test_merge_path_matches_a_plain_merge(piece):
    rng = np.random.default_rng(piece)
    for _ in range(200):
        a, b = (np.unique(np.append(rng.integers(1, 60, rng.integers(0, 40)), 60)) for _ in range(2))
        i, j = alignment.diagonals(a, b, piece)
        assert (np.diff(i + j)[:-1] == piece).all() and i[-1] == len(a) and j[-1] == len(b)  # equal work
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        for k in range(len(i)):
            assert sum(side == 0 for _, side in merged[: i[k] + j[k]]) == i[k]
        both = sorted(set(a.tolist()) & set(b.tolist()))
        want = [np.searchsorted(both, x) for x in (a, b)]
        got = alignment.groups(a, b, piece)
        assert all((x == y).all() for x, y in zip(got, want, strict=True))


@pytest.mark.parametrize(("large", "pairs"), [(1 << 10, 1 << 20), (2, 3)])
def test_groups_and_links_match_brute_force(monkeypatch, brute, large, pairs):
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    monkeypatch.setattr(alignment, "MOST_PAIRS", pairs)
    rng = random.Random(5)
    texts = FIXED + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    both = alignment.TwoTokenizers(A, B)
    got = both.align(pa.array([t or "" for t in texts]))
    want = brute.rows(texts)
    n_groups, n_links = got.counts()
    digests = got.digests(both.names, len(both.bytes_a.lengths))
    assert list(zip(got.a.lengths, got.b.lengths, n_groups, n_links, digests, strict=True)) == [(*w[:4], w[6]) for w in want]
    links = defaultdict(Counter)
    for i, t in enumerate(texts):
        for x, y in brute.groups(t) or []:
            links[i].update((p, q) for p in x for q in y)
    pair, doc, times = got.postings(32_000)
    assert {(d, divmod(p, 32_000)): n for p, d, n in zip(pair.tolist(), doc.tolist(), times.tolist(), strict=True)} == {(d, p): n for d, c in links.items() for p, n in c.items()}


@pytest.mark.parametrize("block", [200, 6 << 20])
def test_link_sums_match_brute_force(spark, monkeypatch, brute, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rng = random.Random(6)
    texts = FIXED + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 20))) for _ in range(60)] + ["the same text"] * 5
    df = spark.createDataFrame([(i if i != 3 else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, a string, n_a int").repartition(3)
    got = sorted(alignment.link_sums(df, A, B).collect(), key=lambda r: -1 if r.doc_id is None else r.doc_id)
    want = sorted([(i if i != 3 else None, *w) for i, w in enumerate(brute.rows(texts))], key=lambda r: -1 if r[0] is None else r[0])
    assert [tuple(r) for r in got] == want
    assert alignment.link_sums(df.limit(0), A, B).count() == 0


def test_token_groups(spark, brute):
    df = spark.createDataFrame([(1, "naïve tokenizers"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.token_groups(df, A, B).collect()}
    want = brute.groups("naïve tokenizers")
    assert rows[1].a_ids == [x for g, _ in want for x in g] and rows[1].b_groups == [k for k, (_, g) in enumerate(want) for _ in g]
    assert rows[2].a_ids == rows[2].b_groups == []


def test_alignment_query(spark, sf_dir, brute):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = sorted(map(tuple, queries.op13_token_alignment(spark, sf_dir).collect()))
    assert got == sorted((r.doc_id, *w) for r, w in zip(rows, brute.rows([r.text for r in rows]), strict=True))
