"""Byte-pair encoding by a deterministic automaton over token arcs.

**The automaton.**  It reads sequences of tokens and accepts exactly those that the merges produce.
It starts as one state with a loop for every symbol: any sequence of symbols.  Then the merges are
applied in order, each by a gadget.  For the merge ``u v -> uv``: arcs ``u`` are led to a copy of
their target that lacks the arc ``v`` (after ``u``, no ``v`` may follow any more), and every state
with an arc ``u`` gets an arc ``uv`` to where ``u`` then ``v`` led.  All arcs of one label lead to the
same state at all times, so a gadget adds one state and the whole automaton has no more states than
there are merges, plus one.

States are kept as their parent and the one label they lack, not as rows of arcs.  The lineage of the
state behind a token follows the token's right parts, so whether it has an arc is told by the merges
of those parts (``follows``).

**Encoding.**  Every prefix of a word has exactly one accepted sequence, so the set of automaton
states that reading bytes can lead to is known from the last tokens of the prefixes near the end.
``Encoder`` turns this subset construction into a table of transitions on bytes, built while words are
read and used for all words: for each byte one lookup gives the next state and the token whose arc
ends there.  The arcs on the path from the end of the word back to its start are the tokens.

**Decoding** emits the labels of the arcs that the ids name.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import MARKS, Ragged, byte_symbols, cut, load, slices, spread
from .common import give_back, tidy

#: Rows of the transition table before it is built anew.
TABLE_ROWS = 150_000
#: Latin letters of one byte in Latin-1.
LATIN = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
#: Bytes of text that are encoded at a time (one text may be longer).
SLICE_BYTES = 2 << 20
#: Added to a byte that ends a word.
END = 256


class Automaton:
    """The compiled merges: ``target[token]`` is the state after an arc of that label."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]], ids: dict[str, int]) -> None:
        self.parent, self.lacks = [-1], [-1]
        self.target: dict[int, int] = {ids[s]: 0 for s in symbols}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.taken: dict[int, int] = {}
        never: set[int] = set()
        for k, (a, b) in enumerate(merges):
            u, v, uv = ids[a], ids[b], ids[a + b]
            if any(x not in self.target and x not in never for x in (u, v)) or uv in self.target:
                raise ValueError(f"merge {k} uses a token that is not made yet, or makes one twice")
            # where u v cannot stand side by side, or one of them never comes, the gadget changes nothing
            if u in never or v in never or not self.follows(v, u):
                never.add(uv)
                continue
            old = self.target[u]
            self.target[uv] = self.target[v]
            self.parent.append(old)
            self.lacks.append(v)
            self.target[u] = len(self.parent) - 1
            self.taken[u << 32 | v] = k
            self.left[uv], self.right[uv], self.born[uv] = u, v, k

    def follows(self, token: int, after: int) -> bool:
        """Whether the state behind ``after`` has an arc ``token``.

        The state lacks what merges took from ``after`` itself and, before ``after`` was made, from its
        right part, and so on down the right spine.  The arc of a merged token came from the arc of its
        left part, if that was there when the merge was applied; so no token down the left spine may have
        been taken away by then.
        """
        until = 1 << 60
        while True:
            before, t = 1 << 60, token
            while True:
                since = self.taken.get(after << 32 | t)
                if since is not None and since < until and since <= before:
                    return False
                if t not in self.left:
                    break
                before, t = self.born[t], self.left[t]
            if after not in self.right:
                return True
            until, after = self.born[after], self.right[after]


class Encoder:
    """Table-driven encoding of words with an automaton; symbols are numbers below 512."""

    def __init__(self, automaton: Automaton, spell: dict[int, tuple[int, ...]], rows: int = TABLE_ROWS) -> None:
        self.automaton, self.rows = automaton, rows
        self.child: dict[int, int] = {}  # a trie of all tokens: node * 512 + symbol
        self.ends: list[int] = [-1]
        for token, symbols in spell.items():
            node = 0
            for s in symbols:
                nxt = self.child.get(node << 9 | s)
                if nxt is None:
                    nxt = self.child[node << 9 | s] = len(self.ends)
                    self.ends.append(-1)
                node = nxt
            self.ends[node] = token
        self.inner = bytearray(len(self.ends))  # nodes with children
        for place in self.child:
            self.inner[place >> 9] = 1
        self.size = {token: len(symbols) for token, symbols in spell.items()}
        self.reset()

    def reset(self) -> None:
        # a row: its open matches (trie node and the token before it, in one number; the last one starts a
        # token here), and the token that ends here
        self.states: dict[tuple[int, ...], int] = {(0,): 0}
        self.open: list[tuple[int, ...]] = [(0,)]
        self.out: list[int] = [-1]
        self.step: dict[int, int] = {}  # transitions: row * 512 + symbol

    def _make(self, row: int, symbol: int) -> int:
        opened, out, child, ends = [], -1, self.child, self.ends
        for match in self.open[row]:
            node, before = match >> 32, (match & 0xFFFFFFFF) - 1
            nxt = child.get(node << 9 | symbol)
            if nxt is not None:
                if self.inner[nxt]:
                    opened.append(nxt << 32 | before + 1)
                token = ends[nxt]
                if out < 0 and token >= 0 and (before < 0 or self.automaton.follows(token, before)):
                    out = token
        if out < 0:
            raise KeyError(symbol)
        opened.append(out + 1)
        key = tuple(opened)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.open)
            self.open.append(key)
            self.out.append(out)
        self.step[row << 9 | symbol] = found
        return found

    def encode(self, symbols) -> list[int]:
        """The tokens of one word; a symbol that no token has raises KeyError."""
        if len(self.open) > self.rows:
            self.reset()
        row, ends, step, out = 0, [], self.step, self.out
        for s in symbols:
            nxt = step.get(row << 9 | s)
            row = self._make(row, s) if nxt is None else nxt
            ends.append(out[row])
        tokens, at, size = [], len(ends), self.size
        while at:
            token = ends[at - 1]
            tokens.append(token)
            at -= size[token]
        return tokens[::-1]


class WordTokenizer:
    """A tokenizer file whose model is byte-level BPE over pre-split words with a word-end mark.

    Normaliser and pre-splitting are the library's own components; the merges are the automaton's.  What
    a task remembers of its texts is gone when its slice of texts is done.
    """

    def __init__(self, path: str) -> None:
        self.library = load(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("not a plain BPE model")
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        numbers = {s: i for i, s in enumerate(byte_symbols())}
        if end:
            numbers |= {s + end: i + END for s, i in numbers.items()}
        if not all(s in ids for s in numbers):
            raise ValueError("the vocabulary lacks a byte")
        self.last = END if end else 0
        automaton = Automaton(list(numbers), merges, ids)
        spell: dict[int, tuple[int, ...]] = {ids[s]: (i,) for s, i in numbers.items()}
        for a, b in merges:
            if ids[a + b] in automaton.target:
                spell[ids[a + b]] = spell[ids[a]] + spell[ids[b]]
        self.encoder = Encoder(automaton, spell)
        added = self.library.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("only plain added tokens are supported")
        if self.library.decoder is not None:
            raise ValueError("decoders are not supported: labels are joined by spaces")
        self.added = {t.content: i for i, t in added.items()}
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.labels: list[bytes | None] = [None] * (1 + max(*ids.values(), *added))
        for label, i in {**ids, **self.added}.items():
            self.labels[i] = label.encode()
        # plain words need neither normalising beyond lower case nor splitting beyond a mark behind them
        letters = [c for c in map(chr, range(256)) if c.isalpha() and c not in "\u00aa\u00b5\u00ba"]
        self.plain = all(self._split(c + "b" + m) == [(c + "b").lower(), m] and self._split(c) == [c.lower()] for c in letters for m in MARKS)

    def _split(self, text: str) -> list[str]:
        """The pre-split words of a stretch of text without added tokens, by the library."""
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [normal[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(normal) if j > i]

    def word(self, word: str) -> list[int]:
        """Ids of one pre-split word, by the automaton."""
        symbols = list(word.encode("utf-8", "surrogatepass"))
        symbols[-1] += self.last
        return self.encoder.encode(symbols)

    def chunks(self, chunks: pa.Array) -> Ragged:
        """Ids of chunks, which hold no spaces and no added tokens."""
        plain = pc.match_substring_regex(chunks, rf"\A[{LATIN}]+[{MARKS}]?\z").to_numpy(zero_copy_only=False) & self.plain
        marked = pc.match_substring_regex(chunks, rf"[{MARKS}]\z")
        stem = pc.utf8_lower(pc.if_else(marked, pc.utf8_slice_codeunits(chunks, 0, -1), chunks))
        mark = pc.index_in(pc.utf8_slice_codeunits(chunks, -1), pa.array(list(MARKS))).fill_null(0).to_numpy()
        marked = marked.to_numpy(zero_copy_only=False) & plain
        odd = np.flatnonzero(~plain)
        parts = [self._split(c) for c in chunks.take(pa.array(odd)).to_pylist()]
        coded = pa.concat_arrays([pa.array(list(MARKS)), stem.filter(pa.array(plain)).cast(pa.string()), pa.array([w for p in parts for w in p], pa.string())]).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        words = Ragged.of([self.word(w) for w in coded.dictionary.to_pylist()])
        sizes = np.ones(len(chunks), np.int64)
        sizes[odd] = np.fromiter(map(len, parts), np.int64, len(parts))
        lengths = sizes + marked
        ends = np.cumsum(lengths)
        starts = ends - lengths
        flat = np.zeros(int(lengths.sum()), np.int64)
        flat[ends[marked] - 1] = codes[mark[marked]]
        n = int(plain.sum())
        flat[starts[plain]] = codes[len(MARKS) : len(MARKS) + n]
        flat[spread(starts[odd], sizes[odd])] = codes[len(MARKS) + n :]
        found = words.take(flat)
        bounds = np.concatenate(([0], np.cumsum(found.lengths)))
        return Ragged(found.flat.astype("<u4"), bounds[ends] - bounds[starts])

    def with_added(self, text: str) -> bytes:
        """Ids of a text that has strings of added tokens, which become those tokens."""
        out: list[int] = []
        for part in self.at_added.split(text):
            if part in self.added:
                out.append(self.added[part])
            else:
                for w in self._split(part):
                    out += self.word(w)
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of whole texts without nulls."""
        special = pa.array(np.zeros(len(texts), bool))
        for content in self.added:
            special = pc.or_(special, pc.match_substring(texts, content))
        special = special.to_numpy(zero_copy_only=False)
        # no word holds white space, and normalising works on each side of it alone
        chunks, codes, sizes = cut(pc.replace_substring(texts.filter(pa.array(~special)), "\n", " "))
        ids = self.chunks(chunks).take(codes)
        ends = np.concatenate(([0], np.cumsum(ids.lengths)))[np.cumsum(sizes)].tolist()
        out: list[bytes] = [b""] * len(texts)
        start = 0
        for i, end in zip(np.flatnonzero(~special).tolist(), ends, strict=True):
            out[i], start = ids.flat[start:end].tobytes(), end
        at = np.flatnonzero(special)
        for i, t in zip(at.tolist(), texts.take(pa.array(at)).to_pylist(), strict=True):
            out[i] = self.with_added(t)
        return out

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs that ids name, joined by spaces (UTF-8); ids beyond the vocabulary are left out."""
        labels, n = self.labels, len(self.labels)
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= n:
            numbers = numbers[numbers < n]
        return b" ".join([label for label in map(labels.__getitem__, numbers.tolist()) if label is not None])


def encode_decode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, outputs: bool = False) -> DataFrame:
    """Encode every whole text, decode its ids; returns ``carry`` and the digests of both.

    Adds ``n_tokens``, ``ids_sha256`` (ids as little-endian unsigned 32-bit integers) and
    ``decoded_sha256`` (decoded text in UTF-8); with ``outputs`` also ``token_ids`` (array) and
    ``decoded``.  A null or empty text has no tokens and decodes to the empty text.  Strings of added
    tokens inside a text become those tokens, as is the library's default.  Carried columns with these
    names are dropped; rows are encoded alone, without a shuffle; an empty table gives an empty
    result.
    """
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"token_ids": "array<int>", "decoded": "string"} if outputs else {})
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema), *(f"{k} {v}" for k, v in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(path)  # compiled for each task, and gone with it
        give_back()
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, end in slices(texts, SLICE_BYTES):
                found = []
                for ids in tokenizer.encode(texts.slice(start, end - start).fill_null("").cast(pa.string())):
                    decoded = tokenizer.decode(ids)
                    row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    found.append([*row, np.frombuffer(ids, "<u4").astype(np.int32), decoded.decode("utf-8", "replace")] if outputs else row)
                arrays = [pa.array([f[i] for f in found], kinds[i]) for i in range(len(made))]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in batch.columns[:-1]), *arrays], names=[*carry, *made])
            batch = texts = None  # gone before the next one comes

    return docs.select(*carry, F.col(text).alias("the_text")).mapInArrow(tidy(run), schema)
