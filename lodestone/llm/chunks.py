"""Whole texts as codes of their distinct chunks, for byte-level tokenizers; Arrow and numpy throughout.

A byte-level tokenizer whose pre-tokens may start with one space never joins a space to what stands
before it, and a single line end between other characters is a pre-token of its own.  A text can be
cut before every space and line end, and each distinct chunk of some texts is looked at once.  Texts
with longer runs of white space, white space at their end or strings of added tokens are ``whole``:
the library takes them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that are pre-tokens of their own behind a word, alone at its end.
MARKS = ".,;:!?"
#: Latin letters, which are letters in all versions of Unicode.
LATIN = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Where these stand, cutting a text could change its pre-tokens.
UNSAFE = rf"{_SPACE} {_SPACE}|{_SPACE}{{3}}|{_SPACE}\z"
#: Bytes of text that are worked on at a time (one text may be longer).
SLICE_BYTES = 8 << 20


def slices(texts: pa.Array, most_bytes: int = SLICE_BYTES, most_rows: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of rows with so many bytes at most, and with one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start = held = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and (held + n > most_bytes or i - start >= most_rows):
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield start, len(sizes)


def load(path: str):
    """A tokenizer of the tokenizers library, without truncation or padding, on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(extra)) for b in range(256)]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each range, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Ragged:
    """Rows of numbers: row ``i`` is ``flat[starts[i] : starts[i] + lengths[i]]``."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    @staticmethod
    def of(rows: list) -> Ragged:
        lengths = np.fromiter(map(len, rows), np.int64, len(rows))
        return Ragged(np.fromiter((x for r in rows for x in r), np.int64, int(lengths.sum())), lengths)

    def take(self, rows: np.ndarray) -> Ragged:
        lengths = self.lengths[rows]
        return Ragged(self.flat[spread(self.starts[rows], lengths)], lengths)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks between spaces, the code of every chunk in order, and the number of chunks of each text."""
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy()
    found = lists.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), np.diff(offsets).astype(np.int64)


class ByteTexts:
    """The pre-tokens of texts for one tokenizer file with a byte-level model."""

    def __init__(self, path: str) -> None:
        self.library = load(path)
        added = self.library.get_added_tokens_decoder().values()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added) or self.library.normalizer is not None:
            raise ValueError("only plain added tokens and no normaliser are supported")
        self.added = sorted((t.content for t in added), key=len, reverse=True)
        self.at_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")") if self.added else None
        self.symbols = dict(enumerate(byte_symbols()))

    def whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts may not be cut."""
        found = pc.match_substring_regex(texts, UNSAFE)
        for content in self.added:
            found = pc.or_(found, pc.match_substring(texts, content))
        return found.to_numpy(zero_copy_only=False)

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens, by the library."""
        return [text[i:j] for _, (i, j) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def split_whole(self, text: str) -> list[str]:
        """The pre-tokens of any text; strings of added tokens are pre-tokens of their own."""
        out: list[str] = []
        for part in self.at_added.split(text) if self.at_added else [text]:
            if part in self.added:
                out.append(part)
            elif part:
                out += self.split(part)
        return out

    def pre_tokens(self, chunks: pa.Array) -> tuple[pa.Array, Ragged]:
        """Distinct pre-tokens of distinct chunks, and the codes that each chunk is made of.

        A chunk starts with a line end or stands behind a space.  Plain words of Latin letters, alone or
        with one mark behind, are cut by Arrow; all other chunks by the library's pre-tokenizer.
        """
        line = pc.starts_with(chunks, "\n")
        body = pc.if_else(line, pc.utf8_slice_codeunits(chunks, 1), chunks)
        plain = pc.match_substring_regex(body, rf"\A[{LATIN}]+[{MARKS}]?\z").to_numpy(zero_copy_only=False)
        marked = pc.match_substring_regex(body, rf"[{MARKS}]\z")
        stem = pc.if_else(marked, pc.utf8_slice_codeunits(body, 0, -1), body)
        mark = pc.index_in(pc.utf8_slice_codeunits(body, -1), pa.array(list(MARKS))).fill_null(0).to_numpy()
        line, marked = (x.to_numpy(zero_copy_only=False) for x in (line, marked))
        name = pc.binary_join_element_wise(pc.if_else(pa.array(line), "", " "), stem, "")
        odd = np.flatnonzero(~plain)
        parts = [self.split(b if n else " " + b) for b, n in zip(body.take(pa.array(odd)).to_pylist(), line[odd].tolist(), strict=True)]
        every = pa.concat_arrays([pa.array(["\n", *MARKS], pa.string()), name.filter(pa.array(plain)).cast(pa.string()), pa.array([p for s in parts for p in s], pa.string())])
        coded = every.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        # of a chunk: a line end, its word or what the library made of it, a mark
        sizes = np.ones(len(chunks), np.int64)
        sizes[odd] = np.fromiter(map(len, parts), np.int64, len(parts))
        marked = marked & plain
        lengths = line + sizes + marked
        flat = np.zeros(int(lengths.sum()), np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        flat[starts[line]] = codes[0]
        flat[ends[marked] - 1] = codes[1 + mark[marked]]
        words = codes[1 + len(MARKS) :]
        n = int(plain.sum())
        flat[(starts + line)[plain]] = words[:n]
        flat[spread((starts + line)[odd], sizes[odd])] = words[n:]
        return coded.dictionary, Ragged(flat, lengths)

    def read(self, texts: pa.Array) -> tuple[pa.Array, Ragged]:
        """Distinct pre-tokens of texts without nulls that may be cut, and the codes of each text in order."""
        # a line end in front makes the first chunk like the others; its pre-token is taken off again
        chunks, codes, sizes = cut(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""))
        words, of_chunk = self.pre_tokens(chunks)
        found = of_chunk.take(codes)
        ends = np.concatenate(([0], np.cumsum(found.lengths)))[np.cumsum(sizes)]
        lengths = np.diff(ends, prepend=0)
        inner = np.ones(len(found.flat), bool)
        inner[ends - lengths] = False
        return words, Ragged(found.flat[inner], lengths - 1)

    def symbols_of(self, word: str) -> str:
        """A pre-token as the model reads it: one character for each byte."""
        return word.replace(" ", self.symbols[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.symbols)

    def pieces(self, words: list[str], made: Callable) -> list:
        """``made`` of the model's tokens for each pre-token."""
        tokenize, symbols = self.library.model.tokenize, self.symbols_of
        return [made(tokenize(symbols(w))) for w in words]
