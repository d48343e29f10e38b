"""SentencePiece models: encoding that keeps the source bytes of every piece, and decoding.

**Normalising.**  A model file has a compiled character map: a double-array trie over UTF-8 bytes whose
leaves name replacement strings.  ``Normaliser`` reads a text from left to right, takes the longest
entry of the trie at each place (one character as it is where there is none) and records, for every
byte it writes, the source byte at which the entry started.  ``▁`` stands for a space; a dummy one may
stand in front.

**Segmenting** works on normalised strings alone, by the library with a model whose own normaliser is
taken out.  Then each piece is projected to the source: from the source byte of its first normalised
byte to that of the byte behind its last.  Of a character that is spelt in byte pieces, the last one
carries the span and the others are empty, as the library has it.

**Chunks.**  Where no entry of the map and no piece goes on over a space, a text is cut at its spaces
and each distinct chunk of a slice is normalised, segmented and projected once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Ragged, cut, slices, spread
from .common import tidy

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: Bytes of text that are encoded at a time (one text may be longer).
SLICE_BYTES = 4 << 20
# fixed values of the model file: field numbers, kinds of pieces
PIECE, TRAINER, NORMALISER = 1, 2, 3
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6


def fields(raw: bytes) -> Iterator[tuple[int, int, bytes | int, bytes]]:
    """(number, wire type, value, the field as it stands) of each field of a protocol buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(raw):
        start, key = i, varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, i = raw[i : i + size], i + size
        yield key >> 3, kind, value, raw[start:i]


class CharacterMap:
    """A compiled character map: a double-array trie of UTF-8 keys, and the strings they become."""

    def __init__(self, compiled: bytes) -> None:
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.strings = compiled[4 + size :]
        self.first = frozenset(b for b in range(256) if self.units and self._step(self._offset(0), b) is not None)
        self.plain = re.compile(b"[^" + b"".join(rb"\x%02x" % b for b in sorted(self.first)) + rb"]*\Z", re.DOTALL) if self.first else None

    def _offset(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """What the longest key at a place becomes, and its length."""
        found, base, i = None, self._offset(0) if self.units else 0, at
        while i < len(raw) and self.units:
            node = self._step(base, raw[i])
            if node is None:
                break
            base, i = self._offset(node), i + 1
            if self.units[node] & 0x100:
                found = self.units[base] & 0x7FFFFFFF, i - at
        if found is None:
            return None
        start = found[0]
        return self.strings[start : self.strings.index(b"\0", start)], found[1]

    def keys(self) -> Iterator[bytes]:
        """All keys."""
        todo = [(self._offset(0), b"")] if self.units else []
        while todo:
            base, key = todo.pop()
            for byte in range(256):
                node = self._step(base, byte)
                if node is not None and (byte or key):
                    if self.units[node] & 0x100:
                        yield key + bytes([byte])
                    if byte:
                        todo.append((self._offset(node), key + bytes([byte])))

    def untouched(self, raw: bytes) -> bool:
        """Whether no key can start anywhere in ``raw``."""
        return self.plain is None or self.plain.match(raw) is not None


@dataclass
class Normaliser:
    """Longest-prefix normalisation that records where each byte came from."""

    characters: CharacterMap
    dummy_prefix: bool = True
    trim: bool = True

    def piecewise(self) -> bool:
        """Whether texts without doubled or leading spaces may be cut before every space and line end."""
        entries = ((key, self.characters.longest(key, 0)[0]) for key in self.characters.keys())
        return not self.trim and self.dummy_prefix and not any(mark in entry for key, made in entries for mark in (b" ", b"\n", SPACE_BYTES) for entry in (key, made))

    def read(self, raw: bytes, prefix: bool | None = None) -> tuple[bytes, np.ndarray]:
        """The normalised bytes of UTF-8 text, and for each of them, and for the end, the source byte it stems from."""
        out, source = [], []
        at, end, blank = 0, len(raw), self.trim
        steps = self._steps(raw)
        if self.trim:  # leading spaces
            kept = []
            for step in steps:
                if kept or step[0] != b" ":
                    kept.append(step)
                else:
                    at = step[2]
            steps = iter(kept)
        if at == end:
            return b"", np.zeros(1, np.int64)
        if self.dummy_prefix if prefix is None else prefix:
            out.append(SPACE_BYTES)
            source.append(np.full(3, at))
        for made, start, stop in steps:
            if blank:
                made = made.lstrip(b" ")
            if made:
                blank = self.trim and made.endswith(b" ")
                shown = made.replace(b" ", SPACE_BYTES)
                out.append(shown)
                source.append(np.arange(start, stop) if shown == raw[start:stop] and stop - start > 4 else np.full(len(shown), start))
        normal, where = b"".join(out), np.concatenate([*source, [end]]) if source else np.array([end])
        while self.trim and normal.endswith(SPACE_BYTES):
            normal = normal[:-3]
            where = where[: len(normal) + 1]
        return normal, where

    def _steps(self, raw: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(normal form, start, end in the source) of each entry taken."""
        at, end = 0, len(raw)
        while at < end:
            found = self.characters.longest(raw, at) if raw[at] in self.characters.first else None
            if found is not None:
                yield found[0], at, at + found[1]
                at += found[1]
                continue
            lead = raw[at]
            size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            yield raw[at : at + size], at, at + size
            at += size


class PieceTokenizer:
    """A SentencePiece model file; what a task remembers of its texts is gone when its slice is done."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        kept, spec, trainer, names, kinds = [], {}, {}, [], []
        for number, _, value, whole in fields(raw):
            if number == NORMALISER:
                spec = {n: v for n, _, v, _ in fields(value)}
            else:
                kept.append(whole)
            if number == PIECE:
                piece = {n: v for n, _, v, _ in fields(value)}
                names.append(piece[1].decode())
                kinds.append(piece.get(3, 1))
            elif number == TRAINER:
                trainer = {n: v for n, _, v, _ in fields(value)}
        if not spec.get(5, 1) or trainer.get(24, 0) or USER_DEFINED in kinds:
            raise ValueError("spaces must be escaped and stand in front, and no pieces be defined by users")
        self.normaliser = Normaliser(CharacterMap(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)))
        # a normaliser that changes nothing: name, no map, no prefix, no trimming, no escapes
        bare = b"\x0a\x08identity" + b"\x18\x00\x20\x00\x28\x00"
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=b"".join(kept) + bytes([NORMALISER << 3 | 2, len(bare)]) + bare)
        self.begin, self.end = self.segmenter.bos_id(), self.segmenter.eos_id()
        self.names, self.kinds = names, np.array(kinds)
        #: Whether no piece goes on over a space.
        self.inner = not any(SPACE in name.lstrip(SPACE) for name in names)
        self.labels = [bytes([int(n[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.sizes = np.array([len(x) for x in self.labels])
        self.unknown = trainer.get(44, b" \xe2\x81\x87 ")
        # a character of one byte needs no care, nor do plain pieces
        self.odd = np.array([k != 1 and not (k == BYTE and x < b"\x80") for k, x in zip(kinds, self.labels, strict=True)])
        self.cuts = self.inner and self.normaliser.piecewise() and not any("\n" in name for name in names)

    def project(self, ids: list[int], normal: bytes, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source spans (begin, end) of the pieces of a normalised string."""
        kinds = self.kinds[ids]
        begins, ends = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        at = i = 0
        while i < len(ids):
            if kinds[i] == BYTE:  # a character in bytes
                lead = normal[at]
                size = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                begins[i : i + size] = ends[i : i + size] = where[at]
                ends[i + size - 1] = where[at + size]
                at, i = at + size, i + size
                continue
            size = len(self.names[ids[i]].encode())
            if kinds[i] == UNKNOWN:  # as many characters as are unknown in a row
                rest = self.names[ids[i + 1]].encode() if i + 1 < len(ids) else b""
                size = normal.index(rest, at + 1) - at if rest else len(normal) - at
            begins[i], ends[i] = where[at], where[at + size]
            at, i = at + size, i + 1
        return begins, ends

    def whole(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Ids and source spans of one text, which is not cut."""
        normal, where = self.normaliser.read(text.encode())
        ids = self.segmenter.encode(normal.decode()) if normal else []
        return ids, *self.project(ids, normal, where)

    def chunks(self, chunks: pa.Array) -> tuple[Ragged, np.ndarray, np.ndarray]:
        """Ids of distinct chunks and their spans; byte 0 is the space in front, or the line end at the start."""
        found = chunks.to_pylist()
        changed = {i for i, c in enumerate(found) if not self.normaliser.characters.untouched(c.encode())} if self.normaliser.characters.first else set()
        read = {i: self.normaliser.read(found[i].encode(), prefix=False) for i in changed}
        shown = [read[i][0].decode() for i in changed] if changed else []
        normal = found if not changed else [*found]
        for i, s in zip(changed, shown, strict=True):
            normal[i] = s
        ids = Ragged.of(self.segmenter.encode([c if c.startswith("\n") else SPACE + c for c in normal], num_threads=1))
        sizes = self.sizes[ids.flat]
        ends = np.cumsum(sizes)
        begins = ends - sizes
        base = np.repeat(begins[np.minimum(ids.starts, max(0, len(begins) - 1))] if len(begins) else ids.starts, ids.lengths)
        begins, ends = begins - base, ends - base
        spelt = np.repeat(np.arange(len(found)), ids.lengths)[self.odd[ids.flat]]
        for i in changed.union(spelt.tolist()):
            made, where = read.get(i) or self.normaliser.read(found[i].encode(), prefix=False)
            at = slice(ids.starts[i], ids.starts[i] + ids.lengths[i])
            if not made.startswith(b"\n"):
                made, where = SPACE_BYTES + made, np.concatenate([[0, 0, 0], where + 1])
            begins[at], ends[at] = self.project(ids.flat[at].tolist(), made, where)
        return ids, begins, ends

    def encode(self, texts: pa.Array, spans: bool = True) -> tuple[Ragged, np.ndarray, np.ndarray]:
        """Ids of whole texts without nulls, without begin and end, and the source span of each piece (unless not asked for)."""
        whole = np.ones(len(texts), bool)
        if self.cuts:
            whole = pc.or_(pc.match_substring_regex(texts, rf"\A(?:[ \n]|\z)|  |{SPACE}"), pc.equal(texts, "")).to_numpy(zero_copy_only=False)
        chunks, codes, sizes = cut(pc.replace_substring(texts.filter(pa.array(~whole)), "\n", " \n"))
        of_chunk, begin, end = self.chunks(chunks)
        ids = of_chunk.take(codes)
        begins = ends = np.zeros(0, np.int64)
        if spans:
            # a chunk starts with its space or line end; the first space is none, so a text's bytes are counted from -1
            length = pc.add(pc.binary_length(chunks), pc.cast(pc.invert(pc.starts_with(chunks, "\n")), pa.int32())).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
            first = np.cumsum(sizes) - sizes
            starts = np.cumsum(length) - length
            starts -= np.repeat(starts[first], sizes) + 1
            at = spread(of_chunk.starts[codes], of_chunk.lengths[codes])
            shift = np.repeat(starts, ids.lengths)
            begins, ends = np.maximum(begin[at] + shift, 0), np.maximum(end[at] + shift, 0)
        bounds = np.concatenate(([0], np.cumsum(ids.lengths)))[np.cumsum(sizes)]
        lengths = np.zeros(len(texts), np.int64)
        lengths[~whole] = np.diff(bounds, prepend=0)
        if not whole.any():
            return Ragged(ids.flat, lengths), begins, ends
        places = np.flatnonzero(whole)
        found = [self.whole(t) for t in texts.take(pa.array(places)).to_pylist()]
        lengths[places] = [len(f[0]) for f in found]
        out = [np.zeros(int(lengths.sum()) if spans or not k else 0, np.int64) for k in range(3)]
        to = np.cumsum(lengths) - lengths
        cut_at, whole_at = spread(to[~whole], lengths[~whole]), spread(to[whole], lengths[whole])
        for k, (a, b) in enumerate(((ids.flat, [f[0] for f in found]), (begins, [f[1] for f in found]), (ends, [f[2] for f in found]))[: 3 if spans else 1]):
            out[k][cut_at] = a
            out[k][whole_at] = np.concatenate([np.asarray(x, np.int64) for x in b])
        return Ragged(out[0], lengths), out[1], out[2]

    @functools.cached_property
    def texts(self) -> Ragged:
        """The bytes of every piece, end to end."""
        return Ragged(np.frombuffer(b"".join(self.labels), np.uint8), self.sizes)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text (UTF-8) of ids: labels end to end, without the dummy space; bytes that are no character become U+FFFD."""
        ids = np.asarray(ids)
        kinds = self.kinds[ids]
        shown = np.flatnonzero(kinds != CONTROL)
        if len(shown) and len(shown) <= shown[-1] - shown[0]:  # bytes on both sides of a control piece are no character
            at = np.flatnonzero(kinds == CONTROL)
            parts = [p for p in np.split(ids, np.unique(np.concatenate([at, at + 1]))) if len(p) and self.kinds[p[0]] != CONTROL]
            return self.decode(parts[0]) + b"".join(self._text(p, self.kinds[p]) for p in parts[1:])
        return self._text(ids[shown], kinds[shown], start=True)

    def _text(self, ids: np.ndarray, kinds: np.ndarray, start: bool = False) -> bytes:
        raw = self.texts.take(ids).flat.tobytes()
        if (kinds == UNKNOWN).any():
            raw = b"".join(self.unknown if k == UNKNOWN else self.labels[i] for i, k in zip(ids.tolist(), kinds.tolist(), strict=True))
        if start and len(ids) and kinds[0] not in (BYTE, UNKNOWN) and raw.startswith(b" ") and (self.normaliser.dummy_prefix or self.normaliser.trim):
            raw = raw.lstrip(b" ") if self.normaliser.trim else raw[1:]
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = re.sub(rb"[\x00-\x7f]+|[\xc2-\xdf][\x80-\xbf]|(?:\xe0[\xa0-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]|\xed[\x80-\x9f])[\x80-\xbf]|(?:\xf0[\x90-\xbf]|[\xf1-\xf3][\x80-\xbf]|\xf4[\x80-\x8f])[\x80-\xbf]{2}|(.)", lambda m: "�".encode() if m[1] else m[0], raw, flags=re.DOTALL)
        return raw


def encode_decode(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, outputs: bool = False) -> DataFrame:
    """Encode every whole text with begin and end ids, decode the ids; returns ``carry`` and digests.

    Adds ``n_tokens`` (all ids), ``ids_sha256`` (little-endian unsigned 32-bit), ``decoded_sha256``
    (UTF-8) and ``spans_sha256``: of the byte spans in the source of all pieces between begin and end,
    as begin and end in turn, little-endian signed 64-bit.  With ``outputs`` also ``token_ids``,
    ``span_begins``, ``span_ends`` and ``decoded``.  A null or empty text has the begin and end ids alone
    and decodes to the empty text.  Strings of control pieces inside a text are plain text.  Carried
    columns with these names are dropped; rows are encoded alone, without a shuffle, so ties and repeated
    rows come out as often as they came in; an empty table gives an empty result.
    """
    made = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "spans_sha256": "string"}
    made |= {"token_ids": "array<int>", "span_begins": "array<long>", "span_ends": "array<long>", "decoded": "string"} if outputs else {}
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema), *(f"{k} {v}" for k, v in made.items())])
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = PieceTokenizer(path)  # read for each task, and gone with it
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for start, end in slices(texts, SLICE_BYTES):
                ids, begins, ends = tokenizer.encode(texts.slice(start, end - start).fill_null("").cast(pa.string()))
                found = []
                for i, n in zip(ids.starts.tolist(), ids.lengths.tolist(), strict=True):
                    own = np.concatenate(([tokenizer.begin], ids.flat[i : i + n], [tokenizer.end]))
                    spans = np.stack([begins[i : i + n], ends[i : i + n]], 1).astype("<i8")
                    decoded = tokenizer.decode(own)
                    row = [n + 2, *(hashlib.sha256(x).hexdigest() for x in (own.astype("<u4").tobytes(), decoded, spans.tobytes()))]
                    found.append([*row, own.astype(np.int32), spans[:, 0], spans[:, 1], decoded.decode()] if outputs else row)
                arrays = [pa.array([f[k] for f in found], kinds[k]) for k in range(len(made))]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, end - start) for c in batch.columns[:-1]), *arrays], names=[*carry, *made])

    return docs.select(*carry, F.col(text).alias("the_text")).mapInArrow(tidy(run), schema)
