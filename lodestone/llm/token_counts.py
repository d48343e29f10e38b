"""Token counts without token ids: pieces are counted once for each distinct pre-token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ByteTexts, slices
from .common import tidy

#: Bytes of text in a block of documents (one text may be longer).
BLOCK_BYTES = 24 << 20
#: Bytes of a block's text that are cut into pre-tokens at a time.
SLICE_BYTES = 3 << 20
#: Columns of the frequency table: rows of pre-tokens, and one row for each block.
SCHEMA = "at string, block long, place int, docs binary, postings binary"


def frequencies(pre: ByteTexts, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of some texts, and (place of the pre-token, place of the text, count), sorted.

    Texts are cut slice by slice; of a slice only its distinct pre-tokens and its counts stay.
    """
    words, codes, docs, counts = [pa.array([], pa.string())], [], [], []
    for start, end in slices(texts, SLICE_BYTES):
        own, code, doc, times = _of_slice(pre, texts.slice(start, end - start))
        codes.append((code + sum(map(len, words))).astype(np.int32))
        docs.append((doc + start).astype(np.int32))
        counts.append(times.astype(np.int32))
        words.append(own)
    coded = pa.concat_arrays(words).dictionary_encode()
    if not codes:
        return coded.dictionary, *(np.zeros(0, np.int32),) * 3
    code = coded.indices.to_numpy()[np.concatenate(codes)]
    # slices and their texts ascend, so equal pre-tokens stay in the order of their texts
    order = np.argsort(code, kind="stable").astype(np.int32)
    return coded.dictionary, code[order], np.concatenate(docs)[order], np.concatenate(counts)[order]


def _of_slice(pre: ByteTexts, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The same for one slice, sorted by text."""
    whole = pre.whole(texts)
    words, found = pre.read(texts.filter(pa.array(~whole)))
    code, doc = found.flat, np.repeat(np.flatnonzero(~whole), found.lengths)
    if whole.any():
        at = np.flatnonzero(whole)
        parts = [pre.split_whole(t) for t in texts.take(pa.array(at)).to_pylist()]
        coded = pa.concat_arrays([words, pa.array([p for s in parts for p in s], pa.string())]).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        code = np.concatenate([codes[code], codes[len(words) :]])
        doc = np.concatenate([doc, np.repeat(at, np.fromiter(map(len, parts), np.int64, len(parts)))])
        words = coded.dictionary
    n = max(1, len(words))
    keys = np.sort(doc * n + code)
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return words, keys[first] % n, keys[first] // n, np.diff(np.append(first, len(keys)))


class Postings:
    """Packed postings: how many documents hold each pre-token, which, and how often (255 at a time)."""

    @staticmethod
    def pack(words: int, code: np.ndarray, doc: np.ndarray, times: np.ndarray) -> bytes:
        many = -(-times // 255)
        last = np.cumsum(many) - 1
        spread = np.full(int(many.sum()), 255, np.uint8)
        spread[last] = times - 255 * (many - 1)
        code, doc = np.repeat(code, many), np.repeat(doc, many)
        # documents ascend: steps from one to the next are small where a pre-token is frequent
        steps = np.where(np.diff(code, prepend=-1) != 0, doc, np.diff(doc, prepend=0))
        sizes = np.bincount(code, minlength=words).astype("<i4")
        raw = b"".join(x.tobytes() for x in (np.array([words], "<i4"), sizes, (steps & 255).astype(np.uint8), (steps >> 8).astype(np.uint8), spread))
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @staticmethod
    def sums(packed: bytes, pieces: np.ndarray, docs: int) -> np.ndarray:
        """Of each document: the pieces of its pre-tokens, each as often as it stands there."""
        raw = zstandard.ZstdDecompressor().decompress(packed)
        words = int(np.frombuffer(raw, "<i4", 1)[0])
        if words != len(pieces):
            raise ValueError("a pre-token has no count")
        sizes = np.frombuffer(raw, "<i4", words, 4)
        n = int(sizes.sum())
        low, high, times = np.frombuffer(raw, np.uint8, 3 * n, 4 + 4 * words).reshape(3, n)
        doc = np.concatenate(([0], np.cumsum(low + (high.astype(np.int64) << 8))))
        doc = doc[1:] - np.repeat(doc[np.cumsum(sizes) - sizes], sizes)
        return np.bincount(doc, weights=times * np.repeat(pieces.astype(np.float64), sizes), minlength=docs).astype(np.int64)


def pre_token_frequencies(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Pre-token frequencies of every document, by blocks of documents.

    A block is some documents of one task (24 MB of text, or one longer one).  It has a row ``(at, block,
    place)`` for every distinct pre-token ``at``, and one row with its documents' keys and sizes
    (``docs``) and the packed ``postings``.  A pre-token has no more rows than there are blocks, so no
    key is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pre = ByteTexts(path)
        number = TaskContext.get().partitionId() << 32
        names = ["at", "block", "place", "docs", "postings"]
        for batch in batches:
            for start, end in slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(start, end - start)
                texts = part.column(1).fill_null("").cast(pa.string())
                words, code, doc, times = frequencies(pre, texts)
                sink = pa.BufferOutputStream()
                mine = pa.RecordBatch.from_arrays([part.column(0), pa.compute.binary_length(texts).cast(pa.int64())], names=["id", "n_bytes"])
                with pa.ipc.new_stream(sink, mine.schema) as out:
                    out.write_batch(mine)
                yield pa.RecordBatch.from_arrays([pa.array([str(number)]), pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([Postings.pack(len(words), code, doc, times)], pa.binary())], names=names)
                for i in range(0, len(words), 50_000):
                    some = words.slice(i, 50_000)
                    m = len(some)
                    yield pa.RecordBatch.from_arrays([some, pa.array(np.full(m, number)), pa.array(np.arange(i, i + m, dtype=np.int32)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=names)
                number += 1

    return docs.select(key, F.col(text).alias("the_text")).mapInArrow(tidy(run), SCHEMA)


def count_pieces(table: DataFrame, path: str) -> DataFrame:
    """``(at, pieces)`` for the distinct pre-tokens of a table that is partitioned by them.

    All rows of a pre-token are in one task, which counts it once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, last = ByteTexts(path), None
        for batch in batches:  # sorted: equal pre-tokens follow each other
            own = batch.column("at").filter(batch.column("docs").is_null())
            words = own.dictionary_encode().dictionary.to_pylist()
            if words and words[0] == last:
                words = words[1:]
            if words:
                last = words[-1]
                counts = [1 if w in pre.added else n for w, n in zip(words, pre.pieces(words, len), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int32())], names=["at", "pieces"])

    return table.sortWithinPartitions("at").mapInArrow(tidy(run), "at string, pieces int")


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 512) -> DataFrame:
    """One row for each input row: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Counts what the library's ``encode(text, add_special_tokens=False)`` gives for the whole text
    (null: empty, 0 tokens).  Pieces are counted once for each distinct pre-token of the corpus, joined
    to the frequencies and summed at each block of documents; token ids never exist, and a task keeps
    one block.  Rows count alone: repeated rows and null keys come out as often as they came in.  An
    empty table gives an empty result.  Only ``key`` and ``text`` are read, so other columns cannot clash.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle serves both sides of the join, so nothing may be filtered or pruned before it
    table = pre_token_frequencies(docs, path, text, key).repartition(n, "at")
    pieces = count_pieces(table, path).withColumnRenamed("at", "piece_at")
    joined = table.join(pieces, F.col("at") == F.col("piece_at"), "left")

    def of_block(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        is_block = rows.column("docs").is_valid()
        block, words = rows.filter(is_block), rows.filter(pa.compute.invert(is_block))
        counts = np.zeros(words.num_rows, np.int64)
        counts[words.column("place").to_numpy()] = words.column("pieces").to_numpy()
        own = pa.ipc.open_stream(block.column("docs")[0].as_buffer()).read_all()
        sums = Postings.sums(block.column("postings")[0].as_py(), counts, own.num_rows)
        return pa.table({"id": own.column("id"), "n_bytes": own.column("n_bytes"), "n_tokens": sums})

    kind = docs.schema[key].dataType.simpleString()
    total = joined.select("block", "place", "pieces", "docs", "postings").groupBy("block").applyInArrow(of_block, f"id {kind}, n_bytes long, n_tokens long")
    return total.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
