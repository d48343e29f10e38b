"""Token-id files: one independent zstandard frame for each document, and a trailing seek table.

A file is a sequence of zstandard frames, then a skippable frame with the seek table in the public
seekable format: for each frame its compressed size, its decompressed size and the low 32 bits of
the XXH64 (seed 0) of its content, then the number of frames, a descriptor and a magic number.  Any
zstandard reader can decompress the whole; a reader of the table decompresses the frames it wants.
A frame holds a document's ids as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .chunks import ByteTexts, Ragged, slices
from .common import materialise, new_folder, tidy

# fixed values of the seekable format
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80


def encode(pre: ByteTexts, texts: pa.Array) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of whole texts without nulls, as the library gives them.

    Each distinct pre-token is encoded once by the library's model; texts that may not be cut are
    encoded by the library as a whole.
    """
    whole = pre.whole(texts)
    words, found = pre.read(texts.filter(pa.array(~whole)))
    pieces = Ragged.of(pre.pieces(words.to_pylist(), lambda made: [t.id for t in made]))
    ids = Ragged(pieces.flat.astype("<u4"), pieces.lengths).take(found.flat)
    ends = np.concatenate(([0], np.cumsum(ids.lengths)))[np.cumsum(found.lengths)].tolist()
    out: list[bytes] = [b""] * len(texts)
    start = 0
    for i, end in zip(np.flatnonzero(~whole).tolist(), ends, strict=True):
        out[i], start = ids.flat[start:end].tobytes(), end
    at = np.flatnonzero(whole)
    for i, e in zip(at.tolist(), pre.library.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False), strict=True):
        out[i] = np.array(e.ids, "<u4").tobytes()
    return out


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    """The trailing skippable frame for (compressed size, size, checksum) of each frame."""
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), WITH_CHECKSUMS, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class Frames:
    """Random access to the frames of one file."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        self.file, self.path = system.open_input_file(inner), path
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC or flags != WITH_CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        table = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3)
        self.sizes, self.sums = table[:, 0].astype(np.int64), table[:, 2]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.reader = zstandard.ZstdDecompressor()

    def read(self, frame: int) -> bytes:
        raw = self.reader.decompress(self.file.read_at(int(self.sizes[frame]), int(self.starts[frame])))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[frame]:
            raise ValueError(f"frame {frame} of {self.path} is damaged")
        return raw


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text", key: str = "doc_id", end_id: int = 0, level: int = 1, files: int | None = None) -> DataFrame:
    """Write all documents in ascending order of ``key``; returns the index of the files.

    ``path`` is a folder that driver and executors share.  Each task writes one file; its name holds
    the task attempt, so a repeated or speculative attempt never touches another one's file, and the
    index (Parquet below ``path``) names only files of attempts that Spark committed.  Index rows:
    ``key, file_no, path, frame, offset`` (ids before the document in its file), ``start`` (ids before
    it in all files), ``n_tokens`` (with the end id).  A null text is an empty document (the end id
    alone).  Null keys come first; rows with equal keys are ordered by text.  An empty table gives an
    empty index.
    """
    spark = docs.sparkSession
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n, "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"{path}/files/part-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst"
        system, inner = fs.FileSystem.from_uri(name)
        pre = ByteTexts(tokenizer)
        out, entries, offset = None, [], 0
        packer = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            if out is None:
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(inner, compression=None)
            frames, offsets, counts = [], [], []
            for i, j in slices(batch.column(1)):
                for ids in encode(pre, batch.column(1).slice(i, j - i).cast(pa.string())):
                    raw = ids + end
                    packed = packer.compress(raw)
                    out.write(packed)
                    frames.append(len(entries))
                    offsets.append(offset)
                    counts.append(len(raw) // 4)
                    entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                    offset += counts[-1]
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([task.partitionId()] * m, pa.int32()), pa.array([name] * m, pa.string()), *(pa.array(x, pa.int64()) for x in (frames, offsets, counts))],
                names=["key", "file_no", "path", "frame", "offset", "n_tokens"],
            )
        if out is not None:
            out.write(seek_table(entries))
            out.close()

    index = rows.mapInArrow(tidy(run), f"key {kind}, file_no int, path string, frame long, offset long, n_tokens long")
    index.write.parquet(f"{path}/index")
    index = spark.read.schema(index.schema).parquet(f"{path}/index")
    sizes = index.groupBy("file_no").agg(F.sum("n_tokens").alias("ids"))  # one row for each file
    before = F.coalesce(F.sum("ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = materialise(sizes.select("file_no", before.alias("base")), "bases")
    return index.join(bases, "file_no").withColumn("start", F.col("base") + F.col("offset")).drop("base")


def read(index: DataFrame, ids: bool = True) -> DataFrame:
    """Read the documents of the given index rows: adds ``ids_crc32`` and, with ``ids``, ``token_ids``.

    Only the frames named are read and decompressed, each checked against its checksum.
    """
    carry = list(index.columns)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema), "ids_crc32 long", *(["token_ids array<int>"] if ids else [])])
    at_path, at_frame = carry.index("path"), carry.index("frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: dict[str, Frames] = {}
        for batch in batches:
            sums, values = [], []
            for p, f in zip(batch.column(at_path).to_pylist(), batch.column(at_frame).to_pylist(), strict=True):
                if p not in files:
                    files.clear()  # one file is open at a time
                    files[p] = Frames(p)
                raw = files[p].read(f)
                sums.append(zlib.crc32(raw))
                if ids:
                    values.append(np.frombuffer(raw, "<u4").astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64()), *([pa.array(values, pa.list_(pa.int32()))] if ids else [])], names=[*carry, "ids_crc32", *(["token_ids"] if ids else [])])

    return index.mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write all documents to a new shared folder and read all back: ``key, start, n_tokens, ids_crc32``."""
    index = write(docs, new_folder(docs.sparkSession, "ids"), tokenizer, text, key)
    return read(index, ids=False).select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32")
