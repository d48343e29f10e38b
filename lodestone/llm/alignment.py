"""Alignment of the tokens of two tokenizers over the same bytes.

**Merge path.**  The end offsets of all A tokens and of all B tokens of some texts, laid end to end, are
two ascending lists.  Merging them is cut into pieces of equal work: diagonal ``d`` crosses the merge
path where ``i`` A ends and ``d - i`` B ends are merged, and ``i`` is found by binary search, for all
diagonals at once.  Each piece is merged alone: it emits the A and B tokens that overlap in it, with
the number of groups closed before each, counted from the start of the piece.  A group ends where both
lists have an end (the A end is merged first, so the B end closes it, also where a piece ends between
the two).  Stitching adds up the pieces' closed groups, and a group that is open where a piece ends goes
on in the next.

**Link counts.**  A and B tokens of one group are linked.  A block of documents has one row for each pair
of ids that it links, with the number of its documents that do; these rows are shuffled and summed, joined
to their sums and to the highest sum of the A id, and go back to their block, whose packed postings
(pair, document, times) give each document's sums.  No pair of tokens is ever a row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ByteTexts, Ragged, slices, spread
from .common import materialise, tidy
from .pieces import PieceTokenizer
from .token_counts import Postings
from .token_files import encode

#: Bytes of text in a block of documents (one text may be longer).
BLOCK_BYTES = 3 << 20
#: Ends that one piece of the merge path has.
PIECE = 1 << 15
#: A group with more pairs of tokens is reduced to its distinct ids before they are paired.
LARGE_GROUP = 1 << 10
#: Pairs that exist at a time.
MOST_PAIRS = 1 << 20


def diagonals(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Where the merge path of two ascending lists crosses every ``piece``-th diagonal: places in both."""
    at = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    low, high = np.maximum(0, at - len(b)), np.minimum(at, len(a))
    while (low < high).any():
        middle = (low + high) // 2
        open_ = low < high
        # of equal ends, that of A is merged first
        first = np.zeros(len(at), bool)
        first[open_] = a[middle[open_]] <= b[at[open_] - 1 - middle[open_]]
        low = np.where(open_ & first, middle + 1, low)
        high = np.where(open_ & ~first, middle, high)
    return low, at - low


def merge_piece(a: np.ndarray, b: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray, int]:
    """One piece: groups closed before each of its A and B tokens, and in all of it; ``before``: the last A end before it."""
    place = np.searchsorted(a, b, "right")
    ends = np.concatenate(([before], a))[place]
    closed = b[ends == b]
    return np.searchsorted(closed, a, "left"), np.searchsorted(closed, b, "left"), len(closed)


def groups(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and B token, for ascending ends that close at the same place."""
    i, j = diagonals(a, b, piece)
    of_a, of_b, total = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 0
    for k in range(len(i) - 1):
        own_a, own_b, n = merge_piece(a[i[k] : i[k + 1]], b[j[k] : j[k + 1]], a[i[k] - 1] if i[k] else -1)
        of_a[i[k] : i[k + 1]], of_b[j[k] : j[k + 1]] = own_a + total, own_b + total
        total += n
    return of_a, of_b


class TwoTokenizers:
    """A byte-level tokenizer file (A) and a SentencePiece model (B), for the bytes of a space and a text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteTexts(path_a), PieceTokenizer(path_b)
        self.a.library.encode_special_tokens = True  # their strings are plain text
        self.a.added, self.a.at_added = [], None
        with open(path_a, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        of_symbol = {s: i for i, s in self.a.symbols.items()}
        labels = [b""] * (1 + max(vocab.values()))
        for name, i in vocab.items():
            if all(c in of_symbol for c in name):
                labels[i] = bytes(of_symbol[c] for c in name)
        self.bytes_a = Ragged(np.frombuffer(b"".join(labels), np.uint8), np.array(list(map(len, labels))))
        self.bytes_b = self.b.texts
        names = [b"%d," % i for n in (len(labels), len(self.b.labels)) for i in range(n)]
        self.names = Ragged(np.frombuffer(b"".join(names), np.uint8), np.array(list(map(len, names))))

    def align(self, texts: pa.Array) -> Aligned:
        """Tokens and groups of whole texts without nulls; of those whose bytes differ, none."""
        spaced = pc.binary_join_element_wise(" ", texts, "")
        raw = encode(self.a, spaced)
        a = Ragged(np.frombuffer(b"".join(raw), "<u4").astype(np.int64), np.fromiter((len(x) // 4 for x in raw), np.int64, len(raw)))
        del raw
        b, _, _ = self.b.encode(texts, spans=False)
        want = [x.encode() for x in spaced.to_pylist()]
        usable = np.array([len(x) > 1 for x in want], bool)
        for labels, ids in ((self.bytes_a, a), (self.bytes_b, b)):
            sizes = np.concatenate(([0], np.cumsum(labels.lengths[ids.flat])))
            ends = np.cumsum(ids.lengths)
            for i, (s, e) in enumerate(zip((ends - ids.lengths).tolist(), ends.tolist(), strict=True)):
                if usable[i]:
                    usable[i] = sizes[e] - sizes[s] == len(want[i]) and labels.take(ids.flat[s:e]).flat.tobytes() == want[i]
        kept = [a, b] if usable.all() else [Ragged(x.flat[np.repeat(usable, x.lengths)], np.where(usable, x.lengths, 0)) for x in (a, b)]
        ends = [np.cumsum(labels.lengths[x.flat]) for labels, x in zip((self.bytes_a, self.bytes_b), kept, strict=True)]
        return Aligned(*kept, *groups(*ends))


class Aligned:
    """Tokens of texts by two tokenizers, and the group of each; groups are numbered through all texts."""

    def __init__(self, a: Ragged, b: Ragged, group_a: np.ndarray, group_b: np.ndarray) -> None:
        self.a, self.b, self.group_a, self.group_b = a, b, group_a, group_b
        self.texts = len(a.lengths)
        self.total = int(group_a[-1]) + 1 if len(group_a) else 0
        self.size_a, self.size_b = np.bincount(group_a, minlength=self.total), np.bincount(group_b, minlength=self.total)
        self.text_of = np.zeros(self.total, np.int64)  # of each group
        self.text_of[group_a] = np.repeat(np.arange(self.texts), a.lengths)

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups and links of each text."""
        first = np.searchsorted(self.text_of, np.arange(self.texts + 1))
        links = np.concatenate(([0], np.cumsum(self.size_a * self.size_b)))
        return np.diff(first), np.diff(links[first])

    def digests(self, names: Ragged, offset: int) -> list[str]:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3`` for each text; nothing where it has no tokens."""
        out, limit = [], 1 << 18
        bounds_a, bounds_b = (np.concatenate(([0], np.cumsum(x.lengths))) for x in (self.a, self.b))
        before_a, before_b = np.concatenate(([0], np.cumsum(self.size_a))), np.concatenate(([0], np.cumsum(self.size_b)))
        first = 0
        while first < self.texts:  # some texts at a time, or one longer one
            last = max(first + 1, int(np.searchsorted(bounds_a, bounds_a[first] + limit, "right")) - 1)
            i, j = np.arange(bounds_a[first], bounds_a[last]), np.arange(bounds_b[first], bounds_b[last])
            ga, gb = self.group_a[i], self.group_b[j]
            base = bounds_a[first] + bounds_b[first]
            at_a, at_b = i + before_b[ga] - base, j + before_a[gb + 1] - base
            order = np.zeros(len(i) + len(j), np.int64)
            order[at_a], order[at_b] = self.a.flat[i], self.b.flat[j] + offset
            ends = np.cumsum(names.lengths[order])
            shown = names.take(order).flat
            # behind the last A token of a group, and the last B token
            shown[ends[at_a[i + 1 == before_a[ga + 1]]] - 1] = ord("|")
            shown[ends[at_b[j + 1 == before_b[gb + 1]]] - 1] = ord(";")
            raw, ends = shown.tobytes(), np.concatenate(([0], ends))
            places = (bounds_a[first : last + 1] + bounds_b[first : last + 1] - base).tolist()
            out += [hashlib.sha256(raw[ends[s] : ends[e] - 1]).hexdigest() if e > s else "" for s, e in zip(places, places[1:], strict=False)]
            first = last
        return out

    def postings(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair of ids ``a * width + b``, text, links) for all that are linked, sorted by pair and text."""
        large = self.size_a * self.size_b > LARGE_GROUP
        sides = []
        for ids, group in ((self.a.flat, self.group_a), (self.b.flat, self.group_b)):
            inside = large[group]
            keys, times = np.unique(group[inside] << 32 | ids[inside], return_counts=True)
            g = np.concatenate([group[~inside], keys >> 32])
            order = np.argsort(g, kind="stable") if len(keys) else slice(None)
            sides.append((g[order], np.concatenate([ids[~inside], keys & 0xFFFFFFFF])[order], np.concatenate([np.ones(int((~inside).sum()), np.int64), times])[order]))
        (ga, ia, ta), (gb, ib, tb) = sides
        n = np.bincount(gb, minlength=self.total)
        start = np.cumsum(n) - n
        reach = np.concatenate(([0], np.cumsum(n[ga])))
        found, at = [], 0
        while at < len(ga):
            to = max(at + 1, int(np.searchsorted(reach, reach[at] + MOST_PAIRS, "right")) - 1)
            g = ga[at:to]
            b = spread(start[g], n[g])
            a = np.repeat(np.arange(at, to), n[g])
            found.append(self._sum((ia[a] * width + ib[b]) * self.texts + self.text_of[gb[b]], ta[a] * tb[b]))
            at = to
        if not found:
            return (np.zeros(0, np.int64),) * 3
        keys, times = found[0] if len(found) == 1 else self._sum(*map(np.concatenate, zip(*found, strict=True)))
        return keys // self.texts, keys % self.texts, times

    @staticmethod
    def _sum(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


def token_groups(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The alignment itself: ``key, a_ids, a_groups, b_ids, b_groups``, groups numbered from 0 in each document.

    A document without tokens (see ``link_sums``) has empty arrays.  Rows are aligned alone, without a shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = TwoTokenizers(path_a, path_b)
        for batch in batches:
            for start, end in slices(batch.column(1), BLOCK_BYTES):
                found = both.align(batch.column(1).slice(start, end - start).fill_null("").cast(pa.string()))
                first = np.searchsorted(found.text_of, np.arange(found.texts))
                columns = []
                for ids, group in ((found.a, found.group_a), (found.b, found.group_b)):
                    offsets = pa.array(np.concatenate(([0], np.cumsum(ids.lengths))), pa.int32())
                    columns += [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (ids.flat, group - np.repeat(first, ids.lengths))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), *columns], names=[key, "a_ids", "a_groups", "b_ids", "b_groups"])

    return docs.select(key, F.col(text).alias("the_text")).mapInArrow(tidy(run), f"`{key}` {kind}, a_ids array<int>, a_groups array<int>, b_ids array<int>, b_groups array<int>")


def blocks(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Linked pairs of ids by block of documents.

    A block has a row ``(a, b, block, place, docs)`` for each pair of ids it links, ``docs`` being the number
    of its documents that do, and one row with ``own`` (keys and counts of its documents) and the packed
    ``postings``.  A pair has no more rows than there are blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both = TwoTokenizers(path_a, path_b)
        offset, width = len(both.bytes_a.lengths), len(both.bytes_b.lengths)
        number = TaskContext.get().partitionId() << 32
        names = ["a", "b", "block", "place", "docs", "own", "postings"]
        for batch in batches:
            for start, end in slices(batch.column(1), BLOCK_BYTES):
                part = batch.slice(start, end - start)
                found = both.align(part.column(1).fill_null("").cast(pa.string()))
                n_groups, n_links = found.counts()
                columns = [part.column(0), *(pa.array(x, pa.int64()) for x in (found.a.lengths, found.b.lengths, n_groups, n_links)), pa.array(found.digests(both.names, offset), pa.string())]
                mine = pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, mine.schema) as out:
                    out.write_batch(mine)
                pair, doc, times = found.postings(width)
                first = np.flatnonzero(np.diff(pair, prepend=-1))
                place = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(pair))))
                held = np.bincount(place, minlength=len(first))
                packed = Postings.pack(len(first), place, doc, times)
                none = pa.nulls(1, pa.int32())
                yield pa.RecordBatch.from_arrays([none, none, pa.array([number], pa.int64()), none, none, pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([packed], pa.binary())], names=names)
                for i in range(0, len(first), 50_000):
                    some = pair[first[i : i + 50_000]]
                    m = len(some)
                    numbers = [pa.array(x.astype(np.int32)) for x in (some // width, some % width)]
                    rest = [pa.array(x.astype(np.int32)) for x in (np.arange(i, i + m), held[i : i + m])]
                    yield pa.RecordBatch.from_arrays([*numbers, pa.array(np.full(m, number)), *rest, pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=names)
                number += 1

    return docs.select(key, F.col(text).alias("the_text")).mapInArrow(tidy(run), "a int, b int, block long, place int, docs int, own binary, postings binary")


def link_counts(pairs: DataFrame) -> DataFrame:
    """``a, b, docs``: how many documents link each pair of ids, from the rows of ``blocks``."""
    return pairs.groupBy("a", "b").agg(F.sum("docs").alias("docs"))


def link_sums(docs: DataFrame, path_a: str, path_b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each input row: ``key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    A space and the text are read by the byte-level tokenizer at ``path_a``, the text by the SentencePiece
    model at ``path_b``, without special tokens, whose strings are plain text.  A text that is null or empty,
    or whose tokens spell other bytes than a space and the text, has no tokens: zeros and an empty
    ``groups_sha256``.  ``count_sum`` adds the number of documents of the corpus that link a pair, over all
    links; ``n_best`` counts the links whose number is the highest of their A id, ties included.  Rows
    count alone: repeated rows and null keys are documents of their own.  An empty table gives an empty
    result.  Only ``key`` and ``text`` are read, so other columns cannot clash.
    """
    table = materialise(blocks(docs, path_a, path_b, text, key), "links")
    pairs = table.where("own is null").select("a", "b", "block", "place", "docs")
    counts = link_counts(pairs)
    best = counts.groupBy("a").agg(F.max("docs").alias("top"))  # no more rows than A has tokens
    # a pair has a row in every block that links it, a block one for every pair: neither side of these joins is hot
    counts = counts.join(F.broadcast(best), "a").select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("docs").alias("total"), (F.col("docs") == F.col("top")).alias("best"))
    scored = pairs.join(counts, (F.col("a") == F.col("x")) & (F.col("b") == F.col("y"))).select("block", "place", "total", "best")
    none = F.lit(None).cast("binary")
    rows = scored.select("*", none.alias("own"), none.alias("postings")).unionByName(table.where("own is not null").select("block", "own", "postings"), allowMissingColumns=True)

    def of_block(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        is_block = rows.column("own").is_valid()
        block, words = rows.filter(is_block), rows.filter(pc.invert(is_block))
        own = pa.ipc.open_stream(block.column("own")[0].as_buffer()).read_all()
        total, best = np.zeros(words.num_rows, np.int64), np.zeros(words.num_rows, np.int64)
        at = words.column("place").to_numpy()
        total[at] = words.column("total").to_numpy()
        best[at] = words.column("best").to_numpy(zero_copy_only=False)
        packed = block.column("postings")[0].as_py()
        sums = [Postings.sums(packed, x, own.num_rows) for x in (best, total)]
        return pa.table({"id": own.column("id"), **{c: own.column(c) for c in ("n_a", "n_b", "n_groups", "n_links")}, "n_best": sums[0], "count_sum": sums[1], "groups_sha256": own.column("groups_sha256")})

    kind = docs.schema[key].dataType.simpleString()
    out = rows.groupBy("block").applyInArrow(of_block, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("id", key)
