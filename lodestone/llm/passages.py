"""Substring dedup by collinear chaining of shared k-mer seeds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import slices
from .common import free_name, materialise, mix, powers_upto, tidy

#: Words in a seed; one of SAMPLE k-mers is a seed, chosen by its hash alone, wherever it stands.
SEED_WORDS, SAMPLE = 4, 4
#: Short seeds whose words in a row are a long seed as well: of each LONG_WINDOW in a row that with the smallest hash.
LONG, LONG_WINDOW = 4, 24
#: k-mers in a row of which one is a seed in any case, the one with the smallest hash.
WINDOW = 24
#: Words on each side of a seed whose sketch tells whether two places may share a passage.
SIDE = 16
#: Least agreement of the sketches of one side, and bits by which a later owner must agree better than an earlier one.
AGREE, BETTER = 0.65, 6
#: Earlier documents with a seed, beside the first one, that each of its places is compared with.
OWNERS = 4
#: Words before a seed and behind it in which places that are left over are compared.
AROUND, BESIDE = 36, 48
#: Places left over of a seed, above which their pairs are dealt over several tasks.
TILE = 4096
#: Earlier places from which on a place is compared with them column by column, and pairs that are compared at a time otherwise.
MANY, PAIRS = 40, 1 << 13
#: Later places of a seed with so many earlier ones from which on they are compared by bits, and 64s of pairs that are compared so at a time.
CROWD, BITS = 8, 1 << 12
#: Words apart at which stretches around two places are aligned, and words beyond those of a passage that must agree for a link to be sure.
STEP, SURE = 7, 4
#: Documents of one slice that hold a seed, above which the slice sends one place of it to the others.
HOT = 16
#: Characters between two seeds of a chain at which the gap costs as much as a seed gains.
GAP = 240
#: Characters that a chain's passage may grow beyond its outermost seeds while it is aligned.
REACH = 240
#: Characters beyond these, so that the words there are whole.
EDGE = 32
#: Least words of a passage, and least share of them that agree in order.
MIN_WORDS, SIMILARITY = 40, 0.8
#: Chains of a pair of documents that ask for their texts in one row.
TOGETHER = 64
#: Matches of pairs that are chained at a time, unless one pair has more.
MATCHES = 1 << 17
#: Bytes of text that are hashed at a time.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A number for each byte; ASCII letters in lower case.
_BYTES = mix(np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64) + np.uint64(1))


class Words:
    """Hash, text, first character and end (exclusive) of every word of some texts without nulls.

    A word is a run of characters other than ASCII white space; positions count characters in its text.
    """

    def __init__(self, texts: pa.Array) -> None:
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        word = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:-1]
        last[:-1] &= ~word[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        powers, inverse = powers_upto(len(raw) + 1)
        prefix = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTES[raw] * powers[: len(raw)], out=prefix[1:])
        characters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=characters[1:])
        self.hash = mix((prefix[ends] - prefix[starts]) * inverse[starts])
        self.text = np.searchsorted(offsets, starts, "right") - 1
        before = characters[offsets[self.text]]
        self.start, self.end = characters[starts] - before, characters[ends] - before
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))  # of each text's words

    def seeds(self, k: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every seed; k-mers of one word, said again and again, are none."""
        n = max(0, len(self.hash) - k + 1)
        found = self.hash[:n].copy()
        for i in range(1, k):
            found = mix(found * np.uint64(0x9E3779B97F4A7C15) + self.hash[i : n + i])
        inside = (self.text[:n] == self.text[k - 1 : k - 1 + n]) & np.any([self.hash[i : n + i] != self.hash[:n] for i in range(1, k)], axis=0)
        found[~inside] = np.uint64((1 << 64) - 1)
        chosen = inside & (found <= np.uint64((1 << 64) // sample - 1))
        # stretches without a seed, as in texts of few distinct words
        seeds = np.concatenate(([0], np.cumsum(chosen)))
        start = np.arange(max(0, n - WINDOW + 1))
        bare = start[(seeds[start + WINDOW] == seeds[start]) & (self.text[start] == self.text[start + WINDOW + k - 2])]
        for i in range(0, len(bare), 1 << 16):
            rows = bare[i : i + (1 << 16), None] + np.arange(WINDOW)
            chosen[rows[np.arange(len(rows)), found[rows].argmin(1)]] = True
        at = np.flatnonzero(chosen & inside)
        long, far = self._long_seeds(found, inside, k)
        return np.concatenate((found[at], long)), np.concatenate((at, far))

    def _long_seeds(self, short: np.ndarray, inside: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every long seed: short fragments of a passage have none of them.

        Every passage of ``LONG * k + LONG_WINDOW - 1`` equal words has one at the same words in all its documents,
        where it stands in them first.
        """
        n = max(0, len(short) - (LONG - 1) * k)
        if not n:
            return short[:0], np.zeros(0, np.int64)
        found, whole = short[:n], inside[:n].copy()
        for i in range(1, LONG):
            found = mix(found * np.uint64(0xD6E8FEB86659FD93) + short[i * k : n + i * k])
            whole &= self.text[i * k + k - 1 : i * k + k - 1 + n] == self.text[:n]
        found[~whole] = np.uint64((1 << 64) - 1)
        pad = np.full(LONG_WINDOW - 1, (1 << 64) - 1, np.uint64)
        # the smallest of each window, then, of all windows around a place, the largest of these
        least = _windows(np.concatenate((pad, found, pad)), LONG_WINDOW, np.minimum)
        chosen = whole & (_windows(least, LONG_WINDOW, np.maximum) == found)
        at = np.flatnonzero(chosen)
        # a line that a document repeats has its long seeds at its first place
        order = np.argsort(found[at], kind="stable")
        said, of = found[at[order]], self.text[at[order]]
        again = np.zeros(len(at), bool)
        again[order[1:]] = (said[1:] == said[:-1]) & (of[1:] == of[:-1])
        at = at[~again]
        return found[at], at

    def sketches(self, at: np.ndarray, k: int, side: int) -> np.ndarray:
        """For seeds at these words: a bit of 32 for each of ``side`` words before (high half) and behind (low half)."""
        bits = np.left_shift(np.uint32(1), (self.hash >> np.uint64(59)).astype(np.uint32))
        far = np.full(side + k, -1, np.int64)
        after = _either(np.concatenate((bits, np.zeros(side + k, np.uint32))), np.concatenate((self.text, far)), side)
        of = np.concatenate((self.text, far))
        behind = np.where(of[at + k] == self.text[at], after[at + k], 0).astype(np.uint64)
        before = _either(np.concatenate((bits[::-1], np.zeros(side + k, np.uint32))), np.concatenate((self.text[::-1], far)), side)
        of = np.concatenate((self.text[::-1], far))
        mirror = len(bits) - at  # of the word before the seed, counted from the end
        front = np.where(of[mirror] == self.text[at], before[mirror], 0).astype(np.uint64)
        return front << np.uint64(32) | behind


def _windows(values: np.ndarray, size: int, of) -> np.ndarray:
    """``of`` (a minimum or maximum) of every ``size`` values in a row."""
    width = 1
    while 2 * width <= size:
        values, width = of(values[:-width], values[width:]), 2 * width
    return of(values[: len(values) - (size - width)], values[size - width :]) if size > width else values


def _either(bits: np.ndarray, text: np.ndarray, side: int) -> np.ndarray:
    """At each word: the bits of it and the ``side - 1`` words behind it in the same text; ``side`` is a power of two."""
    width = 1
    while width < side:
        more = np.zeros_like(bits)
        more[:-width] = np.where(text[:-width] == text[width:], bits[width:], 0)
        bits, width = bits | more, 2 * width
    return bits


def seed_table(docs: DataFrame, text: str, key: str, k: int, sample: int, side: int, hot: int) -> DataFrame:
    """``(h, doc, x, sketch, g)``: every seed with its first character and the sketches of its sides.

    A seed that many documents of one slice hold gets a name of its own there, and only the slice's
    first document sends it under its common name too; so no name has many more rows than there are
    slices.  ``g`` is the common name of all these rows, null for others; ``linked`` gives their places on.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["h", "doc", "x", "sketch", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start, end in slices(batch.column(1), SLICE_BYTES):
                part = batch.slice(start, end - start)
                part = part.take(pc.sort_indices(part.column(0)))
                words = Words(part.column(1).fill_null("").cast(pa.string()))
                h, at = words.seeds(k, sample)
                if not len(h):
                    continue
                doc, x, sketch = words.text[at], words.start[at], words.sketches(at, k, side)
                # only seeds with more places can be in more documents: these are put in order
                order = np.argsort(h)
                places = np.diff(np.append(np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]) != 0), len(h)))
                order = order[np.repeat(places > hot, places)]
                order = order[np.lexsort((at[order], h[order]))]
                new = np.diff(h[order], prepend=~h[order[:1]]) != 0
                runs = new | (np.diff(doc[order], prepend=-1) != 0)
                group = np.cumsum(new) - 1
                many = (np.bincount(group, weights=runs) > hot)[group]
                held, first = order[many], order[many & new]
                take = np.concatenate((np.arange(len(h)), first))
                alone = np.ones(len(take), bool)
                alone[held] = alone[len(h) :] = False
                g = pa.array(h[take].view(np.int64), mask=alone)
                own = h.copy()
                own[held] = mix(own[held] + np.uint64(number))
                h = np.concatenate((own, h[first]))
                number += 1
                for i in range(0, len(h), 100_000):
                    some = take[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), part.column(0).take(pa.array(doc[some])), pa.array(x[some].astype(np.int32)), pa.array(sketch[some].view(np.int64)), g.slice(i, 100_000)], names=names)

    return docs.select(key, text).mapInArrow(tidy(run), f"h long, doc {kind}, x int, sketch long, g long")


def agreement(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Bits that pairs of sketches share; -1 where no side agrees by ``least`` (one without words agrees with none)."""
    total, agree = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
    for x, y in ((a >> np.uint64(32), b >> np.uint64(32)), (a & np.uint64(0xFFFFFFFF), b & np.uint64(0xFFFFFFFF))):
        common = np.bitwise_count(x & y).astype(np.int64)
        size = np.maximum(np.bitwise_count(x), np.bitwise_count(y)).astype(np.int64)
        total += common
        agree |= (size > 0) & (common >= least * size)
    return np.where(agree, total, -1)


def linked(seeds: DataFrame, owners: int, agree: float, better: int) -> DataFrame:
    """``(doc, other, x, y, h)``: places of a seed joined to a place in an earlier document.

    The table is partitioned by seed and sorted by seed, document and place.  Every place is compared with
    the seed's first document and the ``owners`` nearest earlier ones, by the words on both sides.  Of
    those that agree on one side the one with most agreement is taken, the earliest of nearly equal
    ones.  A task keeps a few rows of a seed, however many it has.

    Every place of a seed that three documents or more hold is a row without ``other`` as well, with the
    seed's common name ``h``: where no passage is found with the one chosen, ``left_over`` compares it with all the others.
    """
    kind = seeds.schema["doc"].dataType.simpleString()
    names = ["doc", "other", "x", "y", "h"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None
        held, many = [], False  # of the last seed: its places while few documents have it, and whether more do
        for batch in batches:
            if not batch.num_rows:
                continue
            old = kept.num_rows if kept is not None else 0
            if old:
                batch = pa.concat_batches([kept, batch])
            h, docs, x, sketch, g = (batch.column(i) for i in range(5))
            places = pa.RecordBatch.from_arrays([docs, pa.nulls(len(x), docs.type), x, pa.nulls(len(x), pa.int32()), pc.coalesce(g, h)], names=names)
            again = pc.fill_null(pc.equal(g, h), False).to_numpy(zero_copy_only=False)  # under its own name too
            named = g.is_valid().to_numpy(zero_copy_only=False)
            h, x, sketch = h.to_numpy(), x.to_numpy(), sketch.to_numpy().view(np.uint64)
            new = np.concatenate(([True], h[1:] != h[:-1]))
            runs = new | np.concatenate(([True], pc.not_equal(docs.slice(1), docs.slice(0, len(docs) - 1)).to_numpy(zero_copy_only=False)))
            starts = np.flatnonzero(new)
            several = (np.add.reduceat(runs.astype(np.int64), starts) > 2) | np.logical_or.reduceat(named, starts)
            several[0] |= many and old > 0
            if several[0]:
                yield from held
            wanted = (np.arange(len(h)) >= old) & ~again
            yield places.filter(pa.array(wanted & np.repeat(several, np.diff(np.append(starts, len(h))))))
            many = bool(several[-1])
            last = wanted & (np.arange(len(h)) >= starts[-1])
            held = [] if many else [*(held if len(starts) == 1 else []), places.filter(pa.array(last))]
            run_of, rows_of = np.cumsum(runs) - 1, np.flatnonzero(runs)
            places_of = np.diff(np.append(rows_of, len(runs)))
            first = run_of[np.flatnonzero(new)][np.cumsum(new) - 1]
            rows = np.flatnonzero(run_of > first)
            rows = rows[rows >= old]
            if len(rows):
                mine, least = run_of[rows], first[rows]
                places, totals = [], []
                for back in (None, *range(owners, 0, -1)):  # earliest first
                    owner = least if back is None else np.maximum(mine - back, least)
                    # of a seed that stands several times in both, the first place meets the first, and so on
                    place = rows_of[owner] + np.minimum(rows - rows_of[mine], places_of[owner] - 1)
                    places.append(place)
                    totals.append(agreement(sketch[rows], sketch[place], agree))
                top = np.max(totals, axis=0)
                near = np.array([(t >= 0) & (t > top - better) for t in totals])
                ok = np.flatnonzero(top >= 0)
                place = np.array(places)[near.argmax(0)[ok], ok]
                some = pa.array(rows[ok])
                yield pa.RecordBatch.from_arrays([docs.take(some), docs.take(pa.array(place)), pa.array(x[rows[ok]]), pa.array(x[place]), pa.nulls(len(ok), pa.int64())], names=names)
            # of the last seed: its first row, and the first row of each of the last documents
            tail = rows_of[rows_of >= np.flatnonzero(new)[-1]]
            kept = batch.take(pa.array(np.unique(np.concatenate((tail[:1], tail[-max(owners, 1) :])))))

    return seeds.repartition("h").sortWithinPartitions("h", "doc", "x").mapInArrow(tidy(run), f"doc {kind}, other {kind}, x int, y int, h long")


def likeness(own: np.ndarray, said: np.ndarray, words: int) -> np.ndarray:
    """Most of ``words`` words in a row of a place that stand around each of many others; ``said`` has a row for each code."""
    hits = np.zeros((len(own) + 1, said.shape[1]), np.uint8)
    if said.shape[1] < 512:  # one call for all words, or one fast one for each
        np.cumsum(said[own], axis=0, dtype=np.uint8, out=hits[1:])
    else:
        for i, c in enumerate(own.tolist()):
            np.add(hits[i], said[c], out=hits[i + 1])
    return (hits[words:] - hits[:-words]).max(0)


def likeness_of_pairs(own: np.ndarray, said: np.ndarray, words: int) -> np.ndarray:
    """The same for pairs: a row of ``own`` and ``said`` for each."""
    hits = np.zeros((len(own), own.shape[1] + 1), np.uint8)
    np.cumsum(said[np.arange(len(own))[:, None], own], axis=1, dtype=np.uint8, out=hits[:, 1:])
    return (hits[:, words:] - hits[:, :-words]).max(1)


def likeness_by_bits(own: np.ndarray, said: np.ndarray, words: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``own`` and of ``said`` whose likeness is ``need`` or more, for all pairs; 64 pairs take one number.

    Counters are kept digit by digit: one array for each binary digit of the words of a window that are there.
    """
    columns = np.packbits(said.T, axis=1, bitorder="little")
    columns = np.ascontiguousarray(np.pad(columns, ((0, 0), (0, -columns.shape[1] % 8)))).view(np.uint64)
    digits, low = int(words).bit_length(), (need & -need).bit_length() - 1
    step, rows, places = max(1, BITS // columns.shape[1]), [], []
    for start in range(0, len(own), step):
        hits = [columns[c] for c in own[start : start + step].T]
        count = np.zeros((digits, *hits[0].shape), np.uint64)
        found, spare, x, down = (np.zeros_like(hits[0]) for _ in range(4))
        for i, hit in enumerate(hits):
            # a word enters the window, and one leaves it
            if i < words:
                np.copyto(x, hit)
            else:
                np.bitwise_xor(hit, hits[i - words], out=x)
                np.bitwise_and(x, hits[i - words], out=down)
            for c in count[: digits if i >= words else (i + 1).bit_length()]:
                np.bitwise_xor(c, down, out=spare)
                np.bitwise_xor(c, x, out=c)
                np.bitwise_and(x, spare, out=x)
            if i + 1 >= words:
                np.copyto(spare, count[low])
                for d in range(low + 1, digits):
                    (np.bitwise_and if need >> d & 1 else np.bitwise_or)(spare, count[d], out=spare)
                np.bitwise_or(found, spare, out=found)
        row, word = np.nonzero(found)
        at, bit = np.nonzero(np.unpackbits(found[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        rows.append(start + row[at])
        places.append(word[at] * 64 + bit)
    return np.concatenate(rows), np.concatenate(places)


def in_order(a: np.ndarray, b: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """``common_words`` of pairs of code sequences, ``a`` of up to 128 words; code 0 is no word.

    Each row of ``b`` is paired with the row of ``a`` that ``of`` names, or with its own.
    """
    of = np.arange(len(a)) if of is None else of
    # where each code stands in each row of a
    masks = np.zeros((2, len(a) * 256), np.uint64)
    at = np.arange(len(a)) * 256
    for i, c in enumerate(a.T):
        masks[i // 64, at + c] |= np.uint64(1 << i % 64)
    masks[:, at] = 0
    low = high = np.full(len(b), (1 << 64) - 1, np.uint64)
    at = of * 256
    for word in b.T:
        place = at + word
        near = masks[0].take(place)
        hit = low & near
        total = low + hit
        if a.shape[1] > 64:
            far = masks[1].take(place)
            more = high & far
            high = (high + more + (total < low)) | (high - more)
        low = total | (low - hit)
    return 128 - np.bitwise_count(low).astype(np.int64) - np.bitwise_count(high)


def enough_links(later: np.ndarray, earlier: np.ndarray, score: np.ndarray, sure) -> np.ndarray:
    """Which links go on: of each later place the one of highest score (the earliest of equals) if it is ``sure``, otherwise all."""
    order = np.lexsort((earlier, -score, later))
    best = np.diff(later[order], prepend=-1) != 0
    settled = sure(order[best])[np.cumsum(best) - 1]
    return np.sort(order[best | ~settled])


def left_over(places: DataFrame, texts: DataFrame, found: DataFrame, reach: int, min_words: int, similarity: float) -> DataFrame:
    """``(doc, other, x, y)``: places that no passage covers, joined to places in all earlier documents that may share one.

    ``places`` are rows ``(h, doc, x)``.  The words around every place become codes of one byte; places of a
    seed in equal surroundings are one, and those in later documents are joined to the first.  All pairs of
    the others are compared, in tiles where there are many: of some ``min_words`` words in a row
    around the later place the share ``similarity`` must stand around the earlier one, and as many in
    order (codes may be equal by chance, so none that does is lost).  A place is joined to the partner in a
    tile that agrees most if that one is sure: on stretches around both, none of them beyond ``reach``,
    ``SURE`` words more than a passage needs agree in order (that many codes hardly agree by chance).  Any
    other place is joined to all of its partners.  Pairs that are looked at grow with the square of a seed's
    different surroundings, 64 of them in one number; rows do so only for places without a sure partner.
    """
    kind = texts.schema["d"].dataType.simpleString()
    asked = places.groupBy("doc").agg(F.collect_list(F.struct("h", "x")).alias("m"))
    spans = found.groupBy(F.col("doc").alias("c")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    given = asked.join(texts, F.col("doc") == F.col("d")).join(spans, F.col("doc") == F.col("c"), "left").select("doc", "m", "spans", "t")
    names = ["h", "c", "doc", "x", "bare", "codes"]
    wide, core = 2 * BESIDE + SEED_WORDS, slice(BESIDE - AROUND, BESIDE + AROUND + SEED_WORDS)
    least = min(min_words, 2 * AROUND + SEED_WORDS)
    need = max(1, int(np.ceil(similarity * least)))
    whole = 2 * AROUND + SEED_WORDS
    short = min(int(min_words / similarity) - 2, whole)

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in slices(batch.column(3), SLICE_BYTES):
                part = batch.slice(start, end - start)
                words = Words(part.column(3).fill_null("").cast(pa.string()))
                row = pc.list_parent_indices(part.column(1)).to_numpy().astype(np.int64)
                h, x = (pc.list_flatten(part.column(1)).field(i).to_numpy() for i in range(2))
                key = row << 32 | x
                first_of, last_of = words.text << 32 | words.start, words.text << 32 | words.end
                at = np.searchsorted(first_of, key)
                covered = np.zeros(len(key), bool)
                inside = pc.list_flatten(part.column(2))
                if len(inside):
                    of = pc.list_parent_indices(part.column(2)).to_numpy().astype(np.int64) << 32
                    first, last = of | inside.field(0).to_numpy(), np.maximum.accumulate(of | inside.field(1).to_numpy())
                    span = np.searchsorted(first, key, "right") - 1
                    covered = (span >= 0) & (last[span] > key)
                # a byte for each word, 0 where there is none
                code = np.pad(((words.hash >> np.uint64(32)) % np.uint64(255) + np.uint64(1)).astype(np.uint8), BESIDE + SEED_WORDS)
                rows_of = np.lib.stride_tricks.sliding_window_view(code, wide)
                for i in range(0, len(key), 10_000):
                    own = row[i : i + 10_000]
                    codes = rows_of[at[i : i + 10_000] + SEED_WORDS]
                    # not those of the texts beside it
                    front, back = at[i : i + 10_000] - words.bounds[own], words.bounds[own + 1] - at[i : i + 10_000]
                    edge = np.flatnonzero((front < BESIDE) | (back < BESIDE + SEED_WORDS))
                    place = np.arange(-BESIDE, BESIDE + SEED_WORDS)
                    codes[edge] *= (place >= -front[edge, None]) & (place < back[edge, None])
                    # and the words before and behind that an alignment may reach
                    some = x[i : i + 10_000].astype(np.int64)
                    before = at[i : i + 10_000] - np.searchsorted(last_of, own << 32 | np.maximum(some - reach, 0), "right")
                    behind = np.searchsorted(first_of, own << 32 | some + 1 + reach) - at[i : i + 10_000]
                    codes = np.column_stack((codes, np.minimum(before, 255), np.minimum(behind, 255))).astype(np.uint8)
                    c = np.zeros(len(own), np.uint64)
                    for column in np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view(np.uint64).T:  # eight bytes at a time
                        c = mix(c + column)
                    bare = ~covered[i : i + 10_000] & ((codes[:, core] > 0).sum(1) >= similarity * least)
                    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(wide + 2), len(own), [None, pa.py_buffer(codes.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 10_000]), pa.array(c.view(np.int64)), part.column(0).take(pa.array(own)), pa.array(x[i : i + 10_000]), pa.array(bare), data.cast(pa.binary())], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []

        def joined(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            docs, x, bare = rows.column("doc"), rows.column("x").to_numpy(), rows.column("bare").to_numpy(zero_copy_only=False)
            ids = [rows.column(c).to_numpy() for c in ("h", "i", "j")]
            block, mixed = rows.column("block").to_numpy(), ids[1] != ids[2]
            new = np.concatenate(([True], np.any([c[1:] != c[:-1] for c in ids], axis=0)))
            runs = new | np.concatenate(([True], pc.not_equal(docs.slice(1), docs.slice(0, len(docs) - 1)).to_numpy(zero_copy_only=False)))
            run, group = np.maximum.accumulate(np.where(runs, np.arange(len(x)), 0)), np.cumsum(new) - 1
            data = rows.column("codes")
            codes = np.frombuffer(data.buffers()[2], np.uint8)[data.offset * (wide + 2) : (data.offset + len(data)) * (wide + 2)].reshape(-1, wide + 2)
            codes, far = codes[:, :wide], codes[:, wide:]
            low = np.flatnonzero(new)[group]
            ask = np.flatnonzero(bare & (run > low))
            low, count = low[ask], (run - low)[ask]
            later, earlier = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            said = np.zeros((len(x), 256), bool)
            said[np.arange(len(x))[:, None], codes] = True
            said[:, 0] = False
            own = codes[:, core]
            many = count >= MANY
            asked_of = group[ask]
            crowd = many & (np.bincount(asked_of[many], minlength=int(group[-1]) + 1)[asked_of] >= CROWD)
            for g in np.unique(asked_of[crowd]).tolist():
                mine = np.flatnonzero(crowd & (asked_of == g))
                at, ends = int(low[mine[0]]), count[mine]
                # the first ones have few earlier places
                for i in range(0, len(mine), 512):
                    some = slice(i, i + 512)
                    b, a = likeness_by_bits(own[ask[mine[some]]], said[at : at + int(ends[some].max())], least, need)
                    ok = a < ends[some][b]
                    later.append(ask[mine[some]][b[ok]])
                    earlier.append(at + a[ok])
            alone = many & ~crowd
            columns = said.T.astype(np.uint8) if alone.any() else said
            for b, at, n in zip(ask[alone].tolist(), low[alone].tolist(), count[alone].tolist(), strict=True):
                a = at + np.flatnonzero(likeness(own[b], columns[:, at : at + n], least) >= need)
                later.append(np.full(len(a), b))
                earlier.append(a)
            ask, low, count = ask[~many], low[~many], count[~many]
            ends = np.cumsum(count)
            for start in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(start, min(start + PAIRS, int(ends[-1])))
                which = np.searchsorted(ends, pair, "right")
                b, at = ask[which], low[which] + pair - (ends - count)[which]
                alike = likeness_of_pairs(own[b], said[at], least) >= need
                later.append(b[alike])
                earlier.append(at[alike])
            b, a = np.concatenate(later), np.concatenate(earlier)
            ok = ~mixed[a] | (block[a] != block[b])
            b, a = b[ok], a[ok]
            order = np.lexsort((a, b))
            b, a = b[order], a[order]
            score = np.zeros(len(a), np.int64)
            for i in range(0, len(a), PAIRS):
                ones, of = np.unique(b[i : i + PAIRS], return_inverse=True)
                score[i : i + PAIRS] = in_order(own[ones], codes[a[i : i + PAIRS]], of)
            ok = score >= need
            b, a, score = b[ok], a[ok], score[ok]

            def sure(links: np.ndarray) -> np.ndarray:
                out = np.zeros(len(links), bool)
                for i in range(0, len(links), PAIRS):
                    x, y = b[links[i : i + PAIRS]], a[links[i : i + PAIRS]]
                    before, behind = np.minimum(far[x], far[y]).T
                    for n in (short, (short + whole) // 2, whole):
                        for s in range(0, whole - n + 1, STEP):
                            within = (before >= AROUND - s) & (behind >= s + n - AROUND)
                            out[i : i + PAIRS] |= within & (in_order(own[x, s : s + n], own[y, s : s + n]) >= max(min_words, similarity * n) + SURE)
                return out

            kept = enough_links(b, a, score, sure)
            for i in range(0, len(kept), PAIRS):
                b_, a_ = pa.array(b[kept[i : i + PAIRS]]), pa.array(a[kept[i : i + PAIRS]])
                yield pa.RecordBatch.from_arrays([rows.column("h").take(b_), rows.column("c").take(b_), docs.take(a_), rows.column("x").take(a_)], names=["h", "c", "other", "y"])

        for batch in batches:
            # a tile is compared when all its rows are there
            ids = [batch.column(c).to_numpy() for c in ("h", "i", "j")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in ids], axis=0)) + 1
            if left and batch.num_rows and any(left[0].column(c)[0].as_py() != batch.column(c)[0].as_py() for c in ("h", "i", "j")):
                new = np.concatenate(([0], new))
            if len(new):
                left.append(batch.slice(0, int(new[-1])))
                yield from joined(pa.concat_batches(left))
                left = []
            if batch.num_rows > (int(new[-1]) if len(new) else 0):
                left.append(batch.slice(int(new[-1]) if len(new) else 0))
        if left:
            yield from joined(pa.concat_batches(left))

    around = materialise(given.mapInArrow(tidy(surroundings), f"h long, c long, doc {kind}, x int, bare boolean, codes binary"), "surroundings")
    # of each class the first place, and whether its document asks anywhere
    first = around.groupBy("h", "c").agg(F.min(F.struct("doc", "x")).alias("r"), F.min(F.struct("doc", (~F.col("bare")).alias("covered"))).alias("s"), F.first("codes").alias("codes"))
    first = materialise(first.select("h", "c", F.col("r.doc").alias("doc"), F.col("r.x").alias("x"), (~F.col("s.covered")).alias("bare"), "codes"), "different")
    bare = around.where("bare").select("h", "c", "doc", "x")
    bare = materialise(bare.join(first.select("h", "c", F.col("doc").alias("other"), F.col("x").alias("y")), ["h", "c"]), "bare")
    own = bare.where("doc = other").select("h", "c", "doc", "x")
    # seeds with several blocks are a few: one of TILE places at most
    blocks = first.groupBy("h").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n")).where("n > 1")
    dealt = first.join(F.broadcast(blocks), "h", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("block", F.pmod("c", F.col("n")).cast("int"))
    # with each block of the seed's places once
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select("h", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "c", "doc", "x", "bare", "codes")
    tiles = dealt.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "doc", "x")
    links = tiles.mapInArrow(tidy(compare), f"h long, c long, other {kind}, y int")
    return own.join(links, ["h", "c"]).select("doc", "other", "x", "y").union(bare.where("doc <> other").select("doc", "other", "x", "y"))


class Fenwick:
    """Prefix maxima of (value, index) over ranks 1..n."""

    def __init__(self, n: int) -> None:
        self.best: list[tuple[float, int]] = [(-1e18, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, i: int) -> tuple[float, int]:
        found = (-1e18, -1)
        while i:
            if self.best[i] > found:
                found = self.best[i]
            i -= i & -i
        return found


def merge_runs(x: np.ndarray, y: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Join neighbours (in order of x) on one diagonal: start x, start y, end x, seeds of each run."""
    return runs_of_pairs(np.zeros(len(x), np.int64), x, y, gap)[1:]


def runs_of_pairs(of: np.ndarray, x: np.ndarray, y: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``merge_runs`` for the matches of many pairs, the numbers ``of`` which ascend, and each run's pair."""
    order = np.lexsort((y, x, of))
    x, y = x[order], y[order]
    new = np.concatenate(([True], (np.diff(of) != 0) | (np.diff(x) != np.diff(y)) | (np.diff(x) > gap)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(x)])) - 1
    return of[first], x[first], y[first], x[last] + 1, last - first + 1


def chains(x: np.ndarray, y: np.ndarray, gap: int = GAP) -> list[tuple[int, int, int, int]]:
    """Collinear chains of the matches (x, y): ``(x0, x1, y0, y1)`` of each, best first.

    A chain's score is its seeds less the gaps: ``gap`` characters in x and y together cost a seed
    (two where they are apart in both).  The best chain to end in a run of matches is 1 + the best
    prefix maximum, over runs that end before it in both texts, of score + cost * (end x + end y); a
    Fenwick tree over y keeps these maxima while x ascends.  Chains are then taken greedily from the
    best score down, each with runs that no better one has.
    """
    return chains_of_runs(*merge_runs(x, y, gap), gap)


def chains_of_runs(sx: np.ndarray, sy: np.ndarray, ex: np.ndarray, size: np.ndarray, gap: int) -> list[tuple[int, int, int, int]]:
    """``chains`` of matches that are runs already."""
    ey = sy + (ex - sx)
    cost = 1.0 / (2 * gap)
    ranks = np.unique(ey)
    upto, rank = np.searchsorted(ranks, sy, "right").tolist(), (np.searchsorted(ranks, ey) + 1).tolist()
    starts, ends = np.argsort(sx, kind="stable").tolist(), np.argsort(ex, kind="stable").tolist()
    sx, sy, ex, ey, size = sx.tolist(), sy.tolist(), ex.tolist(), ey.tolist(), size.tolist()
    tree, score, before, done = Fenwick(len(ranks)), [0.0] * len(sx), [-1] * len(sx), 0
    for i in starts:
        while done < len(ends) and ex[ends[done]] <= sx[i]:
            j = ends[done]
            if score[j] > 0:
                tree.put(rank[j], (score[j] + cost * (ex[j] + ey[j]), j))
            done += 1
        best, j = tree.top(upto[i])
        gain = best - cost * (sx[i] + sy[i]) if j >= 0 else 0.0
        score[i] = size[i] + max(0.0, gain)
        before[i] = j if gain > 0 else -1
    out, used = [], [False] * len(sx)
    for i in sorted(range(len(sx)), key=score.__getitem__, reverse=True):
        if used[i]:
            continue
        j = last = i
        while True:
            used[j] = True
            if before[j] < 0 or used[before[j]]:
                break
            j = before[j]
        out.append((sx[j], ex[last], sy[j], ey[last]))
    return out


def chains_of_pairs(of: np.ndarray, x: np.ndarray, y: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair and chain (a row of four) of the ``chains`` of many pairs' matches, ascending; ``of`` ascends."""
    of, sx, sy, ex, size = runs_of_pairs(of, x, y, gap)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    runs = np.diff(np.append(first, len(of)))
    # one run is one chain
    alone = first[runs == 1]
    pairs, found = [of[alone]], [np.stack((sx, ex, sy, sy + (ex - sx)), axis=1)[alone]]
    for i, n in zip(first[runs > 1].tolist(), runs[runs > 1].tolist(), strict=True):
        c = chains_of_runs(sx[i : i + n], sy[i : i + n], ex[i : i + n], size[i : i + n], gap)
        pairs.append(np.full(len(c), of[i]))
        found.append(np.array(c, np.int64))
    pair, found = np.concatenate(pairs), np.concatenate(found)
    order = np.lexsort((*found.T[::-1], pair))
    return pair[order], found[order]


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows; what both begin or end with is in it."""
    if len(a) > len(b):
        a, b = b, a
    apart = np.flatnonzero(a != b[: len(a)])
    head = int(apart[0]) if len(apart) else len(a)
    a, b = a[head:], b[head:]
    apart = np.flatnonzero(a != b[len(b) - len(a) :])
    tail = len(a) - 1 - int(apart[-1]) if len(apart) else len(a)
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b.tolist():
        if w in masks:
            hit = row & masks[w]
            row = ((row + hit) | (row - hit)) & full
    return head + tail + len(a) - row.bit_count()


@cache
def _steps(skip: int) -> list[tuple[int, int]]:
    return sorted(((d, e) for d in range(skip + 1) for e in range(skip + 1) if d + e), key=sum)


def extend(a: np.ndarray, b: np.ndarray, i: int, j: int, skip: int = 3) -> tuple[int, int]:
    """Walk on from words i, j while they agree, over up to ``skip`` words that differ if 2 follow that agree."""
    while i < len(a) and j < len(b):
        n = min(len(a) - i, len(b) - j)
        apart = np.flatnonzero(a[i : i + n] != b[j : j + n])
        n = int(apart[0]) if len(apart) else n
        i, j = i + n, j + n
        if i == len(a) or j == len(b):
            break
        x, y = a[i : i + skip + 2].tolist(), b[j : j + skip + 2].tolist()
        for d, e in _steps(skip):
            if d + 1 < len(x) and e + 1 < len(y) and x[d] == y[e] and x[d + 1] == y[e + 1]:
                i, j = i + d, j + e
                break
        else:
            break
    return i, j


def common_pairs(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of a longest common subsequence, ascending.

    Rows of the bit-parallel table are kept at every ``step`` words of ``b`` and made again for the
    words in between on the way back, so memory grows with len(a) * sqrt(len(b)) bits.
    """
    masks: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, words = (1 << len(a)) - 1, b.tolist()
    step = isqrt(len(words)) + 1

    def follow(row: int, w: int) -> int:
        hit = row & masks.get(w, 0)
        return ((row + hit) | (row - hit)) & full

    kept, row = [], full
    for j, w in enumerate(words):
        if j % step == 0:
            kept.append(row)
        row = follow(row, w)
    out, i = [], len(a)
    for block in range(len(kept) - 1, -1, -1):
        rows = [kept[block]]
        for w in words[block * step : (block + 1) * step]:
            rows.append(follow(rows[-1], w))
        for j in range(len(rows) - 2, -1, -1):
            # a zero bit i of a row: the common length grows with word i of a
            while i and rows[j + 1] >> (i - 1) & 1:
                i -= 1
            if not i:
                break
            if rows[j] >> (i - 1) & 1:  # it grows here only with word j of b
                out.append((i - 1, block * step + j))
                i -= 1
        if not i:
            break
    return out[::-1]


def stretches(a: np.ndarray, b: np.ndarray, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int]]:
    """Disjoint stretches ``(i0, i1, j0, j1, agreeing)`` of two word sequences, each long and alike enough.

    Along the alignment an agreeing pair gains ``1 - similarity`` and a word that differs costs
    ``similarity``.  The longest stretch that does not lose is taken, ends that agree by less than half
    are trimmed off where enough is left, and what lies on its sides is looked at in the same way.
    """
    pairs = common_pairs(a, b)
    if len(pairs) < similarity * min_words:
        return []
    at = np.array(pairs, np.int64)
    # between[q]: words that differ between pair q - 1 and pair q
    between = np.concatenate(([0], np.maximum(*(np.diff(at, axis=0) - 1).T)))
    out, todo = [], [(0, len(at))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < similarity * min_words:
            continue
        lost = np.cumsum(between[lo:hi]) - between[lo]
        # pairs p..q agree by the share n / (n + lost[q] - lost[p]) at least, n = q - p + 1
        score = (1 - similarity) * np.arange(hi - lo) - similarity * lost + 1e-9 * np.arange(hi - lo)
        least = np.minimum.accumulate(score)  # descending: the first p with score[p] <= score[q] + (1 - similarity)
        first = np.searchsorted(-least, -(score + (1 - similarity)), "left")
        q = int(np.argmax((np.arange(hi - lo) + lost) - (first + lost[np.minimum(first, hi - lo - 1)])))
        p, q = lo + int(first[q]), lo + q
        if q - p + 1 < similarity * min_words or (q - p + 1) + between[p + 1 : q + 1].sum() < min_words:
            continue
        x, y = trim(between[p : q + 1])
        if y - x + 1 + between[p + x + 1 : p + y + 1].sum() >= min_words:
            p, q = p + x, p + y
        (i0, j0), (i1, j1) = at[p].tolist(), (at[q] + 1).tolist()
        left, right = (at[p - 1] + 1 if p > lo else np.zeros(2, np.int64) if lo == 0 else at[lo]), (at[q + 1] if q + 1 < hi else np.array([len(a), len(b)]) if hi == len(at) else at[hi - 1] + 1)
        # stray agreements in between may have drawn an end away: walk on from the ends word by word
        n = q - p + 1
        while i0 > left[0] and j0 > left[1] and a[i0 - 1] == b[j0 - 1]:
            i0, j0, n = i0 - 1, j0 - 1, n + 1
        while i1 < right[0] and j1 < right[1] and a[i1] == b[j1]:
            i1, j1, n = i1 + 1, j1 + 1, n + 1
        out.append((i0, i1, j0, j1, n))
        todo += [(lo, p), (q + 1, hi)]
    return sorted(out)


def trim(between: np.ndarray) -> tuple[int, int]:
    """First and last pair that stay when ends that agree by less than half are cut off."""
    x, y = 0, len(between) - 1
    score = np.arange(y + 1) - (np.cumsum(between) - between[0])  # of the pairs before q, less what differs up to q
    x = len(score) - 1 - int(np.argmin(score[::-1])) if score.min() < 0 else 0
    back = between[1:][::-1]
    score = np.arange(y + 1) - np.concatenate(([0], np.cumsum(back)))
    y -= len(score) - 1 - int(np.argmin(score[::-1])) if score.min() < 0 else 0
    return (x, y) if x <= y else (0, len(between) - 1)


def align(wa: np.ndarray, wb: np.ndarray, i0: int, i1: int, j0: int, j1: int, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """Align two stretches of words around a chain from words ``i0, j0`` to words ``i1, j1`` (exclusive).

    Returns first word and end in ``wa``, words and agreeing words of every passage of ``min_words`` of
    which ``similarity`` agree: the whole chain if it does, otherwise the stretches that do.
    """
    i1, j1 = extend(wa, wb, i1, j1)
    back_i, back_j = extend(wa[:i0][::-1], wb[:j0][::-1], 0, 0)
    i0, j0 = i0 - back_i, j0 - back_j
    x, y = wa[i0:i1], wb[j0:j1]
    words = max(len(x), len(y))
    if words >= min_words and min(len(x), len(y)) >= similarity * words:
        common = words if np.array_equal(x, y) else common_words(x, y)
        if common >= similarity * words:
            return [(i0, i1, words, common)]
    # walking on may have stopped early, so all that was given is aligned
    if sum(map(set(wb.tolist()).__contains__, wa.tolist())) < similarity * min_words or common_words(wa, wb) < similarity * min_words:
        return []
    return [(i, ii, max(ii - i, jj - j), n) for i, ii, j, jj, n in stretches(wa, wb, min_words, similarity)]


def lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.ListArray:
    """A list of numbers for each of ``n`` rows; ``of`` has the row of each number and ascends."""
    ends = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def merged(lo: np.ndarray, hi: np.ndarray, reach: int) -> np.ndarray:
    """``(at, to)`` of the stretches that spans ``lo..hi``, widened by ``reach``, cover; ascending and apart."""
    return merged_of_rows(np.zeros(len(lo), np.int64), lo, hi, reach)[1]


def merged_of_rows(of: np.ndarray, lo: np.ndarray, hi: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and ``merged`` stretches of the spans of many rows, the numbers ``of``."""
    order = np.lexsort((lo, of))
    row = of[order] << 40  # far more than a text has characters
    at = np.maximum(lo[order].astype(np.int64) - reach, 0) + row
    to = np.maximum.accumulate(hi[order].astype(np.int64) + reach + row)
    first = np.flatnonzero(np.concatenate(([True], at[1:] > to[:-1])))
    row = row[first]
    return row >> 40, np.stack((at[first] - row, to[np.append(first[1:], len(to)) - 1] - row), axis=1)


class Stretches:
    """Words of the stretches of some texts, one text a row, and the chains in them; positions count characters in the text."""

    def __init__(self, rows: pa.RecordBatch, reach: int) -> None:
        texts, spans = rows.column("s"), rows.column("lo")
        words = Words(texts.flatten().cast(pa.string()))
        base = rows.column("at").flatten().to_numpy()[words.text]
        self.hash, self.start, self.end = words.hash, words.start + base, words.end + base
        lo, hi = (rows.column(c).flatten().to_numpy().astype(np.int64) for c in ("lo", "hi"))
        starts = texts.offsets.to_numpy()
        of_words, self.chains = words.bounds[starts - starts[0]], spans.offsets.to_numpy() - spans.offsets[0].as_py()
        # row and character in one number, so that all chains are looked up together
        row = np.repeat(np.arange(len(texts)) << 40, np.diff(of_words))
        own = np.repeat(np.arange(len(texts)) << 40, np.diff(self.chains))
        i0, i1, end = (np.searchsorted(row + self.start, own + to) for to in (lo, hi, hi + reach))
        begin, end = np.searchsorted(row + self.end, own + (lo - reach), "right"), np.maximum(end, i0 + 1)
        self.bounds = np.stack((begin, end, i0 - begin, np.minimum(np.maximum(i0 + 1, i1), end) - begin), axis=1).tolist()

    def around(self, row: int, chain: int) -> tuple[np.ndarray, int, int, int]:
        """Hashes of the words up to ``reach`` characters around a row's chain, its words ``i0:i1`` among them, and the first one's number."""
        begin, end, i0, i1 = self.bounds[self.chains[row] + chain]
        return self.hash[begin:end], i0, i1, begin


def find_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = SEED_WORDS, sample: int = SAMPLE, gap: int = GAP, reach: int = REACH, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Passages that a document shares with one of smaller key.

    One row for each passage: ``key``, ``other`` (the earlier document), ``start`` and ``end`` (characters,
    end exclusive), ``n_words``, ``similarity``.

    Seeds are k-mers of whole texts, one of ``sample`` by its hash (and one of any ``WINDOW`` in a row), so a
    passage has the same seeds in all documents.  Each place of a seed is joined to one earlier document that holds it: among the first one
    and the four nearest, the one whose words around the seed agree most (see ``linked``).  Matches of a pair of documents
    are chained with gap costs; the chains of a pair ask for the text around them together, so text that
    several of them need moves once; chains are aligned word by word.  Passages of ``min_words`` words or more
    of which ``similarity`` agree in order are returned; a chain that agrees too little as a whole is
    split into those that do.  Sixteen words in a row are long seeds, joined in the same way.  Every place that
    no passage covers then is compared with the places of its seed in all earlier documents (see ``left_over``),
    and those that may share a passage are chained and aligned as well, so fragments of a passage in any
    number of other documents do not hide it.
    A passage is missed where none of its k-mers is a seed; one word
    said again and again is no passage; ``sample`` of 1 takes every k-mer for a seed.
    ``test_passages_*`` measure recall.

    Rows with a null key or without words have no passages.  Rows that repeat a key and text are one
    document and never match each other; of different texts under one key that with the smallest hash
    is looked at.  Repeats inside a document are not looked for.  Empty input gives an empty result; only
    ``key`` and ``text`` are read, so other columns cannot clash.
    """
    return _passages(docs, text, key, k, sample, gap, reach, min_words, similarity).select(F.col("doc").alias(key), "other", "start", "end", "n_words", "similarity")


def one_text(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(d, t)``: one text for each non-null key, that with the smallest hash."""
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("d"), F.col(text).alias("t"))
    several = rows.groupBy("d").agg(F.count("*").alias("rows"), F.min(F.xxhash64("t")).alias("least")).where("rows > 1").select("d", "least")
    if several.isEmpty():
        return rows
    several = materialise(several, "several")
    chosen = rows.join(several, "d", "left").where(F.col("least").isNull() | (F.xxhash64("t") == F.col("least"))).select("d", "t")
    return materialise(chosen.dropDuplicates(["d"]), "documents")


def _passages(docs: DataFrame, text: str, key: str, k: int, sample: int, gap: int, reach: int, min_words: int, similarity: float) -> DataFrame:
    """``find_passages`` with ``doc`` for the key, and the hash of its text."""
    if sample < 1:
        raise ValueError("one of 1 k-mers or more is a seed")
    texts = one_text(docs, text, key)
    matches = materialise(linked(seed_table(texts, "t", "d", k, sample, SIDE, HOT), OWNERS, AGREE, BETTER), "matches")
    found = materialise(_aligned(matches.where("h is null"), texts, gap, reach, min_words, similarity), "passages")
    places = matches.where("h is not null").select("h", "doc", "x")
    more = _aligned(left_over(places, texts, found, reach, min_words, similarity), texts, gap, reach, min_words, similarity)
    return found.union(more).distinct()


def _aligned(matches: DataFrame, texts: DataFrame, gap: int, reach: int, min_words: int, similarity: float) -> DataFrame:
    """Passages of the pairs of documents that have matches ``(doc, other, x, y)``: chained, then aligned."""
    kind = texts.schema["d"].dataType.simpleString()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains of each pair of documents, some dozens at a time, as requests for the stretches of both texts around them."""
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.column(2)
            ends = m.offsets.to_numpy().astype(np.int64) - m.offsets[0].as_py()
            xs, ys = (pc.list_flatten(m).field(i).to_numpy() for i in range(2))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(ends, ends[start] + MATCHES, "right")) - 1)
                some = slice(int(ends[start]), int(ends[end]))
                of, c = chains_of_pairs(np.repeat(np.arange(start, end), np.diff(ends[start : end + 1])), xs[some].astype(np.int64), ys[some].astype(np.int64), gap)
                start = end
                # of each pair TOGETHER chains a row
                new = np.diff(of, prepend=-1) != 0
                new |= (np.arange(len(of)) - np.maximum.accumulate(np.where(new, np.arange(len(of)), 0))) % TOGETHER == 0
                row, take = np.cumsum(new) - 1, pa.array(of[new])
                pair = pa.array(np.arange(number, number + len(take)))
                number += len(take)
                for side, at in ((0, 0), (1, 2)):
                    lo, hi = c[:, at], c[:, at + 1]
                    near, windows = merged_of_rows(row, lo, hi, reach + EDGE)
                    cols = [lists(w, near, len(take)) for w in windows.T] + [lists(w, row, len(take)) for w in (lo, hi)]
                    yield pa.RecordBatch.from_arrays([pair, pa.array(np.full(len(take), side, np.int32)), batch.column(side).take(take), *cols], names=["pair", "side", "d", "at", "to", "lo", "hi"])

    pairs = matches.groupBy("doc", "other").agg(F.collect_list(F.struct("x", "y")).alias("m"))
    asked = materialise(pairs.mapInArrow(tidy(chain), f"pair long, side int, d {kind}, at array<int>, to array<int>, lo array<int>, hi array<int>"), "chains")
    # positions count from 0, substring from 1
    cut = F.transform(F.arrays_zip("at", "to"), lambda w: F.substring(F.col("t"), w["at"] + 1, w["to"] - w["at"]))
    given = asked.join(texts, "d").select("pair", "side", "d", "at", "lo", "hi", F.xxhash64("t").alias("hash"), cut.alias("s"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.RecordBatch | None = None
        for batch in batches:  # sorted by pair and side, so the two rows of a pair follow each other
            if left is not None:
                batch = pa.concat_batches([left, batch])
            even = batch.num_rows // 2 * 2
            left = batch.slice(even) if even < batch.num_rows else None
            # slices by the bytes of the later document's stretches
            later = pc.binary_join(batch.column("s").slice(0, even).take(pa.array(np.arange(0, even, 2))), "")
            for i, j in slices(later, SLICE_BYTES):
                part = batch.slice(2 * i, 2 * (j - i))
                words, rows, found = Stretches(part, reach), [], []
                for r in range(0, part.num_rows, 2):
                    known: dict[tuple, list[tuple[int, int, int, int]]] = {}
                    spans: set[tuple[int, int, int, float]] = set()
                    for c in range(int(words.chains[r + 1] - words.chains[r])):
                        wa, i0, i1, begin = words.around(r, c)
                        wb, j0, j1, _ = words.around(r + 1, c)
                        # a line that stands again and again between the same words is aligned once
                        same = (wa.tobytes(), wb.tobytes(), i0, i1, j0, j1)
                        if same not in known:
                            known[same] = align(wa, wb, i0, i1, j0, j1, min_words, similarity)
                        for a, b, n, common in known[same]:
                            spans.add((int(words.start[begin + a]), int(words.end[begin + b - 1]), n, common / n))
                    rows += [r] * len(spans)
                    found += sorted(spans)
                if rows:
                    take = pa.array(rows)
                    cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
                    yield pa.RecordBatch.from_arrays([part.column("d").take(take), part.column("d").take(pa.array([r + 1 for r in rows])), *cols, part.column("hash").take(take)], names=["doc", "other", "start", "end", "n_words", "similarity", "hash"])

    together = given.repartition("pair").sortWithinPartitions("pair", "side")
    return together.mapInArrow(tidy(check), f"doc {kind}, other {kind}, start long, end long, n_words long, similarity double, hash long")


def remove_passages(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = SEED_WORDS, sample: int = SAMPLE, gap: int = GAP, reach: int = REACH, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Cut from every document the passages that a document of smaller key has.

    Columns are those of ``docs``.  A document of which nothing but white space is left goes; texts
    that were blank before stay as they are, and so do rows without a key and texts that
    ``find_passages`` did not look at.
    """
    found = _passages(docs, text, key, k, sample, gap, reach, min_words, similarity)
    d, h, cut = (free_name(docs, c) for c in ("d_", "h_", "cut_"))
    spans = found.groupBy(F.col("doc").alias(d), F.col("hash").alias(h)).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(cut))
    joined = docs.join(spans, (docs[key] == spans[d]) & (F.xxhash64(docs[text]) == spans[h]), "left")
    # spans are ascending: keep what lies before each one, then what lies behind the last
    start = F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at"))

    def step(acc, span):
        more = F.when(span["start"] > acc["at"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), (span["start"] - acc["at"]).cast("int"))).otherwise("")
        return F.struct(F.concat(acc["s"], more).alias("s"), F.greatest(acc["at"], span["end"]).alias("at"))

    kept = F.aggregate(F.col(cut), start, step, lambda acc: F.concat(acc["s"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))
    out = joined.withColumn(text, F.when(F.col(cut).isNull(), F.col(text)).otherwise(kept))
    return out.where(F.col(cut).isNull() | F.col(text).rlike(r"[^\s]")).select(*docs.columns)
