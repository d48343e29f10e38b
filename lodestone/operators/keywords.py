"""Thousands of keywords in one pass over texts, by a multi-pattern automaton in numpy.

The keywords become a trie of their UTF-8 bytes, completed with failure links to a table of transitions over
the classes of bytes that occur in keywords.  Texts are cut into windows that overlap by the longest
keyword, and all windows of a batch move through the table together, one byte a step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the keywords of one automaton; more are dealt over several, each a pass.
MOST_BYTES = 1 << 17
#: Bytes of a window besides its overlap, and of texts that are looked at together.
WINDOW, BATCH = 512, 8 << 20


class Automaton:
    """Transitions of all keywords; ``ends[state]`` is a keyword that ends there or -1, ``shorter`` the next state with one."""

    def __init__(self, keywords: Sequence[bytes]) -> None:
        used = sorted({b for k in keywords for b in k})
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.width, self.longest = len(used) + 1, max(map(len, keywords), default=0)
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for n, k in enumerate(keywords):
            state = 0
            for b in k:
                nxt = children[state].get(b)
                if nxt is None:
                    nxt = children[state][b] = len(children)
                    children.append({})
                    ends.append(-1)
                state = nxt
            ends[state] = n
        self.ends = np.array(ends, np.int32)
        self.shorter = np.zeros(len(children), np.int32)
        self.step = np.zeros((len(children), self.width), np.int32)
        fail = np.zeros(len(children), np.int32)
        level = [0]
        while level:  # level by level: a state's failure link is shorter than itself
            below = []
            for state in level:
                if state:
                    self.step[state] = self.step[fail[state]]
                for b, child in children[state].items():
                    c = self.classes[b]
                    fail[child] = self.step[state, c] if state else 0
                    self.step[state, c] = child
                    f = fail[child]
                    self.shorter[child] = f if self.ends[f] >= 0 else self.shorter[f]
                    below.append(child)
            level = below
        self.hit = (self.ends >= 0) | (self.shorter > 0)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, keyword, byte where it starts) of every occurrence in texts without nulls."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
        lengths = np.diff(offsets)
        n = -(-lengths // WINDOW)
        text = np.repeat(np.arange(len(texts)), n)
        first = (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW  # of the window, in its text
        lead = np.minimum(first, max(self.longest - 1, 0))
        at, end = offsets[text] + first - lead, offsets[text] + np.minimum(first + WINDOW, lengths[text])
        order = np.argsort(at - end, kind="stable")  # long windows first: those that are over fall away behind
        text, at, end, own = text[order], at[order], end[order], (offsets[text] + first)[order]
        state, found = np.zeros(len(at), np.int32), []
        sizes = end - at
        for i in range(int(sizes[0]) if len(sizes) else 0):
            alive = int(np.searchsorted(-sizes, -i, "left"))
            place = at[:alive] + i
            state = self.step[state[:alive], self.classes[raw[place]]]
            hits = np.flatnonzero(self.hit[state])
            hits = hits[place[hits] >= own[hits]]  # those in the overlap are the window before's
            some = state[hits]
            while len(hits):
                ends = self.ends[some]
                ok = ends >= 0
                found.append((text[hits[ok]], ends[ok], place[hits[ok]] + 1))
                some = self.shorter[some]
                hits, some = hits[some > 0], some[some > 0]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        texts_of, keyword, ends = (np.concatenate(x) for x in zip(*found, strict=True))
        return texts_of, keyword.astype(np.int64), ends - offsets[texts_of]


def keyword_hits(docs: DataFrame, keywords: DataFrame, key: str = "doc_id", text: str = "text", word: str = "keyword", lower: bool = True) -> DataFrame:
    """``(key, keyword, n, first_end)``: how often a text has each keyword, and at which byte the first occurrence ends.

    Occurrences may overlap.  With ``lower`` texts and keywords are compared in lower case.  Keywords are
    distinct; null and empty ones match nothing, and neither does a null text.  Rows of texts are looked at
    alone, so repeated rows and null keys have rows of their own.  The keywords go to every task: they
    are dealt over as many automata as keep each within ``MOST_BYTES``.
    """
    low = (lambda c: F.lower(c)) if lower else (lambda c: c)
    rows = keywords.select(low(F.col(word)).alias("w")).where("w is not null and w <> ''").distinct()
    total = rows.agg(F.sum(F.octet_length("w"))).first()[0] or 0
    groups = total // MOST_BYTES + 1
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, keyword string, n long, first_end long"
    texts = docs.select(key, low(F.col(text)).alias("the_text")).where("the_text is not null")
    out = None
    for group in range(groups):
        own = sorted(r[0] for r in rows.where(F.pmod(F.xxhash64("w"), F.lit(groups)) == group).collect())  # MOST_BYTES or so

        def run(batches: Iterator[pa.RecordBatch], own: list[str] = own) -> Iterator[pa.RecordBatch]:
            automaton, names = Automaton([w.encode() for w in own]), pa.array(own, pa.string())
            for batch in batches:
                sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
                start = 0
                while start < batch.num_rows:
                    before = sizes[start - 1] if start else 0
                    end = max(start + 1, int(np.searchsorted(sizes, before + BATCH, "right")))
                    row, word, stop = automaton.find(batch.column(1).slice(start, end - start))
                    order = np.lexsort((stop, word, row))
                    row, word, stop = row[order], word[order], stop[order]
                    first = np.flatnonzero(np.diff(row * len(own) + word, prepend=-1)) if len(row) else np.zeros(0, np.int64)
                    n = np.diff(np.append(first, len(row)))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first] + start)), names.take(pa.array(word[first])), pa.array(n), pa.array(stop[first])], names=[key, "keyword", "n", "first_end"])
                    start = end

        found = texts.mapInArrow(run, schema) if own else texts.select(F.col(key), F.lit("").alias("keyword"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("first_end")).where("false")
        out = found if out is None else out.unionByName(found)
    return out
