"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut as materialise
from ..shared import new_folder, shared_dir

__all__ = ["SPACES", "code_points", "connected_components", "free_name", "give_back", "materialise", "mix", "new_folder", "powers_upto", "rolling", "roots", "shared_dir", "tidy", "window_hash", "word_bounds"]

#: ASCII white space that separates words wherever a contract says ``[^\x20\x09-\x0D]+``.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def give_back() -> None:
    """Return to the system what this process has freed, tables of powers too; Spark keeps Python workers for later stages."""
    global _powers, _inverse
    _powers = _inverse = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function for ``mapInArrow``, which gives memory back at the end of each task."""

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return all_of


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` clashes with it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def code_points(text: str) -> np.ndarray:
    """The code points of a text; lone surrogates become themselves."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of every run of characters other than ASCII white space."""
    word = ~((codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D)))
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))


def powers_upto(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2**64, at least ``n`` of them."""
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 1 << 16)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _P, np.uint64))), dtype=np.uint64)
            _inverse = np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, _P_INVERSE, np.uint64))), dtype=np.uint64)
    return _powers, _inverse


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def rolling(values: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``window_hash`` gives the hash of any slice of ``values``."""
    powers, _ = powers_upto(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(values + np.uint64(1)) * powers[: len(values)], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hash of the slices ``[start, end)``, equal for equal slices wherever they stand."""
    _, inverse = powers_upto(len(prefix))
    with np.errstate(over="ignore"):
        return (prefix[ends] - prefix[starts]) * inverse[starts]


def roots(n: int, pairs) -> np.ndarray:
    """Smallest member of each element's group, for links between elements ``0..n-1``."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], np.int64)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Components of an undirected graph as ``(node, component)``, component = smallest node.

    Alternates hooking (every node takes the smallest label next to it), pointer jumping and
    contraction of the edges to labels, so the number of rounds is logarithmic even for long
    chains.  Each round is written to the shared folder.  Null ends and self links are ignored;
    nodes without links do not appear.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        for _ in range(3):
            top = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(top, "up").select("node", F.col("top").alias("up"))
        hook = materialise(hook, "hook")
        if labels is None:
            labels = hook.select("node", F.col("up").alias("component"))
        else:
            step = hook.select(F.col("node").alias("component"), "up")
            labels = materialise(labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component")), "labels")
        ends = edges.join(hook.select(F.col("node").alias("a"), F.col("up").alias("u")), "a")
        ends = ends.join(hook.select(F.col("node").alias("b"), F.col("up").alias("v")), "b").where("u <> v")
        edges = materialise(ends.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
