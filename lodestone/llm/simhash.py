"""Near-duplicates by SimHash: 64-bit fingerprints and a tiled, exact comparison of all of them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, free_name, materialise, tidy

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a tile; a cell of equal population counts with more of them is dealt into several.
TILE = 4096
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned fingerprint of a whole text; 0 where it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    hashed = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)]
    h = np.array(hashed, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):  # bounded memory for very long texts
        part = h[i : i + 8192].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", carry: list[str] | None = None) -> DataFrame:
    """``docs`` (or the columns ``carry`` of it) with the signed 64-bit fingerprint of each whole text."""
    carry = [c for c in (docs.columns if carry is None else carry)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema), f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py()) for t in batch.column(batch.num_columns - 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*carry, name])

    return docs.select(*carry, F.col(text).alias("the_text")).mapInArrow(tidy(run), schema)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool, rows: int = 256) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles, as pairs of fingerprints.

    All pairs are compared by exclusive-or and bit counts, some rows at a time; of a clique only as
    many links are kept as hold it together.
    """
    every = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    group, links = np.arange(len(every)), []
    for i in range(0, len(a), rows):
        near = np.bitwise_count(a[i : i + rows, None] ^ b[None, :]) <= radius
        for r in np.flatnonzero(near.any(1)):
            x, y = i + int(r), np.flatnonzero(near[r]) + shift
            others, first = np.unique(group[y], return_index=True)
            for g, f in zip(others.tolist(), first.tolist(), strict=True):
                if g != group[x]:
                    links.append((int(every[x]), int(every[y[f]])))
                    group[group == g] = group[x]
    return links


def tile_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that join all fingerprints (column ``fp``, distinct) at ``radius`` or fewer bits.

    Fingerprints fall into cells by the population counts of their two halves.  Two fingerprints
    within the radius have counts that differ by no more than it in all, so tile pairs of other cells
    are skipped; every remaining pair of tiles is compared in full.  Tiles hold about ``tile``
    fingerprints; only links that hold a group together are returned, never all its pairs.
    """
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    cells = prints.select("fp", high.cast("int").alias("hi"), low.cast("int").alias("lo"))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("fp", F.lit(7)), F.lit(1 << 20)).cast("int"))
    sizes = cells.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))  # at most 33 x 33 rows
    dealt = cells.join(F.broadcast(sizes), ["hi", "lo"]).withColumn("part", F.col("part") % F.col("parts"))
    tiles = dealt.groupBy("hi", "lo", "part").agg(F.collect_list("fp").alias("fps"))
    tiles = materialise(tiles.withColumn("tile", F.concat_ws(":", "hi", "lo", "part")), "tiles")
    near = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius and (i, j) >= (0, 0)]
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in near])
    left = tiles.select("tile", "hi", "lo", F.explode(steps).alias("d")).select(F.col("tile").alias("ta"), (F.col("hi") + F.col("d.i")).alias("hi"), (F.col("lo") + F.col("d.j")).alias("lo"), ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("own"))
    pairs = left.join(tiles.select("hi", "lo", F.col("tile").alias("tb")), ["hi", "lo"]).where("not own or ta <= tb").select("ta", "tb")
    pairs = pairs.join(tiles.select(F.col("tile").alias("ta"), F.col("fps").alias("fa")), "ta")
    pairs = pairs.join(tiles.select(F.col("tile").alias("tb"), F.col("fps").alias("fb")), "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ta, tb, fa, fb in zip(*(batch.column(c) for c in ("ta", "tb", "fa", "fb")), strict=True):
                a, b = (x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in (fa, fb))
                found = np.array(forest(a, b, radius, ta == tb), np.uint64).reshape(-1, 2).view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy())], names=["a", "b"])

    return pairs.select("ta", "tb", "fa", "fb").mapInArrow(tidy(compare), "a long, b long")


def components(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One row for each document: ``key``, ``fp``, ``component_id``.

    ``component_id`` is the smallest key reachable over fingerprints that differ in ``radius`` or fewer
    bits.  Texts without words have fingerprint 0 and link like any other.  Null keys take part, but a
    component's id is its smallest non-null key (null if it has none).  Repeated rows stay repeated.
    Equal fingerprints are compared once.  Empty input gives an empty result.
    """
    found = materialise(with_fingerprints(docs, text, "fp", [key]), "fingerprints")
    return found.join(classes(found, key, radius), "fp").select(key, "fp", "component_id")


def classes(found: DataFrame, key: str, radius: int) -> DataFrame:
    """``(fp, root, component_id)`` of each fingerprint of ``found``: its group, and the smallest key there.

    Fingerprints without links are groups of their own; only the others are joined to their group's
    key, which is written first, so that Spark can split the rows of a group that holds many.
    """
    prints = materialise(found.groupBy("fp").agg(F.min(key).alias("least")), "prints")
    links = connected_components(tile_links(prints.select("fp"), radius)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    near = materialise(prints.join(links, "fp"), "near")
    least = materialise(near.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    alone = prints.join(links, "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least").alias("component_id"))
    return materialise(near.join(least, "root").select("fp", "root", "component_id").unionByName(alone), "classes")


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """One document of each group stays: that with the smallest key; columns as in ``docs``.

    Groups are told apart by their fingerprints alone, so rows without a key and different texts
    under one key stay, one for each group.  Null keys come last; of several texts with the smallest
    key that with the smallest hash stays, and of rows equal in both (repeated rows) one.
    """
    k, h, root = (free_name(docs, c) for c in ("k_", "h_", "root_"))
    rows = docs.select(F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    found = materialise(with_fingerprints(rows, "text", "fp", ["k", "h"]), "fingerprints")
    of_root = found.join(classes(found, "k", radius), "fp").groupBy("root").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("least"))
    keepers = of_root.select(F.col("least.k").alias(k), F.col("least.h").alias(h), F.col("root").alias(root))
    kept = docs.join(keepers, docs[key].eqNullSafe(F.col(k)) & (F.xxhash64(docs[text]) == F.col(h)))
    return kept.dropDuplicates([root]).select(*docs.columns)
