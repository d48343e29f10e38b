"""Conversations as a trie of their prefixes: what sharing prefixes saves, and where conversations part.

**Turn ids.**  A turn is two 64-bit hashes of its role and text and its number of words.  A conversation
is one row: the ids of its turns in order, after the prompts it takes from the first conversation of its
twenty (``rebuild``).

**Shards.**  The rows are sorted over all tasks by their turn ids, shorter ones first, then by id, so that
equal conversations may lie in any number of shards.  A shard is a padded matrix of turn ids, one row
a conversation, sorted by ``numpy.lexsort``.  Where a column differs from the row above, this row starts a
node there and, by OR along the row, at every later depth.  All figures of a node are sums over its
rows, one ``reduceat`` for each depth: its children are the starts one column on, its leaves the rows that
the next one does not go on from, the saved tokens the words of cells that start no node.

**Boundaries.**  A shard takes its first row to start nodes at every depth and its last row for a leaf.
Only nodes with the first or last row can lie in other shards as well.  They are the open nodes: their
parts are added up by prefix, together with corrections for what the first row of a shard shares with
the last row of the one before.  All other nodes are final in their shard and are not shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .chunks import spread
from .common import materialise, mix, tidy

#: Cells of a padded matrix (one longer conversation may have more).
CELLS = 1 << 20
#: Turns that a task of the sort gets, where there are more than tasks.
TASK_TURNS = 1 << 20
#: Ids of conversations in one row, for nodes that end in several shards.
IDS = 4096
PAD = np.iinfo(np.int64).min
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: kind: node (final), part (of an open node), fix (of a part), ids (that end at an open node), edge (of a task: its first and last row).
SCHEMA = "kind string, shard long, open int, depth int, k1 long, k2 long, parent_open int, parent long, conv long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string, ids array<long>, task int, first_row boolean, id1 array<long>, id2 array<long>, words array<long>"


def prompts(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its twenty."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 4).cast("int")


def rebuild(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: for each conversation its rebuilt turns in order, as structs of ``id1, id2, words``.

    One shuffle, by twenties of conversations; the text stays behind.  Equal turn numbers are ordered by the
    hash of role and text.  Rows without a conversation are left out.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    key = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select(
        (key - key % 20).alias("base"),
        key.alias("conv"),
        F.col("turn").alias("turn"),
        # the smallest number pads matrices
        F.greatest(F.xxhash64(F.lit(1), role, text), F.lit(int(PAD) + 1)).alias("id1"),
        F.xxhash64(F.lit(2), text, role).alias("id2"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    own = turns.repartition("base").groupBy("base", "conv").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", "id1", "id2", "words"))).alias("own"))
    own = own.withColumn("own", F.transform("own", lambda t: F.struct(t["id1"].alias("id1"), t["id2"].alias("id2"), t["words"].alias("words"))))
    head = F.max(F.when(F.col("conv") == F.col("base"), F.slice("own", 1, 3))).over(W.partitionBy("base"))
    taken = prompts(F.col("conv"))
    rest = F.slice("own", taken + 1, F.greatest(F.size("own") - taken, F.lit(0)))
    return own.withColumn("head", head).select(F.col("conv").alias("conv_id"), F.when(F.col("head").isNull(), rest).otherwise(F.concat(F.slice("head", F.lit(1), taken), rest)).alias("turns"))


def prefix_keys(id1: np.ndarray, id2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each prefix of a sequence of turn ids, the empty one first."""
    place = np.arange(1, len(id1) + 1, dtype=np.uint64)
    keys = []
    for ids, salt in ((id1, 0x243F6A8885A308D3), (id2, 0x13198A2E03707344)):
        steps = mix(ids.astype(np.int64).view(np.uint64) ^ mix(place + np.uint64(salt)))
        keys.append(np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(steps))).view(np.int64))
    return keys[0], keys[1]


class Rows:
    """Conversations as flat arrays: ids, numbers of turns, turn ids and words."""

    def __init__(self, conv: np.ndarray, sizes: np.ndarray, id1: np.ndarray, id2: np.ndarray, words: np.ndarray) -> None:
        self.conv, self.sizes, self.id1, self.id2, self.words = conv, sizes, id1, id2, words
        self.starts = np.cumsum(sizes) - sizes

    @staticmethod
    def of(batch: pa.RecordBatch) -> Rows:
        lists = batch.column(1)
        inner = lists.flatten()
        return Rows(batch.column(0).to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64), *(inner.field(k).to_numpy() for k in range(3)))

    def take(self, rows: np.ndarray) -> Rows:
        at = spread(self.starts[rows], self.sizes[rows])
        return Rows(self.conv[rows], self.sizes[rows], self.id1[at], self.id2[at], self.words[at])

    def row(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = slice(self.starts[r], self.starts[r] + self.sizes[r])
        return self.id1[at], self.id2[at], self.words[at]

    def shards(self) -> Iterator[Rows]:
        """Ranges of rows whose padded matrix has ``CELLS`` cells at most, or one row."""
        first = widest = 0
        for r, n in enumerate(self.sizes.tolist()):
            if r > first and max(widest, n, 1) * (r + 1 - first) > CELLS:
                yield self.take(np.arange(first, r))
                first, widest = r, 0
            widest = max(widest, n)
        if len(self.sizes) > first:
            yield self.take(np.arange(first, len(self.sizes)))


def corrections(before: tuple, first: tuple) -> list[dict]:
    """What the parts of open nodes count too often, or not at all, where a shard's first row goes on from the last row before it."""
    (a1, a2, _), (b1, b2, words) = before, first
    n = min(len(a1), len(b1))
    differ = np.flatnonzero((a1[:n] != b1[:n]) | (a2[:n] != b2[:n]))
    shared = int(differ[0]) if len(differ) else n
    k1, k2 = prefix_keys(b1[:shared], b2[:shared])
    again = np.concatenate((np.cumsum(words[:shared][::-1])[::-1], [0]))
    leaf = int(shared == len(a1) and shared > 0)
    return [
        {"kind": "fix", "depth": d, "k1": int(k1[d]), "k2": int(k2[d]), "n_convs": 0, "n_children": -int(d < shared), "n_leaves": -leaf, "saved": int(again[max(d - 1, 0)])}
        for d in range(shared + 1)
    ]


def shard_nodes(rows: Rows, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard: final ones, and parts of open ones with the ids of conversations that end there."""
    n, width = len(rows.conv), int(rows.sizes.max())
    wide = [np.full((n, width), PAD if k < 2 else 0, np.int64) for k in range(3)]
    at = spread(np.arange(n) * width, rows.sizes)
    for matrix, flat in zip(wide, (rows.id1, rows.id2, rows.words), strict=True):
        matrix.reshape(-1)[at] = flat
    order = np.lexsort((rows.conv, *(wide[k][:, d] for d in reversed(range(width)) for k in (1, 0))))
    id1, id2, words = (m[order] for m in wide)
    conv, sizes = rows.conv[order], rows.sizes[order]
    starts = np.ones((n, width), bool)
    starts[1:] = np.logical_or.accumulate((id1[1:] != id1[:-1]) | (id2[1:] != id2[:-1]), axis=1)
    shared = width - starts.sum(axis=1)  # with the row above
    saved = np.cumsum(np.where(starts, 0, words)[:, ::-1], axis=1)[:, ::-1]
    leaf = np.append(shared[1:] < sizes[:-1], sizes[-1] > 0).astype(np.int64)
    # rows that end where the row above ends as well
    repeat = np.append(False, (sizes[1:] == sizes[:-1]) & (shared[1:] >= sizes[1:]))
    groups = np.flatnonzero(~repeat)
    last_of = np.append(groups[1:], n)[np.searchsorted(groups, np.arange(n), "right") - 1]
    # prefixes of the first and of the last row: open nodes, numbered along the first, then along the last
    common = int(min(shared[1:].min(initial=width), sizes[0], sizes[-1]))
    keys = [prefix_keys(m1, m2) for m1, m2 in ((id1[0, : sizes[0]], id2[0, : sizes[0]]), (id1[-1, : sizes[-1]], id2[-1, : sizes[-1]]))]
    top_open, bottom_open = int(sizes[0]) + 1, int(sizes[-1]) - common

    def open_number(start: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
        """Of nodes with rows start to end: the number among the open nodes, or -1."""
        out = np.full(len(start), -1, np.int32)
        if depth < top_open:
            out[start == 0] = depth
        if common < depth <= sizes[-1]:
            out[end == n] = np.where(out[end == n] < 0, top_open + depth - common - 1, out[end == n])
        return out

    above_start = above_open = above_least = None
    for depth in range(width + 1):
        alive = np.flatnonzero(sizes >= depth)
        is_start = starts[alive, depth - 1] if depth else np.arange(len(alive)) == 0
        first = np.flatnonzero(is_start)
        start = alive[first]
        # a node reaches to where the next one starts, or its parent ends
        least = np.minimum.reduceat(conv[alive], first)
        n_convs = np.diff(np.append(first, len(alive)))
        next_starts = (starts[alive, depth] & (sizes[alive] > depth)) if depth < width else np.zeros(len(alive), bool)
        children = np.add.reduceat(next_starts.astype(np.int64), first)
        leaves = np.add.reduceat(leaf[alive], first)
        tokens = np.add.reduceat(saved[alive, max(depth - 1, 0)] if width else np.zeros(len(alive), np.int64), first)
        end = alive[np.append(first[1:], len(alive)) - 1] + 1
        number = open_number(start, end, depth)
        if depth:
            parent = np.searchsorted(above_start, start, "right") - 1
            parent_open, parent_least = above_open[parent], above_least[parent]
        else:
            parent_open, parent_least = np.full(1, -1, np.int32), None
        ends = [NO_ENDS] * len(start)
        opened = {}
        for i in np.flatnonzero(sizes[start] == depth).tolist():
            ids = conv[start[i] : last_of[start[i]]]
            if number[i] >= 0:
                opened[i] = ids
            else:
                ends[i] = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest()
        m = len(start)
        is_open = number >= 0
        key = np.zeros((2, m), np.int64)
        for i in np.flatnonzero(is_open).tolist():
            side = 0 if number[i] < top_open else 1
            key[:, i] = keys[side][0][depth], keys[side][1][depth]
        yield pa.RecordBatch.from_pydict({
            "kind": np.where(is_open, "part", "node"), "shard": np.full(m, shard), "open": number, "depth": np.full(m, depth, np.int32), "k1": key[0], "k2": key[1],
            "parent_open": parent_open, "parent": pa.nulls(m, pa.int64()) if parent_least is None else pa.array(parent_least, pa.int64()), "conv": least, "n_convs": n_convs, "n_children": children, "n_leaves": leaves, "saved": tokens, "ends_sha256": pa.array(ends, pa.string()),
        })
        for i, ids in opened.items():
            for k in range(0, len(ids), IDS):
                some = ids[k : k + IDS]
                yield pa.RecordBatch.from_pydict({"kind": ["ids"], "depth": pa.array([depth], pa.int32()), "k1": key[0, i : i + 1], "k2": key[1, i : i + 1], "conv": some[:1], "ids": pa.array([some], pa.list_(pa.int64()))})
        above_start, above_open, above_least = start, number, least


def _filled(batch: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    have = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) if f.name in have else pa.nulls(batch.num_rows, f.type) for f in schema], schema=schema)


def shard_parts(rows: DataFrame) -> DataFrame:
    """Rows of all kinds (see ``SCHEMA``), from sorted ``conv_id, turns``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], SCHEMA).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        number, before = task << 32, None

        def edge(row: tuple, first: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": ["edge"], "task": pa.array([task], pa.int32()), "first_row": [first]} | {c: pa.array([x], pa.list_(pa.int64())) for c, x in zip(("id1", "id2", "words"), row, strict=True)})

        for batch in batches:
            for shard in Rows.of(batch).shards():
                if before is None:
                    yield _filled(edge(shard.row(0), True), schema)
                else:
                    yield _filled(pa.RecordBatch.from_pylist(corrections(before, shard.row(0))), schema)
                for out in shard_nodes(shard, number):
                    yield _filled(out, schema)
                before, number = shard.row(len(shard.conv) - 1), number + 1
        if before is not None:
            yield _filled(edge(before, False), schema)

    return rows.mapInArrow(tidy(run), SCHEMA)


def _between_tasks(parts: DataFrame) -> DataFrame:
    """Corrections between the last row of a task and the first of the next; there is one row for each task."""
    edges = parts.where("kind = 'edge'").groupBy("task").agg(*(F.max(F.when(F.col("first_row") == side, F.struct("id1", "id2", "words"))).alias(name) for side, name in ((True, "first"), (False, "last"))))
    pairs = edges.select(F.lag("last").over(W.orderBy("task")).alias("last"), "first").where("last is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [tuple(np.array(r[c], np.int64) for c in ("id1", "id2", "words")) for r in (before, first)]
                found = [{k: v for k, v in f.items() if k != "kind"} for f in corrections(*rows)]
                yield pa.RecordBatch.from_pylist(found, pa.schema([(c, pa.int32() if c == "depth" else pa.int64()) for c in ("depth", "k1", "k2", "n_convs", "n_children", "n_leaves", "saved")]))

    return pairs.mapInArrow(run, "depth int, k1 long, k2 long, n_convs long, n_children long, n_leaves long, saved long")


def _open_ends(parts: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` of open nodes, hashed row by row in the order of the ids."""
    rows = parts.where("kind = 'ids'").select("depth", "k1", "k2", "conv", "ids")
    rows = rows.repartition("depth", "k1", "k2").sortWithinPartitions("depth", "k1", "k2", "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([state.hexdigest()])], names=["depth", "k1", "k2", "ends_sha256"])

        for batch in batches:
            for i in range(batch.num_rows):
                own = tuple(batch.column(k)[i].as_py() for k in range(3))
                if own != key:
                    if key is not None:
                        yield done()
                    key, state = own, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(",".join(map(str, batch.column(4)[i].as_py())).encode())
        if key is not None:
            yield done()

    return rows.mapInArrow(run, "depth int, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.  ``conversations`` has ``conv_id``, ``turn``, ``role`` and
    ``text``; other columns are not read.  A null turn comes before all numbers; equal turns of a
    conversation are ordered by a hash of role and text, and repeated rows are turns of their own.  A null role
    or text is the empty one.  Rows without a conv_id belong to none and are left out; without any other,
    the result is empty.  Turns are equal if two 64-bit hashes of role and text are.  Texts of any length
    count by their hash and words; the ids of one conversation (24 bytes a turn) are one row.
    """
    spark = conversations.sparkSession
    rows = materialise(rebuild(conversations), "turns")
    if tasks is None:
        turns = rows.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns // TASK_TURNS)
    ordered = [F.transform("turns", lambda t: F.struct(t["id1"], t["id2"])), F.col("conv_id")]
    parts = materialise(shard_parts(rows.repartitionByRange(tasks, *ordered).sortWithinPartitions(*ordered)), "trie")
    key = ["depth", "k1", "k2"]
    sums = ["n_convs", "n_children", "n_leaves", "saved"]
    part = parts.where("kind = 'part'")
    fixes = parts.where("kind = 'fix'").select(*key, *sums).unionByName(_between_tasks(parts))
    merged = part.select(*key, "conv", *sums).unionByName(fixes, allowMissingColumns=True)
    merged = merged.groupBy(*key).agg(F.min("conv").alias("least"), *(F.sum(c).alias(c) for c in sums))
    opened = materialise(merged.join(_open_ends(parts), key, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "open")
    # where an open node lies: in each of its shards under a number
    places = part.select("shard", "open", *key).join(opened.select(*key, "least"), key).select("shard", F.col("open").alias("parent_open"), "least")
    # the parent of most nodes is final in the shard; one that is open has been merged meanwhile
    node = ["parent", "conv", "depth", *sums, "ends_sha256"]
    nodes = parts.where("kind = 'node'")
    known = nodes.where("parent_open < 0").select(*node)
    below = nodes.where("parent_open >= 0").drop("parent").join(places.withColumnRenamed("least", "parent"), ["shard", "parent_open"]).select(*node)
    # an open node's parent is open; any one of its parts names it
    above = part.groupBy(*key).agg(F.min(F.struct("shard", "parent_open")).alias("at")).select(*key, "at.*")
    above = opened.join(above, key).join(places.withColumnRenamed("least", "parent"), ["shard", "parent_open"], "left").withColumnRenamed("least", "conv")
    columns = [
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        *(F.col(c).alias(c) for c in ("n_convs", "n_children")),
        F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    ]
    return known.select(*columns).unionByName(below.select(*columns)).unionByName(above.select(*columns))
