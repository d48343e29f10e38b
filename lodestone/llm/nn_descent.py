"""Near-duplicate vectors by NN-descent, with completion of dense groups and an audit of recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import connected_components, materialise

THRESHOLD = 0.9
#: Neighbours of a vector; a list whose last entry still reaches the threshold doubles, up to MOST.
NEIGHBOURS, MOST = 8, 32
#: Hyperplane partitions for the first graph, and vectors in a leaf of one.
TREES, LEAF = 8, 256
ROUNDS = 3
#: Rows of a list that meet in one local join, of a tile in the completion of groups, of a group that is one tile, and of
#: one product of two tiles.
CHUNK, TILE, SMALL, STRIP = 48, 4096, 256, 512
#: Vectors compared with all rows, share of them that need all of their links, and attempts to reach it.
AUDIT, RECALL, ATTEMPTS = 512, 0.97, 8


def unit_vectors(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """``(id, unit)`` with unit vectors as float64 bytes; null ``unit`` where a row links with nothing.

    That is: a null or empty vector, a null key, a zero vector, a null or non-finite component.
    """
    base = vectors.select(F.col(key).alias("id"), F.col(embedding).cast("array<double>").alias("e"))
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                unit = None
                if i is not None and e and None not in e:
                    v = np.array(e, np.float64)
                    if np.isfinite(v).all() and (big := np.abs(v).max()) > 0:
                        v = v / big
                        unit = (v / np.sqrt(v @ v)).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "unit"])

    return base.mapInArrow(run, f"id {kind}, unit binary")


def _stack(column, kind=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _empty() -> pd.DataFrame:
    return pd.DataFrame({"u": pd.Series([], dtype="int64"), "v": pd.Series([], dtype="int64"), "sim": pd.Series([], dtype="float32")})


def first_graph(nodes: DataFrame, trees: int, leaf: int, k: int, seed: int) -> DataFrame:
    """``(u, v, sim)``: the best ``k`` in a vector's leaf of each hyperplane partition.

    A leaf that holds much more than ``leaf`` vectors (copies that no plane parts) is dealt into pieces.
    """
    n = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _stack(batch.column(1).to_pylist(), np.float32)
            for tree in range(trees):
                planes = np.random.default_rng([seed, tree]).standard_normal((units.shape[1], bits)).astype(np.float32)
                codes = ((units @ planes > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(units), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(units), pa.int32()), pa.array(codes), batch.column(0), batch.column(1)], names=["tree", "code", "node", "small"])

    coded = nodes.select("node", "small").mapInArrow(code, "tree int, code long, node long, small binary")
    sizes = coded.groupBy("tree", "code").agg(F.ceil(F.count("*") / (2 * leaf)).alias("parts"))
    dealt = coded.join(sizes, ["tree", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "tree"), F.col("parts")))

    def best(group: pd.DataFrame) -> pd.DataFrame:
        if len(group) < 2:
            return _empty()
        ids, units = group["node"].to_numpy(), _stack(group["small"], np.float32)
        sims = units @ units.T
        np.fill_diagonal(sims, -2)
        m = min(k, len(ids) - 1)
        at = np.argpartition(-sims, m - 1, axis=1)[:, :m]
        return pd.DataFrame({"u": np.repeat(ids, m), "v": ids[at].ravel(), "sim": np.take_along_axis(sims, at, 1).ravel()})

    return dealt.select("tree", "code", "part", "node", "small").groupBy("tree", "code", "part").applyInPandas(best, "u long, v long, sim float")


def best_lists(links: DataFrame, k: int, most: int, threshold: float) -> DataFrame:
    """The best of each vector's links: ``k``, doubled while the list's last still reaches the threshold."""
    best = links.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("old").alias("old"))
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return best.withColumn("r", rank).where(F.col("r") <= most).where((F.col("r") <= k) | (F.col("sim") >= threshold)).select("u", "v", "sim", "old")


def local_join(graph: DataFrame, nodes: DataFrame, chunk: int, seed: int) -> DataFrame:
    """Candidates ``(u, v, sim)`` from pairs of vectors that share a neighbour, one of the links new.

    A vector's list is its neighbours and those it is a neighbour of; long lists are dealt into chunks.
    A candidate is returned only if it beats the last entry of the list it would join.
    """
    last = graph.groupBy("u").agg(F.min("sim").alias("last"))
    meet = graph.select(F.col("u").alias("p"), F.col("v").alias("node"), "old").union(graph.select(F.col("v").alias("p"), F.col("u").alias("node"), "old")).groupBy("p", "node").agg(F.min("old").alias("old"))
    sizes = meet.groupBy("p").agg(F.ceil(F.count("*") / chunk).alias("parts"), F.min("old").alias("least")).where("least = 0").drop("least")
    dealt = meet.join(sizes, "p").withColumn("part", F.pmod(F.xxhash64("node", "p", F.lit(seed)), F.col("parts")))
    rows = dealt.join(nodes.select("node", "small"), "node").join(last.withColumnRenamed("u", "node"), "node", "left")
    lists = rows.groupBy("p", "part").agg(F.collect_list(F.struct("node", "small", F.coalesce("last", F.lit(-2.0)).cast("float").alias("last"), "old")).alias("list"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs, ss = [], [], []
            lists = batch.column(0)
            flat, offsets = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            ids, lasts, olds = (flat.field(i).to_numpy() for i in (0, 2, 3))
            if not len(ids):
                continue
            units = _stack(flat.field(1).to_pylist(), np.float32)
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                sims = units[a:b] @ units[a:b].T
                np.fill_diagonal(sims, -3)
                fresh = olds[a:b] == 0
                good = (sims > lasts[a:b, None]) & (fresh[:, None] | fresh[None, :])
                i, j = np.nonzero(good)
                us.append(ids[a + i])
                vs.append(ids[a + j])
                ss.append(sims[i, j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs, ss)], names=["u", "v", "sim"])

    return lists.select("list").mapInArrow(pairs, "u long, v long, sim float")


def descend(nodes: DataFrame, threshold: float, k: int, most: int, rounds: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """The neighbour graph ``(u, v, sim, old)`` after up to ``rounds`` rounds of NN-descent."""
    start = first_graph(nodes, trees, leaf, k, seed).withColumn("old", F.lit(0))
    graph = materialise(best_lists(start, k, most, threshold), "graph")
    for i in range(rounds):
        found = local_join(graph, nodes, CHUNK, seed + i).withColumn("old", F.lit(0))
        # a link that was there keeps its mark of age: it has met all others of its lists
        known = graph.withColumn("old", F.lit(1))
        merged = found.join(known.select("u", "v"), ["u", "v"], "left_anti").unionByName(known)
        graph = materialise(best_lists(merged, k, most, threshold), "graph")
        if graph.where("old = 0").isEmpty():
            break
    return graph


def exact_links(graph: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)`` of the graph whose cosine in double precision reaches the threshold."""
    near = graph.where(F.col("sim") >= threshold - 1e-4).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    both = near.join(nodes.select(F.col("node").alias("a"), F.col("unit").alias("ua")), "a").join(nodes.select(F.col("node").alias("b"), F.col("unit").alias("ub")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = _stack(batch.column(2).to_pylist()), _stack(batch.column(3).to_pylist())
                ok = np.flatnonzero((x * y).sum(1) >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok))], names=["a", "b"])

    return both.select("a", "b", "ua", "ub").mapInArrow(check, "a long, b long")


def in_tiles(members: DataFrame, tile: int, columns: list[str]) -> DataFrame:
    """``(component, part, rows)``: members of each component dealt into parts of ``tile`` at most.

    Parts grow with the root of a component's size, so that middling components are several tasks' work
    too.  Only components with several parts are joined to their number, and rows are dealt by component and part,
    so that a large component never meets in one task.
    """
    parts = F.when(F.count("*") > min(tile, SMALL), F.ceil(F.greatest(F.count("*") / tile, F.sqrt(F.count("*") / (SMALL / 4))))).otherwise(1)
    large = materialise(members.groupBy("component").agg(parts.cast("int").alias("parts")).where("parts > 1"), "large")
    part = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = members.join(large, "component", "left").withColumn("part", part).repartition("component", "part")
    packed = dealt.groupBy("component", "part").agg(F.collect_list(F.struct(*columns)).alias("rows"), F.max("parts").alias("parts"))
    return packed.withColumn("parts", F.coalesce("parts", F.lit(1)))


def complete(members: DataFrame, threshold: float, tile: int) -> DataFrame:
    """``(node, links)``: each vector's links inside its component, counted in full.

    Lists stop at ``MOST`` entries; a vector with more links has them all in its component, whose
    members are compared tile by tile, each pair of tiles once.  Counts leave a task, never pairs.
    """
    tiles = materialise(in_tiles(members, tile, ["node", "unit", "copies"]), "tiles")
    # small components go together: a task gets many of them in one batch
    left = tiles.select("component", F.col("part").alias("pa"), F.col("rows").alias("ra"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("pb"))
    pairs = left.join(tiles.select("component", F.col("part").alias("pb"), F.col("rows").alias("rb")), ["component", "pb"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pa_, pb_, ra, rb in zip(*(batch.column(i) for i in range(4)), strict=True):
                a, b = ra.values, rb.values
                x, y = _stack(a.field(1).to_pylist()), _stack(b.field(1).to_pylist())
                na, nb = a.field(0).to_numpy(), b.field(0).to_numpy()
                same = pa_.as_py() == pb_.as_py()
                of_a, of_b = np.zeros(len(na), np.int64), np.zeros(len(nb), np.int64)
                for i in range(0, len(na), STRIP):
                    near = x[i : i + STRIP] @ y.T >= threshold
                    if same:
                        near &= na[i : i + STRIP, None] != nb[None, :]
                    of_a[i : i + STRIP] = near @ b.field(2).to_numpy()
                    if not same:
                        of_b += a.field(2).to_numpy()[i : i + STRIP] @ near
                yield pa.RecordBatch.from_arrays([pa.array(na), pa.array(of_a)], names=["node", "links"])
                if not same:
                    yield pa.RecordBatch.from_arrays([pa.array(nb), pa.array(of_b)], names=["node", "links"])

    return pairs.select("pa", "pb", "ra", "rb").mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def cross_links(graph: DataFrame, members: DataFrame, threshold: float, most: int, tile: int) -> DataFrame:
    """Links ``(a, b)`` between components that full lists may hide, one for each pair of tiles.

    A link that no list holds has two ends whose lists are full of closer vectors.  Such vectors are dealt
    into tiles of their component; two tiles of different components are compared in full, unless the
    angle between their centres is more than both radii and the threshold's angle together.
    """
    full = graph.where(F.col("sim") >= threshold - 1e-4).select("u", "v").distinct().groupBy("u").count().where(F.col("count") >= most).select(F.col("u").alias("node"))
    dense = members.join(full, "node").select("component", "node", "unit")
    packed = in_tiles(dense, tile, ["node", "unit"]).select("component", "part", "rows")

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for rows in batch.column(2):
                units = _stack(rows.values.field(1).to_pylist())
                c = units.sum(0)
                size = np.sqrt(c @ c)
                c = c / size if size > 0 else units[0]
                centres.append(c.tobytes())
                radii.append(float(np.arccos(np.clip((units @ c).min(), -1, 1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centres, pa.binary()), pa.array(radii, pa.float64())], names=["component", "part", "rows", "centre", "radius"])

    kind = "component long, part int, rows array<struct<node: long, unit: binary>>, centre binary, radius double"
    tiles = materialise(packed.mapInArrow(ball, kind), "dense_tiles")
    blocks = max(1, -(-tiles.count() // tile))
    balls = tiles.select("component", "part", "centre", "radius").withColumn("block", F.pmod(F.xxhash64("component", "part"), F.lit(blocks)).cast("int"))
    blocked = materialise(balls.groupBy("block").agg(F.collect_list(F.struct("component", "part", "centre", "radius")).alias("balls")), "balls")
    near_blocks = blocked.withColumn("other", F.explode(F.sequence("block", F.lit(blocks - 1)))).join(blocked.select(F.col("block").alias("other"), F.col("balls").alias("others")), "other")
    reach = float(np.arccos(threshold)) + 1e-9

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ra, rb in zip(batch.column(0), batch.column(1), strict=True):
                a, b = ra.values, rb.values
                angle = np.arccos(np.clip(_stack(a.field(2).to_pylist()) @ _stack(b.field(2).to_pylist()).T, -1, 1))
                ca, cb = a.field(0).to_numpy(), b.field(0).to_numpy()
                i, j = np.nonzero((angle <= a.field(3).to_numpy()[:, None] + b.field(3).to_numpy()[None, :] + reach) & (ca[:, None] != cb[None, :]))
                take_a, take_b = pa.array(i), pa.array(j)
                yield pa.RecordBatch.from_arrays([a.field(0).take(take_a), a.field(1).take(take_a), b.field(0).take(take_b), b.field(1).take(take_b)], names=["ca", "pa", "cb", "pb"])

    pairs = near_blocks.select("balls", "others").mapInArrow(near, "ca long, pa int, cb long, pb int")
    # a block meets itself too, where each pair comes twice
    pairs = pairs.select(*[F.when(F.col("ca") < F.col("cb"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("ca", "cb"), ("pa", "pb"))], *[F.when(F.col("ca") < F.col("cb"), F.col(x)).otherwise(F.col(y)).alias(x) for x, y in (("cb", "ca"), ("pb", "pa"))]).distinct()
    both = pairs.join(tiles.select(F.col("component").alias("ca"), F.col("part").alias("pa"), F.col("rows").alias("ra")), ["ca", "pa"])
    both = both.join(tiles.select(F.col("component").alias("cb"), F.col("part").alias("pb"), F.col("rows").alias("rb")), ["cb", "pb"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ra, rb in zip(batch.column(0), batch.column(1), strict=True):
                a, b = ra.values, rb.values
                x, y = _stack(a.field(1).to_pylist()), _stack(b.field(1).to_pylist())
                for start in range(0, len(x), STRIP):
                    sims = x[start : start + STRIP] @ y.T
                    i, j = np.unravel_index(int(sims.argmax()), sims.shape)
                    if sims[i, j] >= threshold:
                        yield pa.RecordBatch.from_arrays([a.field(0).slice(start + int(i), 1), b.field(0).slice(int(j), 1)], names=["a", "b"])
                        break

    return both.select("ra", "rb").mapInArrow(link, "a long, b long")


def audited(nodes: DataFrame, links: DataFrame, threshold: float, size: int) -> list[tuple[int, int]]:
    """True and counted links of ``size`` vectors (smallest hash), by comparing them with all rows."""
    chosen = nodes.orderBy(F.xxhash64("node", F.lit(99)), "node").limit(size).select("node", "unit").collect()
    if not chosen:
        return []
    ids, units = np.array([r["node"] for r in chosen]), _stack([bytes(r["unit"]) for r in chosen])

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if batch.num_rows:
                near = (units @ _stack(batch.column(1).to_pylist()).T >= threshold) & (ids[:, None] != batch.column(0).to_numpy()[None, :])
                total += near @ batch.column(2).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["node", "true_links"])

    true = nodes.select("node", "unit", "copies").mapInArrow(brute, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))
    rows = true.join(links, "node", "left").select("true_links", F.coalesce("links", F.lit(0)).alias("found")).collect()
    return [(r["true_links"], r["found"]) for r in rows]


def audit(nodes: DataFrame, links: DataFrame, threshold: float, size: int) -> float:
    """Share of the true links of ``size`` vectors (smallest hash) that were counted."""
    rows = audited(nodes, links, threshold, size)
    true = sum(t for t, _ in rows)
    return sum(min(t, f) for t, f in rows) / true if true else 1.0


def whole_share(rows: list[tuple[int, int]], recall: float, strata: tuple[int, ...] = (3, MOST)) -> float:
    """Least share of vectors with all of their links: of the audited with any, and of each stratum by true links.

    A stratum ends at each number of ``strata``; one with too few vectors to tell ``recall`` counts in the whole only.
    """
    rows = [(t, f >= t) for t, f in rows if t > 0]
    ends = [0, *strata, float("inf")]
    groups = [[ok for t, ok in rows if lo < t <= hi] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    groups = [[ok for _, ok in rows], *(g for g in groups if len(g) * (1 - recall) >= 1)]
    return min(sum(g) / len(g) if g else 1.0 for g in groups)


def enough_trees(n: int, leaf: int, trees: int, threshold: float) -> int:
    """At least ``trees``; so many that a pair at the threshold shares a leaf with nine chances in ten."""
    bits = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))
    together = (1 - np.arccos(threshold) / np.pi) ** bits
    return trees if together >= 0.9 else max(trees, int(np.ceil(np.log(0.1) / np.log(1 - together))))


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, k: int = NEIGHBOURS, most: int = MOST, rounds: int = ROUNDS, trees: int = TREES, leaf: int = LEAF, tile: int = TILE, audit_size: int = AUDIT, recall: float = RECALL, attempts: int = ATTEMPTS) -> DataFrame:
    """One row for each input row: ``key``, ``n_links``, ``component_id``, ``kept``.

    Vectors link where their cosine in double precision is ``threshold`` or more.  NN-descent finds the
    neighbour graph; its links at the threshold, checked in double precision, make the components,
    with links between vectors whose lists are full, which are compared across components;
    links of a component's members are then counted in full, so lists that saturate lose nothing.  An
    audit compares some vectors with all rows; while too few of them have all of their links (in all,
    or among those with few, more or many), another descent from other partitions adds to the graph.
    Where that finds nothing new, or ``attempts`` are used up, an error tells the share.

    Vectors of different lengths never link; each length is worked on alone.  Equal vectors are one node
    with a count: they link with each other and are never compared.  Rows
    that cannot be compared (see ``unit_vectors``) have no links and are components of their own;
    a null key has a null component and is not kept.  Keys are expected to be integers and unique;
    rows that repeat a key count as vectors of their own.  An empty table gives an empty result.  Only
    ``key`` and ``embedding`` are read.
    """
    kind = vectors.schema[key].dataType
    rows = materialise(unit_vectors(vectors, key, embedding), "units")
    same = rows.where("unit is not null").groupBy("unit").agg(F.min("id").cast("long").alias("node"), F.count("*").alias("copies"), F.min("id").alias("first_id"))

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [np.frombuffer(u, np.float64).astype(np.float32).tobytes() for u in batch.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(small, pa.binary())], names=[*names, "small"])

    # two nodes may not share a name: of rows that repeat a key with other vectors, later ones get negative names
    names = ["node", "unit", "copies", "first_id"]
    named = same.withColumn("n_", F.row_number().over(W.partitionBy("node").orderBy("unit")))
    named = named.select(F.when(F.col("n_") == 1, F.col("node")).otherwise(-F.abs(F.xxhash64("unit")) - 1).alias("node"), *names[1:])
    nodes = materialise(named.mapInArrow(shrink, f"node long, unit binary, copies long, first_id {kind.simpleString()}, small binary"), "nodes")
    lengths = [r[0] for r in nodes.select(F.length("unit")).distinct().collect()]  # one, as a rule
    found = links = None
    for length in lengths:
        own = nodes if len(lengths) == 1 else materialise(nodes.where(F.length("unit") == length), "nodes")
        more_found, more_links = linked(own, threshold, k, most, rounds, trees, leaf, tile, audit_size, recall, attempts)
        found = more_found if found is None else found.unionByName(more_found)
        links = more_links if links is None else links.unionByName(more_links)
    if found is None:
        found, links = nodes.select("node", F.col("node").alias("component")), nodes.select("node", F.col("copies").alias("links"))
    near = materialise(nodes.select("node", "unit", "copies", "first_id").join(found, "node"), "near")
    least = materialise(near.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    counted = near.join(least, "component").join(links, "node", "left")
    alone = nodes.join(found, "node", "left_anti").select("unit", "copies", F.lit(0).cast("long").alias("links"), F.col("first_id").alias("component_id"))
    every = counted.select("unit", "copies", "links", "component_id").unionByName(alone)
    classes = every.select("unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.join(classes, "unit", "left")
    component = F.when(F.col("unit").isNull(), F.col("id")).otherwise(F.col("component_id")).cast(kind)
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def linked(nodes: DataFrame, threshold: float, k: int, most: int, rounds: int, trees: int, leaf: int, tile: int, audit_size: int, recall: float, attempts: int) -> tuple[DataFrame, DataFrame]:
    """``(node, component)`` and ``(node, links)`` of distinct vectors of one length; those without links do not appear."""
    graph, before = None, -1
    n = nodes.count()
    trees = enough_trees(n, leaf, trees, threshold)
    rounds += max(0, int(np.ceil(np.log10(max(1, n) / 100_000))))
    for attempt in range(attempts):
        more = descend(nodes, threshold, k, most, rounds, trees, leaf, seed=1000 * attempt)
        graph = more if graph is None else graph.unionByName(more)
        exact = materialise(exact_links(graph, nodes, threshold), "exact")
        found = connected_components(exact).select("node", "component")
        members = nodes.join(found, "node").select("component", "node", "unit", "copies")
        across = materialise(cross_links(graph, members, threshold, most, tile), "across")
        if not across.isEmpty():
            found = connected_components(exact.unionByName(across)).select("node", "component")
            members = nodes.join(found, "node").select("component", "node", "unit", "copies")
        links = materialise(complete(members, threshold, tile), "links")
        share = whole_share(audited(nodes, links, threshold, audit_size), recall)
        if share >= recall:
            return found, links
        total = links.agg(F.sum("links")).first()[0] or 0
        if total == before:
            break
        before = total
    raise RuntimeError(f"{share:.3f} of the audited vectors have all of their links after {attempt + 1} descents; {recall} is wanted")
