"""An inverted-file index over vectors: cells around trained centroids, kept as sorted Parquet.

A search compares a query with the vectors of its ``probes`` nearest cells alone.  Probing all cells gives
the exact neighbours; ``recall`` says what fewer lose.  Vectors of another length than the index, and
zero vectors, have cells of their own, which a query always looks at where they could matter: every
row is indexed, and none is beyond reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import best_places
from ..shared import cut

#: Rows that the centroids are fitted on, for each cell; rounds of fitting; cells at most (they are sent to every task).
SAMPLE, ROUNDS, MOST_CELLS = 128, 10, 4096
#: The cell of zero vectors; a vector of another length ``n`` than the index is in cell ``OTHER - n``.
ZERO, OTHER = -1, -2
#: Vectors of one cell, and queries, that are compared at a time.
PART, BLOCK = 16_384, 1024


@dataclass
class Index:
    """``entries``: ``cell, part, id, e`` (unit length); ``cells``: ``cell, rows``; ``centroids``: one row each."""

    entries: DataFrame
    cells: DataFrame
    centroids: np.ndarray
    path: str | None = None


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """``id, n, e``: vectors that can be compared, scaled to unit length (zero vectors as they are)."""
    e = F.transform(F.col(embedding), lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).alias("id"), e.alias("e")).where("e is not null and size(e) > 0 and forall(e, x -> x is not null and abs(x) < double('infinity'))")
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return rows.withColumn("norm", norm).select("id", F.size("e").alias("n"), F.when(F.col("norm") > 0, F.transform("e", lambda x: x / F.col("norm"))).otherwise(F.col("e")).alias("e"), (F.col("norm") > 0).alias("some"))


def fit(unit: DataFrame, cells: int, dim: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of unit vectors ``id, e`` by blocked k-means on ``SAMPLE`` rows a cell, chosen by the hash of their id.

    A task compares a batch of rows with all centroids by one matrix product and gives a sum for each cell;
    the driver holds the centroids alone.  A cell that loses all its rows keeps its centroid.
    """
    sample = cut(unit.orderBy(F.xxhash64("id"), "id").limit(cells * SAMPLE).select("e"), "sample")
    first = sample.dropDuplicates(["e"]).orderBy(F.xxhash64("e"), "e").limit(cells).toArrow()
    centroids = _matrix(first.column("e").combine_chunks(), dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), dim)
            nearest = (rows @ centroids.T).argmax(axis=1)
            np.add.at(held, nearest, rows)
            n += np.bincount(nearest, minlength=len(centroids))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([r.tobytes() for r in held[at]], pa.binary())], names=["cell", "total"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in rows.column("total").to_pylist())
        return pa.table({"cell": rows.column("cell")[:1], "total": pa.array([total.tobytes()], pa.binary())})

    for _ in range(rounds):
        found = sample.mapInArrow(sums, "cell int, total binary").groupBy("cell").applyInArrow(add, "cell int, total binary").toArrow()
        moved = centroids.copy()
        for cell, total in zip(found.column("cell").to_pylist(), found.column("total").to_pylist(), strict=True):
            v = np.frombuffer(total, np.float64)
            moved[cell] = v / (np.linalg.norm(v) or 1.0)
        if np.allclose(moved, centroids):
            break
        centroids = moved
    return centroids


def _dealt(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """Rows ``id, n, e, some`` with each of their ``probes`` nearest cells; ``at`` counts from the nearest, also when all are asked for."""
    dim = centroids.shape[1] if len(centroids) else 0
    probes = min(probes, len(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _matrix(batch.column(batch.schema.get_field_index("e")), dim) @ centroids.T
            best = np.argsort(-near, axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([pa.array(best.astype(np.int32).tolist(), pa.list_(pa.int32())), *batch.columns], names=["cells", *batch.schema.names])

    kind = rows.schema["id"].dataType.simpleString()
    plain = rows.where((F.col("n") == dim) & F.col("some"))
    found = plain.mapInArrow(run, f"cells array<int>, id {kind}, n int, e array<double>, some boolean") if probes else plain.select(F.array().cast("array<int>").alias("cells"), "*")
    rest = rows.where((F.col("n") != dim) | ~F.col("some"))
    apart = F.when(F.col("n") != dim, F.lit(OTHER) - F.col("n")).otherwise(F.lit(ZERO))
    return found.select(F.posexplode("cells").alias("at", "cell"), "id", "n", "e", "some").unionByName(rest.select(F.lit(0).alias("at"), apart.alias("cell"), "id", "n", "e", "some"))


def build(vectors: DataFrame, cells: int, path: str | None = None, key: str = "vec_id", embedding: str = "embedding") -> Index:
    """Train an index and put every vector in the cell of its nearest centroid.

    Null and empty vectors, and those with null or infinite components, are left out, as nothing can be
    compared with them.  The most frequent length is the index's.  With ``path`` the index is written there
    (``open_index`` reads it), sorted by cell, so that a search reads the row groups of its cells; a cell of any
    size is cut in parts of ``PART`` rows.  Equal ids are rows of their own.
    """
    if not 0 < cells <= MOST_CELLS:
        raise ValueError(f"1 to {MOST_CELLS} cells")
    spark = vectors.sparkSession
    unit = _unit(vectors, key, embedding)
    lengths = unit.where("some").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dim = lengths["n"] if lengths else 1
    usable = unit.where((F.col("n") == dim) & F.col("some"))
    centroids = fit(usable, cells, dim) if lengths else np.zeros((0, dim))
    rows = _entries(unit, centroids)
    if path is None:
        entries = cut(rows, "cells")
        return Index(entries, _sizes(entries), centroids)
    rows.write.parquet(f"{path}/entries")
    made = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, e array<double>")  # MOST_CELLS rows at most
    made.coalesce(1).write.parquet(f"{path}/centroids")
    return open_index(spark, path)


def _entries(unit: DataFrame, centroids: np.ndarray) -> DataFrame:
    placed = cut(_dealt(unit, centroids, 1).select("cell", "id", "e"), "placed")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / PART).alias("parts"))  # a row for each cell
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    return dealt.repartitionByRange("cell", "part", F.xxhash64("id")).sortWithinPartitions("cell", "part").select("cell", "part", "id", "e")


def _sizes(entries: DataFrame) -> DataFrame:
    return cut(entries.groupBy("cell").agg(F.count("*").alias("rows"), (F.max("part") + 1).alias("parts")), "sizes")


def open_index(spark: SparkSession, path: str) -> Index:
    """An index that was written."""
    entries = spark.read.parquet(f"{path}/entries")
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").toArrow().column("e").to_pylist()
    centroids = np.array(rows) if rows else np.zeros((0, 1))
    return Index(entries, _sizes(entries), centroids, path)


def add(index: Index, vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding") -> Index:
    """Append vectors to a written index; the centroids stay.  The new files stand beside the old ones."""
    if index.path is None:
        raise ValueError("only a written index can grow")
    _entries(_unit(vectors, key, embedding), index.centroids).write.mode("append").parquet(f"{index.path}/entries")
    return open_index(vectors.sparkSession, index.path)


def search(index: Index, queries: DataFrame, k: int, probes: int, key: str = "vec_id", embedding: str = "embedding", query: str = "query_id") -> DataFrame:
    """``(query, key, cos, rank)``: the ``k`` nearest of the probed cells, best first, ties by key.

    A query meets each part of its cells in blocks of queries, one matrix product each, which returns ``k``
    rows a query.  Only the cells that some query probes are read.  A vector's cosine with a zero vector
    is 0; vectors of other lengths are not compared.
    """
    spark = queries.sparkSession
    asked = _unit(queries, query, embedding)
    wanted = _dealt(asked, index.centroids, max(probes, 1)).drop("at")
    dim = index.centroids.shape[1]
    # zero vectors are as near to all: they are compared with all, and all with them
    zeros = asked.where((F.col("n") == dim) & ~F.col("some")).select(F.explode(F.array(*map(F.lit, range(len(index.centroids))))).alias("cell"), "id", "n", "e", "some") if len(index.centroids) else asked.limit(0).select(F.lit(0).alias("cell"), "*")
    wanted = cut(wanted.unionByName(zeros).unionByName(asked.where((F.col("n") == dim) & F.col("some")).select(F.lit(ZERO).alias("cell"), "id", "n", "e", "some")), "probed")
    probed = [r[0] for r in wanted.select("cell").distinct().collect()]  # no more than there are cells
    parts = index.cells.where(F.col("cell").isin(probed))
    kind_q, kind = asked.schema["id"].dataType.simpleString(), index.entries.schema["id"].dataType.simpleString()
    # the most queries of a cell say how many blocks its vectors meet
    blocks = wanted.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    plan = parts.join(blocks, "cell")  # a row for each cell
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("int"), (F.col(n) - 1).cast("int")))
    v = index.entries.where(F.col("cell").isin(probed)).join(F.broadcast(plan), "cell").select("cell", "part", every("blocks").alias("block"), "id", "e")
    q = wanted.join(F.broadcast(plan), "cell").select("cell", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), every("parts").alias("part"), F.col("id").alias("q"), "e")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q", right.schema.field("q").type), ("id", left.schema.field("id").type), ("cos", pa.float64())])
        if not left.num_rows or not right.num_rows or k <= 0:
            return schema.empty_table()
        left, right = left.combine_chunks(), right.combine_chunks()
        size = len(left.column("e")[0])
        a, b = (np.concatenate([_matrix(c, size) for c in t.column("e").chunks]) for t in (right, left))
        ids, names = left.column("id").to_numpy(zero_copy_only=False), right.column("q")
        sims = np.round(a @ b.T, 9) + 0.0
        places = [best_places(s, ids, k) for s in sims]
        rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
        at = np.concatenate(places)
        return pa.table([names.take(pa.array(rows)), left.column("id").take(pa.array(at)), pa.array(sims[rows, at])], schema=schema)

    by = ["cell", "part", "block"]
    found = v.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(best, f"q {kind_q}, id {kind}, cos double")
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("cos"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(query), F.col("id").alias(key), "cos", "rank")


def probes_for(index: Index, queries: DataFrame, k: int, target: float = 0.95, key: str = "vec_id", embedding: str = "embedding", query: str = "query_id") -> int:
    """The fewest probes that find ``target`` of the true ``k`` neighbours of the given queries.

    One exact search tells in which of a query's cells, from the nearest on, each neighbour lies.
    """
    cells = len(index.centroids)
    truth = search(index, queries, k, cells, key, embedding, query).select(F.col(query).alias("q"), F.col(key).alias("id"))
    held = truth.join(index.entries.select("id", "cell").where("cell >= 0").distinct(), "id")
    order = _dealt(_unit(queries, query, embedding), index.centroids, cells).select(F.col("id").alias("q"), "cell", "at")
    found = held.join(order, ["q", "cell"]).groupBy("at").agg(F.count("*").alias("n")).collect()  # a row for each cell at most
    counts = np.zeros(max(cells, 1))
    for r in found:
        counts[r["at"]] = r["n"]
    return int(np.searchsorted(np.cumsum(counts), target * counts.sum())) + 1


def looked_at(index: Index, queries: DataFrame, probes: int, embedding: str = "embedding", query: str = "query_id") -> float:
    """The share of all pairs of a query and a vector that a search compares."""
    wanted = _dealt(_unit(queries, query, embedding), index.centroids, max(probes, 1))
    pairs = wanted.join(F.broadcast(index.cells), "cell").agg(F.sum("rows")).first()[0] or 0
    total = (index.cells.agg(F.sum("rows")).first()[0] or 0) * queries.count()
    return pairs / total if total else 0.0


def recall(found: DataFrame, truth: DataFrame, key: str = "vec_id", query: str = "query_id") -> float:
    """The share of the true neighbours that were found."""
    both = truth.select(query, key).join(found.select(query, key, F.lit(1).alias("hit")), [query, key], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
