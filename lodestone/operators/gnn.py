"""Graph-neural propagation: gated messages along edges, summed by target, normalised by node.

Hidden states are rows ``(node, h)`` with an array of numbers.  Messages are made where edges and states
are joined, summed by target with partial aggregation in long form, and nodes are updated by Column
expressions; numpy is used for the gates and the message transform alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = 5


def scatter_add(rows: DataFrame, index: str, value: str, size: int | None = None) -> DataFrame:
    """``(index, value)`` sums by index; with ``size`` every index from 0 has a row, and others are refused."""
    sums = rows.groupBy(index).agg(F.sum(value).alias(value))
    if size is None:
        return sums
    if not rows.where((F.col(index) < 0) | (F.col(index) >= size)).isEmpty():
        raise ValueError("an index is out of range")
    return rows.sparkSession.range(size).withColumnRenamed("id", index).join(sums, index, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def scatter_add_rows(rows: DataFrame, index: str, value: str, dim: int, size: int | None = None) -> DataFrame:
    """``scatter_add`` of arrays of ``dim`` numbers; arrays of another length are refused."""
    if not rows.where(F.size(value) != dim).isEmpty():
        raise ValueError(f"a row has not {dim} numbers")
    wide = rows.select(index, *[F.col(value)[i].alias(f"v{i}") for i in range(dim)])
    sums = wide.groupBy(index).agg(*[F.sum(f"v{i}").alias(f"v{i}") for i in range(dim)])
    if size is not None:
        if not rows.where((F.col(index) < 0) | (F.col(index) >= size)).isEmpty():
            raise ValueError("an index is out of range")
        sums = rows.sparkSession.range(size).withColumnRenamed("id", index).join(sums, index, "left")
    return sums.select(index, F.array(*[F.coalesce(f"v{i}", F.lit(0.0)) for i in range(dim)]).alias(value))


def graph_shape(edges: DataFrame, n_nodes: int | None = None, times: str | None = None) -> DataFrame:
    """One row: nodes, edges, mean out-degree, density; parallel edges count (or ``times`` says how many a row is)."""
    if n_nodes is None:
        nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct().agg(F.count("*").alias("nodes"))
    else:
        nodes = edges.sparkSession.range(1).select(F.lit(n_nodes).cast("long").alias("nodes"))
    number = F.count("*") if times is None else F.coalesce(F.sum(times), F.lit(0))
    both = edges.agg(number.alias("edges")).join(nodes)  # one row each
    most = F.when(F.col("nodes") < 2, 1.0).otherwise(F.col("nodes").cast("double") * (F.col("nodes") - 1))
    return both.select("nodes", "edges", (F.col("edges") / F.greatest("nodes", F.lit(1))).alias("mean_degree"), (F.col("edges") / most).alias("density"))


def edge_features(edges: DataFrame, n_nodes: int | None = None, by: Sequence[str] = (), times: str | None = None) -> DataFrame:
    """Add ``z``: out-degrees of both ends, their difference, mean degree, density.

    ``by`` names columns, such as a tenant, within which degrees count; ``times`` one that says how many
    parallel edges a row stands for.
    """
    keys = list(by)
    number = F.count("*") if times is None else F.sum(times)
    degree = edges.groupBy(*keys, "src").agg(number.cast("double").alias("d"))
    shape = graph_shape(edges, n_nodes, times).first()
    out = edges.join(degree.withColumnRenamed("d", "du"), [*keys, "src"]).join(degree.select(*keys, F.col("src").alias("dst"), F.col("d").alias("dv")), [*keys, "dst"], "left")
    dv = F.coalesce("dv", F.lit(0.0))
    return out.withColumn("z", F.array("du", dv, F.abs(F.col("du") - dv), F.lit(float(shape["mean_degree"])), F.lit(float(shape["density"])))).drop("du", "dv")


@dataclass(frozen=True)
class Layer:
    """Weights of one layer; ``seeded`` draws them."""

    w_msg: np.ndarray
    w_g1: np.ndarray
    w_g2: np.ndarray
    delta: float = 0.1
    slope: float = 0.25

    @staticmethod
    def seeded(dim: int = 32, gate: int = 16, seed: int = 0) -> Layer:
        rng = np.random.default_rng(seed)
        draw = lambda rows, cols: rng.standard_normal((rows, cols)) * np.sqrt(2.0 / cols)
        return Layer(draw(dim, dim), draw(gate, FEATURES), draw(dim, gate))

    @property
    def dim(self) -> int:
        return len(self.w_msg)

    def gates(self, z: Column) -> list[Column]:
        """The gate of each state number for an edge's features, as Columns."""
        inner = [F.tanh(_dot([z[j] for j in range(FEATURES)], row)) for row in self.w_g1]
        return [F.lit(1.0) + F.lit(self.delta) * F.tanh(_dot(inner, row)) for row in self.w_g2]

    def projected(self, h: Column) -> Column:
        """The message transform of a state."""
        return F.array(*[_dot([h[j] for j in range(self.dim)], row) for row in self.w_msg])


def _dot(values: Sequence[Column], weights: np.ndarray) -> Column:
    terms = [v * F.lit(float(w)) for v, w in zip(values, weights, strict=True)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def layer_norm(h: Column, dim: int) -> Column:
    """Scale 1, shift 0, population variance + 1e-5."""
    add = lambda a, x: a + x
    mean = F.aggregate(h, F.lit(0.0), add) / dim
    centred = F.transform(h, lambda x: x - mean)
    var = F.aggregate(F.transform(centred, lambda x: x * x), F.lit(0.0), add) / dim
    return F.transform(centred, lambda x: x / F.sqrt(var + 1e-5))


def updated(h: Column, heard: Column, layer: Layer) -> Column:
    """A state after a layer: ``LN(h + PReLU(heard))``; ``heard`` is null where no message came."""
    prelu = lambda x: F.when(x >= 0, x).otherwise(layer.slope * x)
    return layer_norm(F.when(heard.isNull(), h).otherwise(F.zip_with(h, heard, lambda a, b: a + prelu(b))), layer.dim)


def forward(states: DataFrame, edges: DataFrame, layer: Layer) -> DataFrame:
    """One layer: ``LN(h + PReLU(sum of gated messages))``; edges need ``src, dst, z``.

    A node without incoming edges gets ``LN(h)``.  Edges whose source has no state are left out.
    """
    dim = layer.dim
    names = [f"m{i}" for i in range(dim)]

    def message(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            z, h = (batch.column(i).flatten().to_numpy().reshape(-1, n) for i, n in ((1, FEATURES), (2, dim)))
            gates = 1.0 + layer.delta * np.tanh(np.tanh(z @ layer.w_g1.T) @ layer.w_g2.T)
            m = gates * (h @ layer.w_msg.T)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(m[:, i])) for i in range(dim))], names=["node", *names])

    joined = edges.join(states.select(F.col("node").alias("src"), "h"), "src").select("dst", "z", "h")
    messages = joined.mapInArrow(message, "node long, " + ", ".join(f"{n} double" for n in names))
    sums = messages.groupBy("node").agg(*[F.sum(n).alias(n) for n in names])
    both = states.join(sums.select("node", F.array(*names).alias("agg")), "node", "left")
    return both.select("node", updated(F.col("h"), F.col("agg"), layer).alias("h"))


@dataclass(frozen=True)
class Head:
    """Calibration by feature, and a schema bias for each layer (the mean of its bases)."""

    feature: np.ndarray
    bases: list[np.ndarray] = field(default_factory=list)
    schema_weight: float = 0.5

    @staticmethod
    def identity(dim: int, layers: int, k: int = 2, weight: float = 0.5) -> Head:
        return Head(np.ones(dim), [np.zeros((k, dim)) for _ in range(layers)], weight)


def stack(states: DataFrame, edges: DataFrame, layers: list[Layer], head: Head, cut) -> DataFrame:
    """Context chain + weight * schema chain, each over all layers; the schema chain adds its bias after a layer.

    With an identity head both chains are equal, so the result is (1 + weight) times the context's.
    ``cut`` writes a layer's states to the shared folder, which keeps plans short.
    """
    lift = F.array(*[F.lit(float(x)) for x in head.feature])
    start = states.select("node", F.zip_with("h", lift, lambda a, b: a * b).alias("h"))
    context = schema = cut(start)
    for i, layer in enumerate(layers):
        context = cut(forward(context, edges, layer))
        bias = F.array(*[F.lit(float(x)) for x in head.bases[i].mean(0)])
        schema = cut(forward(schema, edges, layer).select("node", F.zip_with("h", bias, lambda a, b: a + b).alias("h")))
    both = context.join(schema.withColumnRenamed("h", "s"), "node")
    return both.select("node", F.zip_with("h", "s", lambda a, b: a + head.schema_weight * b).alias("h"))


def blend(p: Column, h: Column) -> Column:
    """Half the address probability, half the state's size: l1 / (l1 + 1)."""
    l1 = F.aggregate(h, F.lit(0.0), lambda a, x: a + F.abs(x))
    return 0.5 * p + 0.5 * l1 / (l1 + 1)
