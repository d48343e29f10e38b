"""Propagation for many queries at once: entities in tiles, queries in blocks, a sparse product for each pair.

A row holds what an entity (or a document's part) has for a whole block of queries, as one array, so the
number of rows does not grow with entities times queries.  A tile asks for the sources of its edges once,
however many edges start there.  Targets with very many edges are summed apart before their tile is worked on, in
pieces by the tile of the source, so a source is one row there, whatever it names; a source with very many edges is one
row in each tile.

Documents are summed only where they can be among the best: entities have a highest score of all queries, a document
the sum of those as its bound, and the documents of the highest bounds give each query ``k`` scores that others must
reach.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import best_places, embedding_arrays
from ..shared import cut
from . import address, gnn

QUESTION, OWN, SOURCE, EDGE, SUMMED = range(5)
PART = ["tenant", "block", "part", "salt"]


@dataclass(frozen=True)
class Tiling:
    """About how many entities and edges a tile has, from how many edges on a target is summed apart, and queries of a block.

    ``first`` documents of a tenant are summed to know what others must reach; ``heavy`` entities at most, over all tenants,
    have their own bound, the rest one in common; a list of up to ``listed`` documents goes to all tasks.
    """

    rows: int = 4096
    edges: int = 32_768
    hot: int = 8192
    block: int = 128
    slots: int = 16
    first: int = 1024
    heavy: int = 65_536
    listed: int = 1 << 20


def _parts(rows: DataFrame, most: int) -> DataFrame:
    """``(tenant, parts)``: into how many parts of about ``most`` rows those of a tenant go."""
    return rows.groupBy("tenant").agg(F.ceil(F.count("*") / most).alias("parts"))


def _fresh(rows: DataFrame) -> DataFrame:
    """The same columns, told apart from those that the other side of a cogroup has from the same table."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def _place(key: str):
    return F.pmod(F.xxhash64(key), F.col("parts"))


def _stacked(rows: pd.Series, width: int = 0) -> np.ndarray:
    return np.stack(rows.to_list()).astype(np.float64) if len(rows) else np.zeros((0, width))


def questions(plans: DataFrame, dim: int, tiling: Tiling) -> DataFrame:
    """``(tenant, block, slot, query_id, q)``: queries dealt over blocks, with their embeddings."""
    q = embedding_arrays(plans.select("tenant", "query_id", "text"), ["tenant", "query_id"], "text", dim)
    dealt = q.join(_parts(q, tiling.block), "tenant").select("tenant", _place("query_id").alias("block"), "query_id", F.col("e").alias("q"))
    asked = dealt.groupBy("tenant", "block").agg(F.array_sort(F.collect_list(F.struct("query_id", "q"))).alias("all"))  # a block's
    return asked.select("tenant", "block", F.posexplode("all").alias("slot", "x")).select("tenant", "block", "slot", "x.query_id", "x.q")


def raw_scores(plans: DataFrame, asked: DataFrame, entities: DataFrame, tiles: DataFrame, weights: address.Weights, dim: int) -> DataFrame:
    """``(tenant, block, tile, kind, entity_id, raw, mass)``: scores of an entity for a block of queries.

    Rows of kind 1 have a tile's highest score of each query in ``raw`` and the sum of its exponentials in ``mass``.
    """
    t = max(weights.temperature, 1e-6)
    names = embedding_arrays(entities.select("tenant", "entity_id", "name"), ["tenant", "entity_id"], "name", dim)
    places = names.join(tiles, "tenant").select("tenant", _place("entity_id").alias("tile"), "entity_id", "e")
    hits = address.match_scores(plans, entities, weights).join(asked.select("tenant", "query_id", "block", "slot"), ["tenant", "query_id"])
    hits = hits.groupBy("tenant", "block", "entity_id").agg(F.collect_list(F.struct("slot", (F.col("raw") - weights.cons).alias("w"))).alias("hits"))  # one a slot
    each = places.join(asked.select("tenant", "block").distinct(), "tenant").join(hits, ["tenant", "block", "entity_id"], "left")
    each = each.select("tenant", "block", "tile", "entity_id", "e", F.col("hits.slot").alias("at"), F.col("hits.w").alias("w"))
    used = _fresh(asked.join(tiles, "tenant")).select("tenant", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("tile"), "slot", "q")
    kind = plans.schema["tenant"].dataType.simpleString()

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({n: [] for n in ("tenant", "block", "tile", "kind", "entity_id", "raw", "mass")})
        q, e = _stacked(right.sort_values("slot")["q"]), _stacked(left["e"])
        near = (e @ q.T) / np.maximum(np.linalg.norm(e, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :], 1e-12)
        raw = weights.cos * np.maximum(near, 0.0) + weights.cons
        for i, (at, w) in enumerate(zip(left["at"], left["w"], strict=True)):
            if at is not None:
                raw[i, at] += w
        top = raw.max(0)
        mass = np.exp((raw - top) / t).sum(0)
        tenant, block, tile = left["tenant"].iloc[0], left["block"].iloc[0], left["tile"].iloc[0]
        n = len(left)
        return pd.DataFrame({"tenant": [tenant] * (n + 1), "block": block, "tile": tile, "kind": [0] * n + [1], "entity_id": [*left["entity_id"], 0], "raw": [*raw, top], "mass": [None] * n + [mass]})

    by = ["tenant", "block", "tile"]
    schema = f"tenant {kind}, block long, tile long, kind int, entity_id long, raw array<double>, mass array<double>"
    return each.groupBy(*by).cogroup(used.groupBy(*by)).applyInPandas(score, schema)


def with_mass(asked: DataFrame, scored: DataFrame, temperature: float) -> DataFrame:
    """Questions as arrays ``v``: the embedding, the highest score, the mass of the softmax."""
    t = max(temperature, 1e-6)
    stats = scored.where("kind = 1").select("tenant", "block", F.posexplode(F.arrays_zip("raw", "mass")).alias("slot", "x")).select("tenant", "block", "slot", "x.raw", "x.mass")
    tops = stats.groupBy("tenant", "block", "slot").agg(F.max("raw").alias("top"))
    mass = stats.join(tops, ["tenant", "block", "slot"]).groupBy("tenant", "block", "slot", "top").agg(F.sum(F.col("mass") * F.exp((F.col("raw") - F.col("top")) / t)).alias("z"))
    return asked.join(mass, ["tenant", "block", "slot"]).select("tenant", "block", "slot", "query_id", F.concat("q", F.array("top", "z")).alias("v"))


def _rows(asked: DataFrame, scored: DataFrame, links: DataFrame, parts: DataFrame) -> DataFrame:
    """What the parts of a graph need, as rows ``(tenant, block, part, salt, kind, a, b, v)``: questions, sources, edges."""
    row = lambda kind, a, b, v: [*PART, F.lit(kind).alias("kind"), F.col(a).cast("long").alias("a"), (F.lit(0).cast("long") if b is None else F.col(b)).alias("b"), F.col(v).alias("v")]
    out = asked.join(parts, "tenant").select(*row(QUESTION, "slot", None, "v"))
    raw = scored.where("kind = 0").select("tenant", "block", F.col("entity_id").alias("src"), F.col("raw").alias("v"))
    wanted = links.select("tenant", "part", "salt", "src").distinct()
    out = out.unionByName(wanted.join(raw, ["tenant", "src"]).select(*row(SOURCE, "src", None, "v")))
    return out.unionByName(links.join(asked.select("tenant", "block").distinct(), "tenant").select(*row(EDGE, "src", "dst", "v")))


class _Block:
    """The rows of a part, and its sparse products."""

    def __init__(self, rows: pd.DataFrame, layer: gnn.Layer, temperature: float, eta: float):
        kinds = {k: rows[rows["kind"] == k] for k in range(5)}
        v = _stacked(kinds[QUESTION].sort_values("a")["v"])
        self.q, self.top, self.z = v[:, :-2], v[:, -2], v[:, -1]
        self.t, self.eta, self.layer, self.kinds = max(temperature, 1e-6), eta, layer, kinds
        sources = kinds[SOURCE].sort_values("a")
        ids = sources["a"].to_numpy(np.int64)
        self.lifted = self.p(_stacked(sources["v"], len(v))) ** eta
        edges = kinds[EDGE].sort_values("b")
        src, dst = edges["a"].to_numpy(np.int64), edges["b"].to_numpy(np.int64)
        at = np.searchsorted(ids, src)
        known = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == src) if len(ids) else np.zeros(len(src), bool)
        z = _stacked(edges["v"], gnn.FEATURES + 1)[known]
        self.src, dst = at[known], dst[known]
        self.gates = (1.0 + layer.delta * np.tanh(np.tanh(z[:, : gnn.FEATURES] @ layer.w_g1.T) @ layer.w_g2.T)) * z[:, gnn.FEATURES :]
        self.starts = np.flatnonzero(np.diff(dst, prepend=dst[0] - 1)) if len(dst) else np.zeros(0, np.int64)
        self.targets = dst[self.starts]

    def p(self, raw: np.ndarray) -> np.ndarray:
        return np.exp((raw - self.top) / self.t) / self.z

    def heard(self, low: int, high: int) -> np.ndarray:
        """(target, slot, dimension): sums of gates times what the sources carry."""
        if not len(self.starts):
            return np.zeros((0, min(high, len(self.q)) - low, self.layer.dim))
        carried = self.lifted[self.src, low:high]
        return np.stack([np.add.reduceat(carried * self.gates[:, [i]], self.starts, axis=0) for i in range(self.layer.dim)], axis=2)


def _summed(rows: DataFrame, layer: gnn.Layer, temperature: float, eta: float, kind: str) -> DataFrame:
    """``(tenant, block, dst, m)``: what hot targets hear, one array of (slot, dimension), pieces added up."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        b = _Block(group, layer, temperature, eta)
        m = b.heard(0, len(b.q)).reshape(len(b.targets), -1)
        return pd.DataFrame({"tenant": [group["tenant"].iloc[0]] * len(m), "block": group["block"].iloc[0], "dst": b.targets, "m": list(m)})

    pieces = rows.groupBy(*PART).applyInPandas(run, f"tenant {kind}, block long, dst long, m array<double>")
    sums = pieces.select("tenant", "block", "dst", F.posexplode("m").alias("i", "x")).groupBy("tenant", "block", "dst", "i").agg(F.sum("x").alias("x"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])  # slots times dimensions
    return sums.groupBy("tenant", "block", "dst").agg(packed.alias("m"))


def entity_scores(plans: DataFrame, entities: DataFrame, edges: DataFrame, layer: gnn.Layer, weights: address.Weights, eta: float, tiling: Tiling) -> tuple[DataFrame, DataFrame]:
    """``(tenant, block, entity_id, s)``, an array of one score a query of the block, and the questions of the blocks."""
    alive = entities.select("tenant", F.col("entity_id").alias("dst"))
    links = edges.groupBy("tenant", "src", "dst").agg(F.count("*").alias("times")).join(alive, ["tenant", "dst"], "left_semi")
    links = gnn.edge_features(cut(links), entities.count(), ["tenant"], "times")
    links = cut(links.select("tenant", "src", "dst", F.concat("z", F.array(F.col("times").cast("double"))).alias("v")))
    asked = cut(questions(plans, layer.dim, tiling))
    tiles = _parts(entities, tiling.rows).join(_parts(links, tiling.edges).withColumnRenamed("parts", "more"), "tenant", "left")
    tiles = cut(tiles.select("tenant", F.greatest("parts", F.coalesce("more", F.lit(0).cast("long"))).alias("parts")))
    scored = cut(raw_scores(plans, asked, entities, tiles, weights, layer.dim))
    asked = cut(with_mass(asked, scored, weights.temperature))
    kind = plans.schema["tenant"].dataType.simpleString()

    hot = cut(links.groupBy("tenant", "dst").agg(F.count("*").alias("n")).where(F.col("n") > tiling.hot))
    cold = links.join(hot, ["tenant", "dst"], "left_anti").join(tiles, "tenant").select("tenant", _place("dst").alias("part"), F.lit(0).cast("long").alias("salt"), "src", "dst", "v")
    parts = tiles.select("tenant", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).cast("long").alias("salt"))
    rows = _rows(asked, scored, cold, parts)
    own = scored.where("kind = 0").select("tenant", "block", F.col("tile").alias("part"), F.lit(0).cast("long").alias("salt"), F.lit(OWN).alias("kind"), F.col("entity_id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("raw").alias("v"))
    rows = rows.unionByName(own)
    if not hot.isEmpty():
        pieces = links.join(hot, ["tenant", "dst"]).join(tiles, "tenant").select("tenant", _place("src").alias("part"), F.lit(0).cast("long").alias("salt"), "src", "dst", "v")
        sums = _summed(_rows(asked, scored, pieces, pieces.select("tenant", "part", "salt").distinct()), layer, weights.temperature, eta, kind)
        sums = sums.join(tiles, "tenant").select("tenant", "block", _place("dst").alias("part"), F.lit(0).cast("long").alias("salt"), F.lit(SUMMED).alias("kind"), F.col("dst").alias("a"), F.lit(0).cast("long").alias("b"), F.col("m").alias("v"))
        rows = rows.unionByName(sums)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        b = _Block(group, layer, weights.temperature, eta)
        mine = b.kinds[OWN].sort_values("a")
        ids, n = mine["a"].to_numpy(np.int64), len(b.q)
        p = b.p(_stacked(mine["v"], n))
        at = np.searchsorted(ids, b.targets)
        hot_at = np.searchsorted(ids, b.kinds[SUMMED]["a"].to_numpy(np.int64))
        hot_m = _stacked(b.kinds[SUMMED]["v"], n * layer.dim).reshape(-1, n, layer.dim)
        out = np.zeros((len(ids), n))
        for low in range(0, n, tiling.slots):
            high = min(low + tiling.slots, n)
            q = b.q[low:high]
            m = np.zeros((len(ids), high - low, layer.dim))
            m[at] = b.heard(low, high)
            m[hot_at] = hot_m[:, low:high]
            m *= q @ layer.w_msg.T
            h = (p[:, low:high] ** eta)[:, :, None] * q + np.where(m >= 0, m, layer.slope * m)
            h -= h.mean(2, keepdims=True)
            h /= np.sqrt((h * h).mean(2, keepdims=True) + 1e-5)
            l1 = np.abs(h).sum(2)
            out[:, low:high] = 0.5 * p[:, low:high] + 0.5 * l1 / (l1 + 1)
        return pd.DataFrame({"tenant": [group["tenant"].iloc[0]] * len(ids), "block": group["block"].iloc[0], "entity_id": ids, "s": list(out)})

    return rows.groupBy(*PART).applyInPandas(run, f"tenant {kind}, block long, entity_id long, s array<double>"), asked


def _bounds(scores: DataFrame, bridge: DataFrame, tiling: Tiling) -> DataFrame:
    """``(tenant, doc_id, bound)``: what no score of a document exceeds, for any query.

    Entities of the highest scores count with their own, all others with the highest among them.
    """
    tenants = scores.select("tenant").distinct().count()
    most = tiling.heavy // max(tenants, 1)
    few = F.broadcast if tenants <= tiling.heavy else lambda df: df  # a row a tenant, and ``heavy`` ones
    highest = scores.select("tenant", "entity_id", F.array_max("s").alias("u")).groupBy("tenant", "entity_id").agg(F.max("u").alias("u"))
    ranked = highest.withColumn("r", F.row_number().over(W.partitionBy("tenant").orderBy(F.desc("u"), "entity_id"))).where(F.col("r") <= most + 1)
    ranked = cut(ranked)
    heavy, rest = ranked.where(F.col("r") <= most).drop("r"), ranked.where(F.col("r") == most + 1).select("tenant", F.col("u").alias("rest"))
    both = bridge.join(few(heavy), ["tenant", "entity_id"], "left").join(few(rest), "tenant", "left")
    return both.groupBy("tenant", "doc_id").agg(F.sum(F.coalesce("u", "rest", F.lit(0.0))).alias("bound"))


def _able(scores: DataFrame, asked: DataFrame, bridge: DataFrame, k: int, tiling: Tiling) -> DataFrame:
    """The rows of the bridge whose document can be among the best ``k`` of a query, at least those."""
    bounds = cut(_bounds(scores, bridge, tiling))
    order = F.row_number().over(W.partitionBy("tenant").orderBy(F.desc("bound"), "doc_id"))
    first = cut(bounds.withColumn("r", order).where(F.col("r") <= max(tiling.first, k)).select("tenant", "doc_id"))
    found = _best(scores, asked, cut(bridge.join(F.broadcast(first) if first.count() <= tiling.listed else first, ["tenant", "doc_id"], "left_semi")), k, tiling)
    rank = F.row_number().over(W.partitionBy("tenant", "block", "slot").orderBy(F.desc("score"), "doc_id"))
    least = found.withColumn("r", rank).where(F.col("r") == k).select("tenant", "block", "slot", "score")
    least = asked.select("tenant", "block", "slot").join(least, ["tenant", "block", "slot"], "left")
    least = least.groupBy("tenant").agg(F.min(F.coalesce("score", F.lit(float("-inf")))).alias("least"))
    able = cut(bounds.join(least, "tenant").where(F.col("bound") >= F.col("least") - 2e-6).select("tenant", "doc_id"))  # scores are rounded
    n = able.count()
    if 2 * n >= bounds.count():
        return bridge
    return cut(bridge.join(F.broadcast(able) if n <= tiling.listed else able, ["tenant", "doc_id"], "left_semi"))


def document_scores(scores: DataFrame, asked: DataFrame, entity_docs: DataFrame, k: int, tiling: Tiling) -> DataFrame:
    """``(tenant, query_id, doc_id, score)``: sums over a document's entities, the best ``k`` a query at least."""
    k = max(k, 1)
    scores, bridge = cut(scores), entity_docs.select("tenant", "entity_id", "doc_id")
    best = _best(scores, asked, _able(scores, asked, bridge, k, tiling), k, tiling)
    return best.join(asked.select("tenant", "block", "slot", "query_id"), ["tenant", "block", "slot"]).select("tenant", "query_id", "doc_id", "score")


def _best(scores: DataFrame, asked: DataFrame, bridge: DataFrame, k: int, tiling: Tiling) -> DataFrame:
    """``(tenant, block, slot, doc_id, score)``: sums over the entities of a document, of each part of the documents the best ``k``."""
    kind = bridge.schema["doc_id"].dataType.simpleString()
    bridge = bridge.join(_parts(bridge, tiling.edges), "tenant").select("tenant", _place("doc_id").alias("part"), "entity_id", "doc_id")
    wanted = bridge.select("tenant", "part", "entity_id").distinct()
    right = _fresh(wanted.join(scores, ["tenant", "entity_id"])).select("tenant", "block", "part", "entity_id", "s")
    left = bridge.join(asked.select("tenant", "block").distinct(), "tenant")

    def run(pairs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("entity_id")
        ids, s = known["entity_id"].to_numpy(np.int64), _stacked(known["s"])
        names, doc = np.unique(pairs["doc_id"].to_numpy(), return_inverse=True)
        entity = pairs["entity_id"].to_numpy(np.int64)
        at = np.searchsorted(ids, entity)
        ok = (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == entity) if len(ids) else np.zeros(len(entity), bool)
        at, doc = at[ok], doc[ok]
        if not len(at):
            return pd.DataFrame({n: [] for n in ("tenant", "block", "slot", "doc_id", "score")})
        order = np.lexsort((entity[ok], doc))
        at, doc = at[order], doc[order]
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        codes, out = doc[starts], []
        for slot in range(s.shape[1]):
            total = np.round(np.add.reduceat(s[at, slot], starts), 6)
            best = best_places(total, codes, k)
            out.append(pd.DataFrame({"slot": slot, "doc_id": names[codes[best]], "score": total[best]}))
        found = pd.concat(out)
        found["block"], found["tenant"] = pairs["block"].iloc[0], [pairs["tenant"].iloc[0]] * len(found)
        return found[["tenant", "block", "slot", "doc_id", "score"]]

    by = ["tenant", "block", "part"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(run, f"tenant {scores.schema['tenant'].dataType.simpleString()}, block long, slot int, doc_id {kind}, score double")
