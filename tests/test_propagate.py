"""Propagation by tiles and blocks against the dense form."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import address, gnn
from lodestone.operators.propagate import Tiling
from lodestone.operators.store import Graph
from lodestone.plans import planner, reader

LAYER = gnn.Layer.seeded(8, gate=3, seed=5)
ENTITIES = "tenant long, entity_id long, name string, etype string"
EDGES = "tenant long, src long, dst long"
BRIDGE = "tenant long, entity_id long, doc_id long"
QUERIES = "tenant long, query_id long, text string"
FAR = 2**59 + 1  # ids that a double cannot tell apart


def graph(spark, seed, n=40, tenants=2):
    rng = np.random.default_rng(seed)
    words = "red green blue iron steel oak pine river lake hill".split()
    entities, edges, bridge = [], [], []
    for t in range(tenants):
        for e in range(n):
            entities.append((t, e + 1, " ".join(rng.choice(words, rng.integers(1, 3), replace=False)), "concept"))
        ends = rng.integers(1, n + 1, (3 * n, 2))
        edges += [(t, int(a), int(b)) for a, b in ends if a != b]
        edges += [(t, e, 1) for e in range(2, n + 1)]  # a target of all
        edges += [(t, 1, 999), (t, 998, 2), (t, 2, 3), (t, 2, 3)]  # ends that are no entities, parallel ones
        bridge += sorted({(t, int(e), int(d)) for e, d in zip(rng.integers(1, n + 1, 4 * n), rng.integers(0, 25, 4 * n), strict=True)}) + [(t, 997, 24)]
    queries = [(t, 100 * t + i, " ".join(rng.choice(words, 2, replace=False))) for t in range(tenants) for i in range(7)]
    queries += [(0, 50, ""), (0, 51, "nothing known"), (9, 900, "red iron")]
    entities, bridge = [(t, FAR + e, *x) for t, e, *x in entities], [(t, FAR + e, d) for t, e, d in bridge]
    edges = [(t, FAR + a, FAR + b) for t, a, b in edges]
    tables = spark.createDataFrame(entities, ENTITIES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(bridge, BRIDGE)
    return Graph(*tables), spark.createDataFrame(queries, QUERIES)


def dense(spark, g, queries, k, eta=0.5, weights=address.Weights()):
    """All entities for all queries, one after the other."""
    dim = LAYER.dim
    embedded = lambda df, key, text: {(r["tenant"], r[key]): np.array(r["e"]) for r in vectors.embedding_arrays(df, ["tenant", key], text, dim).collect()}
    names, asked = embedded(g.entities, "entity_id", "name"), embedded(queries, "query_id", "text")
    plans = planner.heuristic_plan(queries)
    matched = {(r["tenant"], r["query_id"], r["entity_id"]): r["raw"] for r in address.match_scores(plans, g.entities).collect()}
    merged = g.edges.groupBy("tenant", "src", "dst").agg(F.count("*").alias("times"))
    merged = merged.join(g.entities.select("tenant", F.col("entity_id").alias("dst")), ["tenant", "dst"], "left_semi")
    links = [r.asDict() for r in gnn.edge_features(merged, g.entities.count(), ["tenant"], "times").collect()]
    bridge = [tuple(r) for r in g.entity_docs.collect()]
    out = []
    for (t, q), v in asked.items():
        ids = sorted(e for tenant, e in names if tenant == t)
        raw = np.array([matched.get((t, q, e), 0.0) + weights.cos * max(0.0, float(names[t, e] @ v) / max(np.linalg.norm(names[t, e]) * np.linalg.norm(v), 1e-12)) for e in ids])
        if not ids:
            continue
        p = np.exp((raw - raw.max()) / weights.temperature)
        p /= p.sum()
        at = {e: i for i, e in enumerate(ids)}
        start = (p**eta)[:, None] * v
        m = np.zeros_like(start)
        for x in links:
            if x["tenant"] == t and x["src"] in at:
                gate = 1.0 + LAYER.delta * np.tanh(LAYER.w_g2 @ np.tanh(LAYER.w_g1 @ np.array(x["z"])))
                m[at[x["dst"]]] += x["times"] * gate * (LAYER.w_msg @ start[at[x["src"]]])
        h = start + np.where(m >= 0, m, LAYER.slope * m)
        h = (h - h.mean(1, keepdims=True)) / np.sqrt(h.var(1, keepdims=True) + 1e-5)
        l1 = np.abs(h).sum(1)
        s = 0.5 * p + 0.5 * l1 / (l1 + 1)
        docs = {}
        for tenant, e, d in bridge:
            if tenant == t and e in at:
                docs[d] = docs.get(d, 0.0) + s[at[e]]
        ranked = sorted((-round(x, 6), d) for d, x in docs.items())[:k]
        out += [(t, q, d, -x, i + 1) for i, (x, d) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("tiling", [Tiling(), Tiling(rows=9, edges=20, hot=10, block=3, slots=2)], ids=["one", "many"])
def test_tiles_and_blocks_give_the_dense_result(spark, tiling):
    g, queries = graph(spark, 3)
    got = sorted(tuple(r) for r in reader.propagated(queries, g, LAYER, k=5, tiling=tiling).collect())
    want = dense(spark, g, queries, 5)
    assert [x[:3] + x[4:] for x in got] == [x[:3] + x[4:] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=2e-6)
    assert {x[1] for x in got} >= {50, 51} and 900 not in {x[1] for x in got}


def test_no_queries_no_edges_no_entities(spark):
    g, queries = graph(spark, 4, n=6, tenants=1)
    assert reader.propagated(queries.where("false"), g, LAYER).collect() == []
    empty = Graph(g.entities.where("false"), g.edges, g.entity_docs)
    assert reader.propagated(queries, empty, LAYER).collect() == []
    lonely = Graph(g.entities, g.edges.where("false"), g.entity_docs)
    got = sorted(tuple(r) for r in reader.propagated(queries, lonely, LAYER, k=3).collect())
    assert [x[:3] for x in got] == [x[:3] for x in dense(spark, lonely, queries, 3)]


def test_rows_do_not_grow_with_queries(spark, monkeypatch):
    """Entities are rows once a block, however many queries it has."""
    from lodestone.operators import propagate

    seen = []
    real = propagate.cut
    monkeypatch.setattr(propagate, "cut", lambda df, *a: seen.append(real(df, *a)) or seen[-1])
    g, queries = graph(spark, 5, n=12, tenants=1)
    for many in (1, 7):
        seen.clear()
        reader.propagated(queries.where(F.col("query_id") < many), g, LAYER).collect()
        scored = next(df for df in seen if "mass" in df.columns and "entity_id" in df.columns)
        assert scored.where("kind = 0").count() == 12


def shuffled(spark):
    """Bytes that shuffles have written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.mark.parametrize("case", ["sizes differ", "all alike", "fewer than k"])
def test_documents_that_cannot_rank_are_not_summed(spark, case):
    """Scores meet only the documents whose bound reaches what others have; the best are those of all sums."""
    from lodestone.operators import propagate

    rng = np.random.default_rng(7)
    n, slots, k, docs = 1500, 96, 5, 4 if case == "fewer than k" else 2500
    s = rng.uniform(0.38, 0.42, (n, slots)) if case != "all alike" else np.full((n, slots), 0.25)
    s[rng.integers(0, n, 300), rng.integers(0, slots, 300)] += 0.5  # matches
    sizes = rng.integers(2, 7, docs) if case == "sizes differ" else np.full(docs, 4)
    if case == "sizes differ":
        sizes[::100] = 60
    names = [rng.choice(n, m, replace=False) for m in sizes]
    scores = spark.createDataFrame([(0, 0, i, s[i].tolist()) for i in range(n)], "tenant long, block long, entity_id long, s array<double>")
    asked = spark.createDataFrame([(0, 0, i, 100 + i, [0.0]) for i in range(slots)], "tenant long, block long, slot int, query_id long, v array<double>")
    bridge = spark.createDataFrame([(0, int(e), d) for d, es in enumerate(names) for e in es] + [(0, n + 5, 1)], BRIDGE)
    tiling = Tiling(edges=1000, first=30, heavy=200)
    before = shuffled(spark)
    out = propagate.document_scores(scores, asked, bridge, k, tiling).collect()
    moved = shuffled(spark) - before
    best = {}
    for r in out:
        best.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    sums = np.round(np.array([s[es].sum(0) for es in names]), 6)
    for q in range(slots):
        want = sorted((-x, d) for d, x in enumerate(sums[:, q]))[:k]
        got = sorted(best[100 + q])[:k]
        assert [d for _, d in got] == [d for _, d in want] and np.allclose([x for x, _ in got], [x for x, _ in want], atol=1e-6)
    if case == "sizes differ":
        assert moved < 3_000_000  # the scores of a document's part alone are 1 MB
