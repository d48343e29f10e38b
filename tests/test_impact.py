"""Top documents by upper bounds against a plain ranking."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import address


def plain(pairs, found, background, k):
    docs = {}
    for e, d in pairs:
        docs.setdefault(d, set()).add(e)
    out = []
    for q, rest in background.items():
        scores = sorted((-round(sum(found.get((q, e), rest) for e in es), 9), d) for d, es in docs.items())
        out += [(q, d, -s, r + 1) for r, (s, d) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("head", [1, 4, 512])
def test_best_stops_early_and_is_exact(monkeypatch, head):
    monkeypatch.setattr(address, "HEAD", head)
    rng = np.random.default_rng(head)
    stopped = 0
    for trial in range(60):
        n = int(rng.integers(1, 80))
        docs = [sorted(set(rng.integers(0, 30, rng.integers(1, 3 if trial % 2 else 25)).tolist())) for _ in range(n)]
        docs[0] = list(range(30))
        pairs = [(e, d) for d, es in enumerate(docs) for e in es]
        block = address.ImpactBlock(np.array([e for e, _ in pairs]), np.array([d for _, d in pairs]), np.arange(n))
        entities = rng.choice(35, rng.integers(0, 12), replace=False)
        weights = rng.integers(0, 4, len(entities)) / 7  # ties, and entities without mass
        k = int(rng.integers(1, 6))
        places, scores, looked = block.best(entities.astype(np.int64), weights, 0.01, k)
        got = [(0, int(block.codes[p]), float(s), r + 1) for r, (p, s) in enumerate(zip(places, scores, strict=True))]
        assert sorted(got) == plain(pairs, {(0, int(e)): float(w) for e, w in zip(entities, weights, strict=True)}, {0: 0.01}, k)
        stopped += looked < n
    assert stopped or head == 512


def test_score_documents(spark, monkeypatch):
    monkeypatch.setattr(address, "BLOCK_ROWS", 40)
    monkeypatch.setattr(address, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(3)
    pairs = sorted({(int(e), int(d)) for e, d in zip(rng.integers(0, 40, 400), rng.integers(0, 60, 400), strict=True)} | {(99, d) for d in range(60)})
    found = {(q, int(e)): float(rng.integers(0, 5)) / 8 for q in range(8) for e in rng.choice(41, 6, replace=False)}
    found |= {(q, 99): 0.5 for q in range(4)}  # an entity of all documents
    background = {q: 0.003 for q in range(9)}
    bridge = spark.createDataFrame([(0, e, d) for e, d in pairs] + [(1, 5, 1000)], "tenant long, entity_id long, doc_id long")
    hits = spark.createDataFrame([(0, q, e, 1.0, p) for (q, e), p in found.items()] + [(1, 0, 5, 1.0, 0.9)], "tenant long, query_id long, entity_id long, raw double, p double")
    rest = spark.createDataFrame([(0, q, b) for q, b in background.items()] + [(1, 0, 0.1)], "tenant long, query_id long, background double")
    for k in (1, 4, 100):
        got = address.score_documents(hits, rest, bridge, k)
        assert sorted(tuple(r)[1:] for r in got.where("tenant = 0").collect()) == plain(pairs, found, background, k)
        assert [tuple(r) for r in got.where("tenant = 1").collect()] == [(1, 0, 1000, 0.9, 1)]
    # no row of a query, an entity and a document: what leaves the blocks is k rows a query and block
    blocks = F.countDistinct("doc_id")
    assert address.score_documents(hits, rest, bridge, 1).agg(blocks).first()[0] <= 10
    # ids of 64 bits without a sign
    wide = bridge.withColumn("doc_id", (F.col("doc_id") + F.lit(2**63 - 5000).cast("decimal(20,0)") * 2).cast("decimal(20,0)"))
    assert address.score_documents(hits, rest, wide, 2).count() == 19
    assert address.score_documents(hits, rest, bridge.limit(0), 2).count() == 0
