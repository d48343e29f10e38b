"""The inverted-file index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import vector_index

QUERIES = "vec_id % 20 = 0"


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + rng.normal(size=24) * 0.5).tolist()) for i in range(3000)]
    rows += [(10_000 + i, [1.0] * 24) for i in range(50)]  # a group of copies
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def asked(v):
    return v.where(QUERIES).withColumnRenamed("vec_id", "query_id")


def test_best_places():
    rng = np.random.default_rng(2)
    for k in (0, 1, 3, 50, 80):
        scores, ids = rng.integers(0, 5, 60) / 4, rng.permutation(60)
        assert vectors.best_places(scores, ids, k).tolist() == np.lexsort((ids, -scores))[:k].tolist()


def test_index_recall_and_exactness(spark, clustered, monkeypatch, tmp_path):
    monkeypatch.setattr(vector_index, "PART", 64)
    monkeypatch.setattr(vector_index, "BLOCK", 40)
    index = vector_index.build(clustered, 32, str(tmp_path / "index"))
    assert index.cells.agg(F.sum("rows")).first()[0] == 3050
    truth = vectors.top_k(clustered, asked(clustered), 10)
    exact = vector_index.search(index, asked(clustered), 10, 32)
    assert sorted(map(tuple, exact.select("query_id", "vec_id", "rank").collect())) == sorted(map(tuple, truth.select("query_id", "vec_id", "rank").collect()))
    few = vector_index.search(index, asked(clustered), 10, 4)
    assert vector_index.recall(few, truth) >= 0.95
    assert vector_index.looked_at(index, asked(clustered), 4) < 0.3
    # the cells that are not asked for are not read
    one = clustered.where("vec_id = 20").withColumnRenamed("vec_id", "query_id")
    plan = vector_index.search(index, one, 10, 1)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "PushedFilters: [Or(" in plan
    # centroids spread: no cell but that of the copies is much larger than its share
    assert index.cells.orderBy(F.desc("rows")).first()["rows"] < 3050 / 4


def test_index_grows(spark, clustered, tmp_path):
    v = clustered.where("vec_id < 400")
    index = vector_index.build(v.where("vec_id % 3 > 0"), 4, str(tmp_path / "index"))
    index = vector_index.add(index, v.where("vec_id % 3 = 0"))
    got, want = vector_index.search(index, asked(v), 5, 4), vectors.top_k(v, asked(v), 5)
    assert sorted(map(tuple, got.select("query_id", "vec_id", "rank").collect())) == sorted(map(tuple, want.select("query_id", "vec_id", "rank").collect()))
    with pytest.raises(ValueError, match="written"):
        vector_index.add(vector_index.build(v, 2), v)


def test_index_odd(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, []), (80, [1.0]), (100, [2.0]), (120, [float("nan"), 1.0]), (140, [0.0, 3.0]), (140, [0.0, 3.0]), (160, [1.0, None])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build(v, 2)
    got = {(r.query_id, r.vec_id, r.cos) for r in vector_index.search(index, asked(v).dropDuplicates(["query_id"]), 9, 1).collect()}
    assert {(q, d) for q, d, c in got if q == 80} == {(80, 80), (80, 100)}
    assert {(d, c) for q, d, c in got if q == 20} == {(0, 0.0), (20, 0.0), (140, 0.0)}
    assert not {40, 60, 120, 160} & {x for q, d, _ in got for x in (q, d)}
    assert (0, 0, 1.0) in got and (0, 20, 0.0) in got
    empty = vector_index.build(v.limit(0), 3)
    assert vector_index.search(empty, asked(v), 3, 2).count() == 0
    with pytest.raises(ValueError, match="cells"):
        vector_index.build(v, 0)


def test_probed_recall_on_the_table(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = vector_index.build(v, 16)
    truth = vectors.top_k(v, asked(v), 10)
    found = [vector_index.recall(vector_index.search(index, asked(v), 10, p), truth) for p in (4, 8, 16)]
    assert found == sorted(found) and found[-1] == 1.0
    probes = vector_index.probes_for(index, asked(v), 10, 0.95)
    assert 8 < probes <= 16
    assert vector_index.recall(vector_index.search(index, asked(v), 10, probes - 1), truth) < 0.95 <= vector_index.recall(vector_index.search(index, asked(v), 10, probes), truth)
    assert vector_index.looked_at(index, asked(v), 8) < 0.8


def test_probes_are_counted_from_the_nearest_cell(spark):
    """Eight points, four copies each, a cell for each point: one probe finds all copies, whatever the cell's number."""
    rows = [(i, [float(i % 8 == d) for d in range(8)]) for i in range(32)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = vector_index.build(v, 8)
    queries = v.where("vec_id < 8").withColumnRenamed("vec_id", "query_id")
    assert vector_index.probes_for(index, queries, 4, 0.95) == 1
    assert vector_index.recall(vector_index.search(index, queries, 4, 1), vector_index.search(index, queries, 4, 8)) == 1.0
