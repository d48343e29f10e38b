"""A growing store against one merge; ids of 64 bits."""

import os
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import ids
from lodestone.operators import increments, store
from lodestone.sources import files

SCHEMA = "tenant long, doc_id long, triple_idx int, src string, rel string, dst string"
FIRST = [(0, 1, 0, "Ann", "knows", "Bob"), (0, 1, 1, "Ann", "knows", "Bob"), (1, 1, 0, "ann", "knows", "Eve"), (0, 2, 0, "Bob", "knows", "Cid")]
SECOND = [(0, 3, 0, "ANN", "uses", "Dan"), (0, 3, 1, "cid", "knows", "Ann"), (1, 4, 0, "Zoe", "knows", "EVE")]


def rows(graph):
    return tuple(sorted(map(tuple, getattr(graph, k).select(*c).collect())) for k, c in (("entities", ["tenant", "entity_id", "name", "etype"]), ("edges", ["tenant", "src", "seq", "dst", "relation", "provenance"]), ("entity_docs", ["tenant", "entity_id", "doc_id"])))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_equal_one(spark, tmp_path, request):
    one, two = (spark.createDataFrame(r, SCHEMA) for r in (FIRST, SECOND))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    growing = increments.GrowingStore(spark, str(tmp_path / "g"), 8)
    with pytest.raises(KeyError):
        growing.graph()
    assert growing.append(one) == 1
    # the files of the first batch stay as they are
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "tables").rglob("*.parquet")}
    assert growing.append(two) == 2
    assert before.items() <= {p: p.stat().st_mtime_ns for p in (tmp_path / "g" / "tables").rglob("*.parquet")}.items()
    whole = store.ingest(one.unionByName(two))
    assert rows(growing.graph()) == rows(whole) == rows(store.ingest(two, store.ingest(one)))
    assert rows(growing.graph(1)) == rows(store.ingest(one))
    # the base is joined in its buckets: it is sorted at most, not shuffled
    g = growing.graph()
    for df in (g.entities, g.entity_docs):
        steps = plan(df).split("\n")
        at = next(i for i, x in enumerate(steps) if "Bucketed: true" in x)
        depth = re.search(r"[+:]- ", steps[at]).start()
        above = []
        for x in reversed(steps[:at]):
            found = re.search(r"[+:]- ", x)
            if found and found.start() < depth:
                depth = found.start()
                above.append(x)
        assert any("Join" in x for x in above) and not any("Exchange" in x for x in above[: next(i for i, x in enumerate(above) if "Join" in x)])
    # a reader that opens the store anew has its buckets
    again = increments.GrowingStore(spark, str(tmp_path / "g"), 99)
    assert again.buckets == 8 and again.versions() == [1, 2] and rows(again.graph()) == rows(whole)


def test_compaction_keeps_the_graph(spark, tmp_path):
    growing = increments.GrowingStore(spark, str(tmp_path / "g"), 2)
    every = FIRST + SECOND
    for r in every:
        growing.append(spark.createDataFrame([r], SCHEMA), most_deltas=3)
    whole = store.ingest(spark.createDataFrame(every, SCHEMA))
    assert rows(growing.graph()) == rows(whole)
    assert len(growing._listed()[1]["batches"]) <= 4 < len(growing.versions())
    last = growing.compact()
    assert len(growing._listed()[1]["batches"]) == 1 and rows(growing.graph()) == rows(whole)
    gone = growing.vacuum()
    assert gone and growing.versions() == [last] and rows(growing.graph()) == rows(whole)
    with pytest.raises(KeyError):
        growing.graph(1)


def test_writers_that_meet(spark, tmp_path):
    """A version that another writer took is not written over, and loses no batch."""
    a, b = (increments.GrowingStore(spark, str(tmp_path / "g"), 2) for _ in range(2))
    one, two = (spark.createDataFrame(r, SCHEMA) for r in (FIRST, SECOND))
    seen = []

    def late(batches):
        if not seen:
            seen.append(b.append(two))  # between reading the last version and writing the next
        return [*batches, batch]

    batch = a._write(store.ingest(one))
    assert a._commit(late) == 2 and seen == [1]
    assert len(a._listed()[1]["batches"]) == 2


def test_ids_of_64_bits(spark, tmp_path):
    named = spark.range(40).select(ids.document_key(F.col("id").cast("string")).alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    named.write.json(str(tmp_path / "docs"))
    docs, bad = files.read_documents(spark, str(tmp_path / "docs"))
    assert bad.count() == 0 and docs.count() == 40
    assert docs.join(named, ["doc_id", "text"]).count() == 40 and docs.agg(F.max("doc_id")).first()[0] > 2**63
    (tmp_path / "more").write_text("\n".join(f'{{"doc_id": {n}, "text": "x"}}' for n in (0, 2**64 - 1, 2**64, -1, 1.5, '"7"', "null", 3.0)))
    good, bad = files.read_documents(spark, str(tmp_path / "more"))
    assert {r.doc_id for r in good.collect()} == {0, 2**64 - 1, 3}
    assert {r.line for r in bad.collect()} == {3, 4, 5, 6, 7}
    # the store takes them: first mentions, edges in order, numbers without gaps, a restart from a snapshot
    big = [(0, Decimal(2**64 - 1), 0, "Ann", "knows", "Bob"), (0, Decimal(2**63), 1, "ANN", "knows", "Cid"), (0, Decimal(2**63), 0, "ann", "uses", "Cid")]
    triples = spark.createDataFrame(big, SCHEMA.replace("doc_id long", "doc_id decimal(20,0)"))
    graph = store.ingest(triples)
    assert {r.name for r in graph.entities.collect()} == {"ann", "Bob", "Cid"}
    assert [r.relation for r in store.resequenced(graph.edges).orderBy("seq").collect()] == ["uses", "knows", "knows"]
    snapshots = store.Store(spark, str(tmp_path / "snap"))
    back = snapshots.restore(snapshots.snapshot(graph))
    assert sorted(r.doc_id for r in back.entity_docs.collect())[-1] == 2**64 - 1
    assert snapshots.last() == 1 and snapshots.snapshot(graph) == 2 == snapshots.last()
    growing = increments.GrowingStore(spark, str(tmp_path / "grow"), 2)
    growing.append(triples.where("triple_idx = 0"))
    growing.append(triples.where("triple_idx = 1"))
    assert growing.graph().edges.count() == 3


def test_cli_batch_with_large_ids(spark, tmp_path):
    n = 2**64 - 5
    (tmp_path / "d.jsonl").write_text(f'{{"doc_id": {n}, "text": "a"}}\n')
    (tmp_path / "r.jsonl").write_text(f'{{"doc_id": {n}, "response": "{{\\"triples\\": [{{\\"src\\": \\"Ann\\", \\"rel\\": \\"knows\\", \\"dst\\": \\"Bob\\"}}]}}"}}\n')
    (tmp_path / "s.json").write_text(f'[{{"query": "ann", "ground_truth": [{n}]}}]')
    done = cli.batch(spark, str(tmp_path / "d.jsonl"), str(tmp_path / "r.jsonl"))
    assert done.totals.first().docs_ingested == 1
    assert cli.sampled(done.graph, files.read_samples(spark, str(tmp_path / "s.json")), 1).first().recall == 1.0


def test_buckets_in_passes_and_one_delta_without_shuffles(spark, tmp_path, monkeypatch, request):
    """A large batch is dealt into some buckets at a time, each still one file; pairs of one delta meet the base where they are."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    monkeypatch.setattr(increments, "PASS_ROWS", 9)
    many = lambda low, high: spark.range(low, high).selectExpr("0L tenant", "id % 40 doc_id", "int(id) triple_idx", "concat('n', id % 23) src", "'knows' rel", "concat('N', id % 31) dst")
    one, two = many(0, 60), many(50, 140)
    growing = increments.GrowingStore(spark, str(tmp_path / "g"), 8)
    growing.append(one)
    growing.add(store.ingest(two))
    tables = tmp_path / "g" / "tables"
    assert sorted(p.name for p in next(tables.iterdir()).iterdir()) == ["edges", "entities", "entity_docs"]
    for kind in ("entities", "entity_docs"):
        for batch in tables.iterdir():
            found = [int(re.search(r"_(\d{5})\.", p.name)[1]) for p in (batch / kind).glob("*.parquet")]
            assert len(found) == len(set(found)) and set(found) <= set(range(8))
    g = growing.graph()
    both = store.ingest(two, store.ingest(one))
    assert rows(g) == rows(both)
    assert "Exchange" not in plan(g.entity_docs)
    # a third batch: deltas are gathered
    growing.append(many(100, 170))
    assert rows(growing.graph()) == rows(store.ingest(many(100, 170), both))


def test_a_batch_leaves_no_shuffle_files(spark, tmp_path):
    def shuffled():
        where = spark.sparkContext.getConf().get("spark.local.dir")
        return {f for _, _, fs in os.walk(where) for f in fs if f.startswith("shuffle_")}

    triples = spark.createDataFrame(FIRST * 50, SCHEMA).repartition(3)
    before = shuffled()
    increments.GrowingStore(spark, str(tmp_path / "g"), 4).append(triples)
    assert shuffled() <= before
