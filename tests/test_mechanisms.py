"""Keyed state, table functions and observed counters, each against the plain batch result."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import extract, ingest, store
from lodestone.sources import files
from lodestone.streaming.ingest import StatefulGraph

SCHEMA = "tenant long, doc_id long, triple_idx int, src string, rel string, dst string"
RESPONSES = [
    '{"triples": [{"src": " Ann ", "rel": "knows", "dst": "Bob", "src_type": "Person"}, {"src": "Bob", "rel": "uses", "dst": "X!"}], "stop": true}',
    '{"triples": []}', '{"triples": [{"src": "Ann", "rel": "knows"}]}', '{"triples": [{"src": null, "rel": "a", "dst": "b"}]}', "no json", '{"other": 1}', None, "",
    '{"triples": [' + ", ".join(f'{{"src": "S{i}", "rel": "next", "dst": "S{i + 1}"}}' for i in range(70)) + "]}",
]


@pytest.fixture
def answers(spark):
    return spark.createDataFrame(list(enumerate(RESPONSES)), "doc_id long, response string")


def batches_of(spark, path, rows, n):
    for i in range(n):
        spark.createDataFrame(rows[i::n], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_state_equals_batch_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(d % 2, d, i, rng.choice(["Ann", "ANN", "ann", "Bob"]), "knows", f"N{rng.randrange(6)}") for d in range(30) for i in range(2)] + [(0, 99, 0, "bad!", "knows", "Ann")]
    rng.shuffle(rows)
    batches_of(spark, str(tmp_path / "in"), rows[:40], 3)
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    graph = StatefulGraph(spark, str(tmp_path / "out"))
    graph.start(read(), str(tmp_path / "check")).awaitTermination()
    first = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").iterdir()}
    batches_of(spark, str(tmp_path / "in"), rows[40:], 2)
    again = StatefulGraph(spark, str(tmp_path / "out"))  # as after a restart: state comes from the checkpoint
    again.start(read(), str(tmp_path / "check")).awaitTermination()
    later = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").iterdir()}
    assert first.items() <= later.items() and len(later) > len(first)  # no earlier batch was touched
    clean = extract.sanitize(spark.createDataFrame(rows, SCHEMA)).where("reject_reason is null").drop("reject_reason")
    whole = store.ingest(clean)
    mentions = extract.mentions(clean).groupBy("tenant", "entity_id").agg(F.count("*").alias("n_mentions"), F.countDistinct("doc_id").alias("n_docs"))
    want = whole.entities.join(mentions, ["tenant", "entity_id"])
    columns = ["tenant", "entity_id", "name", "etype", "n_mentions", "n_docs"]
    assert sorted(map(tuple, again.entities().select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    pairs = sorted(map(tuple, again.entity_docs().collect()))
    assert pairs == sorted(map(tuple, whole.entity_docs.collect()))


def test_table_function_equals_parser(spark, answers):
    good, bad = files.parse_envelopes(answers)
    name = ingest.register(spark)
    answers.createOrReplaceTempView("answers_of_a_writer")
    rows = spark.sql(f"SELECT doc_id, t.* FROM answers_of_a_writer, LATERAL {name}(response) t")
    columns = ["doc_id", "triple_idx", "src", "rel", "dst", "src_type", "dst_type"]
    assert sorted(map(str, rows.where("error is null").select(columns).collect())) == sorted(map(str, good.select(columns).collect()))
    assert sorted(r.doc_id for r in rows.where("error is not null").collect()) == sorted(r.doc_id for r in bad.collect())


def test_ingest_takes_a_table_function(spark, answers):
    docs = answers.select("doc_id", F.lit("text").alias("text"))
    plain = ingest.ingest_batch(docs, ingest.answered(answers), blocklist=["S7"])
    writer = ingest.lateral(ingest.EnvelopeTriples, ingest.answered(answers), "response")
    by_function = ingest.ingest_batch(docs, writer, blocklist=["S7"])
    assert plain.totals.first() == by_function.totals.first()
    for part in ("entities", "edges", "entity_docs"):
        assert sorted(map(str, getattr(plain.graph, part).collect())) == sorted(map(str, getattr(by_function.graph, part).collect()))
    key = lambda d: sorted(map(tuple, d.failures.select("doc_id", "stage", "error").collect()))
    assert key(plain) == key(by_function)
    assert plain.totals.first().asDict() == {"docs_seen": 9, "docs_ingested": 3, "entities_added": plain.graph.entities.count(), "edges_added": plain.graph.edges.count(), "triples_skipped": 3}


def test_counters_cost_no_pass_of_their_own(spark, answers, tmp_path):
    """The responses are read once: they may be gone when the totals are asked for."""
    path = tmp_path / "answers"
    answers.write.parquet(str(path))
    calls = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            calls.add(batch.num_rows)
            yield batch

    counted = spark.read.schema(answers.schema).parquet(str(path)).mapInArrow(count, answers.schema)
    docs = answers.select("doc_id", F.lit("text").alias("text"))
    done = ingest.ingest_batch(docs, lambda d: d.drop("text").join(counted, "doc_id", "left"))
    assert calls.value == len(RESPONSES)
    assert done.totals.first().docs_seen == 9 and done.failures.count() == 6
    assert calls.value == len(RESPONSES)
    empty = ingest.ingest_batch(docs.limit(0), ingest.answered(answers))
    assert tuple(empty.totals.first()) == (0, 0, 0, 0, 0)
