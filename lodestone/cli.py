"""Command line: ``python -m lodestone.cli COMMAND``.  Every command prints JSON.

    demo                                      a small graph from built-in answers, and a query
    stats   --tables DIR                      entities and edges of the star schema's graph
    query   --tables DIR --k N TEXT           ranked documents of one query, its best entities, and its prompt
    list    --tables DIR --name PART --limit N
    ingest  --doc TEXT|- --response JSON --store DIR          one document (``-``: standard input)
    ingest-batch  --jsonl FILE --responses FILE --store DIR   documents and responses to a snapshot
    eval    --tables DIR --k N [--samples FILE]               metrics by tier, and over all
    evolve  --jsonl FILE --responses FILE --store DIR --samples FILE --k N   a batch that is kept if recall holds
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _measured, graph_of
from .operators import evaluate, store
from .operators.ingest import Ingested, answered, evolve, ingest_batch, single_document
from .plans import reader
from .sources.files import read_documents, read_samples


def batch(spark: SparkSession, jsonl: str, responses: str, graph: store.Graph | None = None, tenant: int = 0) -> Ingested:
    """Documents in JSON lines and a writer's responses ``{"doc_id", "response"}``, merged into a graph."""
    docs, bad_lines = read_documents(spark, jsonl)
    answers = spark.read.schema("doc_id decimal(20,0), response string").json(responses)
    return ingest_batch(docs, answered(answers), graph, tenant, bad_lines=bad_lines)


def summary(done: Ingested, tenant: int = 0) -> dict:
    """Totals with how many rows were lost at each stage."""
    stages = {r["stage"]: r["n"] for r in done.failures.groupBy("stage").agg(F.count("*").alias("n")).collect()}
    return {"tenant": tenant, **done.totals.first().asDict(), "failures": stages}


def sampled(graph: store.Graph, samples: DataFrame, k: int) -> DataFrame:
    """Metrics of each sample, read from the graph."""
    asked = samples.select(F.lit(0).cast("long").alias("tenant"), "query_id", F.col("query").alias("text"), F.coalesce("tier", F.lit(0)).alias("tier"))
    truth = samples.select("query_id", F.explode("ground_truth").alias("doc_id")).distinct()
    found = reader.read(asked, graph, k).select("query_id", "doc_id", "rank")
    return evaluate.metrics_from_rows(found, truth, asked.select("query_id", "tier"), k)


def show(df: DataFrame) -> None:
    for row in df.toJSON().toLocalIterator():
        print(row)


def demo(spark: SparkSession) -> Ingested:
    facts = {1: ("Alice", "founded", "Acme"), 2: ("Bob", "works_at", "Acme"), 3: ("Acme", "located_in", "Berlin")}
    rows = [(i, " ".join(f), json.dumps({"triples": [dict(zip(("src", "rel", "dst"), f, strict=True))]})) for i, f in facts.items()]
    given = spark.createDataFrame(rows, "doc_id long, text string, response string")
    return ingest_batch(given.select("doc_id", "text"), answered(given))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = parser.add_subparsers(dest="command", required=True)
    needs = {"demo": "", "stats": "tables", "query": "tables k text", "list": "tables name limit", "ingest": "doc response store", "ingest-batch": "jsonl responses store", "eval": "tables k samples", "evolve": "jsonl responses store samples k"}
    defaults = {"k": 3, "limit": 20, "name": "", "samples": None}
    for command, names in needs.items():
        p = sub.add_parser(command)
        for n in names.split():
            if n == "text":
                p.add_argument("text")
            else:
                optional = n in defaults and not (command == "evolve" and n == "samples")
                p.add_argument(f"--{n}", required=not optional, default=defaults.get(n), type=int if n in ("k", "limit") else str)
    a = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ask = lambda text: spark.createDataFrame([(0, 0, text)], "tenant long, query_id long, text string")
    if a.command == "demo":
        done = demo(spark)
        print(json.dumps(summary(done)))
        show(reader.read(ask("Who founded Acme?"), done.graph, 3))
    elif a.command == "ingest":
        doc = single_document(spark, sys.stdin.read() if a.doc == "-" else a.doc)
        done = ingest_batch(doc, answered(doc.select("doc_id", F.lit(a.response).alias("response"))))
        print(json.dumps(summary(done) | {"snapshot": store.Store(spark, a.store).snapshot(done.graph)}))
    elif a.command == "ingest-batch":
        done = batch(spark, a.jsonl, a.responses)
        print(json.dumps(summary(done) | {"snapshot": store.Store(spark, a.store).snapshot(done.graph)}))
        show(done.failures)
    elif a.command == "evolve":
        snapshots, samples = store.Store(spark, a.store), read_samples(spark, a.samples)
        recall = lambda g: evaluate.report(sampled(g, samples, a.k)).first()["recall"]
        print(json.dumps(evolve(snapshots, snapshots.restore(snapshots.last()), lambda g: batch(spark, a.jsonl, a.responses, g).graph, recall)[1]))
    elif a.command == "eval" and a.samples:
        show(evaluate.report_with_overall(sampled(graph_of(spark, a.tables), read_samples(spark, a.samples), a.k), "tier"))
    elif a.command == "eval":
        show(evaluate.report_with_overall(_measured(spark, a.tables), "tier"))
    else:
        graph = graph_of(spark, a.tables)
        if a.command == "stats":
            show(store.stats(graph))
        elif a.command == "list":
            show(store.listing_rows(graph.entities, graph.entity_docs, a.name, a.limit))
        else:
            found = reader.read(ask(a.text), graph, a.k)
            show(found)
            show(reader.entities(ask(a.text), graph, 10))
            show(reader.evidence(ask(a.text), found))


if __name__ == "__main__":
    main()
