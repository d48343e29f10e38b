"""Ingest as one job: documents, a writer's responses, clean triples, the graph, totals and failures by stage."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..shared import cut
from ..sources import files
from . import extract, store

#: A writer: documents in, the same rows with a ``response`` out (null: the writer failed); or triples, as ``lateral`` makes them.
Policy = Callable[[DataFrame], DataFrame]


@dataclass
class Ingested:
    """What an ingest made: the grown graph, one row of totals, and ``(doc_id, stage, error)`` of failures."""

    graph: store.Graph
    totals: DataFrame
    failures: DataFrame


def single_document(spark: SparkSession, text: str, doc_id: int = 0) -> DataFrame:
    """One document; a blank text is an error."""
    if not text.strip():
        raise ValueError("the document is blank")
    return spark.createDataFrame([(doc_id, text)], "doc_id long, text string")


def answered(responses: DataFrame) -> Policy:
    """A policy that takes ``(doc_id, response)`` from a table, such as a model's answers made elsewhere."""
    return lambda docs: docs.join(responses.select("doc_id", "response"), "doc_id", "left")


#: What a table function that writes gives for a document: its triples, or one row with an error.
WRITTEN = "triple_idx int, src string, rel string, dst string, src_type string, dst_type string, error string"
#: Fixed value: raw triples of a response at most.
CAP = 64


class EnvelopeTriples:
    """A table function from a response to its triples; rows equal those of ``files.parse_envelopes``."""

    def eval(self, response: str) -> Iterator[tuple]:
        try:
            triples = None if response is None else json.loads(response)["triples"]
            rows = [tuple(t[k] if t[k] is None or isinstance(t[k], str) else json.dumps(t[k]) for k in ("src", "rel", "dst")) + (t.get("src_type"), t.get("dst_type")) for t in triples or ()]
            whole = triples is not None and all(x is not None for r in rows for x in r[:3])
        except (ValueError, KeyError, TypeError, AttributeError):
            whole = False
        if not whole:
            yield (None,) * 6 + ("no response" if response is None else "not an envelope",)
            return
        for n, r in enumerate(rows[:CAP]):
            yield (n, *(re.sub(r"^\s+|\s+\Z", "", x) for x in r[:3]), *r[3:], None)


def register(spark: SparkSession, name: str = "envelope_triples") -> str:
    """Let SQL call ``EnvelopeTriples``: ``SELECT doc_id, t.* FROM answers, LATERAL envelope_triples(response) t``."""
    spark.udtf.register(name, F.udtf(EnvelopeTriples, returnType=WRITTEN))
    return name


def lateral(writer: type, source: Callable[[DataFrame], DataFrame], column: str) -> Policy:
    """A policy that calls a table function for every row of ``source(docs)``, on its ``column``.

    ``writer`` is a class like ``EnvelopeTriples``; a document for which it gives no row has an envelope without triples.
    """
    function = F.udtf(writer, returnType=WRITTEN)

    def run(docs: DataFrame) -> DataFrame:
        rows = source(docs).select("tenant", "doc_id", column)
        return rows.lateralJoin(function(F.col(column).outer())).drop(column)

    return run


def _observed(metrics: Observation) -> dict:
    """What was counted; nothing where Spark found the input empty and left the counting out."""
    try:
        return metrics.get
    except Py4JJavaError:
        return {}


def ingest_batch(docs: DataFrame, policy: Policy, graph: store.Graph | None = None, tenant: int = 0, blocklist: Sequence[str] = (), bad_lines: DataFrame | None = None) -> Ingested:
    """Let a writer read documents and merge what is clean into a graph.

    Totals: ``docs_seen, docs_ingested, entities_added, edges_added, triples_skipped``.  Failures have the
    stage at which a row was lost: ``parse`` (a bad line, or a response that is no envelope) or
    ``writer`` (no response).  A document of a failed row adds nothing.  Documents, responses and triples are
    counted while they are written, so the counters cost no pass of their own.
    """
    spark, zero = docs.sparkSession, F.lit(0).cast("long")
    kind = docs.schema["doc_id"].dataType
    seen, read, judged_as = (Observation(f"{what}-{uuid.uuid4().hex}") for what in ("seen", "read", "judged"))
    total = lambda condition: F.coalesce(F.sum(condition.cast("long")), zero)
    answers = policy(docs.withColumn("tenant", F.lit(tenant).cast("long")).observe(seen, F.count(F.lit(1)).alias("docs")))
    if "response" in answers.columns:
        # one pass over the responses: parsed, counted and written
        asked = files.parsed(answers.select("tenant", "doc_id", "response"))
        asked = asked.select("tenant", "doc_id", F.col("response").isNull().alias("silent"), "whole", F.when(F.col("whole"), F.col("envelope")).alias("envelope"))
        asked = cut(asked.observe(read, total(F.col("silent")).alias("silent"), total(~F.col("silent") & ~F.col("whole")).alias("broken")))
        triples = files.envelope_triples(asked.where("whole"), ["tenant", "doc_id"])
        failures = asked.where("not whole").select("doc_id", F.when(F.col("silent"), "writer").otherwise("parse").alias("stage"), F.when(F.col("silent"), "no response").otherwise("not an envelope").alias("error"))
    else:
        # a table function has made triples, or an error
        asked = cut(answers.observe(read, total(F.col("error") == "no response").alias("silent"), total(F.col("error") != "no response").alias("broken")))
        triples = asked.where("error is null").drop("error")
        failures = asked.where("error is not null").select("doc_id", F.when(F.col("error") == "no response", "writer").otherwise("parse").alias("stage"), "error")
    judged = extract.sanitize(triples, blocklist)
    judged = cut(judged.observe(judged_as, total(F.col("reject_reason").isNull()).alias("added"), total(F.col("reject_reason").isNotNull()).alias("skipped")))
    merged = store.ingest(judged.where("reject_reason is null"), graph)
    count = lambda df, name: df.agg(F.count("*").alias(name))
    lines = 0
    if bad_lines is not None:
        rows = bad_lines.select(F.lit(None).cast(kind).alias("doc_id"), "stage", "error")
        lines = rows.count()
        failures = failures.unionByName(rows)
    docs_seen, lost, rated = (_observed(o) for o in (seen, read, judged_as))
    here = docs_seen.get("docs", 0)
    failed = lost.get("silent", 0) + lost.get("broken", 0)
    known = {"docs_seen": here + lines, "docs_ingested": here - failed, "edges_added": rated.get("added", 0), "triples_skipped": rated.get("skipped", 0)}
    before = count(graph.entities, "before") if graph is not None else spark.range(1).select(zero.alias("before"))
    grown = count(merged.entities, "after").join(before)  # one row each
    longs = {name: F.lit(value).cast("long").alias(name) for name, value in known.items()}
    totals = grown.select(longs["docs_seen"], longs["docs_ingested"], (F.col("after") - F.col("before")).alias("entities_added"), longs["edges_added"], longs["triples_skipped"])
    return Ingested(merged, totals, failures)


def evolve(snapshots: store.Store, graph: store.Graph, grow: Callable[[store.Graph], store.Graph], measure: Callable[[store.Graph], float], most_lost: float = 0.05) -> tuple[store.Graph, dict]:
    """One round: snapshot, grow, measure, and back to the snapshot if more than ``most_lost`` of the measure is gone.

    The grown graph is a snapshot too, so neither outcome depends on what is computed again later.
    Returns the graph to go on with, and both measures and whether it was rolled back.
    """
    kept = snapshots.snapshot(graph)
    before = measure(snapshots.restore(kept))
    grown = snapshots.snapshot(grow(snapshots.restore(kept)))
    after = measure(snapshots.restore(grown))
    back = before - after > most_lost
    return snapshots.restore(kept if back else grown), {"before": before, "after": after, "rolled_back": back}
