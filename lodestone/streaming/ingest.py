"""Triples as a stream: windows over event time, and a graph that grows batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import extract, store


class StreamingGraph:
    """Appends the triples of each micro-batch below ``path``; the graph is merged when it is read.

    A batch writes its own folder, named by its number, and replaces it if it is tried again, so a
    restart from the stream's checkpoint counts nothing twice.  Merging is set-based: attributes come
    from the first mention by (document, place), whatever the order of batches.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def start(self, triples: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        def write(batch: DataFrame, number: int) -> None:
            clean = extract.sanitize(batch).where("reject_reason is null").drop("reject_reason")
            clean.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        stream = triples.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        return (stream.trigger(availableNow=True) if available_now else stream).start()

    def graph(self) -> store.Graph:
        return store.ingest(self.spark.read.parquet(self.path).drop("batch"))


def mention_windows(triples: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Triples by relation and hour of event time; rows later than ``late`` are left to the watermark."""
    return triples.withWatermark(time, late).groupBy(F.window(time, width), "rel").agg(F.count("*").alias("n"))


def _fewer(mentions: DataFrame) -> DataFrame:
    """Mentions summed in each batch of a task: ``n`` of one document, name and type, and the first place.

    An entity that a third of all documents mention is not shuffled mention by mention.
    """
    by = ["tenant", "entity_id", "doc_id", "name", "etype"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).group_by(by).aggregate([("seq", "min"), ("seq", "count")])
            yield from t.select([*by, "seq_min", "seq_count"]).rename_columns([*by, "seq", "n"]).to_batches()

    rows = mentions.select("tenant", "entity_id", F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), "name", "etype", F.col("seq").cast("long").alias("seq"))
    return rows.mapInArrow(run, "tenant long, entity_id long, doc_id decimal(20,0), name string, etype string, seq long, n long")


class FirstWriter(StatefulProcessor):
    """State of one entity: who named it first, by document and place, and how often which documents name it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "doc_id decimal(20,0), seq long, name string, etype string, mentions long, docs long")
        self.docs = handle.getMapState("docs", "doc_id decimal(20,0)", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        best, mentions, known, new = None, 0, 0, []
        if self.first.exists():
            *best, mentions, known = self.first.get()
        for batch in rows:
            for doc, seq, name, etype, n in batch[["doc_id", "seq", "name", "etype", "n"]].itertuples(index=False):
                mentions += int(n)
                if best is None or (doc, seq) < (best[0], best[1]):
                    best = [doc, int(seq), name, etype]
                if not self.docs.containsKey((doc,)):
                    self.docs.updateValue((doc,), (int(n),))
                    new.append(doc)
                else:
                    self.docs.updateValue((doc,), (self.docs.getValue((doc,))[0] + int(n),))
        self.first.update((*best, mentions, known + len(new)))
        yield pd.DataFrame({"tenant": [key[0]], "entity_id": [key[1]], "name": [best[2]], "etype": [best[3]], "n_mentions": [mentions], "n_docs": [known + len(new)], "doc_id": pd.Series([None], dtype=object)})
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            m = len(some)
            yield pd.DataFrame({"tenant": [key[0]] * m, "entity_id": [key[1]] * m, "name": [None] * m, "etype": [None] * m, "n_mentions": [0] * m, "n_docs": [0] * m, "doc_id": pd.Series([Decimal(d) for d in some], dtype=object)})


class StatefulGraph:
    """Entities and their documents kept as state of a stream: no batch reads what earlier ones brought.

    Each micro-batch gives the changed entities and the pairs of entity and document that are new, and writes
    them to its own folder, replaced if the batch is tried again.  Whatever the order of batches, the first
    mention by document and place names an entity.  Needs a state store on disk (``ROCKSDB``).
    """

    ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    SCHEMA = "tenant long, entity_id long, name string, etype string, n_mentions long, n_docs long, doc_id decimal(20,0)"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def start(self, triples: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        self.spark.conf.set("spark.sql.streaming.stateStore.providerClass", self.ROCKSDB)
        clean = extract.sanitize(triples).where("reject_reason is null").drop("reject_reason")
        changes = _fewer(extract.mentions(clean)).groupBy("tenant", "entity_id").transformWithStateInPandas(FirstWriter(), self.SCHEMA, "Update", "None")

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/batch={number}")

        stream = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        return (stream.trigger(availableNow=True) if available_now else stream).start()

    def entities(self) -> DataFrame:
        """``tenant, entity_id, name, etype, n_mentions, n_docs``: the last change of each entity."""
        rows = self.spark.read.parquet(self.path).where("doc_id is null")
        last = rows.groupBy("tenant", "entity_id").agg(F.max_by(F.struct("name", "etype", "n_mentions", "n_docs"), "batch").alias("a"))
        return last.select("tenant", "entity_id", "a.*")

    def entity_docs(self) -> DataFrame:
        """Distinct pairs; each is written once, in the batch that brought it."""
        return self.spark.read.parquet(self.path).where("doc_id is not null").select("tenant", "entity_id", "doc_id")
