"""A graph that grows by batches: bucketed tables, a delta for each batch, merged when they are read.

Every batch writes its own entities, pairs of entity and document, and edges, and nothing else is read or
rewritten for it.  A reader gathers the deltas, which are small, and joins them to the base in its buckets: the
base is never shuffled, and neither are the pairs of a single delta.  Edges, which nothing is joined to, are written as
they come.  Compaction writes the merged tables as a new base.  (A union of bucketed tables would
look simpler, but Spark 4.1 then aggregates partitions that do not hold the same buckets.)

A version is a small JSON file that lists its tables, oldest first.  A writer claims the next number by
creating that file, which must not exist yet; the one who comes second lists what the first one added and
takes the next.  Older versions stay readable.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import cut, drop, tidy
from .store import Graph, ingest

#: How each kind is bucketed, if it is.  An entity with a third of all documents has them in all buckets.
KEYS = {"entities": ["tenant", "entity_id"], "entity_docs": ["tenant", "entity_id", "doc_id"], "edges": []}
#: Rows that are dealt into buckets at once: what their shuffle takes of the disk does not grow with a batch.
PASS_ROWS = 1 << 26


class GrowingStore:
    """Versions of a graph below ``path``; ``buckets`` counts for a new store, an old one has its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.buckets = self._listed()[1].get("buckets", buckets)

    # versions ---------------------------------------------------------------------------------------------------

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        system, where = self._at(f"{self.path}/versions")
        return sorted(int(f.getPath().getName().removesuffix(".json")) for f in system.listStatus(where) if f.getPath().getName().endswith(".json")) if system.exists(where) else []

    def _listed(self, version: int | None = None) -> tuple[int, dict]:
        """The number and content of a version, the last one by default; 0 and nothing for a new store."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return 0, {}
        if version not in known:
            raise KeyError(f"no version {version}")
        raw = self.spark.read.text(f"{self.path}/versions/{version}.json", wholetext=True).first()[0]
        return version, json.loads(raw)

    def _commit(self, change) -> int:
        """Write ``change(batches of the last version)`` as the next version; tried again where another writer was first."""
        while True:
            last, listed = self._listed()
            system, where = self._at(f"{self.path}/versions/{last + 1}.json")
            staged = self._at(f"{self.path}/versions/.{uuid.uuid4().hex}")[1]
            out = system.create(staged, False)
            out.write(bytearray(json.dumps({"buckets": self.buckets, "batches": change(listed.get("batches", []))}).encode()))
            out.close()
            # a whole file appears under its name at once, or not at all where the name is taken
            if not system.exists(where) and system.rename(staged, where):
                return last + 1
            system.delete(staged, False)

    # tables -----------------------------------------------------------------------------------------------------

    def _write(self, graph: Graph) -> dict:
        """Write tables that nobody lists yet; each bucket is one sorted file."""
        name, schemas = uuid.uuid4().hex, {}
        for kind, keys in KEYS.items():
            df, where = getattr(graph, kind), f"{self.path}/tables/{name}/{kind}"
            if keys:
                self._deal(df, keys, where)
            else:
                cut(df, kind, where, compression="zstd")
            schemas[kind] = json.loads(df.schema.json())
        return {"name": name, "schemas": schemas}

    def _deal(self, df: DataFrame, keys: list[str], where: str) -> None:
        """Write the buckets of a table, some of them at a time if it has many rows."""
        rows, table = cut(df, "rows", f"{where}-rows", compression="zstd"), f"growing_{uuid.uuid4().hex}"
        passes = min(-(-rows.count() // PASS_ROWS) or 1, self.buckets)
        bucket = F.pmod(F.hash(*keys), F.lit(self.buckets))  # as Spark numbers them
        with tidy(self.spark):
            for i in range(passes):
                some = rows if passes == 1 else rows.where(bucket % passes == i)
                dealt = some.repartition(self.buckets, *keys).write.mode("append").option("compression", "zstd")
                dealt.bucketBy(self.buckets, *keys).sortBy(*keys).option("path", where).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        drop(self.spark, f"{where}-rows")

    def _plain(self, batch: dict, kind: str) -> DataFrame:
        """A table as its files, without their buckets."""
        return self.spark.read.schema(T.StructType.fromJson(batch["schemas"][kind])).parquet(f"{self.path}/tables/{batch['name']}/{kind}")

    def _bucketed(self, batch: dict, kind: str) -> DataFrame:
        """A table with its buckets, to be joined; the catalog knows it only while it is looked up."""
        schema = T.StructType.fromJson(batch["schemas"][kind])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        table, keys = f"growing_{uuid.uuid4().hex}", ", ".join(KEYS[kind])
        self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/tables/{batch['name']}/{kind}'")
        try:
            return self.spark.table(table)
        finally:
            self.spark.sql(f"DROP TABLE {table}")

    # what users call --------------------------------------------------------------------------------------------

    def append(self, triples: DataFrame, most_deltas: int = 32) -> int:
        """Add a batch of clean triples; returns the version.  Only the batch is read."""
        return self.add(ingest(triples), most_deltas)

    def add(self, graph: Graph, most_deltas: int = 32) -> int:
        """Add a batch that is a graph already, each pair once; returns the version.

        More than ``most_deltas`` tables beside the base are merged into a new one.
        """
        batch = self._write(graph)
        version = self._commit(lambda batches: [*batches, batch])
        return self.compact() if len(self._listed(version)[1]["batches"]) > most_deltas + 1 else version

    def graph(self, version: int | None = None) -> Graph:
        """The graph of a version, the last one by default: attributes of an entity from its first batch.

        Equal pairs of entity and document count once; edges are those of all batches, ordered by document and
        place.
        """
        batches = self._listed(version)[1].get("batches", [])
        if not batches:
            raise KeyError("the store is empty")

        base, deltas = batches[0], batches[1:]
        if not deltas:
            return Graph(*(self._plain(base, kind) for kind in ("entities", "edges", "entity_docs")))

        def gathered(kind: str) -> DataFrame:
            parts = [self._plain(b, kind).withColumn("batch", F.lit(n)) for n, b in enumerate(deltas)]
            return functools.reduce(DataFrame.unionByName, parts)

        key = ["tenant", "entity_id"]
        later = gathered("entities").groupBy(*key).agg(F.min_by(F.struct("name", "etype"), "batch").alias("b"))
        first = self._bucketed(base, "entities").select(*key, F.struct("name", "etype").alias("a"))
        entities = first.join(later, key, "full").select(*key, F.coalesce("a", "b").alias("a")).select(*key, "a.name", "a.etype")
        # pairs of one delta are distinct and have the buckets of the base
        new = self._bucketed(deltas[0], "entity_docs") if len(deltas) == 1 else gathered("entity_docs").drop("batch").distinct()
        pairs = new.join(self._bucketed(base, "entity_docs"), KEYS["entity_docs"], "left_anti")
        return Graph(entities, self._plain(base, "edges").unionByName(gathered("edges").drop("batch")), self._plain(base, "entity_docs").unionByName(pairs))

    def compact(self) -> int:
        """Merge all tables of the last version into one; batches that were added meanwhile stay beside it."""
        _, listed = self._listed()
        merged = self._write(self.graph())
        gone = {b["name"] for b in listed["batches"]}
        return self._commit(lambda batches: [merged, *(b for b in batches if b["name"] not in gone)])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the tables that none of the last ``keep`` versions lists, and the older versions; returns their names."""
        known = self.versions()
        kept = {b["name"] for v in known[-keep:] for b in self._listed(v)[1]["batches"]}
        system, where = self._at(f"{self.path}/tables")
        old = sorted({b["name"] for v in known[:-keep] for b in self._listed(v)[1]["batches"]} - kept)
        for v in known[:-keep]:
            system.delete(self._at(f"{self.path}/versions/{v}.json")[1], False)
        for name in old:
            system.delete(self._at(f"{self.path}/tables/{name}")[1], True)
        return old
