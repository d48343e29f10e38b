"""The entity graph as DataFrames: merge, edges, bridge, lookups, neighbourhoods, snapshots."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.ids import entity_id
from ..shared import tidy
from .extract import mentions

#: Triples of a document at most, for sequence numbers of edges.
STRIDE = 1 << 20


@dataclass
class Graph:
    """Tables of a store: ``entities``, ``edges``, ``entity_docs``; every row has its tenant."""

    entities: DataFrame
    edges: DataFrame
    entity_docs: DataFrame


def place(df: DataFrame, stride: int, inside: Column) -> Column:
    """A number that orders rows by ``doc_id``, then by ``inside``, which is below ``stride``.

    Ids of 64 bits without a sign come as DECIMAL and make a DECIMAL; long ones make a long, and are below
    2**63 / stride (a larger one is an overflow error).
    """
    doc = F.col("doc_id")
    if isinstance(df.schema["doc_id"].dataType, T.DecimalType):
        return (doc.cast("decimal(20,0)") * F.lit(Decimal(stride)) + inside).cast("decimal(38,0)")
    return doc * stride + inside


def merge_entities(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Entities from mentions: id by lower-case name, attributes of the first mention.

    An existing entity keeps its attributes.  Mentions are first aggregated to distinct names and types, each
    with its first place (a number, so that Spark aggregates by hash, and a name that a third of all
    documents mention costs one row a task); ids and first mentions are found among those few.
    """
    names = new.groupBy("tenant", "name", "etype").agg(F.min(place(new, 2 * STRIDE, F.col("seq"))).alias("place"))
    first = names.select("tenant", entity_id(F.col("name")).alias("entity_id"), "name", "etype", F.lit(1).alias("age"), "place")
    if existing is not None:
        first = first.unionByName(existing.select("tenant", "entity_id", "name", "etype", F.lit(0).alias("age"), F.lit(0).cast(first.schema["place"].dataType).alias("place")))
    best = F.min_by(F.struct("name", "etype"), F.struct("age", "place"))
    return first.groupBy("tenant", "entity_id").agg(best.alias("a")).select("tenant", "entity_id", "a.name", "a.etype")


def bridge(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct ``(tenant, entity_id, doc_id)``: a set, however often a document names an entity."""
    rows = new.select("tenant", "entity_id", "doc_id")
    return (rows if existing is None else rows.unionByName(existing)).distinct()


def edges_of(triples: DataFrame) -> DataFrame:
    """Append-only edges ``(tenant, src, seq, dst, relation, provenance)``; equal ones stay apart.

    ``seq`` orders edges as documents and triples come; it needs no global counter (``resequenced`` makes
    dense numbers of it).
    """
    end = lambda c: F.col(f"{c}_id") if f"{c}_id" in triples.columns else entity_id(F.col(c))
    return triples.select("tenant", end("src").alias("src"), place(triples, STRIDE, F.col("triple_idx")).alias("seq"), end("dst").alias("dst"), F.col("rel").alias("relation"), F.col("doc_id").alias("provenance"))


def resequenced(edges: DataFrame, buckets: int = 1024) -> DataFrame:
    """``seq`` from 0 without gaps in every tenant, in the order it had.

    Edges are numbered inside ranges of ``seq`` and lifted by the sizes of the ranges before (at most
    ``buckets`` rows a tenant), so a tenant with most of the edges is not one task's.
    """
    ends = edges.groupBy("tenant").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    # doubles round, but never change the order of two numbers
    width = F.greatest(F.ceil((F.col("hi") - F.col("lo") + 1).cast("double") / buckets), F.lit(1)).cast("double")
    dealt = edges.join(ends, "tenant", "left").withColumn("bucket", F.floor((F.col("seq") - F.col("lo")).cast("double") / width).cast("int")).drop("lo", "hi")
    sizes = dealt.groupBy("tenant", "bucket").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("tenant").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(W.partitionBy("tenant", "bucket").orderBy("seq", *(c for c in ("src", "relation", "dst") if c in edges.columns))) - 1
    # all edges have their range: left joins leave Spark free to skip the numbers where nobody reads them
    out = dealt.withColumn("inside", inside).join(sizes.select("tenant", "bucket", before.alias("base")), ["tenant", "bucket"], "left")
    return out.withColumn("seq", F.col("base") + F.col("inside")).select(*edges.columns)


def ingest(triples: DataFrame, graph: Graph | None = None) -> Graph:
    """Merge clean triples into a graph; nothing is changed in place."""
    seen = mentions(triples)
    edges = edges_of(triples)
    if graph is None:
        return Graph(merge_entities(seen), edges, bridge(seen))
    return Graph(merge_entities(seen, graph.entities), graph.edges.unionByName(edges), bridge(seen, graph.entity_docs))


def append_edges(new: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split edges into those with both ends present and those that are rejected."""
    known = entities.select("tenant", "entity_id")
    src, dst = known.withColumnRenamed("entity_id", "src"), known.withColumnRenamed("entity_id", "dst")
    good = new.join(src, ["tenant", "src"], "left_semi").join(dst, ["tenant", "dst"], "left_semi")
    bad = new.join(src, ["tenant", "src"], "left_anti").unionByName(new.join(src, ["tenant", "src"], "left_semi").join(dst, ["tenant", "dst"], "left_anti"))
    return good, bad


def upsert(existing: DataFrame, new: DataFrame, order: str = "version") -> DataFrame:
    """Replace records wholesale: the last version of each (tenant, entity_id) wins."""
    both = existing.unionByName(new)
    return both.groupBy("tenant", "entity_id").agg(F.max_by(F.struct(*[c for c in both.columns if c not in ("tenant", "entity_id")]), order).alias("r")).select("tenant", "entity_id", "r.*")


def entity(entities: DataFrame, tenant: int, entity_id: int) -> DataFrame:
    """The entity of an id, if there is one; both conditions reach the scan."""
    return entities.where((F.col("tenant") == tenant) & (F.col("entity_id") == entity_id))


def find_by_name(entities: DataFrame, asked: DataFrame, name: str = "asked") -> DataFrame:
    """Entities of many names at once: rows of ``asked`` joined to those named so in any case, by name or alias."""
    names = entities.withColumn("low", F.explode(F.transform(all_names(entities), F.lower))).dropDuplicates(["tenant", "entity_id", "low"])
    return asked.join(names, F.lower(F.col(name)) == F.col("low")).drop("low")


def all_names(entities: DataFrame) -> Column:
    """An entity's name and its aliases."""
    return F.array_distinct(F.concat(F.array("name"), F.coalesce(F.col("aliases"), F.array().cast("array<string>")))) if "aliases" in entities.columns else F.array("name")


def listing_rows(entities: DataFrame, entity_docs: DataFrame, part: str, limit: int) -> DataFrame:
    """``listing`` with what a list shows: aliases, whether there is an embedding, how many documents name the entity."""
    first = listing(entities, part, limit)
    docs = entity_docs.join(first.select("tenant", "entity_id"), ["tenant", "entity_id"]).groupBy("tenant", "entity_id").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    aliases = F.coalesce(F.col("aliases"), F.array().cast("array<string>")) if "aliases" in entities.columns else F.array().cast("array<string>")
    embedded = F.col("embedding").isNotNull() if "embedding" in entities.columns else F.lit(False)
    shown = first.select("tenant", "entity_id", "name", "etype", aliases.alias("aliases"), embedded.alias("has_embedding"))
    return shown.join(docs, ["tenant", "entity_id"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


def named(entities: DataFrame, name: Column) -> DataFrame:
    """Entities whose name equals ``name`` in any case; aliases count where the column exists."""
    hit = F.lower("name") == F.lower(name)
    if "aliases" in entities.columns:
        hit = hit | F.exists("aliases", lambda a: F.lower(a) == F.lower(name))
    return entities.where(hit)


def listing(entities: DataFrame, part: str, limit: int) -> DataFrame:
    """The first ``limit`` entities, by id, whose name has ``part`` in any case."""
    hit = F.lower("name").contains(part.lower())
    if "aliases" in entities.columns:
        hit = hit | F.exists("aliases", lambda a: F.lower(a).contains(part.lower()))
    return entities.where(hit).orderBy("tenant", "entity_id").limit(limit)


def stats(graph: Graph) -> DataFrame:
    """One row for each tenant: entities, and edges that leave existing entities."""
    nodes = graph.entities.groupBy("tenant").agg(F.count("*").alias("entities"))
    alive = graph.edges.join(graph.entities.select("tenant", F.col("entity_id").alias("src")), ["tenant", "src"], "left_semi")
    return nodes.join(alive.groupBy("tenant").agg(F.count("*").alias("edges")), "tenant", "left").select("tenant", "entities", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


def neighbors(edges: DataFrame, most: int) -> DataFrame:
    """The first ``most`` out-edges of every entity, with their ``rank``; tasks keep no more before the shuffle."""
    rank = F.row_number().over(W.partitionBy("tenant", "src").orderBy("seq", *(c for c in ("relation", "dst") if c in edges.columns)))
    return edges.withColumn("rank", rank).where(F.col("rank") <= most)


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("tenant", F.col("src").alias("entity_id")).agg(F.count("*").alias("out_degree"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, cut) -> DataFrame:
    """``(tenant, entity_id, depth)`` of what ``hops`` out-edges reach from the seeds.

    Breadth first: each round joins the frontier to distinct links and takes away what was seen.
    ``cut`` writes a round's result to the shared folder and reads it back, so plans stay short and a
    lost executor costs one round.
    """
    links = cut(edges.select("tenant", "src", "dst").distinct())
    seen = cut(seeds.select("tenant", "entity_id").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for hop in range(1, hops + 1):
        found = frontier.select("tenant", F.col("entity_id").alias("src")).join(links, ["tenant", "src"]).select("tenant", F.col("dst").alias("entity_id")).distinct()
        frontier = cut(found.join(seen.select("tenant", "entity_id"), ["tenant", "entity_id"], "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def expanded_edges(edges: DataFrame, reached: DataFrame, hops: int) -> DataFrame:
    """All out-edges of every entity that a ``k_hop`` of ``hops`` expanded."""
    inner = reached.where(F.col("depth") < hops).select("tenant", F.col("entity_id").alias("src"))
    return edges.join(inner, ["tenant", "src"], "left_semi")


class Store:
    """Snapshots of a graph as versioned Parquet folders below one path.

    A snapshot is written once and never changed; restoring is reading an older one.  Its number is the first
    that is free; making the folder claims it, so of two writers one takes the next.  Tables are
    partitioned by tenant, so a tenant's scan reads its own files.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        system, where = self._at(path)
        return system.exists(where)

    def _claim(self, path: str) -> bool:
        """Create a marker file that must not exist yet."""
        system, where = self._at(path)
        if system.exists(where):
            return False
        try:
            system.create(where, False).close()
        except Exception:
            if system.exists(where):
                return False
            raise
        return True

    def _numbers(self) -> list[int]:
        """Numbers of snapshots that are whole or being written, in order."""
        system, where = self._at(self.path)
        found = [f.getPath().getName() for f in system.listStatus(where)] if system.exists(where) else []
        return sorted(int(f[5:]) for f in found if f.startswith("snap="))

    def snapshot(self, graph: Graph) -> int:
        n = max(self._numbers(), default=0) + 1
        while not self._claim(f"{self.path}/snap={n}/_CLAIMED"):
            n += 1
        # rows go to the files of two tenants as they come; only those of further ones are sorted first
        with tidy(self.spark, spark__sql__maxConcurrentOutputFileWriters="2"):
            for name in ("edges", "entity_docs", "entities"):  # entities last: their marker shows a whole snapshot
                getattr(graph, name).write.option("compression", "zstd").partitionBy("tenant").parquet(f"{self.path}/snap={n}/{name}")
        return n

    def last(self) -> int:
        """The number of the last whole snapshot; 0 without one."""
        return next((n for n in reversed(self._numbers()) if self._exists(f"{self.path}/snap={n}/entities/_SUCCESS")), 0)

    def restore(self, n: int) -> Graph:
        """The graph of a snapshot in place of any other; its edges are numbered anew."""
        if not self._exists(f"{self.path}/snap={n}/entities/_SUCCESS"):
            raise KeyError(f"no snapshot {n}")
        read = lambda name: self.spark.read.parquet(f"{self.path}/snap={n}/{name}").withColumn("tenant", F.col("tenant").cast("long"))
        return Graph(read("entities"), resequenced(read("edges")), read("entity_docs"))
