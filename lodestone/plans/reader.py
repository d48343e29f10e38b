"""Readers: a table of queries in, ranked documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import embedding_arrays, top_k
from ..operators import address, gnn, propagate
from ..operators.store import Graph
from ..shared import cut
from .planner import heuristic_plan

KEYS = ["tenant", "query_id"]
PAIR = [*KEYS, "entity_id"]


def candidates(plans: DataFrame, entities: DataFrame) -> DataFrame:
    """``(tenant, query_id, n)``: entities of the query's tenant."""
    sizes = entities.groupBy("tenant").agg(F.count("*").alias("n"))
    return plans.select(*KEYS).join(sizes, "tenant")


def narrow(plans: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """``(tenant, query_id, entity_id)``: the ``k`` entities (1 at least) nearest to each query by hashed embedding.

    Texts become dense vectors, and queries meet entities in blocks, each pair of a block and a part of the
    entities being one matrix product.  Ties, such as the many entities of cosine 0, go by id.
    """
    k = max(k, 1)
    q = embedding_arrays(plans.select(*KEYS, "text"), KEYS, "text")
    n = embedding_arrays(entities.select("tenant", "entity_id", "name"), ["tenant", "entity_id"], "name")
    return top_k(n, q, k, "entity_id", "e", "query_id", group="tenant").select(*PAIR)


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    """The best ``k`` documents of each query (1 at least), ties by id."""
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("score"), "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= max(k, 1)).select(*KEYS, "doc_id", "score", "rank")


def _of_hits(found: DataFrame, entity_docs: DataFrame, k: int) -> DataFrame:
    """Documents by the probabilities of listed entities alone."""
    hits = found.where("p > 0").join(entity_docs, ["tenant", "entity_id"])
    return _ranked(hits.groupBy(*KEYS, "doc_id").agg(F.round(F.sum("p"), 9).alias("score")), k)


def _open(plans: DataFrame, graph: Graph, k: int, weights: address.Weights, use_embeddings: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scored entities and the background of queries that all entities but the excluded may answer, and their documents."""
    gone = address.excluded(plans, graph.entities)
    # several steps read the pairs; they are written once
    scores = cut(address.match_scores(plans, graph.entities, weights, use_embeddings).join(gone, PAIR, "left_anti"))
    left_out = gone.groupBy(*KEYS).agg(F.count("*").alias("g"))
    counts = candidates(plans, graph.entities).join(left_out, KEYS, "left").select(*KEYS, (F.col("n") - F.coalesce("g", F.lit(0))).alias("n"))
    found, background = address.softmax(scores, counts, weights.temperature, weights.cons)
    # an excluded entity has no mass: as a hit of probability 0 it is not counted as background either
    found = cut(found.unionByName(gone.select("*", F.lit(None).cast("double").alias("raw"), F.lit(0.0).alias("p"))))
    background = cut(background)
    return found, background, address.score_documents(found, background, graph.entity_docs, k)


def _typed(plans: DataFrame, graph: Graph) -> tuple[DataFrame, Graph]:
    """Queries that ask for one type, and the graph in which a type is part of the tenant."""
    kinds = F.array_distinct(F.transform(F.filter("constraints", lambda c: c["kind"] == "EntityType"), lambda c: c["value"]))
    scope = lambda etype: F.struct(F.col("tenant").alias("tenant"), etype.alias("etype"))
    asked = plans.withColumn("kinds_", kinds).where(F.size("kinds_") == 1).withColumn("tenant", scope(F.col("kinds_")[0])).drop("kinds_")
    entities = graph.entities.withColumn("tenant", scope(F.col("etype")))
    bridge = graph.entity_docs.join(graph.entities.select("tenant", "entity_id", "etype"), ["tenant", "entity_id"]).withColumn("tenant", scope(F.col("etype"))).drop("etype")
    return asked, Graph(entities, graph.edges, bridge)


def read(queries: DataFrame, graph: Graph, k: int = 3, weights: address.Weights = address.Weights(), use_embeddings: bool = False, narrow_k: int | None = None, plan=heuristic_plan) -> DataFrame:
    """Plan, address, softmax, documents: ``(tenant, query_id, doc_id, score, rank)`` for all queries at once.

    Hard constraints of a plan hold: an entity that violates one has no mass and is no background.  Queries
    with inclusions choose among the entities named so, those with a type among its entities.
    ``narrow_k`` restricts each query to its nearest entities, which changes the softmax and hence the
    result; without it every entity takes part.
    """
    plans = plan(queries)
    limited = "constraints" in queries.columns or plan is not heuristic_plan  # else no plan has constraints
    if narrow_k is not None:
        scores = address.match_scores(plans, graph.entities, weights, use_embeddings)
        chosen = narrow(plans, graph.entities, narrow_k)
        if limited:
            chosen = chosen.join(address.allowed(plans, chosen, graph.entities), PAIR, "left_semi")
        inside = chosen.join(scores, PAIR, "left").withColumn("raw", F.coalesce("raw", F.lit(weights.cons)))
        return _of_hits(address.dense_softmax(inside, weights.temperature), graph.entity_docs, k)
    if not limited:
        return _open(plans, graph, k, weights, use_embeddings)[2]
    has = lambda kind: F.coalesce(F.exists("constraints", lambda c: c["kind"] == kind), F.lit(False))
    plans = cut(plans.withColumns({"inclusion_": has("MustInclude"), "type_": has("EntityType")}))
    named, typed, free = plans.where("inclusion_"), plans.where("type_ and not inclusion_"), plans.where("not type_ and not inclusion_")
    out = _open(free, graph, k, weights, use_embeddings)[2]
    own, scoped = _typed(typed, graph)
    of_type = _open(own, scoped, k, weights, use_embeddings)[2]
    out = out.unionByName(of_type.withColumn("tenant", F.col("tenant.tenant")))
    inside = address.constrain(named, graph.entities).join(address.match_scores(named, graph.entities, weights, use_embeddings), PAIR, "left")
    found = address.dense_softmax(inside.withColumn("raw", F.coalesce("raw", F.lit(weights.cons))), weights.temperature)
    return out.unionByName(_of_hits(found, graph.entity_docs, k))


def entities(queries: DataFrame, graph: Graph, top: int = 10, weights: address.Weights = address.Weights(), plan=heuristic_plan) -> DataFrame:
    """``(tenant, query_id, entity_id, p, rank)``: the ``top`` entities of each query by probability, ties by id.

    Entities that match nothing share one probability, so of them only the ``top`` smallest ids can rank.
    """
    plans = plan(queries)
    found, background, _ = _open(plans, graph, 1, weights, False)
    first = graph.entities.withColumn("r", F.row_number().over(W.partitionBy("tenant").orderBy("entity_id"))).where(F.col("r") <= top).select("tenant", "entity_id")
    fill = background.join(F.broadcast(first), "tenant").join(found.select(*PAIR), PAIR, "left_anti")  # ``top`` rows a tenant
    both = found.select(*PAIR, "p").unionByName(fill.select(*PAIR, F.col("background").alias("p"))).where("p > 0").withColumn("p", F.round("p", 12))
    rank = F.row_number().over(W.partitionBy(*KEYS).orderBy(F.desc("p"), "entity_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= top)


def subgraph(queries: DataFrame, graph: Graph, seeds: int = 16, weights: address.Weights = address.Weights(), plan=heuristic_plan) -> DataFrame:
    """``(tenant, query_id, src, dst, relation, n)``: out-edges of each query's best ``seeds`` entities, parallel ones counted."""
    chosen = entities(queries, graph, seeds, weights, plan).select(*KEYS, F.col("entity_id").alias("src"))
    merged = graph.edges.groupBy("tenant", "src", "dst", "relation").agg(F.count("*").alias("n"))
    return chosen.join(merged, ["tenant", "src"]).select(*KEYS, "src", "dst", "relation", "n")


def evidence(queries: DataFrame, results: DataFrame) -> DataFrame:
    """``(tenant, query_id, evidence, prompt)``: what a model is asked to answer with, given the ids of documents found.

    Results are the few best documents of a query, so their ids fit one row.
    """
    ids = results.groupBy(*KEYS).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda r: r["doc_id"]).alias("evidence"))
    found = queries.select(*KEYS, "text").join(ids, KEYS, "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<long>")))
    listed = F.concat(F.lit("["), F.array_join(F.col("evidence").cast("array<string>"), ", "), F.lit("]"))
    return found.select(*KEYS, "evidence", F.concat(F.lit("Question: "), "text", F.lit("\nEvidence doc IDs: "), listed, F.lit("\nAnswer concisely.")).alias("prompt"))


def propagated(queries: DataFrame, graph: Graph, layer: gnn.Layer, k: int = 3, weights: address.Weights = address.Weights(), eta: float = 0.5, plan=heuristic_plan, tiling: propagate.Tiling = propagate.Tiling()) -> DataFrame:
    """Documents by a blend of address probability and propagated state: ``(tenant, query_id, doc_id, score, rank)``.

    Every entity takes part for every query, always with the cosine of hashed embeddings.  An entity starts
    from its probability to the power ``eta`` times the query's embedding, one layer is applied along
    all edges, and half the probability and half l1 / (l1 + 1) of the state is its score; a document sums
    those of its entities.  A message is linear in its source's state, so a source carries one number
    for each query: the embedding is multiplied in at the target.  Entities and documents are worked on in
    tiles, queries in blocks (``propagate``); a query whose tenant has no entity finds nothing.
    """
    plans = plan(queries)
    scores, asked = propagate.entity_scores(plans, graph.entities, graph.edges, layer, weights, eta, tiling)
    return _ranked(propagate.document_scores(scores, asked, graph.entity_docs, k, tiling), k)
