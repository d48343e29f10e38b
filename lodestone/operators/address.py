"""Soft addressing: scores of entities for queries, a softmax over all entities, documents by their mass.

Every entity of a tenant takes part in the softmax, those that match nothing with score 0, so a
document's mass depends on how many entities it has.  Only pairs that match are ever made: the mass
of the rest is the same for all of them and is added as a number (``softmax`` gives it as
``background``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.text import name_tokens
from ..functions.vectors import best_places, hashed_buckets, sparse_cosine
from .store import all_names


@dataclass(frozen=True)
class Weights:
    """Weights of the parts of a score, and the temperature of the softmax."""

    exact: float = 1.5
    alias: float = 0.8
    cos: float = 1.2
    type: float = 0.5
    cons: float = 0.0
    ner: float = 1.0
    temperature: float = 0.5


def parse_weights(text: str) -> Weights:
    """Six or seven comma-separated numbers; with six the temperature is 0.7."""
    values = [float(x) for x in text.split(",")]
    if len(values) not in (6, 7):
        raise ValueError("six or seven numbers are needed")
    return Weights(*values, *([] if len(values) == 7 else [0.7]))


def match_scores(plans: DataFrame, entities: DataFrame, weights: Weights = Weights(), use_embeddings: bool = False) -> DataFrame:
    """``(tenant, query_id, entity_id, raw)`` for pairs that match in some way; all others score 0.

    exact: 1 if an expansion equals the name, else .7 if a one-token expansion is among its tokens, or
    the Jaccard similarity of a longer expansion's tokens and the name's, the best of these.  alias: 1
    if a plan's alias equals an entity's.  cos: of hashed embeddings of the query's text and the name.
    type: 1 if the plan's type is the entity's.  ner: how many expansions equal the name.  Pairs come
    from equi-joins on names, tokens, aliases, buckets and types, never from all pairs.
    """
    e = entities.select("tenant", "entity_id", F.lower("name").alias("low"), name_tokens(F.col("name")).alias("name_tokens"))
    x = plans.select("tenant", "query_id", F.explode("expansions").alias("x"))
    full = x.groupBy("tenant", "query_id", F.col("x").alias("low")).agg(F.count("*").alias("times"))
    parts = [full.join(e.select("tenant", "low", "entity_id"), ["tenant", "low"]).select("tenant", "query_id", "entity_id", F.lit(1.0).alias("exact"), F.col("times").cast("double").alias("ner"))]
    words = x.distinct().withColumn("tokens", name_tokens(F.col("x")))
    by_token = e.select("tenant", "entity_id", F.size("name_tokens").alias("n"), F.explode("name_tokens").alias("token"))
    # a hit's denominator: tokens of the name and of the expansion that are not common to both
    hits = words.select("tenant", "query_id", "x", F.size("tokens").alias("m"), F.explode("tokens").alias("token")).join(by_token, ["tenant", "token"])
    common = hits.groupBy("tenant", "query_id", "x", "m", "entity_id", "n").agg(F.count("*").alias("c"))
    partial = F.when(F.col("m") == 1, 0.7).otherwise(F.col("c") / (F.col("m") + F.col("n") - F.col("c")))
    parts.append(common.select("tenant", "query_id", "entity_id", partial.alias("exact")))
    if "aliases" in entities.columns:
        own = entities.select("tenant", "entity_id", F.explode(F.transform("aliases", F.lower)).alias("a"))
        asked = plans.select("tenant", "query_id", F.explode("aliases").alias("a"))
        parts.append(asked.join(own, ["tenant", "a"]).select("tenant", "query_id", "entity_id", F.lit(1.0).alias("alias")).distinct())
    typed = plans.where(F.col("etype_hint").isNotNull()).select("tenant", "query_id", F.col("etype_hint").alias("etype"))
    parts.append(typed.join(entities.select("tenant", "entity_id", "etype"), ["tenant", "etype"]).select("tenant", "query_id", "entity_id", F.lit(1.0).alias("type")))
    if use_embeddings:
        q = hashed_buckets(plans.withColumn("qk", F.struct("tenant", "query_id")), "qk", "text")
        n = hashed_buckets(entities.withColumn("ek", F.struct("tenant", "entity_id")), "ek", "name")
        near = sparse_cosine(q, n, "qk", "ek").where(F.col("qk.tenant") == F.col("ek.tenant"))
        parts.append(near.select("qk.tenant", "qk.query_id", "ek.entity_id", F.greatest("cos", F.lit(0.0)).alias("cos")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p, allowMissingColumns=True)
    terms = [c for c in ("exact", "alias", "cos", "type", "ner") if c in both.columns]
    best = both.groupBy("tenant", "query_id", "entity_id").agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in terms])
    raw = sum((getattr(weights, c) * F.col(c) for c in terms[1:]), weights.exact * F.col("exact"))
    return best.select("tenant", "query_id", "entity_id", (raw + weights.cons).alias("raw"))


def constrain(plans: DataFrame, entities: DataFrame) -> DataFrame:
    """``(tenant, query_id, entity_id)`` that a query's hard constraints leave, for queries that have any.

    MustInclude and MustExclude compare a whole name or alias, case and all; EntityType the type.  A query
    with an inclusion or a type is answered from an equi-join on it, one with exclusions alone keeps
    all but the names excluded: see ``excluded``.
    """
    asked = plans.where(F.size("constraints") > 0).select("tenant", "query_id", F.explode("constraints").alias("c"), F.size(F.filter("constraints", lambda c: c["kind"] != "MustExclude")).alias("n"))
    need = asked.where("c.kind <> 'MustExclude'").select("tenant", "query_id", "n", "c.kind", "c.value").distinct()
    names = entities.select("tenant", "entity_id", F.explode(all_names(entities)).alias("value"), F.lit("MustInclude").alias("kind"))
    types = entities.select("tenant", "entity_id", F.col("etype").alias("value"), F.lit("EntityType").alias("kind"))
    met = need.join(names.unionByName(types).distinct(), ["tenant", "kind", "value"]).groupBy("tenant", "query_id", "entity_id", "n").agg(F.count("*").alias("met"))
    return met.where("met = n").select("tenant", "query_id", "entity_id").join(excluded(plans, entities), ["tenant", "query_id", "entity_id"], "left_anti")


def allowed(plans: DataFrame, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """Those of given ``(tenant, query_id, entity_id)`` that violate no constraint of their query."""
    facts = entities.select("tenant", "entity_id", "etype", all_names(entities).alias("names"))
    both = pairs.join(plans.select("tenant", "query_id", "constraints"), ["tenant", "query_id"]).join(facts, ["tenant", "entity_id"])
    holds = lambda c: F.when(c["kind"] == "EntityType", c["value"] == F.col("etype")).otherwise(F.array_contains("names", c["value"]) == (c["kind"] == "MustInclude"))
    return both.where(F.col("constraints").isNull() | F.forall("constraints", holds)).select("tenant", "query_id", "entity_id")


def excluded(plans: DataFrame, entities: DataFrame) -> DataFrame:
    """``(tenant, query_id, entity_id)`` that MustExclude takes away."""
    asked = plans.where(F.size("constraints") > 0).select("tenant", "query_id", F.explode("constraints").alias("c")).where("c.kind = 'MustExclude'")
    names = entities.select("tenant", "entity_id", F.explode(all_names(entities)).alias("value"))
    return asked.select("tenant", "query_id", "c.value").join(names, ["tenant", "value"]).select("tenant", "query_id", "entity_id").distinct()


def softmax(scores: DataFrame, candidates: DataFrame, temperature: float, cons: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Probabilities of scored entities, and of the others.

    ``candidates`` has ``(tenant, query_id, n)``, how many entities each query may choose from.  Returns
    ``(tenant, query_id, entity_id, raw, p)`` and ``(tenant, query_id, background)``, the probability of each
    entity without a score.
    """
    t = max(temperature, 1e-6)
    sums = scores.groupBy("tenant", "query_id").agg(F.max("raw").alias("top"), F.count("*").alias("m"))
    base = candidates.join(sums, ["tenant", "query_id"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    base = base.withColumn("top", F.when(F.col("m") < F.col("n"), F.greatest(F.coalesce("top", F.lit(cons)), F.lit(cons))).otherwise(F.col("top")))
    lifted = scores.join(base.select("tenant", "query_id", "top"), ["tenant", "query_id"]).withColumn("w", F.exp((F.col("raw") - F.col("top")) / t))
    mass = lifted.groupBy("tenant", "query_id").agg(F.sum("w").alias("mass"))
    z = base.join(mass, ["tenant", "query_id"], "left").withColumn("bg", F.exp((F.lit(cons) - F.col("top")) / t))
    z = z.withColumn("z", F.coalesce("mass", F.lit(0.0)) + (F.col("n") - F.col("m")) * F.col("bg"))
    p = lambda w: F.when(F.col("z") < 1e-12, 0.0).otherwise(F.col(w) / F.col("z"))
    found = lifted.join(z.select("tenant", "query_id", "z"), ["tenant", "query_id"]).select("tenant", "query_id", "entity_id", "raw", p("w").alias("p"))
    return found, z.select("tenant", "query_id", p("bg").alias("background"))


def dense_softmax(scores: DataFrame, temperature: float) -> DataFrame:
    """Softmax within each query of given scores; null or -infinity gets 0, and so do all if all are."""
    t, by = max(temperature, 1e-6), W.partitionBy("tenant", "query_id")
    finite = F.when(F.col("raw") > float("-inf"), F.col("raw"))
    top = F.max(finite).over(by)
    w = F.coalesce(F.exp((finite - top) / t), F.lit(0.0))
    out = scores.withColumn("w", w).withColumn("z", F.sum("w").over(by))
    return out.withColumn("p", F.when(F.col("z") < 1e-12, 0.0).otherwise(F.col("w") / F.col("z"))).drop("w", "z")


#: Rows of the bridge between entities and documents in a block of documents, and queries in a block.
BLOCK_ROWS, BLOCK_QUERIES = 1 << 21, 1 << 12
#: Documents of a block that give a query its first threshold.
HEAD = 512


class ImpactBlock:
    """Some documents, the largest first, and for every entity the places of those that name it.

    A document's place tells how many entities it has at most, so the best that a query can still find
    from a place on is known without looking: the sum of its heaviest entities, that many of them.
    """

    def __init__(self, entity: np.ndarray, doc: np.ndarray, order: np.ndarray) -> None:
        """``doc`` holds codes of documents, ``order`` the rank of each code's id."""
        sizes = np.bincount(doc, minlength=len(order))
        self.codes = np.lexsort((order, -sizes))  # of the document at each place
        self.sizes, self.ids = sizes[self.codes], order[self.codes]
        place = np.empty(len(order), np.int64)
        place[self.codes] = np.arange(len(order))
        self.entities, own = np.unique(entity, return_inverse=True)
        self.width = max(1, len(order))
        self.keys = np.sort(own * self.width + place[doc])  # by entity, then by place

    def _upto(self, entities: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """For entities (numbers in this block) their places before ``end``, end to end, and how many each has."""
        first = np.searchsorted(self.keys, entities * self.width)
        n = np.searchsorted(self.keys, entities * self.width + end) - first
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)
        return self.keys[at] % self.width, n

    def best(self, entity: np.ndarray, p: np.ndarray, background: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the best ``k`` documents for one query, and how many places were looked at.

        ``entity`` and ``p``: its scored entities and their probabilities; all others have ``background``.
        """
        at = np.searchsorted(self.entities, entity)
        at[at == len(self.entities)] = 0
        here = self.entities[at] == entity if len(self.entities) else np.zeros(len(entity), bool)
        at, p = at[here], p[here]
        gains = np.concatenate(([0.0], np.cumsum(np.sort(np.maximum(p - background, 0.0))[::-1])))
        bound = gains[np.minimum(self.sizes, len(p))] + self.sizes * background
        end = min(len(self.sizes), max(HEAD, 2 * k))
        while True:
            places, n = self._upto(at, end)
            if 8 * len(places) > end:  # dense
                mass, count = np.bincount(places, np.repeat(p, n), end), np.bincount(places, minlength=end)
                found = np.arange(end)
            else:
                found, own = np.unique(places, return_inverse=True)
                mass, count = np.bincount(own, np.repeat(p, n), len(found)), np.bincount(own, minlength=len(found))
                # of documents without a scored entity the largest are the best
                rest = np.setdiff1d(np.arange(min(end, k + len(found))), found, assume_unique=True)[:k]
                found = np.concatenate([found, rest])
                mass, count = (np.concatenate([x, np.zeros(len(rest))]) for x in (mass, count))
            scores = np.round(mass + (self.sizes[found] - count) * background, 9)
            best = best_places(scores, self.ids[found], k)
            least = scores[best[-1]] if len(best) == k else -np.inf
            # places from which on no document can be as good, with room for rounding
            stop = int(np.searchsorted(-(bound + 2e-9), -least, "right"))
            if stop <= end:
                return found[best], scores[best], end
            end = stop


def score_documents(found: DataFrame, background: DataFrame, entity_docs: DataFrame, k: int) -> DataFrame:
    """``(tenant, query_id, doc_id, score, rank)``: the best ``k`` documents (1 at least) by mass, ties by id.

    A document's mass is that of its scored entities and the background of its others.  Documents are dealt
    into blocks, in each of which they stand by size, and queries too; a pair of blocks looks at the documents of
    a query's entities from the largest document on, until none of the rest can be among its best, and gives
    ``k`` rows a query.  A row of a query, an entity and a document never exists, so an entity or token
    that many documents and queries share costs no more rows than another.
    """
    k = max(k, 1)
    spark = entity_docs.sparkSession
    doc_blocks = max(entity_docs.count() // BLOCK_ROWS + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    query_blocks = background.count() // BLOCK_QUERIES + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    docs = entity_docs.select("tenant", F.pmod(F.xxhash64("doc_id"), F.lit(doc_blocks)).cast("int").alias("d"), every(query_blocks).alias("q"), "entity_id", "doc_id")
    asked = found.select("tenant", "query_id", "entity_id", "p").unionByName(background.select("tenant", "query_id", F.lit(None).cast("long").alias("entity_id"), F.col("background").alias("p")))
    asked = asked.select("tenant", every(doc_blocks).alias("d"), F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int").alias("q"), "query_id", "entity_id", "p")
    kinds = {c: t for df in (asked, docs) for c, t in df.dtypes}
    names = ["tenant", "query_id", "doc_id", "score"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "score" else (left if c == "doc_id" else right).schema.field(c).type) for c in names})
        coded = left.column("doc_id").combine_chunks().dictionary_encode()
        ids = coded.dictionary
        order = np.empty(len(ids), np.int64)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        block = ImpactBlock(left.column("entity_id").to_numpy(), coded.indices.to_numpy(), order)
        asked = right.column("query_id").combine_chunks().dictionary_encode()
        entity = right.column("entity_id").combine_chunks()
        rest = entity.is_null().to_numpy(zero_copy_only=False)
        p, entity = right.column("p").to_numpy(), entity.fill_null(0).to_numpy()
        number = asked.indices.to_numpy()
        other = np.zeros(len(asked.dictionary))
        other[number[rest]] = p[rest]
        rows = np.flatnonzero(~rest)
        rows = rows[np.argsort(number[rows], kind="stable")]
        bounds = np.searchsorted(number[rows], np.arange(len(other) + 1)).tolist()
        out = [block.best(entity[rows[i:j]], p[rows[i:j]], other[n], k) for n, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False))]
        n = np.repeat(np.arange(len(out)), [len(x[0]) for x in out])
        first = right.column("tenant").combine_chunks().take(pa.array(np.zeros(len(n), np.int64)))
        return pa.table([first, asked.dictionary.take(pa.array(n)), ids.take(pa.array(block.codes[np.concatenate([x[0] for x in out])])), np.concatenate([x[1] for x in out])], names=names)

    by = ["tenant", "d", "q"]
    schema = ", ".join(f"{c} {'double' if c == 'score' else kinds[c]}" for c in names)
    scored = docs.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(best, schema)
    rank = F.row_number().over(W.partitionBy("tenant", "query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(*names, "rank")
