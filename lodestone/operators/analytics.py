"""Corpus analytics: facets, gaps, moats, overlaps, co-occurrence, hubs, ground truth by predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def facet_counts(docs: DataFrame, facet: str, top: int | None = None) -> DataFrame:
    """``(facet, n, rank)``: rows by facet value (arrays are exploded), most first, ties by value."""
    value = F.explode(facet) if dict(docs.dtypes)[facet].startswith("array") else F.col(facet)
    counts = docs.select(value.alias(facet)).groupBy(facet).agg(F.count("*").alias("n"))
    if top is not None:
        counts = counts.orderBy(F.desc("n"), facet).limit(top)
    # one row for each value; ranks of a report
    return counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), facet)))


def concentration(docs: DataFrame, group: str, facet: str, top: int = 3) -> DataFrame:
    """Share (percent, one decimal) of a group's rows that its ``top`` facet values hold."""
    counts = docs.groupBy(group, facet).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("n"), facet))
    best = counts.withColumn("r", rank)
    return best.groupBy(group).agg(F.sum("n").alias("total"), F.round(100.0 * F.sum(F.when(F.col("r") <= top, F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1)), 1).alias("share"))


def _any(text: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w.lower()))
    return hit


def theme_hits(docs: DataFrame, themes: Mapping[str, Sequence[str]], target: Column, text: str = "text") -> DataFrame:
    """``(theme, target_hits, other_hits)``: documents whose lower-case text has any keyword, in one pass."""
    low = F.lower(F.col(text))
    sums = []
    for name, words in themes.items():
        hit = F.coalesce(_any(low, words), F.lit(False))
        sums.append(F.struct(F.lit(name).alias("theme"), F.sum((hit & target).cast("long")).alias("target_hits"), F.sum((hit & ~target).cast("long")).alias("other_hits")))
    one = docs.agg(F.array(*sums).alias("t"))
    return one.select(F.explode("t").alias("t")).select("t.theme", F.coalesce("t.target_hits", F.lit(0)).alias("target_hits"), F.coalesce("t.other_hits", F.lit(0)).alias("other_hits"))


def gap_matrix(hits: DataFrame) -> DataFrame:
    """Add ``status`` (fixed values) and ``severity`` to theme hits, checked in this order: none, gap, under-invested, lead."""
    t, o = F.col("target_hits"), F.col("other_hits")
    status = (
        F.when((t == 0) & (o == 0), "WHITE-SPACE").when(t == 0, "CLEAR-GAP").when((t * 3 < o) & (o >= 3), "UNDER-INVESTED").when(t >= o, "TARGET-LEAD").otherwise("CONTESTED")
    )
    return hits.withColumns({"status": status, "severity": F.round((o + 1) / (t + 1), 2)})


def moats(hits: DataFrame, smooth: bool = True) -> DataFrame:
    """Ratio of target to other hits of themes that the target has; ``smooth`` adds one above as well."""
    return hits.where("target_hits > 0").withColumn("ratio", (F.col("target_hits") + (1 if smooth else 0)) / (F.col("other_hits") + 1))


def overlap(hits_a: DataFrame, hits_b: DataFrame) -> DataFrame:
    """Themes of two parties: hits of each and whether both, one or none has it."""
    a = hits_a.select("theme", F.col("target_hits").alias("a"))
    both = a.join(hits_b.select("theme", F.col("target_hits").alias("b")), "theme")
    return both.withColumn("kind", F.when((F.col("a") > 0) & (F.col("b") > 0), "shared").when(F.col("a") > 0, "only_a").when(F.col("b") > 0, "only_b").otherwise("none"))


def co_occurrence(rows: DataFrame, doc: str, item: str) -> DataFrame:
    """``(a, b, n)``: documents in which two distinct items meet, a < b.

    Pairs are made inside a document; its distinct items are few by nature (authors, parts of an order).
    """
    distinct = rows.select(doc, item).distinct()
    a, b = distinct.withColumnRenamed(item, "a"), distinct.withColumnRenamed(item, "b")
    return a.join(b, doc).where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def hub_histogram(entity_docs: DataFrame) -> DataFrame:
    """``(n_docs, entities)``: how many entities appear in so many documents."""
    per = entity_docs.groupBy("tenant", "entity_id").agg(F.count("*").alias("n_docs"))
    return per.groupBy("n_docs").agg(F.count("*").alias("entities"))


def top_hubs(entity_docs: DataFrame, entities: DataFrame, top: int = 20) -> DataFrame:
    """Entities with most documents, ties by name descending."""
    per = entity_docs.groupBy("tenant", "entity_id").agg(F.count("*").alias("n_docs"))
    return per.join(entities, ["tenant", "entity_id"]).orderBy(F.desc("n_docs"), F.desc("name"), "tenant").limit(top).select("tenant", "name", "n_docs")


def inverted_index(docs: DataFrame, facet: str, key: str = "doc_id", least: int = 1) -> DataFrame:
    """``(facet, key)`` rows for facet values of at least ``least`` documents; a row for each document, not one list."""
    rows = docs.select(F.col(facet).alias("facet"), F.col(key)).where("facet is not null").distinct()
    # one row for each value, so Spark broadcasts them while they are few and splits a hot value's rows if not
    many = rows.groupBy("facet").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(many, "facet").select("facet", key, "n")


def facet_pairs(docs: DataFrame, a: str, b: str, key: str = "doc_id", least: int = 3) -> DataFrame:
    """Documents that two facet values share, for pairs with at least ``least``."""
    return docs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.countDistinct(key).alias("n")).where(F.col("n") >= least)


def selector(spec: Mapping, text: Column, facets: Mapping[str, Column]) -> Column:
    """A ground-truth predicate: the conjunction of what the spec names.

    ``keyword_any``, ``keyword_all``, ``exclude_kw`` look in the lower-case text; ``equals`` and ``differs``
    compare facets; ``prefix`` wants any value of an array facet (or the facet) to start so; ``pin`` names
    one key and stands alone.
    """
    low = F.lower(text)
    if spec.get("pin") is not None:
        return facets["key"] == spec["pin"]
    out = F.lit(True)
    if spec.get("keyword_any"):
        out = out & _any(low, spec["keyword_any"])
    for w in spec.get("keyword_all", ()):
        out = out & low.contains(w.lower())
    if spec.get("exclude_kw"):
        out = out & ~_any(low, spec["exclude_kw"])
    for name, value in spec.get("equals", {}).items():
        out = out & (facets[name] == value)
    for name, value in spec.get("differs", {}).items():
        out = out & (facets[name] != value)
    for name, value in spec.get("prefix", {}).items():
        out = out & facets[name].startswith(value)
    return F.coalesce(out, F.lit(False))


def ground_truth(docs: DataFrame, specs: Mapping[str, Mapping], facets: Mapping[str, Column], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(query, key)`` for every spec and each document that it selects, in one pass over the documents."""
    hits = F.array(*[F.when(selector(s, F.col(text), facets), F.lit(name)) for name, s in specs.items()])
    return docs.select(F.col(key), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("query"))


def without_truth(truth: DataFrame, specs: Mapping[str, Mapping]) -> DataFrame:
    """``(query)``: the specs that select no document, which an evaluation leaves out."""
    every = truth.sparkSession.createDataFrame([(n,) for n in specs], "query string")
    return every.join(truth.select("query").distinct(), "query", "left_anti")


def first_hits(docs: DataFrame, themes: Mapping[str, Sequence[str]], top: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(theme, key, rank)``: of each theme the first ``top`` documents by key that have a keyword; tasks keep no more."""
    low = F.lower(F.col(text))
    named = F.array(*[F.when(F.coalesce(_any(low, words), F.lit(False)), F.lit(n)) for n, words in themes.items()])
    hits = docs.select(F.col(key), F.explode(F.filter(named, lambda x: x.isNotNull())).alias("theme"))
    rank = F.row_number().over(W.partitionBy("theme").orderBy(key))
    return hits.withColumn("rank", rank).where(F.col("rank") <= top)


def top_coverage(docs: DataFrame, target: Column, facet: str, themes: Mapping[str, Sequence[str]], text: str = "text") -> DataFrame:
    """``(facet, theme, hits, total)``: how many documents of the target's most frequent facet value have each theme."""
    own = docs.where(target)
    top = own.groupBy(facet).agg(F.count("*").alias("total")).orderBy(F.desc("total"), facet).limit(1)  # one row
    of_top = own.join(F.broadcast(top), facet)
    low = F.lower(F.col(text))
    sums = [F.struct(F.lit(n).alias("theme"), F.sum(F.coalesce(_any(low, words), F.lit(False)).cast("long")).alias("hits")) for n, words in themes.items()]
    return of_top.groupBy(facet, "total").agg(F.array(*sums).alias("t")).select(facet, "total", F.explode("t").alias("t")).select(facet, "t.theme", "t.hits", "total")


def landscape(results: DataFrame, docs: DataFrame, facet: str, target: str, key: str = "doc_id", top: int = 20) -> DataFrame:
    """Retrieved documents by facet value, most first, with a mark on the target; unknown ids are left out."""
    counts = results.join(docs.select(key, facet), key).groupBy(facet).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), facet).limit(top).withColumn("is_target", F.col(facet) == target)
