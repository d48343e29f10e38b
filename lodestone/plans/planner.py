"""Query plans: what a query's text asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fallback_tokens, first_object, query_tokens, strip_fence, strip_think
from ..operators.extract import type_hint

CONSTRAINTS = "array<struct<kind:string,value:string>>"


def heuristic_plan(queries: DataFrame, text: str = "text") -> DataFrame:
    """Add ``expansions`` and ``aliases`` (the query's tokens), ``etype_hint`` and ``probes``; one probe, the text."""
    tokens = query_tokens(F.col(text))
    probes = F.array(F.struct(F.col(text).alias("text"), F.lit(1.0).alias("alpha")))
    out = queries.withColumns({"expansions": tokens, "aliases": tokens, "etype_hint": F.lit(None).cast("string"), "probes": probes})
    return out if "constraints" in queries.columns else out.withColumn("constraints", F.lit(None).cast(CONSTRAINTS))


PLAN = "expansions array<string>, aliases array<string>, etype string, probes array<string>"


def parsed_answers(raw: DataFrame, response: str = "response") -> DataFrame:
    """``(text, expansions, aliases, etype, probes)`` from a model's raw answers ``(text, response)``.

    The first JSON object of a response counts, whatever prose or fence is around it; rows without one
    are left out, so that their queries get the heuristic plan.
    """
    found = raw.select("text", F.from_json(first_object(strip_fence(strip_think(F.col(response)))), PLAN).alias("p"))
    return found.where("p is not null").select("text", "p.*")


def model_plan(queries: DataFrame, answers: DataFrame, text: str = "text") -> DataFrame:
    """Plans from a model's answers, keyed by query text; queries without one get the heuristic plan.

    ``answers`` has ``text, expansions, aliases, etype, probes`` (arrays of strings).  Expansions and aliases
    are trimmed, lower-cased and emptied of blanks; tokens of the query that are not among the
    expansions follow them; probes weigh 0.7 behind the query's own.  Each text is planned once.
    """
    clean = lambda c: F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    given = answers.dropDuplicates(["text"]).select(F.col("text").alias("t_"), clean("expansions").alias("e_"), clean("aliases").alias("a_"), type_hint(F.col("etype")).alias("h_"), F.coalesce(F.col("probes"), F.array().cast("array<string>")).alias("p_"))
    base = heuristic_plan(queries, text).join(given, F.col(text) == F.col("t_"), "left")
    more = F.filter(F.array_distinct(fallback_tokens(F.col(text))), lambda x: ~F.array_contains(F.col("e_"), x))
    found = F.col("t_").isNotNull()
    probes = F.concat(F.col("probes"), F.transform("p_", lambda p: F.struct(p.alias("text"), F.lit(0.7).alias("alpha"))))
    out = base.withColumns({"expansions": F.when(found, F.concat("e_", more)).otherwise(F.col("expansions")), "aliases": F.when(found, F.col("a_")).otherwise(F.col("aliases")), "etype_hint": F.col("h_"), "probes": F.when(found, probes).otherwise(F.col("probes"))})
    return out.drop("t_", "e_", "a_", "h_", "p_")
