"""From raw triples to clean ones: sanitising, types, caps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import entity_id

#: Relations that are kept as they are.
RELATIONS = (
    "is_a", "part_of", "located_in", "founded_by", "founded", "works_at", "knows", "related_to", "causes", "treats", "next",
    "previous", "subclass_of", "instance_of", "occurred_at", "produced_by", "produced", "uses", "used_by", "depends_on", "supports",
)
#: Bytes and characters that a name may have.
MAX_NAME_BYTES, NAME_PATTERN = 96, r"\A[A-Za-z0-9 _.\-,/()']+\z"
OTHER_RELATION = "related_to"


def _name_fault(name: Column) -> Column:
    return (
        F.when(F.coalesce(name, F.lit("")) == "", "NameEmpty")
        .when(F.octet_length(name) > MAX_NAME_BYTES, "NameTooLong")
        .when(~name.rlike(NAME_PATTERN), "NameInvalid")
    )


def sanitize(triples: DataFrame, blocklist: Sequence[str] = (), coerce: bool = True, relations: Sequence[str] = RELATIONS) -> DataFrame:
    """Add ``reject_reason`` (null: accepted) and set unknown relations to ``related_to``.

    Checked in this order: source name, target name, empty relation, blocked strings (case-sensitive,
    anywhere in a name or the relation), and, without ``coerce``, unknown relations.
    """
    blocked = F.lit(False)
    for needle in blocklist:
        for c in ("src", "dst", "rel"):
            blocked = blocked | F.col(c).contains(needle)
    unknown = ~F.col("rel").isin(*relations)
    reason = F.coalesce(_name_fault(F.col("src")), _name_fault(F.col("dst")))
    reason = F.coalesce(reason, F.when(F.coalesce(F.col("rel"), F.lit("")) == "", "RelationEmpty"), F.when(blocked, "Blocked"))
    if not coerce:
        reason = F.coalesce(reason, F.when(unknown, "RelationUnknown"))
    out = triples.withColumn("reject_reason", reason)
    return out.withColumn("rel", F.when(F.col("reject_reason").isNull() & unknown, OTHER_RELATION).otherwise(F.col("rel")))


def entity_type(raw: Column) -> Column:
    """A writer's type string: known ones in any case, others as they are written; empty is a concept."""
    low = F.lower(F.trim(raw))
    return (
        F.when(F.coalesce(low, F.lit("")) == "", "concept")
        .when(low.isin("person", "org", "concept", "event", "time"), low)
        .when(low == "organization", "org")
        .otherwise(F.concat(F.lit("custom:"), raw))
    )


def type_hint(raw: Column) -> Column:
    """A planner's type string: exact case after trimming; empty, null and None are no hint."""
    text = F.trim(raw)
    return F.when(text.isin("", "null", "None") | text.isNull(), None).when(text.isin("Person", "Org", "Concept", "Event", "Time"), F.lower(text)).otherwise(F.concat(F.lit("custom:"), text))


def mentions(triples: DataFrame) -> DataFrame:
    """Both ends of every triple: ``(tenant, doc_id, seq, name, etype, entity_id)``; sources come before targets.

    ``seq`` orders the mentions of a document as an ingest reads them.  Ids are those that the triples
    bring (``src_id``, ``dst_id``), or are made from the names.
    """
    kind = lambda c: entity_type(F.col(c)) if c in triples.columns else F.lit("concept")
    given = lambda c: F.col(f"{c}_id") if f"{c}_id" in triples.columns else entity_id(F.col(c))
    side = lambda i, name, t: F.struct(F.lit(i).alias("i"), F.col(name).alias("name"), t.alias("etype"), given(name).alias("entity_id"))
    both = triples.select("tenant", "doc_id", "triple_idx", F.explode(F.array(side(0, "src", kind("src_type")), side(1, "dst", kind("dst_type")))).alias("m"))
    return both.select("tenant", "doc_id", (F.col("triple_idx") * 2 + F.col("m.i")).alias("seq"), "m.name", "m.etype", "m.entity_id")
