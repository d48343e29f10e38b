"""Patent pages: fields of their markup, validity, paragraphs, facets, triples, and documents with a sidecar."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.ids import document_key
from ..functions.text import bigrams, listed, strip_tags, trim_space

#: Caps of a record's lists and of what a paragraph and the triples take of them.
CLASSES, CITATIONS, NAMED, CLAIM_CHARS, INVENTORS = 5, 20, 5, 250, 8
MIN_ABSTRACT, MAX_CHARS = 80, 1500


# The names of items, sections and references below are those of the pages' markup.


def _item(name: str) -> str:
    """The value of a described item."""
    return rf'<dd itemprop="{name}"[^>]*>([^<]+)</dd>'


def _section(name: str) -> str:
    return rf'(?is)<section[^>]*itemprop="{name}"[^>]*>(.*?)</section>'


def _references(name: str) -> str:
    return rf'(?s)<tr itemprop="{name}(?:Orig|Family)"[^>]*>.*?<span itemprop="publicationNumber"[^>]*>([^<]+)</span>'


def fields(html: Column) -> dict[str, Column]:
    """The thirteen fields of a page; '' or an empty array where one is missing.

    Of the classes the five longest are kept (ties by text), of citations the first twenty distinct ones.
    """
    one = lambda pattern: F.regexp_extract(html, pattern, 1)
    every = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), 1)
    tagged, classed = r"(?is)<abstract[^>]*>(.*?)</abstract>", r'(?is)class="abstract[^"]*"[^>]*>(.*?)</div>'
    longest = F.array_sort(F.array_distinct(F.transform(every(r'<span itemprop="Code">([^<]+)</span>'), strip_tags)), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return {
        "number": F.trim(one(_item("publicationNumber"))),
        "title": strip_tags(one(r'(?i)<meta name="DC\.title" content="([^"]+)"')),
        "abstract": strip_tags(F.when(html.rlike(tagged), one(tagged)).otherwise(one(classed))),
        "inventors": F.transform(every(_item("inventor")), strip_tags),
        "assignees": F.transform(every(_item("assigneeOriginal")), strip_tags),
        "classes": F.slice(longest, 1, CLASSES),
        "filing": strip_tags(one(_item("filingDate"))),
        "claim": strip_tags(one(r'(?is)itemprop="claim"[^>]*>\s*<div[^>]*>(.*?)</div>')),
        "description": strip_tags(one(_section("description"))),
        "claims": strip_tags(one(_section("claims"))),
        "cites": F.slice(F.array_distinct(every(_references("backwardReferences"))), 1, CITATIONS),
        "cited_by": F.slice(F.array_distinct(every(_references("forwardReferences"))), 1, CITATIONS),
        "has_title": F.coalesce(html.rlike(r'(?i)<meta name="DC\.title" content="[^"]+"'), F.lit(False)),
    }


def status(f: Mapping[str, Column], least: int = MIN_ABSTRACT) -> Column:
    """``unparseable`` without a title or number, ``thin`` with a short abstract, else ``ok``."""
    return F.when(~f["has_title"] | (f["number"] == ""), "unparseable").when(F.length(f["abstract"]) < least, "thin").otherwise("ok")


#: What stands before and behind each list of a paragraph; ``facets`` reads what ``paragraph`` writes.
BY, ASSIGNED, CLASSED = "by ", "Assigned to ", "CPC classes: "


def paragraph(f: Mapping[str, Column], full: bool = False, max_chars: int = MAX_CHARS) -> Column:
    """One paragraph of the parts that are there: number and title, filing and inventors, assignees, classes, abstract.

    Then the beginning of the first claim or, with ``full``, all claims, the description and citations.
    """
    has = lambda name: F.size(f[name]) > 0 if name in ("inventors", "assignees", "classes", "cites", "cited_by") else f[name] != ""
    joined = lambda name, n=None: F.array_join(f[name] if n is None else F.slice(f[name], 1, n), ", ")
    dot = F.lit(".")
    filed = F.concat(F.lit("Filed "), f["filing"])
    parts = [
        F.concat(F.when(f["number"] == "", "PATENT").otherwise(f["number"]), F.lit(": "), f["title"], dot),
        F.when(has("filing"), F.when(has("inventors"), filed).otherwise(F.concat(filed, dot))),
        F.when(has("inventors"), F.concat(F.lit(BY), joined("inventors", NAMED), dot)),
        F.when(has("assignees"), F.concat(F.lit(ASSIGNED), joined("assignees"), dot)),
        F.when(has("classes"), F.concat(F.lit(CLASSED), joined("classes"), dot)),
        F.when(has("abstract"), F.concat(F.lit("Abstract: "), f["abstract"], F.when(f["abstract"].endswith("."), "").otherwise("."))),
    ]
    if full:
        parts += [F.when(has(name), F.concat(F.lit(head), f[name])) for name, head in (("claims", "Claims: "), ("description", "Description: "))]
        parts += [F.when(has(name), F.concat(F.lit(head), joined(name), dot)) for name, head in (("cites", "Cites: "), ("cited_by", "Cited by: "))]
    else:
        parts.append(F.when(has("claim"), F.concat(F.lit("First claim: "), F.substring(f["claim"], 1, CLAIM_CHARS), F.lit("..."))))
    text = F.concat_ws(" ", *parts)
    return F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars - 4), F.lit(" ..."))).otherwise(text)


def facets(text: Column) -> dict[str, Column]:
    """Inventors, assignees and classes of a paragraph as ``paragraph`` writes it (values hold no full stop)."""
    return {name: listed(text, rf"(?:^| ){head}([^.]+)\.") for name, head in (("inventors", BY), ("assignees", ASSIGNED), ("classes", CLASSED))}


def triples(records: DataFrame) -> DataFrame:
    """``(doc_id, triple_idx, src, rel, dst, src_type, dst_type)`` of records with the columns of ``fields``.

    A title and its pairs of words, inventors, assignees, classes, and citations both ways.
    """
    number = F.col("number")
    fact = lambda src, rel, dst, kinds: F.struct(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"), F.lit(kinds[0]).alias("src_type"), F.lit(kinds[1]).alias("dst_type"))
    concept = ("Concept", "Concept")
    title = F.regexp_replace(trim_space(F.col("title")), r"\.+\z", "")
    many = lambda column, rel, kinds, most=None, back=False: F.transform(column if most is None else F.slice(column, 1, most), lambda x: fact(x, rel, number, kinds) if back else fact(number, rel, x, kinds))
    facts = F.concat(
        F.array(fact(number, "titled", title, concept)),
        many(bigrams(F.col("title")), "mentions", concept),
        many(F.col("inventors"), "invented", ("Person", "Concept"), INVENTORS, back=True),
        many(F.col("assignees"), "assigned_to", ("Concept", "Org")),
        many(F.col("classes"), "classified_as", concept),
        many(F.col("cites"), "cites", concept),
        many(F.col("cited_by"), "cites", concept, back=True),
    )
    return records.select(document_key(number).alias("doc_id"), F.posexplode(facts).alias("triple_idx", "t")).select("doc_id", "triple_idx", "t.*")


def documents(pages: DataFrame, html: str = "html", file: str = "path", full: bool = False, least: int = MIN_ABSTRACT, max_chars: int = MAX_CHARS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents ``(doc_id, text)``, their sidecar ``(doc_id, number, title, file)``, and counters of all pages.

    Of several pages of one number the first by file wins.  Counters are one row: ``scanned, emitted,
    unparseable, thin, repeated``.
    """
    f = fields(F.col(html))
    names = [n for n in f if n != "has_title"]
    parsed = pages.select(F.col(file).alias("file"), *[f[n].alias(n) for n in names], status(f, least).alias("status"))
    rank = F.row_number().over(W.partitionBy("number").orderBy("file"))
    good = parsed.where("status = 'ok'").withColumn("rank", rank)
    first = good.where("rank = 1").withColumn("doc_id", document_key(F.col("number")))
    docs = first.select("doc_id", paragraph({n: F.col(n) for n in names}, full, max_chars).alias("text"))
    of = lambda s: F.sum((F.col("status") == s).cast("long"))
    seen = parsed.agg(F.count("*").alias("scanned"), of("unparseable").alias("unparseable"), of("thin").alias("thin"), F.countDistinct(F.when(F.col("status") == "ok", F.col("number"))).alias("emitted"), of("ok").alias("good"))
    counters = seen.select("scanned", "emitted", "unparseable", "thin", (F.col("good") - F.col("emitted")).alias("repeated"))
    return docs, first.select("doc_id", "number", "title", "file"), counters


def write_documents(pages: DataFrame, path: str, **how) -> DataFrame:
    """Write documents and sidecar as JSON lines below ``path``; returns the counters."""
    docs, sidecar, counters = documents(pages, **how)
    docs.write.json(f"{path}/documents")
    sidecar.write.json(f"{path}/sidecar")
    return counters
