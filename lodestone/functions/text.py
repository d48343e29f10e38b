"""Text functions as Column expressions: tokens, profiles, facets, pages, model responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query plan leaves out.
STOPWORDS = (
    "the", "a", "an", "of", "to", "in", "is", "and", "or", "for", "on", "at", "by", "who", "what", "when", "where", "why", "how",
    "did", "does", "do", "was", "were", "be", "been", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "both", "between", "either", "neither", "with",
)
#: What separates the tokens of queries and embedded texts.
SEPARATORS = r"[^\p{L}\p{N}]+"
#: One run of capitalised tokens with single separators inside.
CAPITALISED_RUN = r"(?:^|[^\p{L}\p{N}])\p{Lu}[\p{L}\p{N}]*(?:[^\p{L}\p{N}]\p{Lu}[\p{L}\p{N}]*)*"
#: Fixed value: profiles that score this much go to the deeper model.
DEEP_SCORE = 25


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def trim_space(text: Column) -> Column:
    """Without white space at both ends; ``trim`` takes spaces alone."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def embedding_tokens(text: Column) -> Column:
    """Lower-case tokens of letters and digits, in order, repeats kept."""
    return F.transform(F.filter(F.split(text, SEPARATORS), lambda t: t != ""), F.lower)


def fallback_tokens(text: Column) -> Column:
    """Lower-case tokens of two bytes or more (counted before lower-casing)."""
    return F.transform(F.filter(F.split(text, SEPARATORS), lambda t: F.octet_length(t) >= 2), F.lower)


def query_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """``fallback_tokens`` without stopwords; repeats kept."""
    return F.filter(fallback_tokens(text), lambda t: ~F.array_contains(_texts(stopwords), t))


def name_tokens(name: Column) -> Column:
    """Distinct tokens of a name: lower case, split at white space alone."""
    return F.array_distinct(F.filter(F.split(F.lower(name), r"\s+"), lambda t: t != ""))


def plain_name(name: Column) -> Column:
    """A name with everything but letters and digits as single spaces, so that query tokens can match it."""
    return F.trim(F.regexp_replace(name, SEPARATORS, " "))


def bigrams(text: Column, least: int = 3) -> Column:
    """Pairs of neighbouring tokens of at least so many characters, lower case, joined by a space."""
    tokens = F.filter(F.transform(F.split(text, r"[^A-Za-z0-9_]+"), F.lower), lambda t: F.length(t) >= least)
    pairs = F.transform(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda t, i: F.concat_ws(" ", F.element_at(tokens, i + 1), t))
    return F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>"))


def profile(text: Column) -> dict[str, Column]:
    """Length in characters, sentence ends, runs of capitalised tokens, and the score they give."""
    length, sentences = F.length(text), F.regexp_count(text, F.lit("[.?!]"))
    phrases = F.regexp_count(text, F.lit(CAPITALISED_RUN))
    score = F.floor(length / 50) + 5 * phrases + 2 * sentences
    return {k: v.cast("long") for k, v in (("char_len", length), ("sentences", sentences), ("phrases", phrases), ("score", score))}


def route(score: Column, deep: int = DEEP_SCORE) -> Column:
    """Which model a profile score goes to."""
    return F.when(score >= deep, "deep").otherwise("light")


# lists in composed paragraphs -------------------------------------------------------------------------


def listed(text: Column, pattern: str) -> Column:
    """The comma-separated values of a pattern's first group, trimmed, empty ones left out."""
    parts = F.transform(F.split(F.regexp_extract(text, pattern, 1), ","), trim_space)
    return F.filter(parts, lambda p: p != "")


# pages ----------------------------------------------------------------------------------------------


def strip_tags(html: Column) -> Column:
    """Tags become spaces, white space single spaces, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"\s+", " "))


def page_fields(html: Column) -> dict[str, Column]:
    """Title, first heading, paragraphs and link targets of a page."""
    return {
        "title": strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "heading": strip_tags(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)),
        "paragraphs": F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1), strip_tags),
        "links": F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*href="([^"]*)"'), 1),
    }


# responses of language models -------------------------------------------------------------------------


def strip_think(text: Column) -> Column:
    """Without ``<think>`` sections; one that does not end takes the rest with it."""
    return trim_space(F.regexp_replace(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*\z", ""))


def strip_fence(text: Column) -> Column:
    """Without one Markdown fence around the whole."""
    return trim_space(F.regexp_replace(F.regexp_replace(trim_space(text), r"^```[A-Za-z]*\s*", ""), r"\s*```\z", ""))


def is_empty_payload(text: Column) -> Column:
    """Whether fewer than two characters are left between white space."""
    return F.coalesce(F.length(trim_space(text)) < 2, F.lit(True))


def is_yes(text: Column) -> Column:
    """A verdict: yes if it starts with Y."""
    return F.upper(trim_space(text)).startswith("Y")


def envelope_text(raw: Column) -> Column:
    """The payload of a JSON envelope: ``response``, else ``text``, else ``output``, else the raw text."""
    fields = [F.get_json_object(raw, f"$.{k}") for k in ("response", "text", "output")]
    return F.coalesce(*fields, raw)


#: What messages about a used up quota, and about too long a request, say.
QUOTA_MARKERS = ("usage limit", "rate limit exceeded", "weekly limit", "exceeded your", "quota exceeded")
CONTEXT_MARKERS = ("context window exceeds limit",)


def says(message: Column, markers: Sequence[str]) -> Column:
    """Whether an error message has one of the markers, in any case."""
    hit = F.lit(False)
    for m in markers:
        hit = hit | F.lower(message).contains(m)
    return F.coalesce(hit, F.lit(False))


def limit_in(message: Column, markers: Sequence[str] = CONTEXT_MARKERS) -> Column:
    """The number in parentheses behind a marker of an error message, null without one."""
    pattern = "(?is)(?:" + "|".join(markers) + r").*?\((\d{1,9})\)"
    return F.try_to_number(F.nullif(F.regexp_extract(message, pattern, 1), F.lit("")), F.lit("999999999")).cast("long")


def shrink(text: Column, limit: Column) -> Column:
    """The text cut to three characters a token of the limit, 500 at least."""
    return F.substring(text, F.lit(1), F.greatest(3 * limit, F.lit(500)).cast("int"))


def last_line(text: Column) -> Column:
    """The last line that is not blank, as of a response in JSON lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) > 0, F.element_at(lines, -1))


def first_object(text: Column) -> Column:
    """The first JSON object in a text by matching braces (quotes are not looked at); null without one."""
    rest = F.substring(text, F.instr(text, "{"), F.length(text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc, c):
        depth = acc["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), (acc["n"] + 1).alias("n"), F.when((acc["end"] == 0) & (depth == 0), acc["n"] + 1).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(F.split(rest, ""), start, step, lambda acc: acc["end"])
    return F.when((F.instr(text, "{") > 0) & (end > 0), F.substring(rest, F.lit(1), end))
