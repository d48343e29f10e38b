"""Mixing sources to target weights: temperature, bisection, budgeted block permutations."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import free_name, materialise

#: Words, counted as tokens unless a token column is given.
WORDS = r"[^\x20\x09-\x0D]+"
#: Sources at most (their totals go to the driver, which finds the exponent).
MAX_SOURCES = 100_000
#: Blocks into which the documents of each source are dealt.
BLOCKS = 1 << 12


def tempered(tokens: Sequence[float], exponent: float) -> np.ndarray:
    """Shares raised to ``exponent``, normalised; sources without tokens get 0."""
    t = np.asarray(tokens, float)
    out = np.zeros(len(t))
    has = t > 0
    if has.any():
        x = exponent * np.log(t[has] / t[has].sum())
        e = np.exp(x - x.max())
        out[has] = e / e.sum()
    return out


def entropy(weights: np.ndarray) -> float:
    w = weights[weights > 0]
    return float(-(w * np.log(w)).sum())


def find_exponent(tokens: Sequence[float], budget: float, target_entropy: float | None = None, repetition_limit: float | None = None, steps: int = 100) -> float:
    """Bisect the exponent of the shares.

    With ``target_entropy`` (nats): the exponent from 0 (uniform) to 64 at which the weights have that
    entropy; targets outside what these reach give the nearer end.  With ``repetition_limit``: the
    smallest exponent from 0 to 1 at which no source is passed through more often than that with
    ``budget`` tokens in all; the limit must be at least budget / all tokens, which exponent 1 needs.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either an entropy or a repetition limit")
    t = np.asarray(tokens, float)
    if not (t > 0).any():
        return 1.0
    if target_entropy is not None:
        low, high = 0.0, 64.0
        too_flat = lambda a: entropy(tempered(t, a)) > target_entropy
    else:
        if repetition_limit * t.sum() < budget * (1 - 1e-12):
            raise ValueError("the budget cannot be met within the repetition limit")
        low, high = 0.0, 1.0
        has = t > 0
        too_flat = lambda a: bool((tempered(t, a)[has] * budget / t[has]).max() > repetition_limit)
    if not too_flat(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if too_flat(mid) else (low, mid)
    return high


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", tokens: str | None = None, budget: float | None = None, target_entropy: float | None = None, repetition_limit: float | None = None, seed: int = 0, blocks: int = BLOCKS) -> DataFrame:
    """Add ``n_tokens``, ``weight``, ``block``, ``pass_start``, ``copies`` to every row of ``docs``.

    ``weight`` is the source's tempered share (see ``find_exponent``) of ``budget`` tokens (default:
    all tokens of the corpus).  The budget of a source is spent in passes through a block permutation
    of its documents: blocks come in the order of a seeded hash, documents in a block likewise.
    Whole passes take every document; the last, partial pass takes those that start before what is
    left of the budget, so a source exceeds its budget by less than one document.  ``pass_start``
    counts the source's tokens before the document in that order; ``copies`` is how often it is
    taken (0: not at all).

    Tokens are words of the whole text unless a column is named.  A null source is a source of its own;
    a null text or token count is 0 tokens; documents without tokens are taken in whole passes and
    where they start before the end.  Repeated rows count as rows of their own.  Ties of the hash are
    decided by key and text.  An empty table gives an empty result.  Input columns with the added names
    are replaced.

    A source may hold any share of the rows: totals come from partial aggregation, positions from
    blocks of about rows / ``blocks`` documents.  The driver sees one row for each source
    (``MAX_SOURCES`` at most).
    """
    spark = docs.sparkSession
    made = ("n_tokens", "weight", "block", "pass_start", "copies")
    size = F.regexp_count(F.col(text), F.lit(WORDS)) if tokens is None else F.col(tokens)
    base = docs.select(*[c for c in docs.columns if c not in made], F.coalesce(size, F.lit(0)).cast("long").alias("n_tokens"))
    s, b, inside, start, taken_from, block_of, passes, rest = (free_name(docs, c) for c in ("mix_source", "mix_block", "mix_inside", "mix_start", "mix_from", "mix_of", "mix_passes", "mix_rest"))
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(F.col(text)))
    base = base.withColumn(s, F.col(source).cast("string")).withColumn("block", F.pmod(hashed, F.lit(blocks)).cast("int"))
    sizes = materialise(base.groupBy(s, "block").agg(F.sum("n_tokens").alias(b)), "blocks")
    totals = sizes.groupBy(s).agg(F.sum(b).alias("t")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = sorted(totals, key=lambda r: (r[0] is not None, r[0] or ""))
    amounts = [float(r["t"]) for r in totals]
    whole = float(budget if budget is not None else sum(amounts))
    weights = tempered(amounts, find_exponent(amounts, whole, target_entropy, repetition_limit))
    plan = []
    for r, w, t in zip(totals, weights.tolist(), amounts, strict=True):
        n = math.floor(w * whole / t + 1e-9) if t else 0
        plan.append((r[0], w, n, w * whole - n * t))
    schema = T.StructType([T.StructField(taken_from, T.StringType()), T.StructField("weight", T.DoubleType()), T.StructField(passes, T.LongType()), T.StructField(rest, T.DoubleType())])
    of_source = F.broadcast(spark.createDataFrame(plan, schema))  # one row for each source, bounded above
    turn = F.xxhash64(F.lit(seed), F.lit("block"), "block")
    before = F.coalesce(F.sum(b).over(W.partitionBy(s).orderBy(turn, "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    from_ = free_name(base, taken_from + "_block")
    starts = sizes.select(F.col(s).alias(from_), F.col("block").alias(block_of), before.alias(start))
    inner = W.partitionBy(s, "block").orderBy(F.xxhash64(F.lit(seed + 1), F.coalesce(F.col(key).cast("string"), F.lit(""))), key, F.xxhash64(F.col(text))).rowsBetween(W.unboundedPreceding, -1)
    out = base.withColumn(inside, F.coalesce(F.sum("n_tokens").over(inner), F.lit(0)))
    out = out.join(starts, out[s].eqNullSafe(starts[from_]) & (out["block"] == starts[block_of]))
    out = out.join(of_source, out[s].eqNullSafe(of_source[taken_from])).withColumn("pass_start", F.col(start) + F.col(inside))
    taken = F.col(passes) + F.when(F.col("pass_start") < F.col(rest) - 1e-6, 1).otherwise(0)
    return out.withColumn("copies", taken.cast("long")).select(*[c for c in docs.columns if c not in made], *made)


def realise(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every row as often as ``mix`` takes it, with the columns of ``docs``."""
    packed = free_name(docs, "the_row")
    cols = [F.col(c) for c in docs.columns]
    names = {"source": "source", "key": "doc_id", "text": "text"} | {k: how.pop(k) for k in ("source", "key", "text") if k in how}
    slim = docs.select(F.struct(*cols).alias(packed), *(F.col(v).alias(k) for k, v in names.items()))
    mixed = mix(slim, "source", "key", "text", **how)
    return mixed.where("copies > 0").select(packed, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(f"{packed}.*")
