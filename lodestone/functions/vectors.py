"""Vector functions: cosine, hashed bag-of-words embeddings, exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .text import embedding_tokens

DIM = 128


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where lengths differ or one is empty."""
    add = lambda acc, x: acc + x
    zero = F.lit(0.0)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), zero, add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), zero, add))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot / F.greatest(norm(a) * norm(b), F.lit(1e-12))).otherwise(zero)


def hashed_buckets(texts: DataFrame, key: str, text: str, dim: int = DIM) -> DataFrame:
    """Sparse hashed embeddings: ``(key, bucket, weight)``, unit length.

    A token's hash picks its bucket and, by its second bit, a sign.  For powers of two the sign follows
    from the bucket, so weights never cancel and cosines are never negative.
    """
    if dim < 4:
        raise ValueError("at least 4 dimensions")
    h = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("long")
    tokens = texts.select(key, F.explode(embedding_tokens(F.col(text))).alias("token"))
    sign = F.when(h.bitwiseAND(F.lit(2)) == 0, 1.0).otherwise(-1.0)
    counts = tokens.groupBy(key, (h % dim).alias("bucket")).agg(F.sum(sign).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(W.partitionBy(key)))
    return counts.withColumn("norm", norm).where("norm > 1e-9").select(key, "bucket", (F.col("raw") / F.col("norm")).alias("weight"))


def embedding_arrays(texts: DataFrame, keys: Sequence[str], text: str, dim: int = DIM) -> DataFrame:
    """Dense hashed embeddings: ``keys`` and ``e``, an array of ``dim`` numbers; all are 0 where a text has no token."""
    packed = texts.select(F.struct(*keys).alias("key_"), F.col(text).alias("text_"))
    sparse = hashed_buckets(packed, "key_", "text_", dim)
    weights = sparse.groupBy("key_").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("w"))  # ``dim`` entries at most
    dense = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long")), lambda i: F.coalesce(F.col("w")[i], F.lit(0.0)))
    zeros = F.array(*[F.lit(0.0)] * dim)
    return texts.select(*keys).join(weights.select("key_.*", dense.alias("e")), list(keys), "left").withColumn("e", F.coalesce("e", zeros))


def sparse_cosine(a: DataFrame, b: DataFrame, key_a: str, key_b: str) -> DataFrame:
    """``(key_a, key_b, cos)`` of all pairs that share a bucket; every other pair has cosine 0."""
    left = a.select(F.col(key_a), "bucket", F.col("weight").alias("wa"))
    right = b.select(F.col(key_b), "bucket", F.col("weight").alias("wb"))
    return left.join(right, "bucket").groupBy(key_a, key_b).agg(F.sum(F.col("wa") * F.col("wb")).alias("cos"))


def best_places(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, best first, ties by id; only those few are sorted."""
    if 0 < k < len(scores):
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, tied = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        places = np.concatenate([above, tied[np.argsort(ids[tied], kind="stable")[: k - len(above)]]])
    else:
        places = np.arange(len(scores) if k else 0)
    return places[np.lexsort((ids[places], -scores[places]))]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", embedding: str = "embedding", query: str = "query_id", rows: int = 65_536, block: int = 1024, group: str | None = None) -> DataFrame:
    """Exact nearest neighbours: ``(query, key, cos, rank)`` for each query, best first, ties by key.

    With ``group``, a column of both tables, a query meets the vectors of its own group alone; the
    result has that column too.

    Vectors are dealt into parts of about ``rows``, queries into blocks of about ``block``; each pair
    of a part and a block is one matrix product that returns ``k`` rows a query.  ``k`` of 0 gives
    nothing.  Vectors of another length than a query's, and null ones, are not compared with it.
    """
    of = F.lit(0).cast("long") if group is None else F.col(group)
    carry = [] if group is None else [F.col("g").alias(group)]
    if k <= 0:
        return vectors.select(of.alias("g"), F.col(key).alias(query), key, F.lit(0.0).alias("cos"), F.lit(1).alias("rank")).where("false").select(*carry, query, key, "cos", "rank")
    parts = vectors.agg(F.greatest(F.ceil(F.count("*") / rows), F.lit(1))).first()[0]
    blocks = queries.agg(F.greatest(F.ceil(F.count("*") / block), F.lit(1))).first()[0]
    double = F.transform(F.col(embedding), lambda x: x.cast("double"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    v = vectors.where(F.col(embedding).isNotNull()).select(of.alias("g"), F.pmod(F.xxhash64(key), F.lit(parts)).alias("part"), every(blocks).alias("block"), F.col(key).alias("id"), double.alias("e"))
    q = queries.where(F.col(embedding).isNotNull()).select(of.alias("g"), F.pmod(F.xxhash64(query), F.lit(blocks)).alias("block"), every(parts).alias("part"), F.col(query).alias("q"), double.alias("e"))
    kinds = {n: t for n, t in [("g", v.schema["g"].dataType.simpleString()), ("q", q.schema["q"].dataType.simpleString()), ("id", v.schema["id"].dataType.simpleString()), ("cos", "double")]}
    empty = pd.DataFrame({n: pd.Series([], dtype="float64" if t == "double" else "int64" if t in ("int", "bigint") else "object") for n, t in kinds.items()})

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in set(map(len, right["e"])):
            qs, vs = right[right["e"].map(len) == size], left[left["e"].map(len) == size]
            if not size or vs.empty:
                continue
            a, b, ids = np.stack(qs["e"]), np.stack(vs["e"]), vs["id"].to_numpy()
            sims = np.round((a @ b.T) / np.maximum(np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :], 1e-12), 9)
            for i, name in enumerate(qs["q"]):
                order = best_places(sims[i], ids, k)
                out.append(pd.DataFrame({"g": qs["g"].iloc[0], "q": name, "id": ids[order], "cos": sims[i][order]}))
        return pd.concat(out) if out else empty

    by = ["g", "part", "block"]
    found = v.groupBy(*by).cogroup(q.groupBy(*by)).applyInPandas(best, ", ".join(f"{n} {t}" for n, t in kinds.items()))
    rank = F.row_number().over(W.partitionBy("g", "q").orderBy(F.desc("cos"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(*carry, F.col("q").alias(query), F.col("id").alias(key), "cos", "rank")

