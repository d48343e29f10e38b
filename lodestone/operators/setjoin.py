"""Pairs of token sets with a Jaccard similarity of a threshold or more, without a join on common tokens.

Tokens are ordered by rarity.  Two sets of given sizes that are similar enough share a token among the first
few of both, and the more alike they must be the fewer: a set sends each of these to the sizes that
a partner may have, in bands, and meets there only sets that sent the same.  What meets is verified by
the whole sets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import cut

#: Sets up to this size have a band for each size; beyond, a band is a tenth wide.
SINGLE = 16


@dataclass
class SimilarSets:
    """``pairs``: ``a, b, common, jaccard`` of representatives, a < b; ``members``: ``id, of``, the representative of each row.

    Rows with equal sets have one representative, the smallest id, and are not paired with each other.
    """

    pairs: DataFrame
    members: DataFrame

    def expanded(self) -> DataFrame:
        """``a, b, jaccard`` of all rows, also of those with equal sets (for small groups of equal ones)."""
        left, right = (self.members.select(F.col("id").alias(x), F.col("of").alias(f"{x}_of")) for x in ("x", "y"))
        apart = self.pairs.select(F.col("a").alias("x_of"), F.col("b").alias("y_of"), "jaccard").join(left, "x_of").join(right, "y_of")
        same = left.join(right, F.col("x_of") == F.col("y_of")).where("x < y").withColumn("jaccard", F.lit(1.0))
        both = apart.select("x", "y", "jaccard").unionByName(same.select("x", "y", "jaccard"))
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def bands(largest: int) -> list[int]:
    """The smallest size of each band, up to ``largest``."""
    out = list(range(1, min(largest, SINGLE) + 1))
    while out and out[-1] * 1.1 < largest:
        out.append(max(out[-1] + 1, math.ceil(out[-1] * 1.1)))
    return out


def prefixes(sets: DataFrame, starts: list[int], threshold: float) -> DataFrame:
    """``token, low, high, id, size, at``: the tokens by which a set can meet partners in each band it may have some in."""
    t = threshold
    ends = [*(s - 1 for s in starts[1:]), 1 << 30]
    every = F.array(*[F.struct(F.lit(n).alias("band"), F.lit(a).alias("first"), F.lit(b).alias("last")) for n, (a, b) in enumerate(zip(starts, ends, strict=True))])
    size = F.col("size")
    reach = F.filter(every, lambda b: (b["first"] <= F.floor(size / t + 1e-9)) & (b["last"] >= F.ceil(size * t - 1e-9)))
    own = F.element_at(F.filter(every, lambda b: (b["first"] <= size) & (size <= b["last"])), 1)["band"]
    met = sets.withColumn("own", own).withColumn("b", F.explode(reach))
    least = F.greatest(F.col("b.first").cast("double"), F.ceil(size * t - 1e-9).cast("double"))  # a partner's size
    need = F.greatest(F.ceil(t / (1 + t) * (size + least) - 1e-9), F.lit(1))  # tokens in common
    sent = met.select("id", "size", F.least("own", "b.band").alias("low"), F.greatest("own", "b.band").alias("high"), (F.col("own") <= F.col("b.band")).alias("small"), (F.col("own") >= F.col("b.band")).alias("large"), F.posexplode(F.slice("tokens", F.lit(1), F.greatest(size - need + 1, F.lit(0)).cast("int"))).alias("at", "token"))
    return sent.where("at >= 0")


def similar_sets(rows: DataFrame, threshold: float, key: str = "id", tokens: str = "tokens") -> SimilarSets:
    """All pairs of rows whose sets have a Jaccard similarity of ``threshold`` (above 0) or more.

    Null and empty sets are similar to nothing; repeated tokens count once; null tokens are ignored.  Rows with
    a null key are left out.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and 1 at most")
    given = rows.select(F.col(key).alias("id"), F.array_distinct(F.array_compact(F.col(tokens))).alias("tokens")).where("id is not null and size(tokens) > 0")
    each = cut(given.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.min("id").alias("of")), "sets")
    members = given.select("id", F.array_sort("tokens").alias("tokens")).join(each, "tokens").select("id", "of")
    said = each.select("of", F.explode("tokens").alias("token"))
    rarity = said.groupBy("token").agg(F.count("*").alias("n"))
    # tokens as numbers in their order: rare ones first
    ordered = said.join(rarity, "token").groupBy("of").agg(F.array_sort(F.collect_list(F.struct("n", F.xxhash64("token").alias("h"), "token"))).alias("o"))
    sets = cut(ordered.select(F.col("of").alias("id"), F.transform("o", lambda x: x["token"]).alias("tokens"), F.size("o").alias("size")), "ordered")
    largest = sets.agg(F.max("size")).first()[0]
    if largest is None:
        return SimilarSets(sets.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).alias("common"), F.lit(0.0).alias("jaccard")).where("false"), members)
    sent = cut(prefixes(sets, bands(largest), threshold), "prefixes")
    by = ["token", "low", "high"]
    small = sent.where("small").select(*by, F.col("id").alias("x"), F.col("size").alias("nx"), F.col("at").alias("px"))
    large = sent.where("large").select(*by, F.col("id").alias("y"), F.col("size").alias("ny"), F.col("at").alias("py"))
    enough = F.ceil(threshold / (1 + threshold) * (F.col("nx") + F.col("ny")) - 1e-9)
    met = small.join(large, by).where((F.col("low") < F.col("high")) | (F.col("x") < F.col("y")))
    # what both have left from this token on must be enough, and sizes must fit
    met = met.where((F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) >= enough) | ((F.col("px") > 0) & (F.col("py") > 0)))
    met = met.where(F.least("nx", "ny") >= F.ceil(F.greatest("nx", "ny") * threshold - 1e-9)).select("x", "y").distinct()
    left, right = (sets.select(F.col("id").alias(i), F.col("tokens").alias(f"t{i}"), F.col("size").alias(f"n{i}")) for i in ("x", "y"))
    common = F.size(F.array_intersect("tx", "ty"))
    found = met.join(left, "x").join(right, "y").withColumn("common", common).withColumn("jaccard", F.col("common") / (F.col("nx") + F.col("ny") - F.col("common")))
    pairs = found.where(F.col("jaccard") >= threshold - 1e-12).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "jaccard")
    return SimilarSets(pairs, members)
