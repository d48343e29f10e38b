"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import free_name


def unit(key: Column, salt: str) -> Column:
    """A number in (0, 1) that depends on ``key`` and ``salt`` only: 52 bits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(salt)).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard 0..n-1 with the highest score ``-weight / ln(unit(key, shard))``.

    Each shard's score depends on the key and that shard alone.  Adding a shard therefore moves
    records only into it, removing one moves only its own records, and a changed weight moves
    records only to or from that shard.  Shards of weight 0 get nothing; ties go to the smaller
    number.
    """
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights must be non-negative and one of them positive")
    scores = [
        F.struct((-F.lit(float(w)) / F.log(unit(key, f":{s}"))).alias("score"), F.lit(-s).alias("shard"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]).cast("int")


def slots(records: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", buckets: int = 1024, bucket_of: Column | None = None) -> DataFrame:
    """Number the records of every shard from 0 without gaps.

    A shard may hold any share of the table, so no task sees a whole shard: records are dealt into
    ``buckets`` hash buckets of each shard, numbered inside their bucket, and lifted by the sizes of
    the buckets before theirs (at most shards x buckets rows, summed by a window).
    """
    key = bucket_of if bucket_of is not None else F.xxhash64(*order)
    b, n, base, inside = (free_name(records, x) for x in ("bucket_no", "bucket_n", "bucket_base", "inside"))
    dealt = records.withColumn(b, F.pmod(key, F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(shard, b).agg(F.count("*").alias(n))
    before = W.partitionBy(shard).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(shard, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    numbered = dealt.withColumn(inside, F.row_number().over(W.partitionBy(shard, b).orderBy(*order)) - 1)
    return numbered.join(bases, [shard, b]).withColumn(slot, (F.col(inside) + F.col(base)).cast("long")).drop(b, n, base, inside)


def assign(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text", grown: Sequence[float] | None = None) -> DataFrame:
    """Add to every record ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``key``: the key and the weights decide.  ``size`` is the UTF-8 length of the text
    plus 1 and ``text_crc32`` the unsigned CRC of its bytes; a null text counts as an empty one.  A
    null key is a key of its own (the empty string), so its records stay together.  Records with
    equal keys meet in one shard and get neighbouring slots of their bucket, in the order of
    ``text_crc32`` and ``size``.  ``grown_shard`` is the shard under ``grown`` (null without it).  An
    empty table gives an empty result.  Input columns with these six names are replaced.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    made = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c not in made or c in (key, text)]
    out = docs.select(
        *kept,
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        (rendezvous(F.col(key), grown) if grown is not None else F.lit(None).cast(T.IntegerType())).alias("grown_shard"),
    )
    # by an MD5 of the key, so that any SQL engine can recompute the order; the buckets of slots() come from it
    bucket = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    return slots(out, "shard", [key, "text_crc32", "size"], bucket_of=bucket)


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id", text: str = "text", files: int = 8) -> None:
    """Write the records as Parquet, one folder for each shard and up to ``files`` files in it."""
    out = assign(docs, weights, key, text)
    dealt = F.pmod(F.xxhash64(key), F.lit(files))
    out.repartition(len(weights) * files, "shard", dealt).write.partitionBy("shard").parquet(path)
