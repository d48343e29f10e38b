"""The queries of this subpackage: each binds one operator to its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, automaton, language, mixing, nn_descent, passages, pieces, quality, sharding, simhash, token_counts, token_files, trie


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.repetition(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "dup_line_share", "dup_line_char_share", *[F.col("dup_ngram_share")[n].alias(f"dup_{n}gram_share") for n in quality.NGRAM_LIMITS])


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.held_out(F.col("doc_id"))
    dictionaries = language.learn(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign(docs, [1.0] * 16, grown=[1.0] * 17).drop("text")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), carry=["doc_id"])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, repetition_limit=2.0).drop("text")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), carry=["doc_id"])


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_sums(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_token_counts,
        op3_embedding_near_dedup,
        op4_token_files,
        op5_quality_rules,
        op6_language_id,
        op7_simhash_near_dedup,
        op8_sharding,
        op9_bpe_round_trip,
        op10_source_mixing,
        op11_conversation_trie,
        op12_piece_round_trip,
        op13_token_alignment,
    )
}


def _score(shard: int) -> str:
    unit = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{shard}'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE"
    return f"-1.0::DOUBLE / ln({unit})"


def _best(n: int) -> str:
    """The first of the largest scores s0..s(n-1)."""
    top = "greatest(" + ", ".join(f"s{i}" for i in range(n)) + ")"
    return "CASE " + " ".join(f"WHEN s{i} = {top} THEN {i}" for i in range(n)) + " END"


_ALL = ", ".join(f"{_score(i)} AS s{i}" for i in range(17))

#: The table of CRC-32 is made from its polynomial, then folded over the bytes of each text.
_CRC_TABLE = "t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tbl)"


def _crc(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT"


def _bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"


SHARDING_SQL = f"""WITH {_CRC_TABLE},
b AS (SELECT doc_id, {_bytes("coalesce(text, '')")} AS bytes, {_ALL} FROM documents),
r AS (SELECT doc_id, (len(bytes) + 1)::BIGINT AS size, {_crc("bytes")} AS text_crc32,
  'key' AS law, ({_best(16)})::INT AS shard, ({_best(17)})::INT AS grown_shard, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1024 AS bucket FROM b, t)
SELECT doc_id, size, text_crc32, law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM r"""

#: Brute force over all pairs; rows that cannot be compared are left out of the links.
NEAR_VECTORS_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON vec_id = c.a LEFT JOIN n ON vec_id = n.a"""

#: Nodes are lists of turns; every node adds its leaf and its saved words to all its prefixes.
CONVERSATION_TRIE_SQL = f"""WITH {_CRC_TABLE},
c AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT conv_id, own, {_crc(_bytes("conv_id::VARCHAR"))} % 4 AS h FROM c, t),
b AS (SELECT a.conv_id, list_concat(coalesce(z.own[1:a.h], []), a.own[a.h + 1:]) AS s FROM h a LEFT JOIN h z ON z.conv_id = a.conv_id - a.conv_id % 20),
n AS MATERIALIZED (SELECT s[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d) AS ends FROM (SELECT conv_id, s, unnest(range(len(s) + 1)) AS d FROM b) GROUP BY 1, 2),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.k, d, kids.k IS NULL AS leaf, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(n.k[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS saved FROM n LEFT JOIN kids ON n.k = kids.k),
sums AS (SELECT k[1:e] AS k, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT k, leaf, saved, unnest(range(d + 1)) AS e FROM w) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN sums ON n.k = sums.k LEFT JOIN kids ON n.k = kids.k LEFT JOIN n p ON n.d > 0 AND p.k = n.k[1:n.d - 1] AND p.d = n.d - 1"""

#: Of the other queries, each needs a hash, a tokenizer, compression or alignment that SQL lacks.
ORACLE_SQL: dict[str, str] = {"op8_sharding": SHARDING_SQL, "op3_embedding_near_dedup": NEAR_VECTORS_SQL, "op11_conversation_trie": CONVERSATION_TRIE_SQL}
