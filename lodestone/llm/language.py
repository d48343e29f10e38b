"""Language identification by compression with per-language dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import free_name, tidy

UNKNOWN = "und"
#: The dictionary of a language: whole texts of this many labelled documents, up to this many bytes.
SAMPLE_DOCS, DICTIONARY_BYTES = 400, 256 * 1024
#: Languages at most; the driver sees one row and one dictionary for each.
MAX_LANGUAGES = 1000
#: Texts are compressed in pieces of this many bytes, so that the dictionary matters all along them.
PIECE_BYTES = 2048
#: Least lead of the best language over the next, as a share of the next one's bytes.
MARGIN = 0.005
LEVEL = 6
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    """The text as it is compressed: lower case, every run of other characters one space."""
    return _NO_LETTERS.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = SAMPLE_DOCS, dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Raw-content dictionaries from a bounded sample of labelled rows.

    Takes, for each non-null language, the ``sample_docs`` rows with the smallest MD5 of their key
    (each task keeps no more than that), and of them whole texts up to ``dictionary_bytes``.  Rows
    with a null or blank text or a null language teach nothing, nor do texts over a quarter of
    ``dictionary_bytes`` (64 KiB): a language whose rows are all longer is not learned.  The driver receives at most
    languages x ``dictionary_bytes``.  The result lists languages by their number of labelled rows,
    most first (ties by name), which is also the order in which equal sizes are decided.
    """
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    rows = docs.where(F.col(lang).isNotNull() & (F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), order.alias("o"), F.encode(F.col(text), "UTF-8").alias("raw"))
    fits = rows.where(F.length("raw") <= dictionary_bytes // 4)  # so that no text takes most of a dictionary
    # hashes alone are ranked; texts are read for those that are in
    rank_of = F.row_number().over(W.partitionBy("lang").orderBy("o"))
    ends = fits.select("lang", "o").withColumn("n", rank_of).where(F.col("n") <= sample_docs).groupBy("lang").agg(F.max("o").alias("last"))
    ends = ends.limit(MAX_LANGUAGES + 1).collect()
    if len(ends) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    last = docs.sparkSession.createDataFrame([(r["lang"], r["last"]) for r in ends], "lang string, last string")
    chosen = fits.join(F.broadcast(last), "lang").where("o <= last")
    by = W.partitionBy("lang").orderBy("o", "raw")
    fits = chosen.withColumn("n", F.row_number().over(by)).where(F.col("n") <= sample_docs).withColumn("so_far", F.sum(F.length("raw")).over(by)).where(F.col("so_far") <= dictionary_bytes)
    learned: dict[str, list[bytes]] = {}
    rank = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).count().orderBy(F.desc("count"), "lang")
    for r in fits.orderBy("lang", "n").select("lang", "raw").toLocalIterator():
        learned.setdefault(r.lang, []).append(letters(bytes(r.raw).decode("utf-8", "replace")))
    return {r.lang: b" ".join(learned[r.lang]) for r in rank.toLocalIterator() if r.lang in learned}


class Classifier:
    """Compressed sizes of a text under each dictionary; one compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, piece: int = PIECE_BYTES) -> None:
        self.names, self.piece, self.parts = list(dictionaries), piece, []
        for name in self.names:
            content = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.parts.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language with the smallest total, and its lead over the next one (0 to 1)."""
        if text is None or not self.names or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        raw = letters(text)
        pieces = [raw[i : i + self.piece] for i in range(0, len(raw), self.piece)]
        sizes = sorted((sum(len(c.compress(p)) for p in pieces), i) for i, c in enumerate(self.parts))
        if len(sizes) == 1:
            return self.names[0], 1.0
        return self.names[sizes[0][1]], 1.0 - sizes[0][0] / sizes[1][0]


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row; the whole text is compressed.

    ``lang_pred`` is the language whose dictionary makes the text smallest (ties: the one listed first),
    or ``und`` where the text is null or has no letter or nothing was learned.  ``score`` is its lead
    over the second best, 0 for ``und``, 1 where one language was learned.  ``rejected`` is true for
    ``und`` and where the score is under ``margin``.  Only the text is looked at, so repeated rows get
    equal answers.  An empty table gives an empty result; input columns with these names are replaced.
    """
    made = ("lang_pred", "score", "rejected")
    carry = [c for c in docs.columns if c not in made]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema), "lang_pred string, score double, rejected boolean"])
    at = carry.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column(at)]
            names, scores = [x[0] for x in found], [x[1] for x in found]
            gone = [n == UNKNOWN or s < margin for n, s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())], names=[*carry, *made])

    return docs.select(*carry).mapInArrow(tidy(run), schema)


def held_out(key: Column, folds: int = 3, fold: int = 1) -> Column:
    """Whether CRC-32 of the key as text falls into the held-out fold; a null key counts as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", margin: float = MARGIN) -> DataFrame:
    """The rows whose language is clear, with the columns of ``docs``; learns as ``learn`` does.

    Labels of the held-out fold are never used, predictions look at the text alone.
    """
    dictionaries = learn(docs.where(~held_out(F.col(key))), text, lang, key)
    if not dictionaries:
        return docs.limit(0)
    inner = free_name(docs, "the_row")
    packed = docs.select(F.struct(*docs.columns).alias(inner), F.col(text).alias("text"))
    return identify(packed, dictionaries, "text", margin).where("not rejected").select(f"{inner}.*")
