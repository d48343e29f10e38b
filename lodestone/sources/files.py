"""File sources and sinks: JSON lines, triple envelopes, evaluation samples, pages, a triple store on Parquet."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

TRIPLE = T.StructType([T.StructField(n, T.StringType()) for n in ("src", "rel", "dst", "src_type", "dst_type")])
ENVELOPE = T.StructType([T.StructField("triples", T.ArrayType(TRIPLE)), T.StructField("stop", T.BooleanType())])
#: Ids of documents: 64 bits without a sign.
DOC_ID = T.DecimalType(20, 0)
SAMPLE = T.StructType([T.StructField("query", T.StringType()), T.StructField("ground_truth", T.ArrayType(DOC_ID)), T.StructField("tier", T.IntegerType())])
#: Ids are read with decimal places, so that a fraction is seen as such.
DOCUMENT = T.StructType([T.StructField("doc_id", T.DecimalType(30, 8)), T.StructField("text", T.StringType())])


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines ``{"doc_id", "text"}``: the good documents, and ``(file, line, stage, error)`` of bad lines.

    Blank lines are skipped before counting; line numbers count what is left of a file from 1.  Unknown
    keys are ignored; a line without one of the keys, or with one of another type, is bad, and so is an id
    that is no whole number from 0 to 2**64 - 1.  Ids come as DECIMAL(20, 0).  Lines of a
    file are numbered by their block and offset, so a file may be split over tasks.
    """
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).where(F.trim("value") != "")
    inside = raw.withColumn("n", F.row_number().over(W.partitionBy("file", "block").orderBy("at")))
    sizes = raw.groupBy("file", "block").agg(F.count("*").alias("size"))
    before = sizes.select("file", "block", F.coalesce(F.sum("size").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = inside.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("n")).alias("line"), "value", F.from_json("value", DOCUMENT, {"mode": "PERMISSIVE"}).alias("d"))
    whole = F.col("d.doc_id").between(F.lit(0), F.lit(Decimal(2**64 - 1))) & (F.floor("d.doc_id") == F.col("d.doc_id"))
    # decimals are read from strings too; only where one may stand in the line is its type looked up
    typed = F.schema_of_variant(F.try_variant_get(F.try_parse_json("value"), "$.doc_id", "variant"))
    number = F.when(F.col("value").rlike(r'"doc_id"\s*:\s*"'), typed != "STRING").otherwise(F.lit(True))
    good = whole & number & F.col("d.text").isNotNull()
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    failures = rows.where(~F.col("good")).select("file", "line", F.lit("parse").alias("stage"), F.lit("not a document").alias("error"))
    return rows.where("good").select(F.col("d.doc_id").cast(DOC_ID).alias("doc_id"), "d.text"), failures


def parsed(responses: DataFrame, response: str = "response") -> DataFrame:
    """Add ``envelope``, and ``whole``: whether it is one; a triple lacking a required key spoils it."""
    out = responses.withColumn("envelope", F.from_json(response, ENVELOPE))
    whole = F.col("envelope.triples").isNotNull() & F.forall("envelope.triples", lambda t: t["src"].isNotNull() & t["rel"].isNotNull() & t["dst"].isNotNull())
    return out.withColumn("whole", F.coalesce(whole, F.lit(False)))


def envelope_triples(whole: DataFrame, carry: list[str], cap: int = 64) -> DataFrame:
    """The first ``cap`` triples of whole envelopes, with names and relations trimmed."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    rows = whole.select(*carry, F.posexplode(F.slice("envelope.triples", 1, cap)).alias("triple_idx", "t"))
    return rows.select(*carry, "triple_idx", trim("t.src").alias("src"), trim("t.rel").alias("rel"), trim("t.dst").alias("dst"), "t.src_type", "t.dst_type")


def parse_envelopes(responses: DataFrame, response: str = "response", cap: int = 64) -> tuple[DataFrame, DataFrame]:
    """Triples of JSON envelopes ``{"triples": [{src, rel, dst}], "stop"}`` and the rows that fail.

    A triple lacking a required key fails its whole row.  Of good rows the first ``cap`` raw triples
    are taken, with names and relations trimmed; all other columns are carried along.
    """
    carry = [c for c in responses.columns if c != response]
    read = parsed(responses, response)
    return envelope_triples(read.where("whole"), carry, cap), read.where("not whole").select(*carry, F.lit("parse").alias("stage"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples from a JSON array; other keys are ignored."""
    return spark.read.schema(SAMPLE).json(path, multiLine=True).select(F.xxhash64("query").alias("query_id"), "*")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(path, html, error)`` of zstandard-compressed pages below a folder; of those that cannot be read ``html`` is null."""
    from collections.abc import Iterator

    import pyarrow as pa
    import zstandard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages, errors = [], []
            for content in batch.column(1).to_pylist():
                try:
                    pages.append(zstandard.ZstdDecompressor().decompressobj().decompress(content).decode("utf-8", "replace"))
                    errors.append(None)
                except zstandard.ZstdError as e:
                    pages.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string()), pa.array(errors, pa.string())], names=["path", "html", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zst").load(path)
    return files.select("path", "content").mapInArrow(run, "path string, html string, error string")


def write_documents(docs: DataFrame, path: str, key: str = "doc_id", order: str = "file") -> None:
    """JSON lines, one for each key: the first by ``order`` wins."""
    first = docs.groupBy(key).agg(F.min_by(F.struct(*docs.columns), order).alias("r"))
    first.select("r.*").write.json(path)
