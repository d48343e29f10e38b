"""The formats: splits, failures as rows, chosen columns, streams that go on after a restart."""

import json
import os

import pytest
import zstandard
from pyspark.sql import functions as F

from lodestone.sources import files, formats

BIG = 2**64 - 1
LINES = [
    {"doc_id": 1, "text": "ein Löwe"}, {"doc_id": BIG, "text": "", "more": [1]}, "broken {", {"doc_id": BIG + 1, "text": "x"}, {"doc_id": -1, "text": "x"},
    {"doc_id": 1.5, "text": "x"}, {"doc_id": 2.0, "text": "two"}, {"doc_id": "3", "text": "x"}, {"doc_id": True, "text": "x"}, {"doc_id": 4}, {"doc_id": 5, "text": None},
    [1], "", "   ", {"doc_id": 6, "text": "語" * 200}, {"doc_id": 1, "text": "ein Löwe"},
]


def written(folder, lines, name="a.json"):
    folder.mkdir(exist_ok=True)
    text = "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines)
    (folder / name).write_text(text, encoding="utf-8")
    return f"file://{folder}"


@pytest.mark.parametrize("split", [97, 256, 10**9])
def test_splits_give_every_line_once_and_agree_with_the_reader(spark, tmp_path, split):
    formats.register(spark)
    path = written(tmp_path / "docs", LINES)
    (tmp_path / "docs" / "_SUCCESS").write_text("{")
    rows = spark.read.format("lodestone_documents").option("splitBytes", split).load(path)
    good, bad = files.read_documents(spark, path)
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(key, rows.where("error is null").collect())) == sorted(map(key, good.collect()))
    assert rows.where("error is not null").count() == bad.count() == 9
    raw = (tmp_path / "docs" / "a.json").read_bytes()
    assert all(r["position"] == 0 or raw[r["position"] - 1 : r["position"]] == b"\n" for r in rows.collect())


def test_columns_options_and_missing_paths(spark, tmp_path):
    formats.register(spark)
    path = written(tmp_path / "docs", LINES)
    only = spark.read.format("lodestone_documents").schema("doc_id decimal(20,0), error string").load(path)
    assert only.columns == ["doc_id", "error"] and only.where("error is null").count() == 5
    with pytest.raises(Exception, match="no column"):
        spark.read.format("lodestone_documents").schema("doc_id string").load(path).collect()
    with pytest.raises(Exception, match="FileNotFound"):
        spark.read.format("lodestone_documents").load(f"{path}/nowhere").collect()
    (tmp_path / "empty").mkdir()
    assert spark.read.format("lodestone_documents").load(f"file://{tmp_path}/empty").count() == 0


def test_sidecar_and_pages(spark, tmp_path):
    formats.register(spark)
    good = {"doc_id": BIG, "number": "US1", "title": "A thing", "file": "p1"}
    side = spark.read.format("lodestone_sidecar").load(written(tmp_path / "side", [good, {"doc_id": 1, "number": "US2"}]))
    assert [r.asDict() for r in side.select("doc_id", "number", "title", "file").where("error is null").collect()] == [good]
    assert side.where("error is not null").select("position").first()[0] > 0
    folder = tmp_path / "pages"
    (folder / "deep").mkdir(parents=True)
    pages = {"a.zst": "<html>ä</html>", "deep/b.zst": "", "deep/c.zst": "x" * 100_000}
    for name, html in pages.items():
        (folder / name).write_bytes(zstandard.ZstdCompressor().compress(html.encode()))
    (folder / "bad.zst").write_bytes(b"no page")
    (folder / "other.txt").write_text("no page")
    for split in (1, 10**9):
        read = spark.read.format("lodestone_pages").option("splitBytes", split).load(f"file://{folder}")
        got = {os.path.relpath(r["path"], folder): r["html"] for r in read.collect()}
        assert got == pages | {"bad.zst": None}
        assert read.rdd.getNumPartitions() == (4 if split == 1 else 1)
        assert read.where("error is not null").count() == 1
    plain = files.read_pages(spark, f"file://{folder}/deep")
    assert sorted(r["html"] for r in plain.collect()) == sorted(pages[n] for n in pages if n.startswith("deep"))
    # names alone need no page that can be read
    assert spark.read.format("lodestone_pages").schema("path string").load(f"file://{folder}").count() == 4


def test_a_stream_takes_each_file_once_and_goes_on_after_a_restart(spark, tmp_path):
    formats.register(spark)
    path = written(tmp_path / "docs", [{"doc_id": 1, "text": "a"}, "bad"], "z.json")
    out, checkpoint = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"

    def run():
        stream = spark.readStream.format("lodestone_documents").load(path).select("doc_id", "text", "error")
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(out).where(F.col("error").isNull()).collect())

    assert run() == [(1, "a")]
    at = os.stat(tmp_path / "docs" / "z.json").st_mtime_ns
    written(tmp_path / "docs", [{"doc_id": 2, "text": "b"}], "b.json")  # its name is smaller, its time is later
    os.utime(tmp_path / "docs" / "b.json", ns=(at + 10**9, at + 10**9))
    assert run() == [(1, "a"), (2, "b")]
    assert run() == [(1, "a"), (2, "b")]
    assert spark.read.parquet(out).where("error is not null").count() == 1
