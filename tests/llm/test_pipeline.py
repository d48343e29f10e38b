"""The stages of the pipeline, each against a brute-force version of its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from lodestone.llm import chunks, mixing, queries, simhash
from lodestone.llm.common import materialise, roots


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], sf_dir), name))
    return out


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "substring_dedup", "source_mixing", "bpe_round_trip"]
    assert all(s.schema.names == stages[0].schema.names and [f.dataType for f in s.schema] == [f.dataType for f in stages[0].schema] for s in stages[1:-1])


def test_language_stage_keeps_clear_documents(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[:2])
    assert all(before[i] == r for i, r in after.items())
    gone = [r for i, r in before.items() if i not in after]
    assert all(len(r.text) < 40 for r in gone) or len(gone) <= 0.03 * len(before)


def test_near_dedup_stage(stages):
    rows = {r.doc_id: r for r in stages[1].collect()}
    ids = sorted(rows)
    prints = np.array([simhash.fingerprint(rows[i].text) for i in ids], np.uint64)
    near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    want = {ids[i] for i in set(roots(len(ids), near.tolist()).tolist())}
    after = {r.doc_id: r for r in stages[2].collect()}
    assert set(after) == want and all(after[i] == rows[i] for i in want)


def test_substring_stage_only_cuts(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[2:4])
    assert set(after) <= set(before)
    for i, t in after.items():
        rest = iter(before[i])
        assert all(c in rest for c in t)  # what is left is a subsequence
    assert sum(map(len, after.values())) > 0.7 * sum(map(len, before.values()))


def test_mixing_stage(stages):
    copies = {r.doc_id: r.copies for r in mixing.mix(stages[3], repetition_limit=2.0).collect()}
    assert Counter(r.doc_id for r in stages[4].collect()) == Counter({i: n for i, n in copies.items() if n})


def test_bpe_stage(stages):
    library = chunks.load(queries.tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4].collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[(r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in stages[5].collect()) == want


def test_run(spark, sf_dir, stages):
    assert corpus_pipeline.run(spark, sf_dir).count() == stages[-1].count()
