"""The set-similarity join and the keyword automaton against brute force."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import keywords, setjoin


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets_match_brute_force(spark, threshold):
    rng = random.Random(threshold)
    sets = [{f"t{min(int(rng.expovariate(0.15)), 60)}" for _ in range(rng.randint(1, 6))} for _ in range(120)]
    for _ in range(8):  # large ones, near each other
        base = {f"w{rng.randrange(400)}" for _ in range(rng.randint(30, 60))}
        sets += [base, {x for x in base if rng.random() < 0.95} | {f"x{rng.randrange(9)}"}]
    sets += [{"t1", "t2"}] * 5
    rows = [(i, sorted(s) + sorted(s)[:1]) for i, s in enumerate(sets)] + [(900, []), (901, None), (902, [None]), (None, ["t1"])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    found = setjoin.similar_sets(df, threshold)
    want = {(i, j): jaccard(sets[i], sets[j]) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard(sets[i], sets[j]) >= threshold}
    assert {(r.a, r.b): r.jaccard for r in found.expanded().collect()} == pytest.approx(want)
    assert found.expanded().count() == len(want)
    assert found.pairs.where("a >= b").count() == 0 and found.members.count() == len(sets)


def test_common_tokens_are_not_joined(spark, monkeypatch):
    """A token that all sets have is sent by none that has a rarer one, so the join stays small."""
    df = spark.range(500).select("id", F.array(F.lit("the"), F.concat(F.lit("a"), "id"), F.concat(F.lit("b"), F.col("id") % 250)).alias("tokens"))
    sent = setjoin.prefixes(df.withColumn("size", F.size("tokens")).withColumn("tokens", F.array_sort("tokens")), setjoin.bands(3), 0.5)
    assert sent.count() > 0
    made = []
    monkeypatch.setattr(setjoin, "cut", lambda d, what="cut": made.append((what, d)) or d)
    found = setjoin.similar_sets(df, 0.5)
    prefixes = dict(made)["prefixes"]
    assert prefixes.where("token = 'the'").count() == 0
    assert found.pairs.count() == 250


def test_bands():
    assert setjoin.bands(3) == [1, 2, 3]
    starts = setjoin.bands(1000)
    assert starts == sorted(set(starts)) and starts[:16] == list(range(1, 17)) and len(starts) < 70
    with pytest.raises(ValueError, match="threshold"):
        setjoin.similar_sets(None, 0.0)


def occurrences(text, word):
    raw, w = text.encode(), word.encode()
    return [i + len(w) for i in range(len(raw) - len(w) + 1) if raw[i : i + len(w)] == w]


@pytest.mark.parametrize("window", [1, 3, 512])
def test_automaton_matches_brute_force(monkeypatch, window):
    monkeypatch.setattr(keywords, "WINDOW", window)
    rng = random.Random(window)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(40)} | {"é", "日本", "aé"})
    texts = ["".join(rng.choice("abcdé日本") for _ in range(rng.randint(0, 40))) for _ in range(60)] + ["", "aaaaaaaa"]
    automaton = keywords.Automaton([w.encode() for w in words])
    got = sorted(zip(*(x.tolist() for x in automaton.find(pa.array(texts))), strict=True))
    assert got == sorted((i, n, e) for i, t in enumerate(texts) for n, w in enumerate(words) for e in occurrences(t, w))
    sliced = sorted(zip(*(x.tolist() for x in automaton.find(pa.array(texts).slice(7, 20))), strict=True))
    assert sliced == [(i - 7, n, e) for i, n, e in got if 7 <= i < 27]


@pytest.mark.parametrize("most", [1 << 19, 60_000])
def test_ten_thousand_keywords(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(keywords, "MOST_BYTES", most)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: (r.text or "").lower() for r in docs.collect()}
    rng = random.Random(2)
    words = set()
    while len(words) < 10_000:
        t = texts[rng.choice(list(texts))]
        i = rng.randrange(max(1, len(t)))
        words.add(t[i : i + rng.randint(4, 14)] or "x")
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), (words[0].upper(),)], "keyword string")
    got = {}
    for r in keywords.keyword_hits(docs, df).collect():
        got.setdefault(r.doc_id, {})[r.keyword] = (r.n, r.first_end)
    for k in rng.sample(sorted(texts), 40):
        raw = texts[k]
        assert set(got.get(k, {})) == {w for w in words if w in raw}
        for w, (n, first) in got.get(k, {}).items():
            ends = occurrences(raw, w) if n < 3 else [len(raw[: raw.index(w)].encode()) + len(w.encode())]
            assert first == ends[0] and (n >= 3 or n == len(ends))


def test_keywords_odd(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Ab ab"), (3, "x")], "doc_id long, text string")
    words = spark.createDataFrame([("AB",)], "keyword string")
    assert [tuple(r) for r in keywords.keyword_hits(docs, words).collect()] == [(None, "ab", 2, 2)]
    assert keywords.keyword_hits(docs, words, lower=False).count() == 0
    assert keywords.keyword_hits(docs, words.limit(0)).count() == 0
