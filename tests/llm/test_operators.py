"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import automaton, chunks, language, mixing, nn_descent, passages, quality, queries, sharding, simhash, token_counts, token_files
from lodestone.llm.common import connected_components, roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("n_tokens", T.StringType()), T.StructField("component_id", T.StringType()), T.StructField("shard", T.StringType())])


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, clashing names."""
    rng = random.Random(3)
    long = sentence(rng, 30_000)
    shared = sentence(rng, 60)
    texts = [None, "", " ", "\n\n\t", "one", "One", "the same text", "the same text", long, long + " end", "x " * 500, "a  b   c \n d ", "<|endoftext|> in <|endoftext|>text", "naïve ñ ß 日本語 🎉", f"start {shared} end", f"other {sentence(rng, 80)} {shared} {sentence(rng, 30)}", "x\x1cy\x85z\xa0w", "ÁB"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s1", "f", "n", "c", "s") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "the same text", "en", "s1", None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(sf_dir):
    return dict(duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet'").fetchall())


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots(470, pairs)
    assert found == {x: want[x] for p in pairs for x in p if p[0] != p[1]} | {x: want[x] for x in found}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 -------------------------------------------------------------------------------------------------


def test_fenwick_chains_match_quadratic():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        x, y = rng.choice(4000, n, replace=False), rng.choice(4000, n, replace=False)
        sx, sy, ex, seeds = passages.merge_runs(x, y, passages.GAP)
        ey, cost = sy + ex - sx, 1 / (2 * passages.GAP)
        order, score = np.argsort(sx, kind="stable"), np.zeros(len(sx))
        for i in order:
            gains = [score[j] - cost * (sx[i] - ex[j] + sy[i] - ey[j]) for j in order if ex[j] <= sx[i] and ey[j] <= sy[i] and score[j] > 0]
            score[i] = seeds[i] + max([0.0, *gains])
        best = passages.chains(x, y)[0]
        assert best[1] == ex[int(np.argmax(score))] or math.isclose(score.max(), score[list(ex).index(best[1])])


def test_common_words():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(0, 20)), rng.integers(0, 5, rng.integers(0, 20))
        row = [0] * (len(b) + 1)
        for u in a:
            new = [0]
            for j, v in enumerate(b):
                new.append(row[j] + 1 if u == v else max(new[-1], row[j + 1]))
            row = new
        assert passages.common_words(a, b) == row[-1]


def test_passages_are_found_and_clean_texts_left(spark):
    rng = random.Random(11)
    clean = [sentence(rng, 300) for _ in range(40)]
    passage = sentence(rng, 60)
    fuzzy = passage.split()
    for i in (10, 25, 41):
        fuzzy[i] = "changed"
    del fuzzy[33]
    near = clean[7].split()
    near[50], near[120] = "other", "word"
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, f"{sentence(rng, 50)} {passage} {sentence(rng, 70)}") for i in range(6)]
    rows += [(200, f"{sentence(rng, 40)} {' '.join(fuzzy)} {sentence(rng, 20)}"), (201, " ".join(near)), (202, clean[8])]
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in found}
    assert set(by) == {101, 102, 103, 104, 105, 200, 201, 202} and len(found) == len(by)
    text = dict(rows)
    for i in range(101, 106):
        assert by[i].other == 100 and text[i][by[i].start : by[i].end] == passage
    assert by[200].other == 100 and by[200].n_words >= 55 and text[200][by[200].start : by[200].end] == " ".join(fuzzy)
    assert (by[201].other, by[202].other) == (7, 8) and by[202].similarity == 1.0
    kept = {r.doc_id: r.text for r in passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(kept[i] == t for i, t in enumerate(clean)) and kept[100] == text[100]
    assert kept[101] == text[101].replace(passage, "") and 202 not in kept


def test_exact_passages_by_brute_force(spark):
    """Every exact repeat of 60 words across documents of a small corpus is covered."""
    rng = random.Random(4)
    common = [sentence(rng, 70) for _ in range(5)]
    text = {i: " ".join([sentence(rng, rng.randint(5, 60)), *(rng.choice(common) for _ in range(rng.randint(0, 2))), sentence(rng, 20)]) for i in range(40)}
    owner, want = {}, defaultdict(set)
    for i in sorted(text):
        words = WORD.findall(text[i])
        for a in range(len(words) - 59):
            w = tuple(words[a : a + 60])
            if owner.setdefault(w, i) != i:
                want[i] |= set(range(a, a + 60))
    got = defaultdict(set)
    for r in passages.find_passages(spark.createDataFrame(list(text.items()), "doc_id long, text string")).collect():
        got[r.doc_id] |= {n for n, m in enumerate(WORD.finditer(text[r.doc_id])) if r.start <= m.start() and m.end() <= r.end}
    assert all(want[i] <= got[i] for i in want) and set(got) == set(want)


def test_alignment_pairs_are_a_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, rng.integers(2, 60), rng.integers(1, 150)) for _ in range(2))
        pairs = passages.common_pairs(a, b)
        assert len(pairs) == passages.common_words(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(pairs))


def test_two_passages_of_one_pair_with_other_text_between(spark):
    """A chain over both is no passage as a whole; each of them is."""
    rng = random.Random(21)
    one, two = sentence(rng, 60), sentence(rng, 60)
    rows, n = [], 0
    for gap in (31, 100, 300):
        rows += [(n, f"{sentence(rng, 30)} {one} {sentence(rng, gap)} {two} {sentence(rng, 30)}"), (n + 1, f"{sentence(rng, 50)} {one} {sentence(rng, gap)} {two} {sentence(rng, 10)}")]
        one, two, n = sentence(rng, 60), sentence(rng, 60), n + 2
    text = dict(rows)
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i in range(0, n, 2):
        spans = sorted((r.start, r.end) for r in found if (r.doc_id, r.other) == (i + 1, i))
        assert len(spans) == 2 and all(text[i + 1][a:b] in text[i] and len(text[i + 1][a:b].split()) == 60 for a, b in spans)
    assert len(found) == n


def test_passage_whose_seeds_an_earlier_document_has_first(spark):
    """Earlier documents have a passage's sentences apart, too short to report; two later ones have it whole."""
    rng = random.Random(31)
    rows = []
    for i in range(0, 60, 3):
        first, second = sentence(rng, 30), sentence(rng, 30)
        apart = f"{sentence(rng, 20)} {first} {sentence(rng, 700)} {second} {sentence(rng, 20)}"
        rows += [(i, apart), *((i + j, f"{sentence(rng, 40)} {first} {second} {sentence(rng, 40)}") for j in (1, 2))]
    text = dict(rows)
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other) for r in found} == {(i + 2, i + 1) for i in range(0, 60, 3)}
    assert all(len(text[r.doc_id][r.start : r.end].split()) == 60 for r in found)


def test_passage_whose_halves_stand_in_earlier_documents(spark):
    """Two documents share 70 words; two earlier ones have a half each, too short to be reported."""
    rng, rows = random.Random(51), []
    for i in range(0, 400, 4):
        one, two = sentence(rng, 35), sentence(rng, 35)
        around = lambda t: f"{sentence(rng, 40)} {t} {sentence(rng, 40)}"
        rows += [(i, around(one)), (i + 1, around(two)), (i + 2, around(f"{one} {two}")), (i + 3, around(f"{one} {two}"))]
    got = {(r.doc_id, r.other) for r in passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & {(i + 3, i + 2) for i in range(0, 400, 4)}) >= 97


def test_fuzzy_passages_of_60_words(spark):
    """Every sixth word changed: 0.83 of 60 words agree."""
    rng, rows, n = random.Random(61), [], 100
    for i in range(n):
        words = sentence(rng, 60).split()
        other = ["changed" + sentence(rng, 1) if at % 6 == 3 else w for at, w in enumerate(words)]
        rows += [(2 * i, f"{sentence(rng, 60)} {' '.join(words)} {sentence(rng, 60)}"), (2 * i + 1, f"{sentence(rng, 60)} {' '.join(other)} {sentence(rng, 60)}")]
    got = {(r.doc_id, r.other) for r in passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & {(2 * i + 1, 2 * i) for i in range(n)}) >= 95


def test_passages_of_rows_that_repeat_a_key(spark):
    """Equal rows are one document; of other texts under one key that with the smallest hash is looked at."""
    rng = random.Random(71)
    passage = sentence(rng, 60)
    rows = [(1, f"{sentence(rng, 30)} {passage}"), (2, f"{passage} {sentence(rng, 30)}"), (2, f"{passage} {sentence(rng, 31)}"), (3, f"{sentence(rng, 9)} {passage}"), (3, None)]
    rows += [rows[3], (None, passage), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = passages.find_passages(df).collect()
    assert {(r.doc_id, r.other) for r in found} <= {(2, 1), (3, 1), (3, 2)} and {r.doc_id for r in found} >= {2}
    kept = passages.remove_passages(df).collect()
    assert sum(passage in (r.text or "") for r in kept if r.doc_id == 2) == 1 and sum(r.doc_id is None for r in kept) == 2


def test_fuzzy_passages_recall(spark):
    """Copies of 50 words with one to two words in ten replaced, at random and at regular places."""
    rng, rows, n = random.Random(41), [], 60
    hows = [*([("random", 10)] * n), *([("random", 5)] * n), *([("every", 5)] * n)]
    for i, (how, part) in enumerate(hows):
        words = sentence(rng, 50).split()
        other = list(words)
        for at in rng.sample(range(50), 50 // part) if how == "random" else range(2, 50, part):
            other[at] = "changed" + sentence(rng, 1)
        rows += [(2 * i, f"{sentence(rng, 60)} {' '.join(words)} {sentence(rng, 60)}"), (2 * i + 1, f"{sentence(rng, 60)} {' '.join(other)} {sentence(rng, 60)}")]
    got = {(r.doc_id, r.other) for r in passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = Counter(hows[i] for i in range(len(hows)) if (2 * i + 1, 2 * i) in got)
    print(dict(found), "of", n)
    assert found["random", 10] == n and found["random", 5] >= 0.9 * n and found["every", 5] >= 0.9 * n


def test_passages_of_a_line_said_again_and_again(spark):
    """More chains of one pair than one row asks for, in stretches that touch and in some that do not."""
    line = " ".join(f"word{i}" for i in range(45))
    near = [f"a{i} b{i}" for i in range(100)]
    far = [" ".join(f"far{i}x{j}" for j in range(120)) for i in range(100)]
    text = " ".join(f"{line} {gap}" for gap in near + far)
    docs = spark.createDataFrame([(1, f"start {line} finish"), (2, text)], "doc_id long, text string")
    rows = passages.find_passages(docs).collect()
    want, at = set(), text.find(line)
    while at >= 0:
        want.add((at, at + len(line)))
        at = text.find(line, at + 1)
    assert len(want) == 200 and {(r.start, r.end) for r in rows} == want and len(rows) == 200
    assert all((r.doc_id, r.other, r.n_words, r.similarity) == (2, 1, 45, 1.0) for r in rows)


def test_windows_around_chains_cover_them_once():
    lo, hi = np.array([50, 0, 500, 90]), np.array([60, 10, 900, 120])
    assert passages.merged(lo, hi, 20).tolist() == [[0, 140], [480, 920]]


def test_passages_odd(odd, empty):
    found = passages.find_passages(odd).collect()
    assert {(r.doc_id, r.other) for r in found} == {(9, 8), (15, 14)}
    kept = passages.remove_passages(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 0 - (kept.where("doc_id = 9").count() == 0)
    assert passages.find_passages(empty).count() == 0 and passages.remove_passages(empty).count() == 0


# 2, 4, 9 -------------------------------------------------------------------------------------------


def test_token_counts(docs, texts, odd, empty):
    library = chunks.load(BYTE_BPE)
    for df, rows in ((docs, list(texts.items())), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        got = Counter(tuple(r) for r in token_counts.token_counts(df, BYTE_BPE).collect())
        want = Counter()
        for i, t in rows:
            n = len(library.encode(t or "", add_special_tokens=False).ids)
            want[(i, len((t or "").encode()), n, n > 512)] += 1
        assert got == want
    assert token_counts.token_counts(empty, BYTE_BPE).count() == 0


def test_token_files(spark, docs, texts, odd, empty):
    library = chunks.load(BYTE_BPE)
    at, want = 0, []
    for i in sorted(texts):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, token_files.round_trip(docs, BYTE_BPE).collect())) == want
    got = token_files.round_trip(odd, BYTE_BPE).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    rows = Counter()
    for r in odd.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        rows[(r.doc_id, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == rows
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(ends))
    assert {(r.n_tokens, r.ids_crc32) for r in got if r.doc_id in (0, 1)} == {(1, zlib.crc32(b"\0" * 4))}
    assert token_files.round_trip(empty, BYTE_BPE).count() == 0


def test_token_files_read_some(spark, docs, texts, tmp_path):
    import zstandard

    index = token_files.write(docs, f"file://{tmp_path}/out", BYTE_BPE)
    row = token_files.read(index.where("key = 17")).first()
    library = chunks.load(BYTE_BPE)
    assert row.token_ids == [*library.encode(texts[17], add_special_tokens=False).ids, 0]
    path = index.where("key = 17").first().path
    raw = open(path.removeprefix("file://"), "rb").read()
    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw)  # any reader can take all of it
    assert len(whole) == 4 * index.where(F.col("path") == path).agg(F.sum("n_tokens")).first()[0]
    broken = bytearray(raw)
    frames = token_files.Frames(path)
    broken[int(frames.starts[1]) - 3] ^= 0xFF
    (tmp_path / "broken.zst").write_bytes(broken)
    with pytest.raises(Exception):  # noqa: B017
        token_files.Frames(f"file://{tmp_path}/broken.zst").read(0)


def test_bpe(docs, texts, odd, empty):
    library = chunks.load(WORD_BPE)
    for df, rows in ((docs, list(texts.items())), (odd, [(r.doc_id, r.text) for r in odd.collect()])):
        want = Counter()
        for i, t in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids
            raw = np.array(ids, "<u4").tobytes()
            want[(i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
        got = automaton.encode_decode(df, WORD_BPE, carry=["doc_id"])
        assert Counter(map(tuple, got.collect())) == want
    assert automaton.encode_decode(empty, WORD_BPE).count() == 0


def test_ids_decode_by_their_labels():
    library, own = chunks.load(WORD_BPE), automaton.WordTokenizer(WORD_BPE)
    rng = np.random.default_rng(5)
    for ids in ([], [49406, 7, 49407], rng.integers(0, 49408, 500).tolist()):
        assert own.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False).encode()
    assert own.decode(np.array([7, 10**6, 8], "<u4").tobytes()) == library.decode([7, 8], skip_special_tokens=False).encode()


def test_automaton_accepts_exactly_the_tokenizations():
    """All words over two letters against merging by rank; self-merges included."""
    merges = [("a", "b"), ("a", "a"), ("ab", "a"), ("aa", "aa"), ("b", "ab"), ("aba", "b")]
    ids = {s: i for i, s in enumerate(["a", "b", *(x + y for x, y in merges)])}
    machine = automaton.Automaton(["a", "b"], merges, ids)
    spell = {0: (0,), 1: (1,)}
    for x, y in merges:
        if ids[x + y] in machine.target:  # the last merge can never apply: "ab" is merged before
            spell[ids[x + y]] = spell[ids[x]] + spell[ids[y]]
    assert len(spell) == len(ids) - 1
    encoder = automaton.Encoder(machine, spell)
    for n in range(1, 11):
        for word in itertools.product("ab", repeat=n):
            parts = list(word)
            while True:
                ranked = [(merges.index(p), i) for i, p in enumerate(itertools.pairwise(parts)) if p in merges]
                if not ranked:
                    break
                i = min(ranked)[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert encoder.encode(["ab".index(c) for c in word]) == [ids[p] for p in parts], word


# 3 -------------------------------------------------------------------------------------------------


def brute_links(rows, threshold=0.9):
    ok = [(i, np.array(e, float)) for i, e in rows if i is not None and e is not None and None not in e and np.isfinite(e).all() and np.any(e)]
    out = {}
    units = np.array([v / np.linalg.norm(v) for _, v in ok])
    near = units @ units.T >= threshold
    group = roots(len(ok), zip(*np.nonzero(near), strict=True))
    ids = np.array([i for i, _ in ok])
    for n, i in enumerate(ids):
        out[int(i)] = (int(near[n].sum()) - 1, int(ids[group == group[n]].min()))
    return out


def test_near_vectors(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((400, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, (base[i % 30] + rng.standard_normal(16) * 0.15).tolist()) for i in range(120)]
    rows += [(2000 + i, (base[3] + rng.standard_normal(16) * 0.25).tolist()) for i in range(150)]  # one dense group
    rows += [(3000 + i, base[5].tolist()) for i in range(40)]  # exact copies
    bad = [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9003, [None] + [1.0] * 15), (9004, [1.0, 2.0]), (9005, []), (None, base[0].tolist())]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in nn_descent.near_vectors(df, trees=4, leaf=64, tile=64).collect()}
    want = brute_links(rows)
    found = sum(got[i].n_links for i in want)
    true = sum(n for n, _ in want.values())
    assert found >= 0.97 * true and all(got[i].n_links <= n for i, (n, _) in want.items())
    assert sum(got[i].component_id == c for i, (_, c) in want.items()) >= 0.97 * len(want)
    for i, _ in bad:
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept == (i is not None)
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def test_dense_groups_whose_lists_are_full_are_joined(spark):
    """Two groups closer inside than across, each with more members than a list holds; a third one is apart."""
    rng = np.random.default_rng(18)
    a, b, apart = np.linalg.qr(rng.standard_normal((16, 3)))[0].T
    b = 0.92 * a + np.sqrt(1 - 0.92**2) * b
    rows = [(1000 * g + i, (c + rng.standard_normal(16) * 0.02).tolist()) for g, c in enumerate((a, b, apart)) for i in range(90)]
    want = brute_links(rows)
    assert len({c for _, c in want.values()}) == 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_vectors(df, leaf=64, tile=64).collect()}
    assert got == want


def test_vectors_of_several_lengths(spark):
    """Each length links within itself; a component of several tiles is counted in full."""
    rng = np.random.default_rng(28)
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0]), (5, [1.0, 0.0, 0.02])]
    centre = rng.standard_normal(12)
    rows += [(100 + i, (centre + rng.standard_normal(12) * 0.2).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_vectors(df, leaf=64, tile=32).collect()}
    want = {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (1, 3)} | brute_links(rows[5:])
    assert got == want


def test_isolated_pairs_at_eleven_planes(spark):
    """Pairs at a cosine of 0.91 in leaves as small as those of half a million vectors."""
    rng = np.random.default_rng(38)
    base = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    rows = []
    for i in range(2000):
        v = rng.standard_normal(64)
        v /= np.linalg.norm(v)
        w = rng.standard_normal(64)
        w -= (w @ v) * v
        rows += [(2 * i, (base @ v).tolist()), (2 * i + 1, (base @ (0.91 * v + np.sqrt(1 - 0.91**2) * w / np.linalg.norm(w))).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_vectors(df, leaf=2).collect()}
    assert sum(got[2 * i] == (1, 2 * i) == got[2 * i + 1] for i in range(2000)) >= 0.97 * 2000


def test_near_vectors_recall_audit(spark):
    """The audit's brute force agrees with numpy."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((60, 8))
    rows = [(i, (base[i % 20] + rng.standard_normal(8) * 0.1).tolist()) for i in range(60)]
    units = nn_descent.unit_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    nodes = units.select(F.col("id").alias("node"), "unit", F.lit(1).cast("long").alias("copies"))
    want = brute_links(rows)
    links = spark.createDataFrame([(i, n // 2) for i, (n, _) in want.items()], "node long, links long")
    total = sum(n for n, _ in want.values())
    assert math.isclose(nn_descent.audit(nodes, links, 0.9, 1000), sum(n // 2 for n, _ in want.values()) / total)


def test_near_vectors_audit_counts_vectors_and_fails_if_short(spark):
    """Pairs that were all lost are not outweighed by one dense group; a recall that is not reached is an error."""
    rows = [(300, 300)] * 300 + [(1, 0)] * 100 + [(0, 0)] * 100
    assert sum(min(r) for r in rows) > 0.99 * sum(t for t, _ in rows)
    assert nn_descent.whole_share(rows, 0.97) == 0.0 and nn_descent.whole_share([(1, 1)] * 50 + [(0, 0)], 0.97) == 1.0
    assert [nn_descent.enough_trees(n, 256, 8, 0.9) for n in (10, 50_000, 1_000_000, 10_000_000)] == [8, 8, 14, 27]
    base = np.random.default_rng(19).standard_normal((40, 8))
    df = spark.createDataFrame([(i, base[i % 20].tolist() if i < 20 else (base[i % 20] + 0.01).tolist()) for i in range(40)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="have all of their links"):
        nn_descent.near_vectors(df, recall=1.01)


# 5 -------------------------------------------------------------------------------------------------


def brute_quality(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    repeat = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    shares = {}
    for n in quality.NGRAM_LIMITS:
        seen_n, cover = set(), set()
        for i in range(len(words) - n + 1):
            w = tuple(words[i : i + n])
            if w in seen_n:
                cover |= set(range(i, i + n))
            seen_n.add(w)
        shares[n] = sum(len(words[i]) for i in cover) / max(1, sum(map(len, words)))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat), n < 50 or 100 * len(repeat) > 50 * n, shares


def test_quality(docs, texts, odd, empty):
    rows = {r.doc_id: r for r in quality.repetition(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in texts.items():
        r, (n, chars, symbols, lines, repeat, failed, shares) = rows[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, repeat, failed)
        assert all(math.isclose(r.dup_ngram_share[k], v, abs_tol=1e-12) for k, v in shares.items())
        assert not (r.kept and failed)
    for r in quality.repetition(odd.where("length(text) < 10000 or text is null"), carry=["doc_id", "text"]).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(r.text)[:6]
    assert quality.repetition(odd).count() == odd.count() and quality.repetition(empty).count() == 0


def test_quality_verdict():
    rng = random.Random(2)
    clean = sentence(rng, 400)
    assert quality.measure(clean)["kept"]
    line = sentence(rng, 12)
    assert not quality.measure("\n".join([sentence(rng, 12)] * 3 + [line] * 4 + [sentence(rng, 12) for _ in range(2)]))["kept"]
    part = sentence(rng, 60)
    m = quality.measure(" ".join([part, sentence(rng, 10), part]))
    assert m["dup_ngram_share"][10] > 0.4 and not m["kept"]


# 6 -------------------------------------------------------------------------------------------------


def test_language(docs, odd, empty):
    held = language.held_out(F.col("doc_id"))
    model = language.learn(docs.where(~held))
    found = language.identify(docs, model).withColumn("held_out", held)
    rows = found.where("held_out and length(text) > 40").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in found.collect())
    assert sum(map(len, model.values())) <= len(model) * (language.DICTIONARY_BYTES + language.SAMPLE_DOCS)
    got = {r.text: r for r in language.identify(odd, model).collect()}
    assert got[None].lang_pred == got[""].lang_pred == got["\n\n\t"].lang_pred == "und" and got[None].rejected
    assert language.identify(empty, model).count() == 0 and language.identify(odd, {}).where("lang_pred <> 'und'").count() == 0
    kept = language.keep_known(odd)
    assert kept.columns == odd.columns and language.keep_known(empty).count() == 0


def test_language_is_smallest_compressed():
    import zstandard

    rng = random.Random(6)
    words = {k: ["".join(rng.choice(a) for _ in range(6)) for _ in range(50)] for k, a in (("x", "abcde"), ("y", "vwxyz"), ("z", "abxyz"))}
    model = {k: language.letters(" ".join(rng.choice(w) for _ in range(500))) for k, w in words.items()}
    classifier = language.Classifier(model)
    for _ in range(30):
        k = rng.choice("xyz")
        text = " ".join(rng.choice(words[k]) for _ in range(30))
        sizes = {n: len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=language.LEVEL, write_content_size=False).compress(language.letters(text))) for n, d in model.items()}
        assert classifier.predict(text)[0] == min(sizes, key=sizes.get) == k


def test_language_ignores_held_out_labels(docs):
    held = language.held_out(F.col("doc_id"))
    spoiled = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang")))
    assert language.learn(spoiled.where(~held)) == language.learn(docs.where(~held))


# 7 -------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, texts, odd, empty):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        prints = [brute_fingerprint(t) for _, t in rows]
        near = [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
        group = roots(len(rows), near)
        want = Counter()
        for n, (i, _) in enumerate(rows):
            ids = [rows[m][0] for m in np.flatnonzero(group == group[n]) if rows[m][0] is not None]
            want[(i, prints[n], min(ids) if ids else None)] += 1
        assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.components(df).collect()) == want
    assert simhash.components(empty).count() == 0


def test_simhash_tiles(spark):
    """Chains and cliques of prints within the radius, in many small tiles, against all pairs."""
    rng = random.Random(12)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for p in list(prints)[:40]:
        for _ in range(rng.randint(1, 8)):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 6)):
                q ^= 1 << b
            prints.add(q)
    prints = sorted(prints)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    links = [(r.a, r.b) for r in simhash.tile_links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile=16).collect()]
    at = {p: i for i, p in enumerate(signed)}
    near = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= 4 for a, b in links) and len(links) <= 4 * len(near)
    assert (roots(len(prints), [(at[a], at[b]) for a, b in links]) == roots(len(prints), near)).all()


def test_simhash_keeps_one(odd, empty):
    kept = simhash.drop_near_duplicates(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns and len({r.doc_id for r in rows}) == len(rows)
    assert [r.doc_id for r in rows if r.text == "the same text"] == [6]
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_simhash_keeps_one_of_each_group_whatever_its_key(spark):
    """Rows without a key, and different texts under one key, are documents of their own."""
    rng = random.Random(12)
    clean = [sentence(rng, 200) for _ in range(8)]
    rows = [(None, t) for t in clean[:4]] + [(5, t) for t in clean[4:7]] + [(None, clean[0]), (5, clean[4]), (7, clean[1]), (None, clean[7]), (9, clean[7])]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {clean[0]: None, clean[1]: 7, clean[2]: None, clean[3]: None, clean[4]: 5, clean[5]: 5, clean[6]: 5, clean[7]: 9}
    assert {r.text: r.doc_id for r in kept} == want and len(kept) == len(want)


# 8 -------------------------------------------------------------------------------------------------


def brute_shard(key, weights):
    scores = []
    for s, w in enumerate(weights):
        u = (int(hashlib.md5(f"{'' if key is None else key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        scores.append((-w / math.log(u) if w else -1.0, -s))
    return -max(scores)[1]


def test_sharding(docs, texts, odd, empty):
    weights, grown = [1.0] * 16, [1.0] * 17
    for df in (docs, odd):
        rows = sharding.assign(df, weights, grown=grown).collect()
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in df.collect())
        slots = defaultdict(list)
        for r in rows:
            raw = (r.text or "").encode()
            assert (r["size"], r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
            assert r.shard == brute_shard(r.doc_id, weights) and r.grown_shard == brute_shard(r.doc_id, grown) and r.grown_shard in (r.shard, 16)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.assign(empty, weights).count() == 0


def test_sharding_weights(spark):
    keys = spark.range(6000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit("t"))
    share = {r.shard: r["count"] / 6000 for r in sharding.assign(keys, [1.0, 2.0, 0.0, 3.0]).groupBy("shard").count().collect()}
    assert 2 not in share and all(abs(share[s] - w / 6) < 0.03 for s, w in ((0, 1), (1, 2), (3, 3)))


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, [1.0, 1.0, 1.0], str(tmp_path / "s"), files=2)
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# 10 ------------------------------------------------------------------------------------------------


def test_exponent():
    tokens = [1000, 100, 10, 0]
    for target in (0.2, 0.5, 0.9, 1.05):
        a = mixing.find_exponent(tokens, 1110, target_entropy=target)
        assert math.isclose(mixing.entropy(mixing.tempered(tokens, a)), target, rel_tol=1e-9)
    assert mixing.find_exponent(tokens, 1110, target_entropy=5.0) == 0.0
    a = mixing.find_exponent(tokens, 1110, repetition_limit=4.0)
    w = mixing.tempered(tokens, a)
    assert 0 < a < 1 and math.isclose(max(w[i] * 1110 / tokens[i] for i in range(3)), 4.0, rel_tol=1e-9) and w[3] == 0
    with pytest.raises(ValueError):
        mixing.find_exponent(tokens, 5000, repetition_limit=4.0)


@pytest.mark.parametrize("how", [{"repetition_limit": 1.5}, {"target_entropy": 2.0}, {"repetition_limit": 5.0, "budget": 300_000}])
def test_mixing(docs, texts, how):
    rows = mixing.mix(docs, blocks=16, **how).collect()
    count = {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert len(rows) == len(texts) and all(r.n_tokens == count[r.doc_id] for r in rows)
    budget = how.get("budget", sum(count.values()))
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    totals = {s: sum(r.n_tokens for r in rs) for s, rs in by.items()}
    names = sorted(totals)
    a = mixing.find_exponent([totals[s] for s in names], budget, how.get("target_entropy"), how.get("repetition_limit"))
    weights = dict(zip(names, mixing.tempered([totals[s] for s in names], a), strict=True))
    for s, rs in by.items():
        rs.sort(key=lambda r: (r.pass_start, r.n_tokens))
        at = 0
        for r in rs:  # one gapless order of the source
            assert r.pass_start == at and math.isclose(r.weight, weights[s])
            at += r.n_tokens
        taken, longest = sum(r.copies * r.n_tokens for r in rs), max(r.n_tokens for r in rs)
        assert -1e-3 <= taken - weights[s] * budget <= longest
        assert {r.copies for r in rs} <= {int(weights[s] * budget // totals[s]), int(weights[s] * budget // totals[s]) + 1}
        blocks = [b for b, _ in itertools.groupby(r.block for r in rs if r.n_tokens)]
        assert len(blocks) == len(set(blocks))  # blocks come whole


def test_mixing_keeps_columns_that_clash(spark):
    names = ["rest_", "s_", "b_", "in_block", "mix_source", "mix_inside", "mix_from", "mix_rest", "passes_", "block_start"]
    rows = [(i, f"src{i % 3}", "a b c d " * (i % 7), *(f"{n}{i}" for n in names)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mix(df, repetition_limit=2.0)
    assert got.columns == [*df.columns, "n_tokens", "weight", "block", "pass_start", "copies"]
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
    assert mixing.realise(df, repetition_limit=2.0).columns == df.columns


def test_mixing_odd(odd, empty):
    rows = mixing.mix(odd, repetition_limit=1.0).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect()) and all(r.copies == 1 for r in rows if r.n_tokens)
    assert mixing.realise(odd, repetition_limit=1.5).columns == odd.columns
    assert mixing.mix(empty, repetition_limit=2.0).count() == 0 and mixing.realise(empty, repetition_limit=2.0).count() == 0
