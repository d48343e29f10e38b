"""Passages whose seeds stand in many other documents: no partner is lost among them."""

import re
import time

import numpy as np
import pyarrow as pa

from lodestone.llm import common, passages


def hidden(rng, decoys):
    """A passage, a later version of it with every sixth word changed, and documents with a half of that version."""
    said = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    before = said(60)
    after = [w if i % 6 else f"x{w[1:]}" for i, w in enumerate(before)]
    halves = [" ".join(said(30) + half + said(30)) for i in range(decoys) for half in (after[:30], after[30:])]
    return " ".join(said(50) + before + said(50)), " ".join(said(50) + after + said(50)), halves


def test_partner_behind_other_documents(spark):
    rng, rows, want = np.random.default_rng(5), [], set()
    for c in range(10):
        early, late, halves = hidden(rng, 7)
        base = c * 1000
        # two halves are the seeds' first documents, the others the nearest ones
        rows += [(base + i, t) for i, t in enumerate(halves[:2])] + [(base + 10, early)] + [(base + 20 + i, t) for i, t in enumerate(halves[2:])] + [(base + 900, late)]
        want.add((base + 900, base + 10))
    found = passages.find_passages(spark.createDataFrame(rows, "doc_id long, text string"), sample=1).collect()
    assert {(r.doc_id, r.other) for r in found if r.n_words >= 55} == want


def test_partner_in_another_slice(spark):
    early, late, halves = hidden(np.random.default_rng(6), 30)
    kind = "doc_id long, text string"
    one = spark.createDataFrame([(1000, early)], kind).coalesce(1)
    # a slice in which so many documents hold the seeds that it sends them under a name of its own
    many = spark.createDataFrame([*((i, t) for i, t in enumerate(halves)), (2000, late)], kind).coalesce(1)
    found = passages.find_passages(one.union(many)).collect()
    assert {(r.doc_id, r.other) for r in found if r.n_words >= 55} == {(2000, 1000)}


def test_tiles_lose_no_pair(spark, monkeypatch):
    early, late, halves = hidden(np.random.default_rng(7), 30)
    docs = spark.createDataFrame([(0, early), *((i + 1, t) for i, t in enumerate(halves)), (2000, late)], "doc_id long, text string")
    whole = sorted(passages.find_passages(docs).collect())
    monkeypatch.setattr(passages, "TILE", 8)
    monkeypatch.setattr(passages, "MANY", 3)
    assert sorted(passages.find_passages(docs).collect()) == whole and any((r.doc_id, r.other) == (2000, 0) for r in whole)


def test_words_in_order_and_around():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 12, (200, 76)).astype(np.uint8), rng.integers(0, 12, (200, 100)).astype(np.uint8)
    assert passages.in_order(a, b).tolist() == [passages.common_words(x[x > 0], y[y > 0]) for x, y in zip(a, b, strict=True)]
    said = rng.random((700, 256)) < 0.3
    own = rng.integers(0, 256, (700, 76)).astype(np.uint8)
    want = [max(int(s[o[i : i + 40]].sum()) for i in range(37)) for s, o in zip(said, own, strict=True)]
    assert passages.likeness_of_pairs(own, said, 40).tolist() == want
    for n in (100, 700):  # both ways to count
        assert passages.likeness(own[0], said[:n].T.astype(np.uint8), 40).tolist() == passages.likeness_of_pairs(np.repeat(own[:1], n, 0), said[:n], 40).tolist()


def test_powers_go_with_a_task():
    powers, inverse = common.powers_upto(1 << 17)
    assert (powers[:9] * inverse[:9] == 1).all()
    common.give_back()
    assert len(common._powers) == len(common._inverse) == 1
    assert (common.powers_upto(1 << 17)[0] == powers).all()


def test_likeness_by_bits():
    rng = np.random.default_rng(9)
    for n, words, need in ((1, 40, 32), (70, 40, 32), (900, 40, 33), (130, 7, 5), (130, 76, 61)):
        own, said = rng.integers(0, 256, (150, 76)).astype(np.uint8), rng.random((n, 256)) < 0.75
        said[:, 0] = False
        want = [(i, j) for i in range(150) for j in np.flatnonzero(passages.likeness_of_pairs(np.repeat(own[i : i + 1], n, 0), said, words) >= need).tolist()]
        got = passages.likeness_by_bits(own, said, words, need)
        assert sorted(zip(*(x.tolist() for x in got), strict=True)) == want and (n < 100 or want)


def test_links_that_go_on():
    later, earlier, score = np.array([9, 9, 9, 7, 7, 9]), np.array([1, 2, 3, 1, 2, 4]), np.array([5, 8, 8, 4, 3, 2])
    seen = []
    kept = passages.enough_links(later, earlier, score, lambda links: seen.extend(links.tolist()) or later[links] == 9)
    assert kept.tolist() == [1, 3, 4] and seen == [3, 1]


def test_a_place_has_one_link(spark):
    """A line that every document has in other surroundings: each later place goes on with one partner, not with all."""
    rng = np.random.default_rng(10)
    said = lambda n: [f"w{i}" for i in rng.integers(0, 50_000, n)]
    line = said(60)
    rows = [(d, " ".join(said(60) + line + said(60))) for d in range(50)]
    texts = spark.createDataFrame(rows, "d long, t string")
    at = {d: [m.start() for m in re.finditer(r"\S+", t)] for d, t in rows}
    places = spark.createDataFrame([(7, d, at[d][90]) for d, _ in rows], "h long, doc long, x int")
    none = spark.createDataFrame([], "doc long, start long, end long")
    links = passages.left_over(places, texts, none, passages.REACH, 40, 0.8).collect()
    assert sorted(r.doc for r in links) == list(range(1, 50))
    # 40 words that agree are no more than must: all partners are looked at
    rows = [(d, " ".join(said(60) + line[:40] + said(60))) for d in range(50)]
    at = {d: [m.start() for m in re.finditer(r"\S+", t)] for d, t in rows}
    places = spark.createDataFrame([(7, d, at[d][80]) for d, _ in rows], "h long, doc long, x int")
    links = passages.left_over(places, spark.createDataFrame(rows, "d long, t string"), none, passages.REACH, 40, 0.8).collect()
    assert len(links) > 1200 and {r.doc for r in links} == set(range(1, 50))


def test_common_words_of_long_equal_texts():
    """What both sequences begin or end with costs no rows of as many bits as they have words."""
    a = np.arange(200_000) * 7
    b = np.delete(a, 100_000)
    b[100_050] = -1
    before = time.process_time()
    assert passages.common_words(a, b) == passages.common_words(b, a) == 199_998
    assert passages.common_words(a, a) == 200_000 and passages.common_words(a[:0], a) == 0
    assert time.process_time() - before < 2
    rng = np.random.default_rng(11)
    for _ in range(300):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        row = [0] * (len(b) + 1)
        for x in a.tolist():
            row, last = [0], row
            for j, y in enumerate(b.tolist()):
                row.append(max(last[j] + 1 if x == y else 0, last[j + 1], row[j]))
        assert passages.common_words(a, b) == row[-1]


def test_chains_of_many_pairs():
    """The chains of many pairs together are those of each pair alone, and so are the stretches around them."""
    rng = np.random.default_rng(12)
    of = np.sort(rng.integers(0, 400, 1500))
    x = rng.integers(0, 3000, 1500)
    y = x + rng.integers(-2, 3, 1500) * rng.integers(0, 200, 1500).clip(150) + 1000
    pair, found = passages.chains_of_pairs(of, x, y, passages.GAP)
    want = [(i, *c) for i in np.unique(of).tolist() for c in sorted(passages.chains(x[of == i], y[of == i]))]
    assert [(i, *c) for i, c in zip(pair.tolist(), found.tolist(), strict=True)] == want and len(want) > len(np.unique(of))
    for lo, hi in ((found[:, 0], found[:, 1]), (found[:, 2], found[:, 3])):
        row, windows = passages.merged_of_rows(pair, lo, hi, 272)
        assert [windows[row == i].tolist() for i in np.unique(pair)] == [passages.merged(lo[pair == i], hi[pair == i], 272).tolist() for i in np.unique(pair)]


def test_words_around_chains():
    """Chains looked up together: the words that touch the stretch, also before the first and behind the last text's end."""
    rng = np.random.default_rng(13)
    pieces = [[" ".join("x" * n for n in rng.integers(1, 9, m)) for m in rng.integers(1, 40, k)] for k in (2, 1, 3)]
    at = [np.cumsum([7, *(len(p) + 50 for p in row[:-1])]).tolist() for row in pieces]
    spans = [sorted((b + int(i), b + int(i) + 3) for b, p in zip(bases, row, strict=True) for i in rng.integers(0, len(p), 3)) for bases, row in zip(at, pieces, strict=True)]
    spans[0].append((5000, 5001))
    rows = pa.RecordBatch.from_pydict({"s": pieces, "at": at, "lo": [[s[0] for s in r] for r in spans], "hi": [[s[1] for s in r] for r in spans]})
    got = passages.Stretches(rows, 20)
    first = 0
    for r, (bases, row) in enumerate(zip(at, pieces, strict=True)):
        words = [(b + m.start(), b + m.end()) for b, p in zip(bases, row, strict=True) for m in re.finditer(r"\S+", p)]
        for c, (lo, hi) in enumerate(spans[r]):
            begin = sum(e <= lo - 20 for _, e in words)
            i0, i1, end = (sum(s < to for s, _ in words) for to in (lo, hi, hi + 20))
            end = max(end, i0 + 1)
            near, a, b, at_word = got.around(r, c)
            assert (a, b, at_word) == (i0 - begin, min(max(i0 + 1, i1), end) - begin, first + begin)
            assert near.tolist() == got.hash[first + begin : first + end].tolist()
        first += len(words)
