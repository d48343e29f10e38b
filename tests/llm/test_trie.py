"""The trie of conversations against a brute-force version and SQL."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from lodestone.llm import queries, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [y[2:] for y in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + v[h:])
    nodes, kids = defaultdict(list), defaultdict(set)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[v[:d]].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].add(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in nodes:
        w = (len(nodes[k]) - 1) * len(WORD.findall(k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += w
            leaves[k[:d]] += not kids[k]
    ends = {k: ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)) for k, m in nodes.items()}
    return sorted((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items())


def found(spark, rows, tasks=None):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, shard int")
    return sorted(map(tuple, trie.prefix_trie(df, tasks).collect()), key=lambda r: (r[0], r[1], r[2] or -1, r[7]))


@pytest.mark.parametrize(("cells", "ids", "tasks"), [(1 << 20, 4096, 2), (6, 2, 3), (1, 1, 1)])
def test_trie_matches_brute_force(spark, monkeypatch, cells, ids, tasks):
    monkeypatch.setattr(trie, "CELLS", cells)
    monkeypatch.setattr(trie, "IDS", ids)
    rng = random.Random(cells)
    rows = []
    for c in range(60):
        texts = ["x y", "z", "", None] if c % 2 else ["the same first turn"]
        rows += [(c, t if t or c % 3 else None, rng.choice(["u", "a", None]) if c % 2 else "u", rng.choice(texts)) for t in range(rng.randint(1, 5))]
    rows += [(None, 1, "u", "x"), (1_000_003, 1, "u", "word " * 3000)]
    rows += [(c, t, "u", f"turn {t}") for c in (400, 401) for t in range(200)]  # long ones
    rows += [(10_000 + c, t, "u", "a copy") for c in range(30) for t in range(2)]  # a group of copies
    want = sorted(brute(rows), key=lambda r: (r[0], r[1], r[2] or -1, r[7]))
    assert found(spark, rows, tasks) == want


def test_trie_odd(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "u", "x")]) == []
    # a conversation whose only turn is replaced by none, as the first of its twenty is absent
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    assert found(spark, [(c, 1, "u", "x")]) == brute([(c, 1, "u", "x")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    # repeated rows are turns of their own, ties have one order
    tied = [(20, 1, "u", "b"), (20, 1, "u", "a"), (20, 1, "u", "a"), (40, 1, "u", "a"), (40, 1, "u", "a"), (40, 1, "u", "b")]
    rows = found(spark, tied, 2)
    assert len(rows) == 4 and {r[3] for r in rows} == {2} and sum(r[6] for r in rows if r[1] == 0) == 3


def test_corrections_where_nothing_is_shared():
    import numpy as np

    a, b = (np.array([1]), np.array([1]), np.array([5])), (np.array([2]), np.array([2]), np.array([7]))
    (root,) = trie.corrections(a, b)
    assert (root["depth"], root["n_children"], root["n_leaves"], root["saved"]) == (0, 0, 0, 0)


def test_trie_query(spark, sf_dir):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{sf_dir}/conversations.parquet'").fetchall()
    duckdb.sql(f"create or replace view conversations as select * from '{sf_dir}/conversations.parquet'")
    got = sorted(map(tuple, queries.op11_conversation_trie(spark, sf_dir).collect()), key=str)
    assert got == sorted(brute(rows), key=str) == sorted(duckdb.sql(queries.CONVERSATION_TRIE_SQL).fetchall(), key=str)
