"""Operators of the entity graph on small inputs."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.functions import ids, text, vectors
from lodestone.operators import address, analytics, evaluate, extract, gnn, ingest, store
from lodestone.plans import planner, reader
from lodestone.shared import cut
from lodestone.sources import files, patents
from lodestone.streaming.ingest import StreamingGraph, mention_windows


def triples(spark, rows):
    return spark.createDataFrame([(0, d, i, s, r, t) for d, i, s, r, t in rows], "tenant long, doc_id long, triple_idx int, src string, rel string, dst string")


def values(spark, column, *rows):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], "x string").select(column(F.col("x"))).collect()]


# text -----------------------------------------------------------------------------------------------


def test_tokens(spark):
    assert values(spark, text.query_tokens, "Who founded the Two A-1 Café?", "", "a x é of") == [["founded", "café"], [], ["é"]]
    assert values(spark, text.embedding_tokens, "A-1  b") == [["a", "1", "b"]]
    assert values(spark, text.name_tokens, "C++ inc. C++") == [["c++", "inc."]]
    assert values(spark, text.bigrams, "The cold Widget of it", "one") == [["the cold", "cold widget"], []]


def test_profile(spark):
    score = lambda k: lambda c: text.profile(c)[k]
    assert values(spark, score("phrases"), "Marie Curie met Niels Bohr", "Alpha  Beta", "none here", "A-B. C") == [2, 2, 0, 2]
    assert values(spark, score("score"), "x" * 120, "Ab. Cd!") == [2, 14]


def test_responses(spark):
    assert values(spark, text.strip_think, "<think>a</think> b ", "a <think> never ends") == ["b", "a"]
    assert values(spark, text.strip_fence, "```json\n{}\n```", "plain") == ["{}", "plain"]
    assert values(spark, text.envelope_text, '{"text": "t"}', "raw") == ["t", "raw"]
    assert values(spark, text.is_empty_payload, " a ", "ab", None) == [True, False, True]
    assert values(spark, text.limit_in, "context window exceeds limit (1234)", "none") == [1234, None]
    assert values(spark, text.limit_in, "(7) Context window exceeds limit (99)") == [99]
    assert values(spark, text.first_object, 'x {"a": {"b": 1}} y {', "{ no", "none", None, "} {}") == ['{"a": {"b": 1}}', None, None, None, "{}"]
    assert values(spark, text.last_line, "a\n b \n\n", "") == [" b ", None]
    assert values(spark, lambda c: text.says(c, text.QUOTA_MARKERS), "Rate limit exceeded", "fine", None) == [True, False, False]


def test_ids(spark):
    a, b = values(spark, ids.entity_id, "Alice", "aLICE")
    assert a == b > 0
    labels = spark.createDataFrame([(255,), (0,), (-1,)], "tenant long").select(ids.tenant_label(F.col("tenant")))
    assert [r[0] for r in labels.collect()] == ["t00000000000000ff", "t0000000000000000", "tffffffffffffffff"]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([], []), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()]
    assert math.isclose(got[0], 1 / math.sqrt(2)) and got[1:] == [0.0, 0.0]
    rng = np.random.default_rng(0)
    e = rng.standard_normal((60, 5))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<double>")
    found = vectors.top_k(v, v.where("vec_id < 4").withColumnRenamed("vec_id", "query_id"), 3, rows=16, block=2).collect()
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    for q in range(4):
        assert [r.vec_id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == np.argsort(-unit @ unit[q])[:3].tolist()
    assert vectors.top_k(v, v.withColumnRenamed("vec_id", "query_id"), 0).count() == 0


# store ----------------------------------------------------------------------------------------------


def test_provenance_and_first_writer(spark):
    g = store.ingest(triples(spark, [(1, 0, "Ann", "knows", "Bob"), (2, 0, "ANN", "knows", "Cy")]))
    assert {(r.name) for r in g.entities.collect()} == {"Ann", "Bob", "Cy"}
    assert g.entity_docs.count() == 4
    more = store.ingest(triples(spark, [(3, 0, "bob", "knows", "Dee"), (3, 1, "bob", "knows", "Dee")]), g)
    assert {r.name for r in more.entities.collect()} == {"Ann", "Bob", "Cy", "Dee"}
    assert more.edges.count() == 4 and more.entity_docs.count() == 6
    assert store.stats(more).first()["edges"] == 4


def test_edges_need_both_ends(spark):
    e = spark.createDataFrame([(0, 1), (0, 2)], "tenant long, entity_id long")
    new = spark.createDataFrame([(0, 1, 1, 2), (0, 1, 2, 9), (0, 9, 3, 1), (0, 8, 4, 9)], "tenant long, src long, seq long, dst long")
    good, bad = store.append_edges(new, e)
    assert [r.seq for r in good.collect()] == [1] and sorted(r.seq for r in bad.collect()) == [2, 3, 4]


def test_neighbors_and_hops(spark):
    edges = spark.createDataFrame([(0, 1, i, d) for i, d in enumerate((2, 3, 4))] + [(0, 2, 5, 5), (0, 5, 6, 1), (1, 1, 7, 99)], "tenant long, src long, seq long, dst long")
    assert sorted(r.dst for r in store.neighbors(edges, 2).where("tenant = 0 and src = 1").collect()) == [2, 3]
    seeds = spark.createDataFrame([(0, 1)], "tenant long, entity_id long")
    depth = lambda h: {r.entity_id: r.depth for r in store.k_hop(edges, seeds, h, cut).collect()}
    assert depth(0) == {1: 0} and depth(1) == {1: 0, 2: 1, 3: 1, 4: 1} and depth(9) == {1: 0, 2: 1, 3: 1, 4: 1, 5: 2}
    reached = store.k_hop(edges, seeds, 2, cut)
    assert store.expanded_edges(edges, reached, 2).count() == 4


def test_snapshots(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    g = store.ingest(triples(spark, [(1, 0, "Ann", "knows", "Bob")]))
    assert s.snapshot(g) == 1 and s.snapshot(store.ingest(triples(spark, [(2, 0, "X", "knows", "Y")]), g)) == 2
    assert s.restore(1).entities.count() == 2 and s.restore(2).entities.count() == 4
    with pytest.raises(KeyError):
        s.restore(3)


def test_upsert_and_lists(spark):
    old = spark.createDataFrame([(0, 1, "a", 1), (0, 2, "b", 1)], "tenant long, entity_id long, name string, version int")
    new = spark.createDataFrame([(0, 2, "B2", 2), (0, 3, "c", 2)], "tenant long, entity_id long, name string, version int")
    assert {r.entity_id: r.name for r in store.upsert(old, new).collect()} == {1: "a", 2: "B2", 3: "c"}
    assert [r.entity_id for r in store.named(old, F.lit("B")).collect()] == [2]
    assert [r.entity_id for r in store.listing(old, "", 1).collect()] == [1]


# extraction -----------------------------------------------------------------------------------------


def test_sanitizer(spark):
    rows = [("Ann", "knows", "Bob"), ("", "knows", "Bob"), ("A" * 97, "knows", "B"), ("Erdős", "knows", "B"), ("A\n", "knows", "B"), ("A", "", "B"), ("A", "likes", "B"), ("bad Ann", "knows", "B"), (None, "knows", "B")]
    got = extract.sanitize(triples(spark, [(1, i, *r) for i, r in enumerate(rows)]), ["bad"]).orderBy("triple_idx").collect()
    assert [r.reject_reason for r in got] == [None, "NameEmpty", "NameTooLong", "NameInvalid", "NameInvalid", "RelationEmpty", None, "Blocked", "NameEmpty"]
    assert got[6].rel == "related_to"
    strict = extract.sanitize(triples(spark, [(1, 0, "A", "likes", "B")]), coerce=False).first()
    assert strict.reject_reason == "RelationUnknown"
    again = extract.sanitize(extract.sanitize(triples(spark, [(1, 0, "A", "likes", "B")])).drop("reject_reason")).first()
    assert again.rel == "related_to" and again.reject_reason is None
    assert values(spark, extract.entity_type, "Organization", "ORG", "", "Gene") == ["org", "org", "concept", "custom:Gene"]
    assert values(spark, extract.type_hint, "null", "Org", "org") == [None, "org", "custom:org"]


def test_envelopes(spark):
    whole = {"triples": [{"src": " A ", "rel": "knows", "dst": "B"}, {"src": "B", "rel": "uses", "dst": "C"}], "more": 1}
    broken = {"triples": [{"src": "A", "dst": "B"}]}
    df = spark.createDataFrame([(1, json.dumps(whole)), (2, json.dumps(broken)), (3, "no json"), (4, '{"triples": []}')], "doc_id long, response string")
    good, bad = files.parse_envelopes(df, cap=1)
    assert [(r.doc_id, r.src, r.triple_idx) for r in good.collect()] == [(1, "A", 0)] and sorted(r.doc_id for r in bad.collect()) == [2, 3]


def test_jsonl_and_cli_ingest(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"doc_id": 1, "text": "a"}\n\nnot json\n{"doc_id": 2, "text": "b", "x": 1}\n{"text": "c"}\n')
    docs, bad = files.read_documents(spark, str(tmp_path / "d.jsonl"))
    assert sorted(r.doc_id for r in docs.collect()) == [1, 2] and sorted(r.line for r in bad.collect()) == [2, 4]
    env = json.dumps({"triples": [{"src": "Ann", "rel": "knows", "dst": "Bob"}, {"src": "Ö", "rel": "knows", "dst": "B"}]})
    (tmp_path / "r.jsonl").write_text(json.dumps({"doc_id": 1, "response": env}) + "\n")
    done = cli.batch(spark, str(tmp_path / "d.jsonl"), str(tmp_path / "r.jsonl"))
    assert cli.summary(done) == {"tenant": 0, "docs_seen": 4, "docs_ingested": 1, "entities_added": 2, "edges_added": 1, "triples_skipped": 1, "failures": {"parse": 2, "writer": 1}}
    snapshots = store.Store(spark, f"file://{tmp_path}/store")
    assert snapshots.last() == 0 and snapshots.snapshot(done.graph) == 1 == snapshots.last()
    (tmp_path / "s.json").write_text('[{"query": "ann", "ground_truth": [1], "tier": 2}, {"query": "bob", "ground_truth": [7]}]')
    measured = evaluate.report_with_overall(cli.sampled(done.graph, files.read_samples(spark, str(tmp_path / "s.json")), 1), "tier").collect()
    assert {r.tier: r.recall for r in measured} == {0: 0.0, 2: 1.0, None: 0.5}
    assert cli.summary(cli.demo(spark))["entities_added"] == 4


def test_pages_and_samples(spark, tmp_path):
    import zstandard

    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.zst").write_bytes(zstandard.compress(b"<html><title> A  <b>B</b></title><h1>H</h1><p>one<br>two</p><a href=\"x\">l</a></html>"))
    (tmp_path / "p/b.zst").write_bytes(b"broken")
    pages = files.read_pages(spark, str(tmp_path / "p")).collect()
    assert sorted((r.html is None, r.error is None) for r in pages) == [(False, True), (True, False)]
    pages = [r for r in pages if r.html]
    f = text.page_fields(F.col("html"))
    row = spark.createDataFrame([(pages[0].html,)], "html string").select(*[v.alias(k) for k, v in f.items()]).first()
    assert row.asDict() == {"title": "A B", "heading": "H", "paragraphs": ["one two"], "links": ["x"]}
    (tmp_path / "q.json").write_text('[{"query": "a", "ground_truth": [1, 2], "kind": "x"}]')
    assert files.read_samples(spark, str(tmp_path / "q.json")).first().ground_truth == [1, 2]
    docs = spark.createDataFrame([(1, "a", "x"), (1, "b", "w"), (2, "c", "y")], "doc_id long, text string, file string")
    files.write_documents(docs, str(tmp_path / "out"))
    assert {r.doc_id: r.text for r in spark.read.json(str(tmp_path / "out")).collect()} == {1: "b", 2: "c"}


PAGE = """<meta name="DC.title" content="Cold   Widget."><dd itemprop="publicationNumber" repeat> US1 </dd>{abstract}
<dd itemprop="inventor">A B</dd><dd itemprop="inventor">C</dd><dd itemprop="assigneeOriginal">Org</dd><span itemprop="Code">G01</span><span itemprop="Code">G</span><span itemprop="Code">H01</span>
<dd itemprop="filingDate">2020</dd><section itemprop="claims"><div itemprop="claim"> <div>1. A <b>thing</b></div></div></section><section itemprop="description">All
 about</section><tr itemprop="backwardReferencesOrig"><td><span itemprop="publicationNumber">US2</span></td></tr><tr itemprop="forwardReferencesFamily"><td><span itemprop="publicationNumber">US3</span></td></tr>"""


def test_patents(spark, tmp_path):
    long = "An abstract that is long enough " * 4
    rows = [("b", PAGE.format(abstract=f"<abstract>{long}</abstract>")), ("a", PAGE.format(abstract=f'<div class="abstract x">{long}</div>')), ("c", PAGE.format(abstract="<abstract>thin</abstract>")), ("d", "robot"), ("e", None)]
    pages = spark.createDataFrame(rows, "path string, html string")
    f = patents.fields(F.col("html"))
    one = pages.where("path = 'b'").select(*[c.alias(n) for n, c in f.items()])
    got = one.first()
    assert (got.number, got.title, got.inventors, got.classes, got.claim, got.description, got.cites, got.cited_by) == ("US1", "Cold Widget.", ["A B", "C"], ["G01", "H01", "G"], "1. A thing", "All about", ["US2"], ["US3"])
    short = f"US1: Cold Widget.. Filed 2020 by A B, C. Assigned to Org. CPC classes: G01, H01, G. Abstract: {long.strip()}."
    assert one.select(patents.paragraph({n: F.col(n) for n in one.columns})).first()[0] == f"{short} First claim: 1. A thing..."
    assert one.select(patents.paragraph({n: F.col(n) for n in one.columns}, full=True)).first()[0] == f"{short} Claims: 1. A thing Description: All about Cites: US2. Cited by: US3."
    assert patents.documents(pages)[2].first().asDict() == {"scanned": 5, "emitted": 1, "unparseable": 2, "thin": 1, "repeated": 1}
    assert [r.file for r in patents.documents(pages)[1].collect()] == ["a"]
    assert patents.write_documents(pages, f"file://{tmp_path}/out").first().emitted == 1 and spark.read.json(f"file://{tmp_path}/out/documents").count() == 1
    facts = {(r.src, r.rel, r.dst) for r in patents.triples(one).collect()}
    assert facts == {("US1", "titled", "Cold Widget"), ("US1", "mentions", "cold widget"), ("A B", "invented", "US1"), ("C", "invented", "US1"), ("US1", "assigned_to", "Org"), *(("US1", "classified_as", c) for c in ("G01", "H01", "G")), ("US1", "cites", "US2"), ("US3", "cites", "US1")}


def test_ingest_batch_and_evolve(spark, tmp_path):
    env = lambda *t: json.dumps({"triples": [dict(zip(("src", "rel", "dst"), x, strict=True)) for x in t], "stop": True})
    docs = spark.createDataFrame([(1, "Alice founded Acme."), (2, "Bob works at Globex."), (3, "odd"), (4, "silent")], "doc_id long, text string")
    answers = spark.createDataFrame([(1, env(("Alice", "founded", "Acme"))), (2, env(("Bob", "works_at", "Globex"), ("Ö", "knows", "B"))), (3, "none")], "doc_id long, response string")
    done = ingest.ingest_batch(docs, ingest.answered(answers))
    assert done.totals.first().asDict() == {"docs_seen": 4, "docs_ingested": 2, "entities_added": 4, "edges_added": 2, "triples_skipped": 1}
    assert {(r.doc_id, r.stage) for r in done.failures.collect()} == {(3, "parse"), (4, "writer")}
    asked = spark.createDataFrame([(0, 1, "Acme"), (0, 2, "Globex")], "tenant long, query_id long, text string")
    truth = spark.createDataFrame([(1, 1), (2, 2)], "query_id long, doc_id long")

    def recall(graph):
        found = reader.read(asked, graph, 1).select("query_id", "doc_id", "rank")
        return evaluate.report(evaluate.metrics_from_rows(found, truth, asked.select("query_id"), 1)).first().recall

    # a round that drowns both answers: other documents name them too, and more
    noise = docs.limit(0).unionByName(spark.createDataFrame([(0, "noise")], "doc_id long, text string"))
    poison = spark.createDataFrame([(0, env(("Acme", "knows", "Globex"), ("Acme x", "knows", "Globex x")))], "doc_id long, response string")
    snapshots = store.Store(spark, f"file://{tmp_path}/snaps")
    kept, told = ingest.evolve(snapshots, done.graph, lambda g: ingest.ingest_batch(noise, ingest.answered(poison), g).graph, recall)
    assert told["before"] == 1.0 and told["after"] < 0.95 and told["rolled_back"] and kept.entities.count() == 4
    kept, told = ingest.evolve(snapshots, done.graph, lambda g: g, recall)
    assert not told["rolled_back"] and told["after"] == 1.0 and sorted(r.seq for r in kept.edges.collect()) == [0, 1]
    with pytest.raises(ValueError):
        ingest.single_document(spark, " \n")


# retrieval -------------------------------------------------------------------------------------------


def brute_read(queries, names, docs, k, stop=text.STOPWORDS):
    """Dense scoring of every entity for every query, in plain Python."""
    import re

    out = {}
    for q, t in queries:
        tokens = [x.lower() for x in re.split(r"[^a-zA-Z0-9]+", t) if len(x) >= 2 and x.lower() not in stop]
        raw = {}
        for e, n in names.items():
            low = n.lower()
            exact = 1.0 if low in tokens else 0.7 if set(low.split()) & set(tokens) else 0.0
            raw[e] = 1.5 * exact + tokens.count(low)
        top = max(raw.values())
        w = {e: math.exp((r - top) / 0.5) for e, r in raw.items()}
        z = sum(w.values())
        score = {d: round(sum(w[e] for e in es) / z, 9) for d, es in docs.items()}
        out[q] = sorted(score, key=lambda d: (-score[d], d))[:k]
    return out


@pytest.mark.parametrize("k", [1, 5, 40])
def test_sparse_reading_equals_dense(spark, k):
    rng = random.Random(k)
    words = [f"word{i}" for i in range(25)]
    rows = [(d, i, " ".join(rng.sample(words, rng.randint(1, 2))), "knows", rng.choice(words)) for d in range(30) for i in range(rng.randint(1, 4))]
    g = store.ingest(triples(spark, rows))
    names = {r.entity_id: r.name for r in g.entities.collect()}
    docs = {}
    for r in g.entity_docs.collect():
        docs.setdefault(r.doc_id, set()).add(r.entity_id)
    queries = [(1, "who is word1 with word2"), (2, "word3 word3"), (3, "nothing matches"), (4, "the word24")]
    df = spark.createDataFrame([(0, q, t) for q, t in queries], "tenant long, query_id long, text string")
    got = {}
    for r in sorted(reader.read(df, g, k).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert got == brute_read(queries, names, docs, k)
    wide = {}
    for r in sorted(reader.read(df, g, k, narrow_k=10_000).collect(), key=lambda r: r["rank"]):
        wide.setdefault(r.query_id, []).append(r.doc_id)
    assert wide == got


def test_constrained_reading_equals_dense(spark):
    """Inclusions, types and exclusions against dense scoring in plain Python."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(20)]
    rows = [(0, d, i, " ".join(rng.sample(words, rng.randint(1, 2))), "knows", rng.choice(words), rng.choice(["Person", "Org"]), "Org") for d in range(25) for i in range(rng.randint(1, 4))]
    g = store.ingest(spark.createDataFrame(rows, "tenant long, doc_id long, triple_idx int, src string, rel string, dst string, src_type string, dst_type string"))
    every = {r.entity_id: (r.name, r.etype) for r in g.entities.collect()}
    docs = {}
    for r in g.entity_docs.collect():
        docs.setdefault(r.doc_id, set()).add(r.entity_id)
    asked = [(1, "word1 word2", [("MustInclude", "word1")]), (2, "word3", [("EntityType", "person")]), (3, "word4 and word5", [("MustExclude", "word4")]), (4, "word6", None), (5, "word7", [("EntityType", "org"), ("MustExclude", "word7")]), (6, "word8", [("EntityType", "org"), ("EntityType", "person")]), (7, "word9", [("MustInclude", "nobody")])]
    df = spark.createDataFrame([(0, *a) for a in asked], f"tenant long, query_id long, text string, constraints {planner.CONSTRAINTS}")
    want = {}
    for q, t, must in asked:
        ok = {e: n for e, (n, kind) in every.items() if all((n == v) if c == "MustInclude" else (n != v) if c == "MustExclude" else (kind == v) for c, v in must or [])}
        mine = {d: es & set(ok) for d, es in docs.items() if es & set(ok)}
        if mine:
            want |= brute_read([(q, t)], ok, mine, 6)
    got, near = {}, {}
    for out, k in ((got, None), (near, 10_000)):
        for r in sorted(reader.read(df, g, 6, narrow_k=k).collect(), key=lambda r: r["rank"]):
            out.setdefault(r.query_id, []).append(r.doc_id)
    assert got == want and near == want
    best = reader.entities(df.drop("constraints").where("query_id = 4"), g, 5).orderBy("rank").collect()
    assert len(best) == 5 and best[0].p > best[-1].p
    sub = reader.subgraph(df.drop("constraints").where("query_id = 4"), g, 5)
    assert {r.src for r in sub.collect()} <= {r.entity_id for r in best}


def test_scores(spark):
    e = spark.createDataFrame([(0, 1, "Ann Lee", "person", ["AL"]), (0, 2, "ann", "org", []), (0, 3, "Zed", "person", None)], "tenant long, entity_id long, name string, etype string, aliases array<string>")
    p = spark.createDataFrame([(0, 7, ["ann", "ann", "ann lee kim"], ["al"], "person", None)], f"tenant long, query_id long, expansions array<string>, aliases array<string>, etype_hint string, constraints {planner.CONSTRAINTS}")
    got = {r.entity_id: r.raw for r in address.match_scores(p, e).collect()}
    assert math.isclose(got[1], 1.5 * 0.7 + 0.8 + 0.5) and math.isclose(got[2], 1.5 + 2.0) and math.isclose(got[3], 0.5)
    assert address.parse_weights("1,2,3,4,5,6").temperature == 0.7
    with pytest.raises(ValueError):
        address.parse_weights("1,2")


def test_softmax(spark):
    rows = spark.createDataFrame([(0, 1, 1, 1.0), (0, 1, 2, float("-inf")), (0, 1, 3, 2.0), (0, 2, 1, float("-inf"))], "tenant long, query_id long, entity_id long, raw double")
    p = {(r.query_id, r.entity_id): r.p for r in address.dense_softmax(rows, 1.0).collect()}
    assert math.isclose(p[1, 3], math.e / (1 + math.e)) and p[1, 2] == p[2, 1] == 0.0


def test_constraints(spark):
    e = spark.createDataFrame([(0, 1, "A", "org"), (0, 2, "A", "person"), (0, 3, "B", "org"), (0, 4, "a", "org")], "tenant long, entity_id long, name string, etype string")
    p = spark.createDataFrame([(0, 1, [("MustInclude", "A"), ("EntityType", "org")]), (0, 2, [("MustExclude", "B")])], f"tenant long, query_id long, constraints {planner.CONSTRAINTS}")
    assert [(r.query_id, r.entity_id) for r in address.constrain(p, e).collect()] == [(1, 1)]
    assert [(r.query_id, r.entity_id) for r in address.excluded(p, e).collect()] == [(2, 3)]


def test_model_plan(spark):
    q = spark.createDataFrame([(0, 1, "Two founders of Acme"), (0, 2, "plain words")], "tenant long, query_id long, text string")
    a = spark.createDataFrame([("Two founders of Acme", [" ACME Corp ", ""], ["Ac"], "Org", ["who started acme"])], "text string, expansions array<string>, aliases array<string>, etype string, probes array<string>")
    got = {r.query_id: r for r in planner.model_plan(q, a).collect()}
    assert got[1].expansions == ["acme corp", "two", "founders", "of", "acme"] and got[1].etype_hint == "org" and len(got[1].probes) == 2
    assert got[2].expansions == ["plain", "words"] and got[2].etype_hint is None


# measuring ------------------------------------------------------------------------------------------


def test_metrics(spark):
    df = spark.createDataFrame([([1, 2, 3], [3, 9]), ([], [1]), ([1], []), ([5, 5], [5, 5])], "retrieved array<long>, ground_truth array<long>")
    got = evaluate.metrics(df, 2).collect()
    assert [(r.recall, r.precision, r.mrr) for r in got] == [(0.0, 0.0, 1 / 3), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.5, 0.5, 1.0)]
    assert evaluate.report(evaluate.metrics(df, 2)).first().n == 4


def test_rewards_and_groups(spark):
    rows = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (2, 5.0), (2, 5.0)], "g long, reward double")
    adv = sorted((r.g, round(r.advantage, 6)) for r in evaluate.group_advantage(rows, "g").collect())
    assert adv == [(1, -1.224745), (1, 0.0), (1, 1.224745), (2, 0.0), (2, 0.0)]
    assert sorted((r.g, round(r.z, 6)) for r in evaluate.z_scores(rows, "g", "reward").collect()) == adv
    t = triples(spark, [(1, 0, "a", "r", "b"), (1, 1, "a", "r", "b"), (1, 2, "a", "r", "c")])
    assert math.isclose(evaluate.repetition_penalty(t, "doc_id").first().penalty, 1 / 3)
    o = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 0.0, 1.0), (1.0, 0.0, -1.0)], "new_logp double, old_logp double, advantage double")
    assert math.isclose(evaluate.objective(o).first().objective, (1.0 + 1.2 - math.e) / 3)
    assert evaluate.objective(o.limit(0)).first().objective == 0.0


# graph-neural ---------------------------------------------------------------------------------------


def test_layer(spark):
    rng = np.random.default_rng(1)
    h = rng.standard_normal((5, 4))
    pairs = [(0, 1), (0, 1), (2, 1), (1, 3)]
    layer = gnn.Layer.seeded(4, 3, seed=2)
    states = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "node long, h array<double>")
    edges = gnn.edge_features(spark.createDataFrame(pairs, "src long, dst long"), n_nodes=5)
    deg, total = np.zeros(5), np.zeros((5, 4))
    for u, _ in pairs:
        deg[u] += 1
    for u, v in pairs:
        z = np.array([deg[u], deg[v], abs(deg[u] - deg[v]), deg.mean(), len(pairs) / 20])
        total[v] += (1 + 0.1 * np.tanh(layer.w_g2 @ np.tanh(layer.w_g1 @ z))) * (layer.w_msg @ h[u])
    x = h + np.where(total >= 0, total, 0.25 * total)
    want = (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5)
    got = {r.node: r.h for r in gnn.forward(states, edges, layer).collect()}
    assert np.allclose([got[i] for i in range(5)], want)
    context = gnn.forward(states, edges, layer)
    both = {r.node: r.h for r in gnn.stack(states, edges, [layer], gnn.Head.identity(4, 1), cut).collect()}
    assert all(np.allclose(both[r.node], 1.5 * np.array(r.h)) for r in context.collect())


def test_scatter_add(spark):
    rows = spark.createDataFrame([(0, 1.0), (2, 2.0), (0, 3.0)], "i long, v double")
    assert {r.i: r.v for r in gnn.scatter_add(rows, "i", "v", 4).collect()} == {0: 4.0, 1: 0.0, 2: 2.0, 3: 0.0}
    with pytest.raises(ValueError):
        gnn.scatter_add(rows, "i", "v", 2)


# analytics, streams ------------------------------------------------------------------------


def test_analytics(spark):
    hits = spark.createDataFrame([("a", 0, 0), ("b", 0, 2), ("c", 1, 9), ("d", 3, 3), ("e", 2, 3)], "theme string, target_hits long, other_hits long")
    assert [r.status for r in analytics.gap_matrix(hits).orderBy("theme").collect()] == ["WHITE-SPACE", "CLEAR-GAP", "UNDER-INVESTED", "TARGET-LEAD", "CONTESTED"]
    assert analytics.moats(hits, smooth=False).count() == 3
    pairs = analytics.co_occurrence(spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "y"), (2, "x")], "d long, i string"), "d", "i").collect()
    assert [(r.a, r.b, r.n) for r in pairs] == [("x", "y", 2)]


def test_stream_equals_batch(spark, tmp_path):
    rows = triples(spark, [(d, i, f"N {d % 5}", "knows", f"M {i}") for d in range(20) for i in range(3)])
    rows.repartition(6).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    graph = StreamingGraph(spark, str(tmp_path / "out"))
    graph.start(stream, str(tmp_path / "check")).awaitTermination()
    key = lambda g: sorted((r.entity_id, r.name) for r in g.entities.collect())
    assert key(graph.graph()) == key(store.ingest(rows)) and graph.graph().edges.count() == 60
    timed = rows.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") * 600))
    assert mention_windows(timed).agg(F.sum("n")).first()[0] == 60
