"""SentencePiece encoding, spans and decoding against the library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from lodestone.llm import pieces, queries

MODEL = queries.tokenizer_path("piece_bpe_32k.model")
PARTS = ["a", "b", "the ", " ", "  ", "\n", "▁", "é", "日本", "🎉", "<s>", "</s>", "<0x41>", "\t", "\x00", " ", "Hello", " world", ".", "ﬁ", "é", "�", "​", "① ｶﾞ", "̈", "\r\n"]
RULES = ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "\n", " \n ", "x " * 3000, "日" * 2000]
    return fixed + ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_spans_and_text_match_the_library(library):
    tokenizer, texts = pieces.PieceTokenizer(MODEL), odd_texts(1500)
    assert tokenizer.cuts
    ids, begins, ends = tokenizer.encode(pa.array(texts))
    for i, text in enumerate(texts):
        at = slice(ids.starts[i], ids.starts[i] + ids.lengths[i])
        want = library.encode(text, return_type="proto").pieces
        assert ids.flat[at].tolist() == [p.id for p in want], repr(text)
        assert list(zip(begins[at].tolist(), ends[at].tolist(), strict=True)) == [(p.begin, p.end) for p in want], repr(text)
        assert "".join(text.encode()[p:q].decode() for p, q in zip(begins[at], ends[at], strict=True)) == text
        both = [1, *ids.flat[at].tolist(), 2]
        assert tokenizer.decode(np.array(both)).decode() == library.decode(both), repr(text)


def test_any_ids_decode_as_the_library_does(library):
    tokenizer, rng = pieces.PieceTokenizer(MODEL), random.Random(4)
    space = library.piece_to_id("▁")
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), space]) for _ in range(rng.randint(0, 8))]
        assert tokenizer.decode(np.array(ids, np.int64)).decode() == library.decode(ids), ids


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_character_map_matches_the_library(rule, trim, prefix):
    normal = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, escape_whitespaces=True, remove_extra_whitespaces=trim)
    compiled = {n: v for n, _, v, _ in pieces.fields(normal.serialized_model_proto())}[pieces.NORMALISER]
    compiled = {n: v for n, _, v, _ in pieces.fields(compiled)}[2]
    mine = pieces.Normaliser(pieces.CharacterMap(compiled), prefix, trim)
    for text in [*odd_texts(200, 7), "Å ｱﾊﾞ ①  ﷺ  ½", " ｶﾞ "]:
        made, where = mine.read(text.encode())
        want, offsets = normal.normalize(text, with_offsets=True)
        assert made.decode() == want
        chars = np.concatenate(([0], np.cumsum([len(c.encode()) for c in text])))
        starts = np.concatenate(([0], np.cumsum([len(c.encode()) for c in want]))).astype(int)
        assert np.searchsorted(chars, where[starts]).tolist() == list(offsets)


@pytest.mark.parametrize("rule", RULES[:2])
def test_spans_through_a_character_map(tmp_path, rule):
    """The model with a map that changes characters, cut in chunks or whole, against the library."""
    normal = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    compiled = {n: v for n, _, v, _ in pieces.fields(normal.serialized_model_proto())}[pieces.NORMALISER]
    compiled = {n: v for n, _, v, _ in pieces.fields(compiled)}[2]

    def sized(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    spec = b"\x12" + sized(len(compiled)) + compiled + b"\x18\x01\x20\x00\x28\x01"
    with open(MODEL, "rb") as f:
        kept = b"".join(whole for number, _, _, whole in pieces.fields(f.read()) if number != pieces.NORMALISER)
    path = tmp_path / "mapped.model"
    path.write_bytes(kept + b"\x1a" + sized(len(spec)) + spec)
    library, tokenizer = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.PieceTokenizer(str(path))
    assert not tokenizer.cuts  # characters become spaces
    texts = odd_texts(400, 9)
    ids, begins, ends = tokenizer.encode(pa.array(texts))
    for i, text in enumerate(texts):
        at = slice(ids.starts[i], ids.starts[i] + ids.lengths[i])
        want = library.encode(text, return_type="proto").pieces
        assert [(p.id, p.begin, p.end) for p in want] == list(zip(*(x[at].tolist() for x in (ids.flat, begins, ends)), strict=True)), repr(text)


@pytest.mark.parametrize("cuts", [False, True])
def test_chunks_of_mapped_characters(cuts):
    """A map without spaces leaves texts cut in chunks; both ways give the same ids and spans."""
    tokenizer = pieces.PieceTokenizer(MODEL)

    class Fold:  # ``ä`` becomes ``ae``, ``ﬁ`` becomes ``fi``
        first = frozenset("äﬁ".encode()[i] for i in (0, 2))

        def longest(self, raw, at):
            made = {"ä": b"ae", "ﬁ": b"fi"}
            return next(((v, len(k.encode())) for k, v in made.items() if raw.startswith(k.encode(), at)), None)

        def untouched(self, raw):
            return not self.first & set(raw)

    tokenizer.normaliser.characters, tokenizer.cuts = Fold(), cuts
    texts = ["die ﬁnger ändern\nsich ä", "ä", "\nﬁ ﬁ", "日本 ä日"]
    ids, begins, ends = tokenizer.encode(pa.array(texts))
    for i, text in enumerate(texts):
        at = slice(ids.starts[i], ids.starts[i] + ids.lengths[i])
        plain = tokenizer.segmenter.encode("▁" + text.replace(" ", "▁").replace("ä", "ae").replace("ﬁ", "fi"))
        assert ids.flat[at].tolist() == plain
        want = tokenizer.whole(text)
        assert begins[at].tolist() == want[1].tolist() and ends[at].tolist() == want[2].tolist()
        assert ends[at][-1] == len(text.encode())


def test_piece_queries(spark, sf_dir, library):
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    got = {r.doc_id: r for r in queries.op12_piece_round_trip(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        ids = [1, *library.encode(text or ""), 2]
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids).encode()))


def test_pieces_odd(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "a\tb", None), (3, "a\tb", None), (None, "naïve 日本", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = pieces.encode_decode(df, MODEL, outputs=True)
    assert got.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "token_ids", "span_begins", "span_ends", "decoded"]
    out = sorted(got.collect(), key=str)
    assert [r.n_tokens for r in out if not r.text] == [2, 2] and [r.decoded for r in out if not r.text] == ["", ""]
    assert [r.decoded for r in out if r.doc_id == 3] == ["a\tb"] * 2
    (last,) = [r for r in out if r.doc_id is None]
    raw = last.text.encode()
    assert b"".join(raw[i:j] for i, j in zip(last.span_begins, last.span_ends, strict=True)) == raw
    assert pieces.encode_decode(df.limit(0), MODEL).count() == 0
