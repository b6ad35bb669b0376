import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import CLASHES, SF, awkward, empty

from trapline.llm import bpe, queries

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(queries.piece_model())


def encoded(encoder, texts):
    ids, off = encoder(texts)
    return [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])]


CASES = ["", " ", "  ", "a", "▁▁ x", " x  ", "\n\n", " " * 1500 + "a", "!" * 3000, "the" * 900, "ab" * 700 + " x", " " * 17, "<s> x </s> <unk> <0x41>", "a" * 40, "a\0b", "ａＢ", "　\tx",
         "日本語テキスト" * 90, "😀" * 600, "é", "\U0010ffff", "0123456789" * 80]


def test_cases(library, encoder):
    assert encoded(encoder, CASES) == [library.encode(t) for t in CASES]
    for t in CASES:
        ids, off = encoder([t])
        assert encoder.model.decode_rows(ids, off) == [library.decode(library.encode(t))]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text("aeth inro▁ \n.,!é0", max_size=80)), max_size=6))
def test_any_text(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    encoder = bpe.Encoder(queries.piece_model())
    want = [library.encode(t) for t in texts]
    assert encoded(encoder, texts) == want
    ids, off = encoder(texts)
    assert encoder.model.decode_rows(ids, off) == [library.decode(x) for x in want]


def test_long_words_by_both_ways(library, encoder, monkeypatch):
    words = ["the" * 300, "aab" * 400, "=" * 999, "Qu4" * 200 + "é" * 300]
    heap = encoded(encoder, words)
    monkeypatch.setattr(bpe, "LONG_WORD", 10**9)
    assert encoded(bpe.Encoder(queries.piece_model()), words) == heap == [library.encode(w) for w in words]


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 3)
    encoder = bpe.Encoder(queries.piece_model())
    for t in ["one two three four five", "one six", "seven one two"]:
        assert encoded(encoder, [t]) == [library.encode(t)]


def test_awkward_rows(spark, library):
    docs = awkward(spark, CLASHES)
    rows = bpe.encode(docs, queries.piece_model()).collect()
    want = sorted(((r["doc_id"], library.encode(r["text"] or "")) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=repr) == want
    assert all(r["score"] == "own" for r in rows)
    back = bpe.decode(bpe.encode(docs, queries.piece_model()), queries.piece_model()).collect()
    assert sorted(((r["doc_id"], r["decoded"]) for r in back), key=repr) == sorted(((d, library.decode(x)) for d, x in want), key=repr)


def test_decoding_of_lists_that_no_text_gives(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [0, 1, 2]), (4, [198]), (5, [264])], "doc_id long, ids array<int>")
    awkward(spark)
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, queries.piece_model()).collect()}
    assert got[1] == got[2] == "" and got[5] == "a" and got[3] == bpe.UNKNOWN_SURFACE and "�" in got[4]


def test_empty(spark):
    assert bpe.encode(empty(spark), queries.piece_model()).collect() == []


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for d, t in docs.items():
        ids = library.encode(t)
        want[d] = len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids))
    assert {r["doc_id"]: tuple(r)[1:] for r in queries.op10_sentencepiece(spark, SF).collect()} == want


def test_round_trip_is_encode_and_decode(spark):
    docs = awkward(spark, CLASHES)
    model = queries.piece_model()
    one = bpe.round_trip(docs, model).select("doc_id", "text", "ids", "decoded", "score").collect()
    two = bpe.encode(docs, model).collect()
    back = bpe.decode(bpe.encode(docs, model), model).collect()
    assert sorted((repr((r["doc_id"], r["ids"])) for r in one)) == sorted(repr((r["doc_id"], r["ids"])) for r in two)
    assert sorted((repr((r["doc_id"], r["decoded"])) for r in one)) == sorted(repr((r["doc_id"], r["decoded"])) for r in back)
    assert bpe.round_trip(empty(spark), model).collect() == []
