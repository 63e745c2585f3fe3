import random

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from codelore.llm import token_counts as C

DATA = open(P.path(C.VOCABULARY), "rb").read()
MODEL = C.PieceModel(DATA)
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=DATA)
PARTS = ["the", "The", " ", "  ", "   ", "\n", "\t", "▁", "▁▁", "</s>", "<s>", "<unk>", "<0x41>", "é", "漢", "😀", "\u00a0", "\u200b", "x", "ing", "1234", "...", "-", "ß", "\x00", "\x1c"]


def whole(text):
    return len(LIBRARY.encode(text or "", add_bos=False, add_eos=False))


def test_counts_equal_the_library_on_mixed_parts():
    rng = random.Random(11)
    for _ in range(3000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 30)))
        assert MODEL.count(text) == whole(text), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_counts_equal_the_library_on_any_text(text):
    if not any("\ud800" <= c <= "\udfff" for c in text):
        assert MODEL.count(text) == whole(text)


def test_documents(spark):
    rows = C.op9_token_counts(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), whole(text), whole(text) > 4096)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "aaaaaaaaa bbbbbb", "k"), (3, "aaaaaaaaa bbbbbb", "k"), (None, " ", None)], "doc_id long, text string, _text string")
    rows = C.count_tokens(df, keep=("doc_id", "_text")).collect()
    assert sorted((r.doc_id or 0, r._text or "", r.n_tokens) for r in rows) == [(0, "", whole(" ")), (1, "k", 0), (2, "k", 0), (3, "k", whole("aaaaaaaaa bbbbbb")), (3, "k", whole("aaaaaaaaa bbbbbb"))]
    assert C.count_tokens(df.where("false")).collect() == []
    for name in ("n_bytes", "N_Tokens", "over_limit"):
        with pytest.raises(ValueError):
            C.count_tokens(df.withColumn(name, df.doc_id), keep=("doc_id", name))
    named = C.count_tokens(df.withColumn("n_tokens", df.doc_id)).columns
    assert named == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_very_long_texts(spark):
    texts = ["word 42, " * 1_200_000, "x" * 200_000, " " * 100_000, "漢字かな" * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in C.count_tokens(df).collect()}
    assert got == {i: (len(t.encode()), whole(t), True) for i, t in enumerate(texts)}


def test_a_character_that_no_piece_has_falls_back_to_bytes():
    assert MODEL.count("\U00010900") == whole("\U00010900") >= 4
