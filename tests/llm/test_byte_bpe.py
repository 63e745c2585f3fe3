import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest

from codelore.llm import byte_bpe as B

TABLE = B.RankTable(open(P.path(B.VOCABULARY), "rb").read(), P.PATTERN)
ALPHABET = ["a", "the", " ", "  ", "\n", "'s", "'re", "'", "7", "é", "漢", "😀", "x" * 30, "\x1c", "-", "...", " ", "\t"]


def whole(text):
    return np.asarray(TABLE.encoding.encode_ordinary(text or ""), dtype="<u4").tobytes()


def run(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in B.encode(df, decoded=True, **more).collect()}


def test_stitched_equals_whole(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 400))) for _ in range(150)]
    texts += ["x" * 5000, " " * 3000, "ab " * 1000, "漢" * 900, "'s" * 700, "1" * 800 + "a" * 800]
    got = run(spark, texts, chunk=64, overlap=20, deal=100)
    for i, text in enumerate(texts):
        assert bytes(got[i].ids) == whole(text), text[:80]
        assert bytes(got[i].decoded) == text.encode()


def test_null_empty_and_production_chunk(spark):
    long = "word 42, " * 9000
    got = run(spark, [None, "", long, long, "<|endoftext|>"])
    assert got[0].ids == b"" and got[1].decoded == b""
    assert bytes(got[2].ids) == whole(long) == bytes(got[3].ids)
    assert bytes(got[4].decoded) == b"<|endoftext|>"


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a" * 100, "k"), (1, "a" * 100, "k"), (None, "b", None)], "doc_id long, text string, _body string")
    rows = B.encode(df, chunk=64, overlap=20, deal=64).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"]
    for name in ("ids", "Decoded"):
        with pytest.raises(ValueError):
            B.encode(df.withColumn(name, df.doc_id), keep=("doc_id", name))
    assert B.digests(df.where("false")).collect() == []


def test_decode_round_trip_and_unknown_identifier(spark):
    df = spark.createDataFrame([(1, "naïve — text"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: bytes(r.decoded) for r in B.decode(B.encode(df)).collect()}
    assert back == {1: "naïve — text".encode(), 2: b""}
    with pytest.raises(ValueError):
        TABLE.decode(np.asarray([60_000], dtype="<u4").tobytes())


def test_digests(spark):
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = B.digests(df).collect()[0]
    assert row.n_tokens == len(whole("hello world")) // 4
    assert row.ids_sha256 == hashlib.sha256(whole("hello world")).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()


@pytest.mark.parametrize("chunk,overlap", [(24, 8), (64, 20), (B.CHUNK, B.OVERLAP)])
def test_pieces_of_a_text_are_its_pre_tokens(chunk, overlap):
    rng = random.Random(chunk)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randint(0, 900))) for _ in range(300)]
    texts += ["x" * 5000, " " * 3000, "'" * 700, "ab " * 3000, "漢" * 4000 + " a", "a1" * 3000, "'re" * 2000, ". " * 3000, " \n" * 2000]
    for text in texts:
        pieces = list(TABLE.pieces(text, chunk, overlap))
        assert [token for piece in pieces for token in piece] == TABLE.pattern.findall(text)
        assert TABLE.encode(text, chunk, overlap) == whole(text)
    # Ordinary prose is cut about once a chunk.
    assert len(list(TABLE.pieces("some words, in 7 lines.\n" * 2000, chunk, overlap))) > 24 * 2000 / chunk / 2


def test_a_text_without_stitches_takes_linear_time():
    assert TABLE.encode("漢" * 300_000) == whole("漢" * 300_000)
