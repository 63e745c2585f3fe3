import random

from pyspark.sql import functions as F

from codelore.llm import chat as C

PIECES = ["\\", "<s>", "</s>", "[INST]", "<\\s>", "<", "[", "s>", "<|turn|>", "<\\|turn|>", "\\\\", "a", "\n", "é", "<|text|>", "<|end|>", "|end|>", "[/INST]", "<\\\\s>"]


def test_escape_is_reversible_and_hides_controls(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 9))) for _ in range(2000)]
    t = C.Template()
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("e", C.escape(F.col("t"), t)).withColumn("u", C.unescape(F.col("e"), t))
    rows = df.collect()
    assert all(r.t == r.u for r in rows)
    assert not any(c in r.e for r in rows for c in t.controls)


def test_round_trip_machine_and_mask(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    orders = {0: ["user"], 1: ["system", "user", "assistant"], 2: ["assistant", "user"], 3: ["user", "user"], 4: ["system"], 5: ["user", "assistant"] * 100, 6: ["robot", None]}
    for conv, order in orders.items():
        turns = [(r, "".join(rng.choices(PIECES, k=4)) if i % 7 else None) for i, r in enumerate(order)]
        rows += [(conv, i, r, x) for i, (r, x) in enumerate(turns)]
        expected[conv] = [(r or "", x or "") for r, x in turns]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = C.format_conversations(df).withColumn("turns", C.read_turns(F.col("formatted"))).withColumn("trained", C.trained_text(F.col("segments")))
    got = {r.conv_id: r for r in out.collect()}
    for conv, turns in expected.items():
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].n_turns == len(turns)
        assert got[conv].trained == "".join(x for r, x in turns if r == "assistant")
    assert {c: got[c].valid for c in orders} == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True, 6: False}


def test_null_conversation_repeated_rows_and_empty_table(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in C.format_conversations(df).collect()}
    assert got[None].n_turns == 2 and got[1].n_turns == 1
    assert C.format_conversations(df.where("false")).collect() == []


def test_equals_sql(spark):
    from tests.llm.oracle import assert_same

    assert_same(spark, "/root/testdata/sf0.01", C.op4_chat_formatting, C.ORACLE)


def test_very_long_texts_ties_and_clashing_columns(spark):
    long = "a <s> [INST] \\ é </s>\n" * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "!"), (2, 0, "user", "b"), (2, 0, "assistant", "a"), (2, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"valid": F.lit("mine"), "formatted": F.lit("mine"), "bucket": F.lit(3)})
    got = {r.conv_id: r for r in C.format_conversations(df).withColumn("turns", C.read_turns(F.col("formatted"))).withColumn("trained", C.trained_text(F.col("segments"))).collect()}
    assert got[1].valid and [tuple(t) for t in got[1].turns] == [("user", long), ("assistant", long + "!")] and got[1].trained == long + "!"
    # Turns of one number are in the order of role, then text.
    assert [tuple(t) for t in got[2].turns] == [("assistant", "a"), ("user", "a"), ("user", "b")]
