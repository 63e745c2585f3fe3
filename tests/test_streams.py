"""Embedding in steps, import jobs, conversation state and live events."""

import time

import numpy as np
import pytest

from codelore.operators import embedding
from codelore.sources.store import Store
from codelore.streaming import events, jobs


def test_hashing_embedder():
    e = embedding.Hashing(64)
    a, b, c, none = e(["the parser reads files", "the parser reads files", "quite other words here", ""])
    assert np.allclose(a, b) and abs(np.linalg.norm(a) - 1) < 1e-6 and not none.any()
    assert a @ e(["the parser reads"])[0] > a @ c


def test_embed(spark):
    chunks = spark.createDataFrame([(i, f"word{i} common", "x") for i in range(70)] + [(99, None, "x")], "id long, content string, embeddings string")
    rows = embedding.embed(chunks, at_once=16).collect()
    assert len(rows) == 71 and {len(r.embedding) for r in rows} == {embedding.DIMENSIONS}
    sizes = []
    embedding.embed(chunks, lambda texts: sizes.append(len(texts)) or np.zeros((len(texts), 3)), at_once=16).count()
    for bad in (lambda texts: np.zeros((len(texts) + 1, 3)), lambda texts: np.zeros(len(texts))):
        with pytest.raises(Exception, match="one vector"):
            embedding.embed(chunks, bad).collect()
    assert embedding.embed(chunks.where("false")).collect() == []


def test_embed_in_steps(spark, tmp_path):
    chunks = spark.range(40).selectExpr("id", "concat('text ', id) as content")
    told = []
    n = embedding.embed_in_steps(chunks, lambda df: df.write.mode("append").parquet(f"{tmp_path}/v"), lambda done, total: told.append((done, total)), steps=4)
    assert n == 40 and told[-1] == (40, 40) and len(told) == 4 and told == sorted(told)
    assert spark.read.parquet(f"{tmp_path}/v").select("id").distinct().count() == 40


def test_jobs(spark, tmp_path):
    now = iter(range(100))
    j = jobs.Jobs(Store(spark, str(tmp_path)), lambda: next(now))
    assert j.get("r") == {}
    seen = []
    done = j.run("r", ("cloning", lambda: seen.append(j.get("r")["state"])), ("building_graph", lambda: seen.append(j.get("r")["state"])), ("indexing_code", lambda: j.progress("r")(3, 9)))
    assert done["state"] == "ready" and (done["done"], done["total"]) == (3, 9) and seen == ["cloning", "building_graph"]

    def fails():
        raise OSError("no network")

    failed = j.run("r", ("cloning", fails), ("building_graph", lambda: seen.append("never")))
    assert failed["state"] == "error" and "no network" in failed["error"] and "never" not in seen
    j.start("r")
    with pytest.raises(RuntimeError):
        j.start("r")
    with pytest.raises(ValueError):
        j.advance("r", "ready")
    assert j.start("other")["state"] == "cloning"


def test_focus_carries_over(spark, tmp_path):
    spark.createDataFrame([(1, 1, "a"), (1, 2, None), (2, 1, None)], "conv_id long, turn long, focus string").coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = "conv_id long, turn long, focus string"

    def run():
        state = events.conversation_state(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), keep=2, forget_after="1 hour")
        query = state.writeStream.format("memory").queryName("focus").outputMode("update").option("checkpointLocation", f"{tmp_path}/c").start()
        # A query that waits for keys to time out does not end by itself.
        for _ in range(300):
            if spark.table("focus").count() >= 2:
                break
            time.sleep(0.2)
        query.stop()
        return {r.conv_id: (r.n_turns, r.held, r.focus) for r in spark.table("focus").collect()}

    assert run() == {1: (2, 2, "a"), 2: (1, 1, None)}


def test_broadcast(spark, tmp_path):
    spark.createDataFrame([("r", [f"n{i}" for i in range(90)], "n1", None), ("s", None, None, "hi")], "repository string, node_ids array<string>, focus string, note string").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    mine, all_ = [], []
    events.broadcast(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda: [("r", mine.append), (None, all_.append)], f"{tmp_path}/c").awaitTermination(120)
    assert [e["repository"] for e in mine] == ["r"] and len(mine[0]["node_ids"]) == 60 and {e["repository"] for e in all_} == {"r", "s"}
    assert {e["note"] for e in all_} == {"", "hi"}


def test_listener(spark, tmp_path):
    told = []
    listener = jobs.listen(spark, told.append)
    spark.range(5).write.parquet(f"{tmp_path}/in")
    spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    for _ in range(100):
        if any(x["state"] == "ended" for x in told):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert {"started", "ended"} <= {x["state"] for x in told} and sum(x.get("rows", 0) for x in told) == 5
