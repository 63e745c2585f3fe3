"""Reads whose cost grows with the input and no faster, and that have no limit on rows."""

import math
import re

from pyspark.sql import functions as F

from codelore.functions import fixed, text as T
from codelore.operators import facts, history, insights, reads, retrieval
from codelore.plans import graphs, searches, stand_in, textual
from tests.test_text import brute_redact

SF = "/root/testdata/sf0.001"

NODES = "id string, repository string, kind string, name string, key string, parent_id string"


def limited(spark, rows):
    """The rows that a recursive query may make; a larger table meets the default."""
    spark.conf.set("spark.sql.cteRecursionRowLimit", rows)


def test_chains_have_no_limit_on_rows(spark):
    nodes = spark.createDataFrame([("r", "r", "repository", "r", "r", None)] + [(f"f{i}", "r", "file", f"f{i}", f"f{i}", "r") for i in range(40)], NODES)
    try:
        limited(spark, 20)
        found = reads.ancestors(nodes, nodes.where("kind = 'file'")).collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted((r.asked, r.pos, r.id) for r in found) == sorted((f"f{i}", p, x) for i in range(40) for p, x in ((0, "r"), (1, f"f{i}")))


def test_a_knowledge_graph_is_filled_from_any_rank(spark):
    """Twelve methods need three nodes each; after the first, only a file at a later rank fits."""
    rows = []
    for i in range(12):
        rows += [(f"f{i:02}", "r", "file", "f", f"k{i:02}", None), (f"c{i:02}", "r", "class", "c", f"k{i:02}::c", f"f{i:02}"), (f"m{i:02}", "r", "method", "m", f"k{i:02}::c.m", f"c{i:02}")]
    nodes = spark.createDataFrame(rows, NODES)
    edges = spark.createDataFrame([(f"e{i}{j}", "r", "CALLS", f"m{i:02}", f"m{j:02}") for i in range(12) for j in range(i)], "id string, repository string, kind string, source string, target string")
    try:
        limited(spark, 20)
        assert sorted(r.id for r in reads.knowledge(nodes, edges, 4).collect()) == ["c00", "f00", "f01", "m00"]
        assert reads.knowledge(nodes, edges, 100).count() == 36
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_changes_are_added_up_before_they_meet_windows(spark):
    """As a scan of each window counts them: windows overlap, touch, are empty; a commit has two
    times, a sha, a module and a time are missing, and rows are repeated.
    """
    rows = [("r", f"s{i % 17}" if i % 11 else None, f"p{i % 5}", None if i % 7 == 0 else f"m{i % 5}", 10 + i % 17) for i in range(90)]
    rows += [("r", "twice", "p0", "m0", 12), ("r", "twice", "p0", "m0", 20), ("r", "twice", "p0", "m0", 20), ("r", "none", "p1", "m1", None), ("q", "s", "p", "m", 15)]
    asked = [("r", "all", 0, 100), ("r", "a", 10, 14), ("r", "b", 14, 21), ("r", "c", 12, 19), ("r", "empty", 15, 15), ("r", "turned", 18, 12), ("q", "at", 14, 15), ("q", "from", 15, 20), ("z", "no", 0, 9)]
    touched = spark.createDataFrame(rows, "repository string, sha string, relative_path string, module string, authored_at long")
    found = history.changes(touched, spark.createDataFrame(asked, "repository string, request string, low long, high long"))
    want = {}
    for repository, request, low, high in asked:
        inside = [x for x in rows if x[0] == repository and x[4] is not None and low < x[4] <= high]
        for path in {x[2] for x in inside}:
            own = [x for x in inside if x[2] == path]
            want[repository, request, path] = (len({x[1] for x in own} - {None}), max(x[4] for x in own))
    assert {(r.repository, r.request, r.relative_path): (r.commits, r.last_at) for r in found.collect()} == want
    # No row is held against the bounds of a window by itself.
    assert not re.search(r"authored_at#\d+L? > low#", found._jdf.queryExecution().optimizedPlan().toString())


def broadcasts(df):
    return len(re.findall("BroadcastHashJoin", df._jdf.queryExecution().executedPlan().toString()))


def test_tables_that_grow_do_not_pass_the_driver(spark):
    for name in ("symbols", "imports", "calls", "edges"):
        assert broadcasts(stand_in.planned(spark, SF, name)) == 0, name
    assert broadcasts(stand_in.planned(spark, SF, "nodes")) == 1  # nations


def test_ends_of_relations_are_merged(spark):
    g = graphs.Repositories(spark, SF)
    for df in (reads.relations(g.nodes, g.edges), reads.degrees(reads.relations(g.nodes, g.edges))):
        assert broadcasts(df) == 0


def test_scores_are_added_up_within_shards(spark, tmp_path, monkeypatch):
    """Shards of a few documents answer as one does, and as a count of each document."""
    words = ["graph", "edge", "node", "walk", "merge"]
    texts = [(i, " ".join(words[(i * j + j) % 5] for j in range(i % 7))) for i in range(60)] + [(60, None), (61, "graph graph")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "graph walk graph"), (2, "edge"), (3, "unknown"), (None, "node")], "query long, text string")
    answers = lambda index, k: sorted((tuple(r) for r in retrieval.bm25(index, asked, k=k).collect()), key=repr)
    whole = retrieval.build_index(docs, str(tmp_path / "whole"))
    monkeypatch.setattr(retrieval, "SHARD", 4)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        parts = retrieval.build_index(docs, str(tmp_path / "parts"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert parts.postings.select("shard").distinct().count() >= 12 > whole.postings.select("shard").distinct().count()
    assert sorted(map(tuple, parts.terms.collect())) == sorted(map(tuple, whole.terms.collect())) and parts[2:] == whole[2:]
    told = [(i, t.split()) for i, t in texts if t is not None]
    assert parts[2:] == (62, sum(len(t) for _, t in told) / len(told))
    df = {w: sum(w in t for _, t in told) for w in words}
    want = []
    for query, text in ((1, "graph walk graph"), (2, "edge"), (None, "node")):
        score = lambda t: sum(math.log(1 + (62 - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / parts.mean)) for w in text.split())  # noqa: B023, E731
        found = sorted((-round(score(t), 6), i) for i, t in told if score(t) > 0)
        want += [(query, i, -s, n) for n, (s, i) in enumerate(found, 1)]
    assert answers(parts, 1000) == answers(whole, 1000) == sorted(want, key=repr)
    assert answers(parts, 5) == answers(whole, 5) == sorted((w for w in want if w[3] <= 5), key=repr)
    plan = retrieval.bm25(parts, asked)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(shard#" in plan and not re.search(r"hashpartitioning\(query#\d+L?, id#", plan)


def test_totals_need_no_index(spark):
    found = searches.bm25_totals(spark, SF)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" in plan and "hashpartitioning" not in plan and "RoundRobin" not in plan


def test_credentials_are_searched_for_once(spark):
    """Odd texts as plain Python masks them; a text's shapes are not masked again for each label."""
    texts = [*textual.SAMPLES, None, "", "KEY://", "Sk-" + "a" * 30, "a://b:c@d ghp_" + "a1" * 9 + " token = 'x'", "PRIVATE_KEY:\n\"abcdefgh\"", "ACCESS-TOKEN = 'ghp_" + "b2" * 9 + "'", "x-----BEGIN PRIVATE KEY-----".replace("x-", "\n-")]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.redacted(F.col("t")).alias("r"))
    for r in rows.collect():
        if r.t is None:
            assert r.r.text is None and r.r.labels is None
        else:
            assert (r.r.text, ",".join(r.r.labels)) == brute_redact(r.t), r.t
    plan = textual.redact_documents(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall("regexp_replace", plan)) == len(fixed.SECRETS) + 1 and "rlike" not in plan.lower()


def test_questions_and_layers_are_sent_to_the_edges(spark, monkeypatch):
    """Edges are not shuffled for a few asked nodes, whose number Spark does not know; more are joined."""
    g = graphs.Repositories(spark, SF)
    starts = insights.guess_entry(g.nodes, g.edges).select(F.col("repository").alias("request"), "id")
    planned, keep = [], insights.materialise
    monkeypatch.setattr(insights, "materialise", lambda df: planned.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    sent = sorted(map(tuple, insights.flow(g.nodes, g.edges, starts).collect()))
    assert len(planned) == 4 and all(re.search(r"BroadcastHashJoin \[source#\d+\], \[source#\d+\]", plan) for plan in planned[1:])
    monkeypatch.setattr(insights, "MOST_SENT", 0)
    assert sorted(map(tuple, insights.flow(g.nodes, g.edges, starts).collect())) == sent
    asked = spark.createDataFrame([(1, "alpha", "dependency_analysis", "alpha::file::app/main.py", [])], "question long, repository string, intent string, focus string, concepts array<string>")
    said = lambda: facts.by_intent(asked, g.nodes, g.edges, g.commits, g.commit_files, g.refs)
    few = said()
    plan = few._jdf.queryExecution().executedPlan().toString()
    ends = r"\[(source|target)#\d+\], \[(source|target)#\d+\], LeftSemi"
    assert len(re.findall(f"BroadcastHashJoin {ends}, BuildRight", plan)) >= 2 and not re.findall(rf"SortMergeJoin {ends}", plan.split("dependents")[0])
    monkeypatch.setattr(facts, "MOST_SENT", 0)
    assert [r.fact for r in said().collect()] == [r.fact for r in few.collect()]
