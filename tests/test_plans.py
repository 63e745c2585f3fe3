"""Plans are what they are meant to be: pushed filters, pruned columns, bounded rounds."""

import re

from pyspark.sql import functions as F

from codelore.operators import around, graph, history, insights, reads, retrieval
from codelore.plans import graphs, searches, subjects
from codelore.sources import store

SF = "/root/testdata/sf0.001"


def physical(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def count(df, pattern):
    return len(re.findall(pattern, df._jdf.queryExecution().executedPlan().toString()))


def test_filters_and_columns_reach_the_scan(spark):
    g = graphs.Repositories(spark, SF)
    plan = physical(g.nodes.where((F.col("kind") == "file") & (F.col("repository") == "alpha")).select("id"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(kind,file\)", plan) and re.search(r"ReadSchema: struct<id:string,repository:string,kind:string>", plan)
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumnRenamed("lang", "language")
    assert "In(lang, [de,en])" in physical(docs.where(store.where(language=["en", "de"])).select("doc_id"))


def test_a_search_reads_postings_where_they_lie(spark, monkeypatch):
    one = searches.questions(spark, SF).orderBy("query").limit(1)
    found = retrieval.bm25(searches.index(spark, SF), one)
    plan = physical(found)
    assert "documents.parquet" not in plan and len(re.findall(r"Location: .*/postings", plan)) == 1 and "In(term, [" in plan
    assert count(found, "BroadcastHashJoin") == 1 and count(found, "SortMergeJoin") == 0
    # Questions beyond the size that is sent are joined, with the same result.
    every = lambda: sorted(map(tuple, retrieval.bm25(searches.index(spark, SF), searches.questions(spark, SF)).collect()))
    sent = every()
    monkeypatch.setattr(retrieval, "MOST_SENT", 3)
    assert every() == sent and sent


def test_caps_are_applied_before_the_shuffle(spark):
    g = graphs.Repositories(spark, SF)
    for df in (history.newest(g.commits), history.releases(g.refs), insights.complexity(g.nodes), reads.expand(g.nodes, g.nodes.select("id"))):
        assert count(df, "WindowGroupLimit") >= 1


def test_rounds_do_not_grow_a_plan(spark):
    g = graphs.Repositories(spark, SF)
    few, many = (graph.label_propagation(g.edges.where("kind = 'CALLS'"), rounds) for rounds in (1, 6))
    assert count(few, "Exchange") == count(many, "Exchange") == 0 and count(many, "Scan ExistingRDD") == 1
    starts = insights.guess_entry(g.nodes, g.edges).select(F.col("repository").alias("request"), "id")
    shallow, deep = (insights.flow(g.nodes, g.edges, starts, depth) for depth in (2, 6))
    assert count(deep, "Exchange") == 0 and count(shallow, "Scan ExistingRDD") == 2 and count(deep, "Scan ExistingRDD") == 6
    hits, _ = around.walk(g.nodes, g.edges, around.seeds(g.nodes, subjects.questions(g)))
    assert count(hits, "Exchange") == 0 and count(hits, "FileScan") == 0
