"""The reads of a service over a small built repository, and answering with fakes."""

import pytest
from pyspark.sql import functions as F

from codelore.operators import agent, builder, context, embedding, retrieval
from codelore.plans import built
from codelore.service import Service
from codelore.sources.store import Store


@pytest.fixture(scope="module")
def graph(spark):
    return builder.build(built.mixed(spark))


@pytest.fixture(scope="module")
def service(spark, graph, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    commits = spark.createDataFrame([("mixed", f"{i}abc{i}", "Ann", 1_600_000_000 + i * 3_000_000, f"change {i}", i == 3) for i in range(5)], "repository string, sha string, author string, authored_at long, summary string, is_merge boolean")
    touched = [(i, p) for i in range(5) if i != 3 for p in ("src/shop/models.py", "README.md")] + [(4, "web/app.ts")]
    files = spark.createDataFrame([("mixed", f"{i}abc{i}", p, p.split("/")[0] if "src" not in p else "src/shop", "M", 1_600_000_000 + i * 3_000_000) for i, p in touched], "repository string, sha string, relative_path string, module string, change_type string, authored_at long")
    refs = spark.createDataFrame([("mixed", "v1", "tag", "2abc2", 1_606_000_001), ("mixed", "main", "branch", "4abc4", None)], "repository string, name string, kind string, sha string, created_at long")
    store.replace_graph("mixed", graph.nodes, graph.edges)
    store.replace_history("mixed", commits, files, refs)
    return Service.of(store, "mixed")


FILE, CLASS = "mixed::file::src/shop/models.py", "mixed::class::src/shop/models.py::Order"


def names(df, column="name"):
    return sorted(r[column] for r in df.collect())


def test_repository_reads(service):
    assert {(r.kind, r.n) for r in service.repositories().collect()} >= {("file", 9), ("edges", 40), ("commits", 5)}
    view = service.overview("mixed")
    assert names(view["nodes"]) == ["(root)", "json", "react", "requests", "src/shop", "tests", "web"]
    assert [(r.source, r.target) for r in view["edges"].collect()] == [("mixed::module::tests", "mixed::module::src/shop")]
    with pytest.raises(LookupError):
        service.overview("other")
    assert names(service.search("mixed", "ORDER")) == ["Order", "Order.save"]
    flow = service.flow("mixed").orderBy("depth").collect()
    assert [list(r.names) for r in flow] == [["app.ts"], ["go.ts", "view.tsx"]] and flow[0].label == "application entry point"
    found = {(r.category, r.path): r.value for r in service.hotspots("mixed").collect()}
    assert found[("churn", "src/shop/models.py")] == 4 and ("churn", "README.md") not in found


def test_knowledge_keeps_containers(service):
    for most in (1, 5, 50):
        kept = service.knowledge_graph("mixed", most)
        ids = {r.id: r for r in kept["nodes"].collect()}
        assert len(ids) <= most
        for r in ids.values():
            assert r.kind == "file" or r.parent_id in ids
        assert all(e.source in ids and e.target in ids for e in kept["edges"].collect())
    assert len(ids) == 20


def test_node_reads(service):
    view = service.expand(["mixed::module::web", FILE])
    assert [(r.asked[-3:], r.name) for r in view["nodes"].orderBy("asked", "pos").collect()] == [(".py", "Order"), (".py", "make"), ("web", "lib"), ("web", "app.ts"), ("web", "view.tsx")]
    assert names(view["edges"], "kind") == ["CALLS", "IMPORTS"]
    parts = {}
    for r in service.node_detail([FILE, CLASS, "mixed::module::web"]).collect():
        parts.setdefault((r.asked.split("::")[1], r.part), []).append(r.name or r.n)
    assert sorted(parts[("file", "symbols")]) == ["Order", "make"] and parts[("file", "dependencies")] == ["base.py"] and len(parts[("file", "history")]) == 4
    assert parts[("class", "parent")] == ["models.py"] and parts[("class", "children")] == ["Order.save"] and parts[("module", "children_count")] == [3]
    assert [r.name for r in service.ancestors(f"{CLASS.replace('class', 'method')}.save").orderBy("pos").collect()] == ["mixed", "src/shop", "models.py", "Order", "Order.save"]
    assert {(r.direction, r.via, r.name) for r in service.dependencies(CLASS).collect()} == {("dependencies", "INHERITS", "Base"), ("dependents", "CALLS", "make")}
    chosen = service.node_set([CLASS, "none", FILE])
    assert [(r.pos, r.name) for r in chosen["nodes"].orderBy("pos").collect()] == [(0, "Order"), (2, "models.py")]
    near = service.neighborhood(FILE)
    assert {r.id.split("::")[-1] for r in near["nodes"].collect()} >= {"src/shop/models.py", "src/shop/base.py", "src/shop/__init__.py", "tests/test_shop.py"}
    small = service.neighborhood(FILE, most=2)
    assert small["nodes"].count() == 2 and small["withheld"].first().withheld > 0


def test_history_reads(service):
    assert [r.sha for r in service.history(CLASS, 2).orderBy("pos").collect()] == ["4abc4", "2abc2"]
    line = service.timeline("mixed")
    assert names(line["releases"]) == ["v1"] and names(line["branches"]) == ["main"] and line["lanes"].where("pos = 1").first().total_commits == 4
    dots = service.commit_timeline("mixed").orderBy("pos").collect()
    assert [(r.short_sha, r.files_changed, r.release, r.truncated) for r in dots] == [("0abc0", 2, "", False), ("1abc1", 2, "", False), ("2abc2", 2, "v1", False), ("3abc3", 0, "", False), ("4abc4", 3, "", False)]
    detail = service.commit_detail("mixed", "4abc").collect()
    assert {(r.relative_path, r.indexed) for r in detail} == {("README.md", False), ("src/shop/models.py", True), ("web/app.ts", True)}
    with pytest.raises(Exception, match="too short"):
        service.commit_detail("mixed", "4").collect()
    for start, end in (("0abc", "4abc"), ("4abc", "0abc")):
        changed = service.changes_between("mixed", start, end)
        assert {(r.relative_path, r.commits) for r in changed["files"].collect()} == {("README.md", 3), ("src/shop/models.py", 3), ("web/app.ts", 1)}
    early = service.snapshot("mixed", 1_600_000_000)["modules"].collect()
    assert {r.module: r.file_count_at for r in early} == {"src/shop": 3, "tests": 1, "(root)": 2}
    late = service.snapshot_at_commit("mixed", "4abc4")
    assert {r.module for r in late["modules"].collect()} == {"src/shop", "tests", "(root)", "web"} and late["edges"].count() == 1


def test_file_content(service, tmp_path):
    (tmp_path / "src/shop").mkdir(parents=True)
    (tmp_path / "src/shop/models.py").write_text("db_password = 'correct horse'\n")
    row = service.file_content(FILE, str(tmp_path)).first()
    assert "[REDACTED]" in row.content and row.redacted
    with pytest.raises(LookupError):
        service.file_content(CLASS, str(tmp_path))


def test_graph_does_not_depend_on_the_order_of_files(spark, graph):
    again = builder.build(built.mixed(spark).orderBy(F.rand(5)).repartition(7))
    same = lambda a, b: sorted(map(str, a.select(*sorted(a.columns)).collect())) == sorted(map(str, b.select(*sorted(b.columns)).collect()))
    assert same(graph.nodes, again.nodes) and same(graph.edges, again.edges)
    assert builder.build(built.mixed(spark).where("false")).nodes.count() == 0


def test_answering(spark, graph, tmp_path):
    texts = [(1, "src/shop/models.py", "Order", "class", "class Order saves an order"), (2, "web/app.ts", "App", "class", "the app page"), (3, "main.go", "main", "function", "func main")]
    chunks = spark.createDataFrame(texts, "id long, relative_path string, symbol string, chunk_type string, content string")
    index = retrieval.build_index(chunks.withColumnRenamed("id", "doc_id"), str(tmp_path / "index"), text_col="content")
    vectors = embedding.embed(chunks).select(F.col("id").alias("vec_id"), "embedding")
    asked = spark.createDataFrame([(1, "mixed", "How does Order save?", None), (2, "mixed", "explain the page of the app", None), (3, "mixed", "Refactor main", "mixed::module::web")], "question long, repository string, text string, explorer string")
    asked = agent.classified(embedding.embed(asked, text_col="text").withColumnRenamed("embedding", "q"))
    focus = agent.resolve_focus(graph.nodes, asked.withColumn("carried", F.lit(None).cast("string")))
    about = {r.question: (r.label, r.source) for r in focus.collect()}
    assert about[1] == ("Order", "mention") and about[3] == ("web", "explorer") and about[2] == (None, "carried")
    full = asked.join(focus.select("question", "focus"), "question")
    code, hits, _ = agent.gather(index, vectors, chunks, graph.nodes, graph.edges, full)
    best = {r.question: r.relative_path for r in code.where("rank = 1").collect()}
    assert best[1] == "src/shop/models.py" and best[2] == "web/app.ts"
    assert {r.id for r in hits.where("question = 1 and distance = 0").collect()} == {CLASS}
    assert {r.id for r in hits.where("question = 2 and distance = 0").collect()} >= {"mixed::file::web/app.ts"}
    alone, around_, _ = agent.gather(None, None, chunks, graph.nodes, graph.edges, full)
    assert alone.count() == 0 and around_.where("question = 1").count() > 0
    contexts = spark.createDataFrame([(1, "q", "some context"), (2, "q", " "), (3, "q", None)], "question long, text string, context string")
    said = {r.question: r.answer for r in agent.answer(contexts, lambda q, c: F.concat(F.lit("<think>no</think> "), c, F.lit("!"))).collect()}
    assert said == {1: "some context!", 2: agent.NOTHING_FOUND, 3: agent.NOTHING_FOUND}
    turns = spark.createDataFrame([(1, i, f"q{i}", "a", "") for i in range(8)], "conv_id long, turn long, question string, answer string, focus_label string")
    held = agent.recorded(turns, turns.where("turn = 7").withColumn("turn", F.lit(8).cast("long"))).collect()
    assert sorted(r.turn for r in held) == list(range(1, 9))
    ids = agent.highlight(F.array(F.lit(None).cast("string"), F.lit(CLASS), F.lit("mixed::module::web"), F.lit("odd")), F.array(F.lit(FILE), F.lit(CLASS)), most=2)
    assert spark.range(1).select(ids.alias("x")).first().x == [CLASS, FILE]


def test_contexts_break_ties_by_id(spark):
    chunks = spark.createDataFrame([(1, i, "a.py", 0.5, i) for i in (3, 1, 2)] + [(1, 1, "a.py", 0.9, 9)], "question long, id long, relative_path string, score double, ordinal long")
    single = context.dedupe(chunks)
    assert {r.id: r.score for r in single.collect()} == {1: 0.9, 2: 0.5, 3: 0.5}
    near = spark.createDataFrame([(1, "b.py", True)], "question long, path string, seed boolean")
    assert [r.id for r in context.rank(single, near).orderBy("rank").collect()] == [1, 2, 3]


def test_odd_requests(spark, service):
    from codelore.operators import reads

    assert reads.resolve_repository(None, ["a"]) == "a" == reads.resolve_repository("a", ["a", "b"])
    for asked, there in ((None, []), (None, ["a", "b"]), ("c", ["a"])):
        with pytest.raises(LookupError):
            reads.resolve_repository(asked, there)
    assert service.expand("no::such::node")["nodes"].count() == 0 == service.ancestors("x").count() == service.node_detail([]).count()
    assert service.search("mixed", "  ").count() == 0 and service.search("mixed", "%.t_").count() == 7 and service.search("mixed", "a\\b").count() == 0
    ids = spark.createDataFrame([("a::file::x::y",), ("a::file",)], "id string").withColumn("s", builder.split_node_id(F.col("id")))
    assert ids.where("id like '%y'").first().s.key == "x::y"
    with pytest.raises(Exception, match="no node id"):
        ids.where("id not like '%y'").collect()
    loop = spark.createDataFrame([("a", "r", "file", "a", "a", "b", 3), ("b", "r", "file", "b", "b", "a", 3)], "id string, repository string, kind string, name string, key string, parent_id string, level int")
    assert [r.id for r in reads.ancestors(loop, loop.where("id = 'a'").select("id")).orderBy("pos").collect()] == ["b", "a"]


def test_strategies_can_be_added(spark):
    from codelore.operators import chunking

    whole = lambda df: df.select("path", F.lit(0).cast("long").alias("chunk_index"), F.lit("unit").alias("chunk_type"), F.lit("").alias("symbol"), F.lit(1).cast("long").alias("start_line"), F.lit(9).cast("long").alias("end_line"), "content")
    rows = chunking.chunk_files(built.mixed(spark), {"go": whole}).collect()
    assert {(r.relative_path, r.chunk_type) for r in rows if r.language == "go"} == {("main.go", "unit")}
    assert {r.chunk_type for r in rows if r.language == "python"} == {"block"}
