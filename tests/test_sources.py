import os
import subprocess

import pytest
from pyspark.sql import functions as F

from codelore.operators import chunking, graph
from codelore.sources import files, gitlog, store
from codelore.streaming import events


def test_scan_and_classify(spark, tmp_path):
    kept = {"main.py": "print(1)\n", "web/app.ts": "let a = 1\r\n", "web/__init__.py": "x = 1\n", "_private.py": "y = 2\n"}
    skipped = {"yarn.lock": ("x", "ignored_filename"), "a.min.js": ("x", "generated_file"), "p.png": ("x", "ignored_extension"), "notes.txt": ("x", "unsupported_extension"), "blank.py": (" \n\u00a0", "empty"), "README.md": ("x", "ignored_stem"), "license": ("x", "ignored_stem"), "history.py": ("x", "ignored_stem"), ".gitignore": ("x", "ignored_filename"), "nul.py": ("a\x00b", "binary_content")}
    for name, text in [*kept.items(), *((n, t) for n, (t, _) in skipped.items()), ("node_modules/x.py", "1"), ("Build/y.py", "1")]:
        path = tmp_path / name
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(text.encode())
    found = files.scan(spark, str(tmp_path), "demo")
    assert {r.path: r.skip_reason for r in found.select("path", "skip_reason").collect()} == {**{k: None for k in kept}, **{k: r for k, (_, r) in skipped.items()}}
    rows = {r.relative_path: r for r in files.parsed(found).collect()}
    assert rows["web/app.ts"].language == "typescript" and rows["main.py"].extension == ".py"
    assert {r.reason: r.files for r in files.statistics(found).collect()}["kept"] == 4


def test_git_log(spark):
    log = "\x00".join(["a\x1fAnn\x1f100\x1fp\x1fone\nM\tx.py\nA\ty\\z.py", "b\x1fBob\x1f200\x1fp q\x1fmerge\nM\tx.py", "bad"])
    headers = gitlog.parse_headers(spark.createDataFrame([(log,)], "raw string"), "raw")
    assert [(r.sha, r.is_merge, r.summary) for r in headers.collect()] == [("a", False, "one"), ("b", True, "merge")]
    assert {(r.sha, r.path, r.change_type) for r in gitlog.commit_files(headers).collect()} == {("a", "x.py", "M"), ("a", "y/z.py", "A")}
    assert gitlog.commit_files(headers, bulk=1).collect() == []


def test_refs_and_log_of_a_checkout(spark, tmp_path):
    def git(*arguments, when="1700000000"):
        env = {**os.environ, "GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000", "GIT_CONFIG_GLOBAL": "/dev/null"}
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=Ann", "-c", "user.email=a@b.c", *arguments], check=True, capture_output=True, env=env)

    git("init", "-b", "main")
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "src" / "pkg" / "__init__.py").write_text("token_secret = 'abcdefgh123'\n")
    git("add", ".")
    git("commit", "-m", "first")
    git("tag", "-a", "v1", "-m", "one")
    git("branch", "work")
    for ref in ("origin/HEAD", "origin/main", "origin/feature/x"):
        git("update-ref", f"refs/remotes/{ref}", "HEAD")
    (tmp_path / "b.txt").write_text("x")
    git("add", ".")
    git("commit", "-m", "second", when="1700000500")
    for source in (gitlog.GitLogSource, gitlog.GitRefsSource):
        spark.dataSource.register(source)
    refs = {(r.kind, r.name): r.created_at for r in gitlog.parse_refs(spark.read.format("gitrefs").load(str(tmp_path))).collect()}
    assert refs == {("branch", "main"): 1700000500, ("branch", "work"): 1700000000, ("branch", "feature/x"): 1700000000, ("tag", "v1"): 1700000000}
    headers = gitlog.parse_headers(spark.read.format("gitlog").load(str(tmp_path)), "raw")
    assert {(r.path, r.module, r.change_type) for r in gitlog.commit_files(headers).collect()} == {("src/pkg/__init__.py", "src/pkg", "A"), ("b.txt", "(root)", "A")}
    row = files.file_content(spark, str(tmp_path), "src/pkg/__init__.py").first()
    assert (row.content, row.line_count, row.truncated, row.findings) == ("token_secret = '[REDACTED]'\n", 2, False, ["assignment:token_secret"])
    os.symlink("/etc/hostname", tmp_path / "link")
    for bad, error in (("../x", PermissionError), ("link", PermissionError), ("none.py", FileNotFoundError)):
        with pytest.raises(error):
            files.file_content(spark, str(tmp_path), bad)


def test_store(spark, tmp_path):
    old = spark.createDataFrame([("1", "r", "a.py", "h1"), ("2", "r", "b.py", "h2")], "id string, repository string, relative_path string, file_hash string")
    new = spark.createDataFrame([("2", "r", "b.py", "h3"), ("3", "s", "c.py", "h4")], old.schema)
    merged = store.upsert(old, new)
    assert {(r.id, r.file_hash) for r in merged.collect()} == {("1", "h1"), ("2", "h3"), ("3", "h4")}
    assert old.where(store.where(relative_path=["a.py", "zz"])).count() == 1
    for bad in ({"nope": 1}, {"symbol": []}):
        try:
            store.where(**bad)
            raise AssertionError
        except ValueError:
            pass


def test_incremental_index(spark):
    chunk = lambda df: df.select("repository", "relative_path", "file_hash", F.lit(0).alias("chunk_index"), "content")
    schema = "repository string, relative_path string, file_hash string, content string"
    first = spark.createDataFrame([("r", "a", "1", "x"), ("r", "b", "2", "y"), ("r", "c", "3", "z")], schema)
    stored = events.incremental_index(first, None, chunk)
    second = spark.createDataFrame([("r", "a", "1", "x"), ("r", "b", "9", "new"), ("r", "d", "4", "w")], schema)
    done = events.incremental_index(second, stored, chunk)
    assert {(r.relative_path, r.content) for r in done.collect()} == {("a", "x"), ("b", "new"), ("d", "w")}


def test_streams(spark, tmp_path):
    source = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(source).schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(source).write.mode("overwrite").parquet(f"{tmp_path}/in")
    stream = events.windowed_counts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").agg(F.sum("n")).first()[0] == 1000
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    turns.write.parquet(f"{tmp_path}/turns")
    state = events.conversation_state(spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/turns"), keep=3)
    query = state.writeStream.format("memory").queryName("state").outputMode("update").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = spark.table("state").groupBy("conv_id").agg(F.max("n_turns").alias("n"), F.max("held").alias("held"))
    assert last.agg(F.sum("n")).first()[0] == turns.count() and last.agg(F.max("held")).first()[0] == 3


def test_graph_invariants(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 4), (4, 5), (5, 6)], "source long, target long")
    nodes = spark.createDataFrame([(1,), (3,), (4,)], "node long")
    assert {(r.source, r.target) for r in graph.induced(edges, nodes).collect()} == {(1, 3), (3, 4)}
    ranked = spark.createDataFrame([("r", "a", 1, ["f1"]), ("r", "b", 2, ["f2", "m"]), ("r", "c", 3, ["f1"])], "repository string, node string, rank int, chain array<string>")
    assert {r.node for r in graph.knowledge_subset(ranked, 3).collect()} == {"a", "f1", "c"}
    # However many do not fit, a later one that does is found; repositories do not share a limit.
    many = [("r", f"x{i}", i, [f"f{i}"]) for i in range(60)] + [("r", "last", 99, None), ("s", "y", 1, ["g"])]
    rows = graph.knowledge_subset(spark.createDataFrame(many, ranked.schema), 3).collect()
    assert {(r.repository, r.node) for r in rows} == {("r", "x0"), ("r", "f0"), ("r", "last"), ("s", "y"), ("s", "g")}


def test_character_windows(spark):
    text = "  " + "ab\n" * 1500 + "  "
    rows = chunking.character_windows(spark.createDataFrame([(1, text), (2, None), (3, " "), (4, "short")], "doc_id long, text string")).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in rows] == [0, 1, 2] and {r.doc_id for r in rows} == {1}
    assert rows[0].start_line == 1 and rows[1].start_line == 634
