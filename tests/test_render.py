"""Rendered texts, whole."""

from pyspark.sql import functions as F

from codelore.operators import navigation, render

ROW = """named_struct(
  'turns', array(named_struct('question', 'what?', 'answer', concat(' a\\nb', repeat('c', 500))), named_struct('question', 'and?', 'answer', cast(null as string))),
  'node', named_struct('kind', 'file', 'name', 'a.py', 'key', 'x/a.py'),
  'uses', array(named_struct('name', 'b.py', 'key', 'x/b.py')), 'none', cast(array() as array<struct<name:string,key:string>>),
  'counts', map('file', 3, 'class', 1, 'method', 2),
  'modules', array(named_struct('name', 'web', 'file_count', 1, 'line_count', 9, 'primary_language', ''), named_struct('name', 'api', 'file_count', 2, 'line_count', 30, 'primary_language', 'python')),
  'window', named_struct('total', 5, 'first_at', 86400, 'last_at', 0),
  'edges', array(named_struct('source', 'web', 'target', 'api')),
  'externals', array(named_struct('name', 'json', 'uses', 2), named_struct('name', 'abc', 'uses', 7)))"""


def test_texts(spark):
    r = spark.range(1).select(F.expr(ROW).alias("r")).select("r.*")
    c = F.col
    out = r.select(
        render.conversation(c("turns")).alias("talk"),
        render.dependencies(c("node"), c("uses"), c("none")).alias("deps"),
        render.architecture(F.lit("demo"), c("counts"), c("modules"), c("window"), c("edges"), c("externals")).alias("arch"),
        render.hotspot_reason(F.lit("structural"), F.lit("module"), F.lit("api"), F.lit("api"), F.lit(4)).alias("hot"),
        render.size_reason(F.lit("a.py"), F.lit(700), F.lit(2), F.lit(9), F.lit("high")).alias("size"),
        render.document([("FACTS", F.lit("one")), ("EMPTY", F.lit("  ")), ("CODE", F.lit("two"))]).alias("doc"),
    ).first()
    assert out.talk == "User: what?\nAssistant: a b" + "c" * 397 + " …\nUser: and?"
    assert out.deps == "file a.py (x/a.py)\n\nDepends on (1):\n  -> b.py  [x/b.py]\n\nUsed by: nothing inside this repository."
    assert out.arch == (
        "Repository: demo\nIndexed: 3 files, 1 classes, 2 functions/methods.\n\nModules (largest first):\n  - api: 2 files, 30 lines, mainly python\n  - web: 1 files, 9 lines, mainly mixed\n\n"
        "(Dates below are limited to the indexed history window: 5 commits from 1970-01-02 to unknown. Earlier history was not walked, so these are not module creation dates.)\n\n"
        "Module dependencies (source imports target):\n  - web -> api\n\nMost used external packages: abc (7), json (2)"
    )
    assert out.hot == "4 modules in this repository import api, so a change to it can affect all of them."
    assert out.size == "a.py is 700 lines with 2 classes and 9 functions (complexity band: high)."
    assert out.doc == "FACTS\none\n\n---\n\nCODE\ntwo"


def test_commit_target(spark):
    t = spark.range(1).select(navigation.commit_target(F.lit("demo"), F.lit("0123456789"), F.lit("Fix it")).alias("t")).select("t.*").first()
    assert (t.available, t.target_type, t.commit_sha, t.focus_mode, t.label) == (True, "commit", "0123456789", "timeline", "View 01234567 — Fix it")
