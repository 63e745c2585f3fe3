"""Queries over the graph builder: a small repository in several languages, and its parts at scale.

The rows of the small repository are stated: they were worked out by hand from its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.functions import paths
from codelore.operators import builder, chunking
from codelore.plans import graphs
from codelore.plans.graphs import Repositories
from codelore.plans.shared import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: (path, content) of a repository of Python, TypeScript and Go.
MIXED = [
    ("src/shop/__init__.py", "from .models import Order\n"),
    ("src/shop/models.py", "import json, requests\nfrom typing import List\nfrom .base import Base\n\n\nclass Order(Base):\n    async def save(self):\n        return self.load()\n\n\ndef make():\n    return Order()\n"),
    ("src/shop/base.py", "import json\n\n\nclass Base:\n    def load(self):\n        return 1\n"),
    ("tests/test_shop.py", "import requests\nfrom src.shop.models import make\nfrom . import missing\n\n\ndef test_make():\n    make()\n"),
    ("broken.py", "def oops(:\n"),
    ("web/app.ts", "import { go } from './lib/go';\nimport React from 'react';\nimport x from '../web/view';\nexport class App extends Page {}\nexport class Page {}\n"),
    ("web/lib/go.ts", "import React from 'react/dom';\nimport a from '../app';\nimport q from './nowhere';\nexport function go() {}\n"),
    ("web/view.tsx", "const d = require('lib/go');\nexport const view = () => 1;\n"),
    ("main.go", "import \"fmt\"\nfunc main() {}\n"),
]


def mixed(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([("mixed", p, c) for p, c in MIXED], "repository string, relative_path string, content string")
    path = F.col("relative_path")
    return rows.withColumns({"language": paths.language(path), "file_name": paths.basename(path), "extension": F.concat(F.lit("."), paths.extension(path)), "file_hash": F.md5("content")})


def _stated(names: str, rows: list[tuple]) -> str:
    """SQL for rows that are given; whole numbers are long, None is null text."""
    text = lambda x: "null::varchar" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::bigint" if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


#: kind, key, the parent's kind and key, lines, what it counts.
NODES = [
    ("repository", "mixed", "", 0, 0, 0, 0, ""),
    ("module", "src/shop", "repository::mixed", 0, 0, 0, 0, ""), ("module", "tests", "repository::mixed", 0, 0, 0, 0, ""), ("module", "(root)", "repository::mixed", 0, 0, 0, 0, ""), ("module", "web", "repository::mixed", 0, 0, 0, 0, ""),
    ("directory", "web/lib", "module::web", 0, 0, 0, 0, ""),
    ("file", "src/shop/__init__.py", "module::src/shop", 2, 0, 0, 1, "low"), ("file", "src/shop/models.py", "module::src/shop", 13, 1, 2, 4, "low"), ("file", "src/shop/base.py", "module::src/shop", 7, 1, 1, 1, "low"),
    ("file", "tests/test_shop.py", "module::tests", 8, 0, 1, 3, "low"), ("file", "broken.py", "module::(root)", 2, 0, 0, 0, "low"), ("file", "web/app.ts", "module::web", 6, 2, 0, 3, "low"),
    ("file", "web/lib/go.ts", "directory::web/lib", 5, 0, 1, 3, "low"), ("file", "web/view.tsx", "module::web", 3, 0, 1, 1, "low"), ("file", "main.go", "module::(root)", 3, 0, 1, 1, "low"),
    ("class", "src/shop/models.py::Order", "file::src/shop/models.py", 3, 0, 0, 0, ""), ("method", "src/shop/models.py::Order.save", "class::src/shop/models.py::Order", 2, 0, 0, 0, ""), ("function", "src/shop/models.py::make", "file::src/shop/models.py", 2, 0, 0, 0, ""),
    ("class", "src/shop/base.py::Base", "file::src/shop/base.py", 3, 0, 0, 0, ""), ("method", "src/shop/base.py::Base.load", "class::src/shop/base.py::Base", 2, 0, 0, 0, ""), ("function", "tests/test_shop.py::test_make", "file::tests/test_shop.py", 2, 0, 0, 0, ""),
    ("class", "web/app.ts::App", "file::web/app.ts", 1, 0, 0, 0, ""), ("class", "web/app.ts::Page", "file::web/app.ts", 1, 0, 0, 0, ""), ("function", "web/lib/go.ts::go", "file::web/lib/go.ts", 1, 0, 0, 0, ""), ("function", "web/view.tsx::view", "file::web/view.tsx", 1, 0, 0, 0, ""),
    ("function", "main.go::main", "file::main.go", 1, 0, 0, 0, ""),
    ("external", "external/json", "repository::mixed", 0, 0, 0, 0, ""), ("external", "external/requests", "repository::mixed", 0, 0, 0, 0, ""), ("external", "external/react", "repository::mixed", 0, 0, 0, 0, ""),
]


@R.frame("graph_nodes", _stated("kind, key, parent, line_count, class_count, function_count, import_count, complexity", NODES))
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = builder.build(mixed(spark)).nodes
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    parent = F.coalesce(F.regexp_replace("parent_id", "^mixed::", ""), F.lit(""))
    return nodes.select("kind", "key", parent.alias("parent"), number("line_count"), number("class_count"), number("function_count"), number("import_count"), F.coalesce("complexity", F.lit("")).alias("complexity"))


#: kind, source, target, first line, names or way.  CONTAINS follow from the nodes' parents.
EDGES = [
    ("IMPORTS", "file::src/shop/__init__.py", "file::src/shop/models.py", 1, "Order"), ("IMPORTS", "file::src/shop/models.py", "file::src/shop/base.py", 3, "Base"), ("IMPORTS", "file::tests/test_shop.py", "file::src/shop/models.py", 2, "make"),
    ("IMPORTS", "file::web/app.ts", "file::web/lib/go.ts", 1, ""), ("IMPORTS", "file::web/app.ts", "file::web/view.tsx", 2, ""), ("IMPORTS", "file::web/lib/go.ts", "file::web/app.ts", 1, ""),
    ("DEPENDS_ON", "module::tests", "module::src/shop", 0, ""),
    ("INHERITS", "class::src/shop/models.py::Order", "class::src/shop/base.py::Base", 6, ""), ("INHERITS", "class::web/app.ts::App", "class::web/app.ts::Page", 3, ""),
    ("CALLS", "method::src/shop/models.py::Order.save", "method::src/shop/base.py::Base.load", 8, "self"), ("CALLS", "function::src/shop/models.py::make", "class::src/shop/models.py::Order", 12, "constructor"), ("CALLS", "function::tests/test_shop.py::test_make", "function::src/shop/models.py::make", 7, "name"),
]
_CONTAINED = [("CONTAINS", parent, f"{kind}::{key}", 0, "") for kind, key, parent, *_ in NODES if parent]


@R.frame("graph_edges", _stated("kind, source, target, line, said", EDGES + _CONTAINED))
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = builder.build(mixed(spark)).edges
    short = lambda c: F.regexp_replace(c, "^mixed::", "").alias(c)
    line = F.when(F.col("kind") == "CONTAINS", 0).otherwise(F.coalesce("line", F.lit(0))).cast("long").alias("line")
    return edges.select("kind", short("source"), short("target"), line, F.coalesce(F.nullif("via", F.lit("")), F.array_join("names", ","), F.lit("")).alias("said"))


@R.frame("graph_stats", _stated("repository, files, symbols, parse_failures, imports, external_imports, unresolved_imports", [("mixed", 9, 11, 1, 6, 9, 2)]))
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return builder.build(mixed(spark)).stats


# parts at scale
@graphs.query("hierarchy_nodes", "nodes", "select id, kind, name, parent_id, level from nodes where kind in ('repository', 'module', 'directory', 'file')")
def hierarchy_nodes(g: Repositories) -> DataFrame:
    files = g.files.select("repository", F.col("path").alias("relative_path"), F.lit("").alias("file_name"))
    return builder.hierarchy(files).select("id", "kind", "name", "parent_id", "level")


@graphs.query("contains_edges", "edges", "select id, line from edges where kind = 'CONTAINS'")
def contains_edges(g: Repositories) -> DataFrame:
    return builder.contains(g.nodes).select("id", F.col("line").cast("int").alias("line"))


@graphs.query("module_depends", "edges", "select repository, source, target from edges where kind = 'DEPENDS_ON'")
def module_depends(g: Repositories) -> DataFrame:
    return builder.depends(g.imports)


@graphs.query("node_id_roundtrip", "nodes", "select id, kind, key from nodes")
def node_id_roundtrip(g: Repositories) -> DataFrame:
    return g.nodes.select("id", builder.split_node_id(F.col("id")).alias("s")).select("id", "s.kind", "s.key")


for _name in ("hierarchy_nodes", "contains_edges", "module_depends", "node_id_roundtrip"):
    QUERIES[_name], ORACLES[_name] = graphs.QUERIES.pop(_name), graphs.ORACLES.pop(_name)


@R.frame(
    "call_merge",
    """select l_suppkey, l_partkey, count(*) as count, min(l_linenumber) as line, arg_min(l_returnflag, l_linenumber * 100 + ascii(l_returnflag)) as via, array_to_string(list_sort(list(l_linenumber))[1:20], ',') as lines from {lineitem} group by l_suppkey, l_partkey""",
)
def call_merge(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "lineitem").select(F.lit("r").alias("repository"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("via"))
    merged = builder.merge_calls(sites)
    return merged.select(F.col("source").alias("l_suppkey"), F.col("target").alias("l_partkey"), "count", "line", "via", F.array_join("lines", ",").alias("lines"))


_HREFS = "select page_id, unnest(hrefs) as href, unnest(range(1, len(hrefs) + 1))::int as line from (select page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) as hrefs from {pages})"


def _hrefs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("i", "href")).select("page_id", "href", (F.col("i") + 1).alias("line"))


@R.frame(
    "import_merge",
    f"""select page_id, initial, min(line) as line, string_agg(href, ',' order by first, href) as names from (select *, row_number() over (partition by page_id, initial order by first, href) as r from (
      select page_id, substr(href, 1, 2) as initial, href, min(line) as first, min(line) as line from ({_HREFS}) group by all)) where r <= 8 group by page_id, initial""",
)
def import_merge(spark: SparkSession, d: str) -> DataFrame:
    statements = _hrefs(spark, d).select(F.lit("r").alias("repository"), F.col("page_id").alias("source"), F.substring("href", 1, 2).alias("target"), F.col("href").alias("name"), "line")
    # A page id is no beginning of a link, so no statement is an import of itself.
    merged = builder.merge_imports(statements.withColumn("source", F.col("source").cast("string")))
    return merged.select(F.col("source").cast("long").alias("page_id"), F.col("target").alias("initial"), "line", F.array_join("names", ",").alias("names"))


@R.frame("external_uses", f"select href as package, count(*)::bigint as uses from ({_HREFS}) where href <> '' group by href having count(*) >= 2")
def external_uses(spark: SparkSession, d: str) -> DataFrame:
    used = _hrefs(spark, d).select(F.lit("web").alias("repository"), F.col("href").alias("package"), F.lit(1).alias("n"))
    return builder.externals(used).select(F.col("name").alias("package"), "uses")


@R.frame("namespace_ambiguity", "select p_type as path, p_name as name, case when count(distinct p_brand) = 1 then min(p_brand) end as value from {part} group by p_type, p_name")
def namespace_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    bound = table(spark, d, "part").select(F.lit("r").alias("repository"), F.col("p_type").alias("path"), F.col("p_name").alias("name"), F.col("p_brand").alias("value"))
    return builder.namespaces(bound).drop("repository")


#: (importer, module, the file that is meant)
RELATIVE = [
    ("web/app.ts", "./lib/util", "web/lib/util.ts"), ("web/app.ts", "./lib", "web/lib/index.js"), ("web/app.ts", "./view", "web/view.tsx"), ("web/app.ts", "./missing", None), ("web/lib/util.ts", "../view", "web/view.tsx"),
    ("web/lib/util.ts", "../app.ts", "web/app.ts"), ("web/lib/util.ts", "./../../top", "top.ts"), ("web/lib/util.ts", "../../../../top", "top.ts"), ("web/app.ts", "/web/view", None), ("web/app.ts", "util", "web/lib/util.js"), ("web/app.ts", "web/view", "web/view.tsx"),
    ("web/app.ts", "tool.deep", "py/tool/deep.py"), ("web/app.ts", "py.tool", "py/tool/__init__.py"), ("web/app.ts", "nothing", None), ("top.ts", "./top", "top.ts"),
]
_THERE = ["web/app.ts", "web/lib/util.ts", "web/lib/index.js", "web/view.tsx", "web/lib/util.js", "top.ts", "py/tool/deep.py", "py/tool/__init__.py"]


@R.frame("relative_resolve", _stated("importer, module, path", RELATIVE))
def relative_resolve(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame([("r", p) for p in _THERE], "repository string, relative_path string")
    imports = spark.createDataFrame([("r", p, m, 1) for p, m, _ in RELATIVE], "repository string, path string, module string, line long")
    return builder.other_imports(files, imports).select(F.col("source").alias("importer"), "module", F.col("target").alias("path"))


@R.frame("import_index", _stated("module, path", sorted({("web/app", "web/app.ts"), ("app", "web/app.ts"), ("web/lib/util", "web/lib/util.js"), ("util", "web/lib/util.js"), ("web/lib/index", "web/lib/index.js"), ("index", "web/lib/index.js"), ("web/view", "web/view.tsx"), ("view", "web/view.tsx"), ("top", "top.ts"), ("py.tool.deep", "py/tool/deep.py"), ("tool.deep", "py/tool/deep.py"), ("deep", "py/tool/deep.py"), ("py.tool", "py/tool/__init__.py"), ("tool", "py/tool/__init__.py")})))
def import_index(spark: SparkSession, d: str) -> DataFrame:
    files = spark.createDataFrame([("r", p) for p in _THERE], "repository string, relative_path string")
    return builder.import_index(files).select("module", "path")



#: Chunks of the mixed repository: Python along its syntax, other files whole, as they are short.
CHUNKS = [
    ("src/shop/__init__.py", 0, "module", "", 1, 1), ("src/shop/models.py", 0, "module", "", 1, 3), ("src/shop/models.py", 1, "class", "Order", 6, 8), ("src/shop/models.py", 2, "function", "make", 11, 12),
    ("src/shop/base.py", 0, "class", "Base", 4, 6), ("tests/test_shop.py", 0, "module", "", 1, 3), ("tests/test_shop.py", 1, "function", "test_make", 6, 7),
    ("web/app.ts", 0, "block", "", 1, 5), ("web/lib/go.ts", 0, "block", "", 1, 4), ("web/view.tsx", 0, "block", "", 1, 2), ("main.go", 0, "block", "", 1, 2),
]


@R.frame("chunk_files", _stated("relative_path, chunk_index, chunk_type, symbol, start_line, end_line", CHUNKS))
def chunk_files(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_files(mixed(spark)).select("relative_path", "chunk_index", "chunk_type", "symbol", "start_line", "end_line")
