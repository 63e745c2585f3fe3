"""Queries over navigation, relative imports and ordered sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.operators import navigation
from codelore.plans.shared import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: Conversation turns as an ordered list: the first place of every role stays.
R.sql(
    "ordered_dedupe",
    "select conv_id, array_join(array_distinct(transform(array_sort(collect_list(struct(turn, role))), x -> x.role)), ',') as roles from {conversations} group by conv_id",
    "select conv_id, string_agg(role, ',' order by first_turn) as roles from (select conv_id, role, min(turn) as first_turn from {conversations} group by conv_id, role) group by conv_id",
)

def _context(id: int, intent: str, nodes=(), seed=None, related=(), code=()) -> tuple:
    return id, intent, "demo", list(nodes), seed, list(related), list(code)


_FILE = ("demo::file::api/a.py", "file", "api/a.py", "a.py", "mention", "", "api")
_METHOD = ("demo::method::C.run", "method", "C.run", "run", "explorer", "core/c.py", "core")
_MODULE = ("demo::module::core", "module", "core", "core", "mention", None, None)
_FOUND = ("demo::file::z.py", "file", "z.py", "z.py", "retrieval", "", "(root)")
CONTEXTS = [
    _context(1, "readonly_request", seed=_FILE), _context(2, "architecture_analysis"), _context(3, "structure_analysis"), _context(4, "git_history_analysis"), _context(5, "git_history_analysis", seed=_METHOD),
    _context(6, "flow_analysis", nodes=["n1", "n2", "n3"]), _context(7, "hotspot_analysis", nodes=["n1"]), _context(8, "dependency_analysis", seed=_FILE, related=["r1", "r2"]), _context(9, "concept_analysis", seed=_METHOD, related=["r1"]),
    _context(10, "code_explanation", seed=_MODULE), _context(11, "repository_search", seed=_FOUND, code=[("lib/x.py", "X")]), _context(12, "code_explanation", seed=_FOUND, code=[("lib/x.py", "X")]), _context(13, "file_analysis"), _context(14, "file_analysis", code=[("", "")]),
    _context(15, "file_analysis", seed=_METHOD, related=[f"r{i}" for i in range(30)]),
]

#: Available, target, module, file, symbol, node, how many are related, focus, label, reason.
TARGETS = [
    (1, False, "", "", "", "", "", 0, "", "", "read-only refusal has no exploration target"),
    (2, True, "architecture", "", "", "", "", 0, "expand", "Explore the architecture", ""),
    (3, True, "repository", "", "", "", "", 0, "expand", "Explore demo", ""),
    (4, True, "timeline", "", "", "", "", 0, "timeline", "Open the timeline", ""),
    (5, True, "timeline", "core", "core/c.py", "", "demo::method::C.run", 0, "timeline", "See run on the timeline", ""),
    (6, True, "graph_neighborhood", "", "", "", "n1", 2, "flow", "Explore this flow", ""),
    (7, True, "graph_neighborhood", "", "", "", "n1", 0, "neighborhood", "Explore these files", ""),
    (8, True, "file", "api", "api/a.py", "", "demo::file::api/a.py", 2, "neighborhood", "Explore what connects to a.py", ""),
    (9, True, "graph_neighborhood", "core", "core/c.py", "run", "demo::method::C.run", 1, "neighborhood", "Explore what connects to run", ""),
    (10, True, "module", "core", "", "", "demo::module::core", 0, "expand", "Explore core", ""),
    (11, True, "file", "", "lib/x.py", "X", "demo::file::lib/x.py", 0, "center", "Explore x.py", ""),
    (12, False, "", "", "", "", "", 0, "", "", "no structural subject and intent is not locational"),
    (13, False, "", "", "", "", "", 0, "", "", "no retrieved code to point at"),
    (14, False, "", "", "", "", "", 0, "", "", "top chunk has no path"),
    (15, True, "symbol", "core", "core/c.py", "run", "demo::method::C.run", 20, "center", "Explore run", ""),
]
_COLUMNS = "id, available, target_type, module, file, symbol, node_id, related, focus_mode, label, reason"


def _stated(row: tuple) -> str:
    return "(" + ", ".join(str(x).lower() if isinstance(x, bool) else f"{x}::bigint" if isinstance(x, int) else f"'{x}'" for x in row) + ")"


#: The expected targets are stated: the decision is a table of cases.
@R.frame("navigation_target", f"select * from (values {', '.join(map(_stated, TARGETS))}) v({_COLUMNS})")
def navigation_target(spark: SparkSession, d: str) -> DataFrame:
    decided = navigation.decide(spark.createDataFrame(CONTEXTS, navigation.CONTEXT))
    return decided.withColumn("related", F.size("related_node_ids").cast("long")).select(*_COLUMNS.split(", "))
