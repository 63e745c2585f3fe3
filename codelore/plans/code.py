"""Queries over a small repository of Python files: syntax units, symbols, and resolved edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.operators import chunking, othercode, pycode
from codelore.plans.shared import Registry, table
from codelore.streaming import events

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

FILES = [
    ("shop", "shop/__init__.py", "from .models import Order\n"),
    ("shop", "shop/base.py", "from abc import ABC\nfrom typing import Protocol\n\n\nclass Saves(Protocol):\n    def save(self): ...\n\n\nclass Base(ABC):\n    def load(self):\n        return 1\n\n    def close(self):\n        return self.load()\n"),
    ("shop", "shop/models.py", "import json\nfrom shop.base import Base, Saves\n\n\nclass Order(Base, Saves):\n    def save(self):\n        self.close()\n        return super().load()\n\n\ndef make():\n    return Order()\n"),
    ("shop", "shop/service.py", "from shop import Order\nfrom shop.models import make as build\nimport shop.base\n\n\ndef run():\n    order = Order()\n    order.save()\n    build()\n    return shop.base.Base()\n"),
    ("shop", "tests/test_service.py", "from shop.service import run\n\n\ndef test_run():\n    assert run()\n"),
    ("shop", "broken.py", "def oops(:\n"),
]


def _files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "repository string, path string, content string")


def _expected(names: str, rows: list[tuple], long: bool = False) -> str:
    """SQL for stated rows."""
    text = lambda x: f"{x}::bigint" if long and isinstance(x, int) else repr(x)
    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


UNITS = [
    ("shop/__init__.py", 0, "module", "", 1, 1), ("shop/base.py", 0, "module", "", 1, 2), ("shop/base.py", 1, "class", "Saves", 5, 6), ("shop/base.py", 2, "class", "Base", 9, 14), ("shop/models.py", 0, "module", "", 1, 2),
    ("shop/models.py", 1, "class", "Order", 5, 8), ("shop/models.py", 2, "function", "make", 11, 12), ("shop/service.py", 0, "module", "", 1, 3), ("shop/service.py", 1, "function", "run", 6, 10),
    ("tests/test_service.py", 0, "module", "", 1, 1), ("tests/test_service.py", 1, "function", "test_run", 4, 5),
]


#: Rows of parsed code are stated: they can be read off the files above.
@R.frame("ast_units", _expected("path, chunk_index, chunk_type, symbol, start_line, end_line", UNITS, True))
def ast_units(spark: SparkSession, d: str) -> DataFrame:
    return chunking.python_units(_files(spark)).drop("content")


SYMBOLS = [
    ("shop/base.py", "Saves", "class", 5, 6), ("shop/base.py", "Saves.save", "method", 6, 6), ("shop/base.py", "Base", "class", 9, 14), ("shop/base.py", "Base.load", "method", 10, 11), ("shop/base.py", "Base.close", "method", 13, 14),
    ("shop/models.py", "Order", "class", 5, 8), ("shop/models.py", "Order.save", "method", 6, 8), ("shop/models.py", "make", "function", 11, 12), ("shop/service.py", "run", "function", 6, 10), ("tests/test_service.py", "test_run", "function", 4, 5),
]


@R.frame("py_symbols", _expected("path, name, kind, start_line, end_line", SYMBOLS, True))
def py_symbols(spark: SparkSession, d: str) -> DataFrame:
    found = pycode.analyse(_files(spark)).select("path", F.explode("symbols").alias("s"))
    return found.select("path", "s.name", "s.kind", "s.start_line", "s.end_line")


SNIPPETS = [
    ("web", "app.ts", "typescript", "import { go } from './lib/go';\nexport default class App extends Base {}\nexport async function start() {}\n"),
    ("web", "Box.java", "java", "import java.util.List;\npublic final class Box {}\ninterface Lid {}\n"),
    ("web", "run.go", "go", "import \"fmt\"\nfunc (b *Box) Run() {}\n"),
    ("web", "lib.rs", "rust", "use std::io;\npub fn open() {}\npub enum Kind { A }\n"),
    ("web", "x.css", "css", "a { }\n"),
]


def _snippets(spark: SparkSession) -> DataFrame:
    return othercode.analyse(spark.createDataFrame(SNIPPETS, "repository string, path string, language string, content string"))


#: The expected rows are stated, as the patterns are not SQL.
@R.frame("code_imports", _expected("path, module, line", [("app.ts", "./lib/go", 1), ("Box.java", "java.util.List", 1), ("run.go", "fmt", 1), ("lib.rs", "std::io", 1)]))
def code_imports(spark: SparkSession, d: str) -> DataFrame:
    return _snippets(spark).select("path", F.explode("imports").alias("i")).select("path", "i.module", F.col("i.line").cast("int").alias("line"))


@R.frame(
    "code_symbols",
    _expected(
        "path, kind, name, line",
        [("app.ts", "class", "App", 1), ("app.ts", "function", "start", 2), ("Box.java", "class", "Box", 1), ("Box.java", "class", "Lid", 2), ("run.go", "function", "Run", 1), ("lib.rs", "function", "open", 1), ("lib.rs", "function", "Kind", 2)],
    ),
)
def code_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _snippets(spark).select("path", F.explode("symbols").alias("s")).select("path", "s.kind", "s.name", F.col("s.line").cast("int").alias("line"))


_EDGE = "kind, source, target, via, first_line, count"
IMPORTS = [
    ("IMPORTS", "shop/__init__.py", "shop/models.py", "", 1, 1), ("IMPORTS", "shop/models.py", "shop/base.py", "", 2, 2), ("IMPORTS", "shop/service.py", "shop/__init__.py", "", 1, 1), ("IMPORTS", "shop/service.py", "shop/base.py", "", 3, 1),
    ("IMPORTS", "shop/service.py", "shop/models.py", "", 2, 1), ("IMPORTS", "tests/test_service.py", "shop/service.py", "", 1, 1),
]


@R.frame("import_resolve", _expected(_EDGE, IMPORTS, True))
def import_resolve(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, "IMPORTS")


@R.frame("inherits_edges", _expected(_EDGE, [("IMPLEMENTS", "shop/models.py::Order", "shop/base.py::Saves", "", 5, 1), ("INHERITS", "shop/models.py::Order", "shop/base.py::Base", "", 5, 1)], True))
def inherits_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, "INHERITS", "IMPLEMENTS")


CALLS = [
    ("CALLS", "shop/base.py::Base.close", "shop/base.py::Base.load", "self", 14, 1), ("CALLS", "shop/models.py::Order.save", "shop/base.py::Base.close", "self", 7, 1), ("CALLS", "shop/models.py::Order.save", "shop/base.py::Base.load", "super", 8, 1),
    ("CALLS", "shop/models.py::make", "shop/models.py::Order", "constructor", 12, 1), ("CALLS", "shop/service.py::run", "shop/base.py::Base", "constructor", 10, 1), ("CALLS", "shop/service.py::run", "shop/models.py::Order", "constructor", 7, 1),
    ("CALLS", "shop/service.py::run", "shop/models.py::Order.save", "local-instance", 8, 1), ("CALLS", "shop/service.py::run", "shop/models.py::make", "name", 9, 1), ("CALLS", "tests/test_service.py::test_run", "shop/service.py::run", "name", 5, 1),
]


@R.frame("calls_edges", _expected(_EDGE, CALLS, True))
def calls_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, "CALLS")


def _edges(spark: SparkSession, *kinds: str) -> DataFrame:
    return pycode.resolve(pycode.analyse(_files(spark))).where(F.col("kind").isin(*kinds)).select("kind", "source", "target", "via", "first_line", "count")


#: A unit of 200 lines of 33 to 35 characters is cut about every 2,000; a short and an empty one.
@R.frame("oversize_split", _expected("unit, piece, first, last", [(1, 0, 0, 57), (1, 1, 56, 112), (1, 2, 111, 166), (1, 3, 165, 199), (2, 0, 0, 1), (4, 0, 0, 1), (4, 1, 1, 2)], True))
def oversize_split(spark: SparkSession, d: str) -> DataFrame:
    sizes = [len(f"line {i} of a unit that is too long\n") for i in range(200)]
    return chunking.oversize(spark.createDataFrame([(1, sizes), (2, [5, 6]), (3, []), (4, [3000, 10, 3000])], "unit long, sizes array<long>"))


ORDERS = [("shop/models.py::Order", 0, "shop/models.py::Order"), ("shop/models.py::Order", 1, "shop/base.py::Base"), ("shop/models.py::Order", 2, "shop/base.py::Saves"), ("shop/base.py::Base", 0, "shop/base.py::Base"), ("shop/base.py::Saves", 0, "shop/base.py::Saves")]


@R.frame("c3_mro", _expected("cls, position, base", ORDERS, True))
def c3_mro(spark: SparkSession, d: str) -> DataFrame:
    return pycode.orders(pycode.analyse(_files(spark))).drop("repository")


@R.frame(
    "sliding_events",
    """with s as (select event_type, epoch_us(ts) as t from {events}), k as (select event_type, (t // 43200000000 - i) * 43200000000 as start from s, (select unnest([0, 1]) as i))
    select event_type, start, count(*) as n from k group by event_type, start""",
)
def sliding_events(spark: SparkSession, d: str) -> DataFrame:
    return events.windowed_counts(table(spark, d, "events"), "1 day", "12 hours").select("event_type", F.unix_micros("start").alias("start"), "n")


@R.frame(
    "session_events",
    """with e as (select user_id, epoch_us(ts) as t, lag(epoch_us(ts)) over (partition by user_id order by ts) as before from {events}),
    s as (select user_id, t, sum(case when before is null or t - before >= 21600000000 then 1 else 0 end) over (partition by user_id order by t rows unbounded preceding) as session from e)
    select user_id, min(t) as start, max(t) + 21600000000 as "end", count(*) as n from s group by user_id, session""",
)
def session_events(spark: SparkSession, d: str) -> DataFrame:
    return events.session_counts(table(spark, d, "events"), "6 hours").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n")


@R.frame("conversation_tail", "select conv_id, least(count(*), 8) as held, max(turn) as last_turn from {conversations} group by conv_id")
def conversation_tail(spark: SparkSession, d: str) -> DataFrame:
    rows = events.last_turns(table(spark, d, "conversations"))
    return rows.select("conv_id", F.size("turns").cast("long").alias("held"), F.element_at("turns", -1)["turn"].alias("last_turn"))
