"""Imports and definitions of files in languages that have no parser here, by patterns."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from codelore.functions import fixed

IMPORT = "struct<module:string,line:long>"
SYMBOL = "struct<kind:string,name:string,line:long,bases:array<string>>"
_IMPORT = pa.struct([("module", pa.string()), ("line", pa.int64())])
_SYMBOL = pa.struct([("kind", pa.string()), ("name", pa.string()), ("line", pa.int64()), ("bases", pa.list_(pa.string()))])


def analyse_source(source: str, language: str | None, definitions: dict | None = None) -> tuple[list[dict], list[dict]]:
    """(imports, symbols) of one file; a module is listed once, at its first match of a pattern.

    A line is that on which the match begins.  Languages without patterns have neither.
    """
    known = (definitions or fixed.DEFINITIONS).get(language or "", {})
    breaks = [i for i, c in enumerate(source) if c == "\n"] if known else []
    line = lambda m: bisect_left(breaks, m.start()) + 1
    first: dict[str, int] = {}
    for pattern in known.get("imports", ()):
        for m in re.finditer(pattern, source):
            if name := m[1].strip():
                first.setdefault(name, line(m))
    symbols = []
    for kind in ("class", "function"):
        for m in re.finditer(known[kind], source) if kind in known else ():
            names = [g for g in m.groups() if g]
            symbols.append({"kind": kind, "name": names[0], "line": line(m), "bases": names[1:]})
    return [{"module": name, "line": at} for name, at in first.items()], symbols


def analyse(files: DataFrame, definitions: dict | None = None) -> DataFrame:
    """(repository, path, language, line_count, imports, symbols) of files (repository, path,
    language, content), each on its own; ``definitions`` are the patterns of each language.
    """
    schema = pa.schema([("repository", pa.string()), ("path", pa.string()), ("language", pa.string()), ("line_count", pa.int64()), ("imports", pa.list_(_IMPORT)), ("symbols", pa.list_(_SYMBOL))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(3).to_pylist()]
            found = [analyse_source(t, k, definitions) for t, k in zip(texts, b.column(2).to_pylist(), strict=True)]
            columns = [*b.columns[:3], pa.array([t.count("\n") + 1 for t in texts], pa.int64()), pa.array([i for i, _ in found], schema.field(4).type), pa.array([s for _, s in found], schema.field(5).type)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return files.select("repository", "path", "language", "content").mapInArrow(run, f"repository string, path string, language string, line_count long, imports array<{IMPORT}>, symbols array<{SYMBOL}>")
