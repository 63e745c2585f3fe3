"""Chunks of files: character windows natively, syntax units of Python by its own parser."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

SIZE, OVERLAP, LEAST = 2000, 100, 24
_EDGE_SPACE = "^[ \t\n\r\u000b\f]+|[ \t\n\r\u000b\f]+$"


def character_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(id, chunk_index, start_line, end_line, content): overlapping windows of each stripped text.

    Windows of fewer than ``least`` stripped characters are dropped before numbering.
    """
    text = F.regexp_replace(F.col(text_col), _EDGE_SPACE, "")
    base = df.select(F.col(id_col).alias("id"), text.alias("t")).where(F.char_length("t") > 0)
    starts = base.select("id", "t", F.explode(F.sequence(F.lit(0), F.char_length("t") - 1, F.lit(size - overlap))).alias("at"))
    cut = starts.select("id", "at", F.substring("t", F.col("at") + 1, F.lit(size)).alias("piece"), F.substring("t", F.lit(1), F.col("at")).alias("before"))
    newlines = lambda c: (F.char_length(c) - F.char_length(F.replace(c, F.lit("\n"), F.lit("")))).cast("long")
    kept = cut.select("id", "at", "piece", (newlines(F.col("before")) + 1).alias("start_line")).withColumn("content", F.regexp_replace("piece", _EDGE_SPACE, "")).where(F.char_length("content") >= least)
    by_file = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return kept.select(F.col("id").alias(id_col), (by_file - 1).cast("long").alias("chunk_index"), "start_line", (F.col("start_line") + newlines(F.col("piece"))).alias("end_line"), "content")


_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def parse(source: str) -> ast.Module | None:
    """The syntax tree of a file; None if the parser does not take it."""
    try:
        return ast.parse(source)
    except (RecursionError, SyntaxError, ValueError):
        return None


def _span(node: ast.AST) -> tuple[int, int]:
    """First and last line of a statement, decorators included."""
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))]), node.end_lineno or node.lineno


def _with_comments(lines: list[str], first: int) -> int:
    """The first line of the comment block that stands directly above ``first``."""
    while first > 1 and lines[first - 2].lstrip().startswith("#"):
        first -= 1
    return first


def _class_units(node: ast.ClassDef, lines: list[str], most: int) -> list[tuple[str, str, int, int]]:
    start, end = _with_comments(lines, _span(node)[0]), node.end_lineno
    spans = [(".".join((node.name, n.name)), *_span(n)) for n in node.body if isinstance(n, _FUNCTIONS)]
    if not spans or sum(map(len, lines[start - 1 : end])) <= most:
        return [("class", node.name, start, end)]
    body, last = min(first for _, first, _ in spans), max(stop for _, _, stop in spans)
    header = [("class", node.name, start, body - 1)] if body > start else []
    methods = [("method", name, max(body, _with_comments(lines, first)), stop) for name, first, stop in spans]
    return header + methods + ([("class", node.name, last + 1, end)] if end > last else [])


def syntax_units(source: str, most: int = SIZE) -> list[tuple[str, str, int, int]] | None:
    """(type, symbol, start line, end line) of a Python file's units; None if it does not parse.

    Functions and classes are units; statements between them are grouped as ``module``.  A class
    of more than ``most`` characters is split into its header, its methods, and what follows them.
    """
    if (tree := parse(source)) is None:
        return None
    lines = source.splitlines(keepends=True)
    units: list[tuple[str, str, int, int]] = []
    for loose, run in groupby(tree.body, lambda n: not isinstance(n, (ast.ClassDef, *_FUNCTIONS))):
        items = list(run)
        if loose:
            units.append(("module", "", items[0].lineno, max(n.end_lineno for n in items)))
            continue
        for item in items:
            if isinstance(item, ast.ClassDef):
                units += _class_units(item, lines, most)
            else:
                first, last = _span(item)
                units.append(("function", item.name, _with_comments(lines, first), last))
    return sorted(units, key=lambda u: u[2])


def split_oversize(sizes: list[int], most: int = SIZE, shared: int = 2) -> list[tuple[int, int]]:
    """(first, last) places of pieces of a unit whose lines have ``sizes`` characters.

    A unit of up to ``most`` characters is one piece.  Otherwise a piece ends with the line that
    takes it to ``most`` and is at least two lines; the next begins ``shared`` lines back.  What
    remains is a piece only if it holds a line that no piece has.
    """
    if sum(sizes) <= most:
        return [(0, len(sizes) - 1)]
    pieces, start, held = [], 0, 0
    for at, size in enumerate(sizes):
        held += size
        if held >= most and at > start:
            pieces.append((start, at))
            start = max(start + 1, at - shared + 1)
            held = sum(sizes[start : at + 1])
    if not pieces or pieces[-1][1] < len(sizes) - 1:
        pieces.append((start, len(sizes) - 1))
    return pieces


def oversize(units: DataFrame, most: int = SIZE, shared: int = 2) -> DataFrame:
    """(unit, piece, first, last): the pieces of units (unit, sizes), sizes being those of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(unit, i, *piece) for unit, sizes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, piece in enumerate(split_oversize(sizes or [], most, shared) if sizes else [])]
            names = ("unit", "piece", "first", "last")
            kinds = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], names=names)

    return units.select("unit", "sizes").mapInArrow(run, f"unit {units.schema['unit'].dataType.simpleString()}, piece long, first long, last long")


def python_chunks(source: str, most: int = SIZE, least: int = LEAST) -> list[tuple[str, str, int, int, str]]:
    """(type, symbol, start line, end line, content) of a Python file's chunks.

    A file that does not parse, or gives no unit of ``least`` characters, has none.
    """
    lines, out = source.splitlines(keepends=True), []
    for kind, symbol, start, end in syntax_units(source, most) or []:
        for first, last in split_oversize([len(x) for x in lines[start - 1 : end]], most):
            body = "".join(lines[start - 1 + first : start + last]).strip("\n")
            if len(body.strip()) >= least:
                out.append((kind, symbol, start + first, start + last, body))
    return out


def windows(source: str, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str, str, int, int, str]]:
    """The chunks of :func:`character_windows`, for a file that is in a Python worker already."""
    text, out = source.strip(), []
    for at in range(0, len(text), size - overlap):
        piece = text[at : at + size]
        if len(body := piece.strip()) >= least:
            line = text.count("\n", 0, at) + 1
            out.append(("block", "", line, line + piece.count("\n"), body))
    return out


_CHUNK = "path string, chunk_index long, chunk_type string, symbol string, start_line long, end_line long, content string"


def python_units(df: DataFrame, path_col: str = "path", content_col: str = "content", most: int = SIZE, least: int = LEAST, fall_back: bool = False) -> DataFrame:
    """(path, chunk_index, chunk_type, symbol, start_line, end_line, content) of Python files.

    Files without syntax units have no rows, or character windows with ``fall_back``.
    """
    schema = pa.schema([("path", pa.string()), ("chunk_index", pa.int64()), ("chunk_type", pa.string()), ("symbol", pa.string()), ("start_line", pa.int64()), ("end_line", pa.int64()), ("content", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = python_chunks(source or "", most, least) or (windows(source or "", most, OVERLAP, least) if fall_back else [])
                rows += [(path, n, *chunk) for n, chunk in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.select(path_col, content_col).mapInArrow(run, _CHUNK)


def _by_syntax(files: DataFrame) -> DataFrame:
    return python_units(files, "path", fall_back=True)


#: How languages are cut: files (path, content) to chunks; other languages are cut into windows.
STRATEGIES: dict[str, Callable[[DataFrame], DataFrame]] = {"python": _by_syntax}


def chunk_files(files: DataFrame, strategies: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """The chunks of parsed files (repository, language, file_name, relative_path, extension,
    file_hash, content) of one or more repositories.

    Python is cut along its syntax, or into windows where that gives nothing; other languages are
    cut into windows by column expressions, unless ``strategies`` has another way for them.
    """
    ways = STRATEGIES if strategies is None else strategies
    keyed = files.withColumn("_file", F.to_json(F.struct("repository", "relative_path")))
    columns = ["path", "chunk_index", "chunk_type", "symbol", "start_line", "end_line", "content"]
    # null-safe: a file without a language has no strategy of its own
    own = F.coalesce(F.col("language").isin(*ways), F.lit(False)) if ways else F.lit(False)
    blocks = character_windows(keyed.where(~own), "_file", "content")
    chunks = blocks.select(F.col("_file").alias("path"), "chunk_index", F.lit("block").alias("chunk_type"), F.lit("").alias("symbol"), "start_line", "end_line", "content")
    for language, cut in ways.items():
        chunks = chunks.unionByName(cut(keyed.where(F.col("language") == language).select(F.col("_file").alias("path"), "content")).select(*columns))
    return keyed.drop("content").join(chunks.withColumnRenamed("path", "_file"), "_file").select(*[c for c in files.columns if c != "content"], *columns[1:])
