"""Texts made of rows: excerpts, conversations, dependencies, hotspots and architecture.

All are column expressions over a row's own arrays, so a batch of answers is rendered without a
join.  Formats are fixed values; what is shown of a list is bounded, and says how long the list is.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codelore.functions import paths

MOST_EXCERPT, MOST_ANSWER, MOST_NEIGHBOURS, MOST_PACKAGES = 2400, 400, 20, 12
BLOCK_RULE = "\n\n---\n\n"


def _has(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def _if(condition: Column, *parts: Column | str) -> Column:
    return F.when(condition, said(*parts)).otherwise("")


def said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _cut(text: Column, most: int, mark: str) -> Column:
    short = F.regexp_replace(F.substring(text, 1, most), r"\s+$", "")
    return F.when(F.char_length(text) > most, said(short, mark)).otherwise(text)


def _day(seconds: Column) -> Column:
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "unknown").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def excerpts(code: Column) -> Column:
    """Retrieved chunks with where they are from, best first.

    ``code`` is an array of (relative_path, start_line, end_line, symbol, chunk_type, graph_linked,
    content).
    """

    def one(c: Column, i: Column) -> Column:
        placed = (F.coalesce(c["start_line"], F.lit(0)) > 0) & (F.coalesce(c["end_line"], F.lit(0)) > 0)
        return said(
            "[", i + 1, "] ", c["relative_path"], _if(placed, ":", c["start_line"], "-", c["end_line"]), _if(_has(c["symbol"]), "  symbol: ", c["symbol"]), _if(_has(c["chunk_type"]), "  kind: ", c["chunk_type"]),
            "  role: ", paths.role(F.coalesce(c["relative_path"], F.lit(""))), _if(F.coalesce(c["graph_linked"], F.lit(False)), "  (also reached via the repository graph)"),
            "\n```\n", _cut(F.coalesce(c["content"], F.lit("")), MOST_EXCERPT, "\n… (excerpt truncated)"), "\n```",
        )

    return F.array_join(F.transform(code, one), "\n\n")


def conversation(turns: Column) -> Column:
    """Earlier turns, an array of (question, answer) in order."""

    def one(t: Column) -> Column:
        answer = F.replace(F.regexp_replace(F.coalesce(t["answer"], F.lit("")), r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
        return said("User: ", t["question"], _if(_has(t["answer"]), "\nAssistant: ", _cut(answer, MOST_ANSWER, " …")))

    return F.array_join(F.transform(turns, one), "\n")


def document(blocks: list[tuple[str, Column]]) -> Column:
    """The blocks that are not blank, each under its heading, between rules."""
    shown = [F.when(_has(F.trim(text)), said(title, "\n", text)) for title, text in blocks]
    return F.array_join(F.array_compact(F.array(*shown)), BLOCK_RULE)


# The titles by which a prompt's rules name its blocks.
BLOCKS = ("CURRENT EXPLORER CONTEXT", "CONVERSATION SO FAR", "REPOSITORY GRAPH (from static analysis)", "REPOSITORY FACTS (computed over the whole repository)", "REPOSITORY HISTORY (from git)", "RELEVANT CODE")


def prompt(explorer: Column, turns: Column, graph: Column, facts: Column, history: Column, code: Column) -> Column:
    """The context of an answer as one text: what is selected, what was said, the graph, facts (an
    array), history, and code, each under its title; blocks without content are left out.
    """
    stated = F.array_join(F.filter(F.coalesce(facts, F.array().cast("array<string>")), lambda f: _has(F.trim(f))), "\n\n")
    texts = (explorer, conversation(turns), graph, stated, history, excerpts(code))
    return document(list(zip(BLOCKS, texts, strict=True)))


def dependencies(node: Column, uses: Column, used_by: Column) -> Column:
    """A node (kind, name, key) with what it depends on and what depends on it (name, key)."""

    def side(title: str, arrow: str, nodes: Column) -> Column:
        lines = F.transform(F.slice(nodes, 1, MOST_NEIGHBOURS), lambda n: said("  ", arrow, " ", n["name"], "  [", n["key"], "]"))
        return F.when(F.size(nodes) > 0, said(title, " (", F.size(nodes), "):\n", F.array_join(lines, "\n"))).otherwise(f"{title}: nothing inside this repository.")

    return said(node["kind"], " ", node["name"], " (", node["key"], ")\n\n", side("Depends on", "->", uses), "\n\n", side("Used by", "<-", used_by))


def hotspot_reason(category: Column, kind: Column, name: Column, path: Column, value: Column) -> Column:
    """Why a node is a hotspot, from the count that made it one; size has its own sentence."""
    noun = F.when(kind == "module", "modules").otherwise("files")
    return F.when(category == "structural", said(value, " ", noun, " in this repository import ", name, ", so a change to it can affect all of them.")).when(
        category == "churn", said(path, " was changed in ", value, " commits within the indexed history window — the most frequently modified indexed file.")
    )


def size_reason(path: Column, lines: Column, classes: Column, functions: Column, band: Column) -> Column:
    return said(path, " is ", lines, " lines with ", classes, " classes and ", functions, " functions (complexity band: ", F.coalesce(band, F.lit("unknown")), ").")


def architecture(repository: Column, counts: Column, modules: Column, window: Column, edges: Column, externals: Column) -> Column:
    """Modules, largest first, their dependencies, and the most used external packages.

    ``counts`` is a map of node kinds; ``modules`` has (name, file_count, line_count,
    primary_language), ``edges`` (source, target), ``externals`` (name, uses), ``window`` (total,
    first_at, last_at) of the history.  Ties go by name.
    """
    n = lambda *kinds: sum((F.coalesce(F.element_at(counts, k), F.lit(0)) for k in kinds[1:]), F.coalesce(F.element_at(counts, kinds[0]), F.lit(0)))
    # Structs sort by their first fields: the negated size, then the name.
    largest = F.array_sort(F.transform(modules, lambda m: F.struct((-m["file_count"]).alias("o"), m["name"].alias("name"), m["line_count"].alias("lines"), m["primary_language"].alias("language"))))
    listed = F.transform(largest, lambda m: said("  - ", m["name"], ": ", -m["o"], " files, ", m["lines"], " lines, mainly ", F.when(_has(m["language"]), m["language"]).otherwise("mixed")))
    most_used = F.slice(F.array_sort(F.transform(externals, lambda e: F.struct((-e["uses"]).alias("o"), e["name"].alias("name")))), 1, MOST_PACKAGES)
    arrows = F.transform(F.array_sort(edges), lambda e: said("  - ", e["source"], " -> ", e["target"]))
    return said(
        "Repository: ", repository, "\nIndexed: ", n("file"), " files, ", n("class"), " classes, ", n("function", "method"), " functions/methods.\n\nModules (largest first):\n", F.array_join(listed, "\n"),
        _if(
            F.coalesce(window["first_at"], F.lit(0)) != 0,
            "\n\n(Dates below are limited to the indexed history window: ", window["total"], " commits from ", _day(window["first_at"]), " to ", _day(window["last_at"]),
            ". Earlier history was not walked, so these are not module creation dates.)",
        ),
        _if(F.size(edges) > 0, "\n\nModule dependencies (source imports target):\n", F.array_join(arrows, "\n")),
        _if(F.size(externals) > 0, "\n\nMost used external packages: ", F.array_join(F.transform(most_used, lambda e: said(e["name"], " (", -e["o"], ")")), ", ")),
    )
