"""Reads of a repository graph, for many requests at once.

``nodes`` has (id, repository, kind, name, key, parent_id, level) and whatever a node carries:
line_count, language, module, relative_path, uses and so on.  ``edges`` has (id, repository, kind,
source, target) and more.  A request is a row of a DataFrame; its answer is the rows that carry
its columns, with the place of each among them where order matters.  All is joins on ids and
windows per request, so a read costs the same plan for one request or for a million.

Ties end in ``id`` or ``key``, which are unique.  An unknown id has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from codelore.functions import fixed
from codelore.operators import graph
from codelore.session import materialise

MOST_CHILDREN, MOST_SET, MOST_ANCESTORS, MOST_FOUND, MOST_NAMED = 120, 60, 12, 25, 10


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, name: str, by: Sequence[str], *order: Column | str, most: int | None = None) -> DataFrame:
    """``df`` with its 1-based place ``name`` among the rows of each ``by``; the first ``most``."""
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return out if most is None else out.where(F.col(name) <= most)


def of_kinds(df: DataFrame, kinds: Sequence[str] | None) -> DataFrame:
    return df if kinds is None else df.where(F.col("kind").isin(*kinds)) if kinds else df.where(F.lit(False))


# names and lookups


def repositories(nodes: DataFrame) -> DataFrame:
    return nodes.select("repository").distinct()


def resolve_repository(asked: str | None, available: Sequence[str]) -> str:
    """The repository to answer about: the one asked for, or the only one there is."""
    if asked:
        if asked in available:
            return asked
        raise LookupError(f"repository {asked!r} is not known; there are: {', '.join(available) or 'none'}")
    if len(available) == 1:
        return available[0]
    raise LookupError("no repository is known" if not available else f"name one of several repositories: {', '.join(available)}")


def counts(nodes: DataFrame, edges: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """(repository, kind, n): nodes of each kind, and the numbers of ``edges`` and ``commits``."""
    parts = [nodes.groupBy("repository", "kind").agg(F.count("*").alias("n")), edges.groupBy("repository").agg(F.count("*").alias("n")).select("repository", F.lit("edges").alias("kind"), "n")]
    if commits is not None:
        parts.append(commits.groupBy("repository").agg(F.count("*").alias("n")).select("repository", F.lit("commits").alias("kind"), "n"))
    return reduce(DataFrame.unionByName, parts)


def lookup(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """The nodes whose ``id`` is asked for, once each."""
    return nodes.join(asked.select("id").distinct(), "id", "left_semi")


def find(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (repository, key) and optional ``kind``, the node of the first id."""
    on = [c for c in ("repository", "key", "kind") if c in asked.columns]
    held = nodes.join(asked.select(*on).distinct(), on)
    return numbered(held, "_n", ["repository", "key", *(["kind"] if "kind" in on else [])], "id", most=1).drop("_n")


def by_name(nodes: DataFrame, asked: DataFrame, kinds: Sequence[str] | None = None, most: int = MOST_NAMED) -> DataFrame:
    """(repository, term, pos, node columns): nodes of exactly the asked name, A-Z in any case."""
    left = asked.select(F.col("repository").alias("_r"), "term", ascii_lower(F.col("term")).alias("_t")).distinct()
    held = of_kinds(nodes, kinds).withColumn("_name", ascii_lower(F.col("name")))
    found = held.join(left, (F.col("_r") == F.col("repository")) & (F.col("_t") == F.col("_name"))).drop("_r", "_t", "_name")
    return numbered(found, "pos", ["repository", "term"], F.length("key"), "key", "id", most=most)


def search(nodes: DataFrame, asked: DataFrame, kinds: Sequence[str] | None = None, most: int = MOST_FOUND) -> DataFrame:
    """(repository, term, pos, node columns): nodes whose name or key holds the asked term.

    ``_`` and ``%`` in a term match any character and any text; case counts only beyond A-Z; a
    blank term finds nothing.  Shorter names come first.
    """
    left = asked.select(F.col("repository").alias("_r"), F.trim("term").alias("term")).where("term <> ''").distinct()
    left = left.withColumn("_p", F.concat(F.lit("%"), F.replace(ascii_lower(F.col("term")), F.lit("\\"), F.lit("\\\\")), F.lit("%")))
    held = of_kinds(nodes, kinds).withColumn("_name", ascii_lower(F.col("name"))).withColumn("_key", ascii_lower(F.col("key")))
    found = held.join(left, (F.col("_r") == F.col("repository")) & F.expr("_name like _p or _key like _p")).drop("_r", "_p", "_name", "_key")
    return numbered(found, "pos", ["repository", "term"], F.length("name"), "key", "id", most=most)


def find_ranked(nodes: DataFrame, asked: DataFrame, most: int = 8) -> DataFrame:
    """The best nodes for a name: of three times as many found, exact names, then beginnings, then
    files, then shorter names.
    """
    found = search(nodes, asked, most=3 * most)
    name, term = F.lower("name"), F.trim(F.lower("term"))
    grade = F.when(name == term, 0).when(F.startswith(name, term), 1).otherwise(2)
    return numbered(found.drop("pos"), "pos", ["repository", "term"], grade, F.col("kind") != "file", F.length("name"), "key", "id", most=most)


def search_merged(shown: DataFrame, nodes: DataFrame, asked: DataFrame, local: int = 12, remote: int = 20, most: int = 16) -> DataFrame:
    """(repository, term, pos, node columns): nodes on the screen first, then those of the whole graph.

    Of the shown ones, exact names come before beginnings, names that hold the term, and paths that
    do; terms of fewer than two characters find nothing.
    """
    long = asked.where(F.length(F.trim("term")) >= 2)
    name, term = F.lower("name"), F.lower("term")
    grade = F.when(name == term, 0).when(F.startswith(name, term), 1).when(F.contains(name, term), 2).otherwise(3)
    near = numbered(search(shown, long, most=1 << 30).drop("pos"), "n", ["repository", "term"], grade, F.length("name"), "key", "id", most=local).withColumn("o", F.lit(0))
    far = search(nodes, long, most=remote).withColumnRenamed("pos", "n").withColumn("o", F.lit(1))
    once = numbered(near.unionByName(far), "_n", ["repository", "term", "id"], "o", "n", most=1)
    return numbered(once, "pos", ["repository", "term"], "o", "n", most=most).drop("_n", "o", "n")


# adjacency


def outgoing(edges: DataFrame, asked: DataFrame, kinds: Sequence[str] | None = fixed.RELATIONS) -> DataFrame:
    return of_kinds(edges, kinds).join(asked.select(F.col("id").alias("source")).distinct(), "source", "left_semi")


def incoming(edges: DataFrame, asked: DataFrame, kinds: Sequence[str] | None = fixed.RELATIONS) -> DataFrame:
    return of_kinds(edges, kinds).join(asked.select(F.col("id").alias("target")).distinct(), "target", "left_semi")


def resolved(edges: DataFrame, nodes: DataFrame, side: str) -> DataFrame:
    """Edges as their nodes at ``side``: (asked, via, edge columns but ids, node columns).

    One row per edge; an edge whose end is no node is dropped.
    """
    other = "target" if side == "source" else "source"
    kept = [c for c in edges.columns if c not in ("id", "repository", "kind", "source", "target")]
    ends = edges.select(F.col(other).alias("asked"), F.col(side).alias("_end"), F.col("kind").alias("via"), *[F.col(c).alias(f"edge_{c}") for c in kept])
    return ends.join(nodes, F.col("_end") == F.col("id")).drop("_end")


def dependencies(nodes: DataFrame, edges: DataFrame, asked: DataFrame, kinds: Sequence[str] = fixed.RELATIONS) -> DataFrame:
    """(asked, direction, via, node): what each asked node depends on, and what depends on it."""
    out = resolved(outgoing(edges, asked, kinds), nodes, "target").withColumn("direction", F.lit("dependencies"))
    return out.unionByName(resolved(incoming(edges, asked, kinds), nodes, "source").withColumn("direction", F.lit("dependents")))


def node_set(nodes: DataFrame, asked: DataFrame, most: int = MOST_SET) -> DataFrame:
    """(request, pos, node columns): the nodes of each request's first ``most`` ids, in its order."""
    few = asked.where(F.col("pos") < most).groupBy("request", "id").agg(F.min("pos").alias("pos"))
    return few.join(nodes, "id")


def node_set_edges(edges: DataFrame, shown: DataFrame, kinds: Sequence[str] = fixed.RELATIONS) -> DataFrame:
    """(request, edge columns): relations with both ends among a request's shown nodes (request, id)."""
    ends = shown.select("request", "id").distinct()
    starting = of_kinds(edges, kinds).join(ends.withColumnRenamed("id", "source"), "source")
    return starting.join(ends.withColumnRenamed("id", "target"), ["request", "target"], "left_semi").select("request", *edges.columns)


# the hierarchy


def children(nodes: DataFrame, asked: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """(asked, pos, node columns): the children of each asked id, by kind, then name."""
    held = of_kinds(nodes, kinds).join(asked.select(F.col("id").alias("asked")).distinct(), F.col("parent_id") == F.col("asked"))
    return numbered(held, "pos", ["asked"], "kind", "name", "id")


def ancestors(nodes: DataFrame, asked: DataFrame, most: int = MOST_ANCESTORS) -> DataFrame:
    """(asked, pos, id, kind, name): the chain from the top down to each asked node.

    A chain has ``most`` nodes at most, ends where a parent is missing, and meets no node twice.
    All chains climb by one node a round, whose rows are written before the next one.
    """
    slim = nodes.select("id", "parent_id", "kind", "name")
    step = slim.join(asked.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("asked"), "id", "parent_id", "kind", "name", F.lit(0).alias("depth"), F.array("id").alias("seen"))
    rounds = [materialise(step)]
    while len(rounds) < most:
        below = rounds[-1].select("asked", F.col("parent_id").alias("_up"), "depth", "seen").where("_up is not null")
        # Each parent is read once, however many chains meet it: those of many chains are few.
        above = slim.join(below.select(F.col("_up").alias("id")).distinct(), "id", "left_semi")
        step = below.join(above, F.col("_up") == F.col("id")).where(~F.array_contains("seen", F.col("id")))
        step = materialise(step.select("asked", "id", "parent_id", "kind", "name", (F.col("depth") + 1).alias("depth"), F.array_append("seen", F.col("id")).alias("seen")))
        if step.isEmpty():
            break
        rounds.append(step)
    up = reduce(DataFrame.unionByName, [r.drop("parent_id", "seen") for r in rounds])
    return up.select("asked", (F.max("depth").over(W.partitionBy("asked")) - F.col("depth")).alias("pos"), "id", "kind", "name")


def rollup(nodes: DataFrame) -> DataFrame:
    """(repository, module, file_count, line_count, languages, primary_language) of each module.

    ``languages`` counts files by language; the most frequent is the primary one, ties by name.
    """
    files = nodes.where("kind = 'file'")
    each = files.groupBy("repository", "module", F.nullif("language", F.lit("")).alias("language")).agg(F.count("*").alias("n"), F.sum(F.coalesce("line_count", F.lit(0))).alias("lines"))
    named = F.struct("language", "n")
    best = F.min(F.when(F.col("language").isNotNull(), F.struct((-F.col("n")).alias("o"), "language"))).alias("best")
    rolled = each.groupBy("repository", "module").agg(F.sum("n").alias("file_count"), F.sum("lines").alias("line_count"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("language").isNotNull(), named)))).alias("languages"), best)
    return rolled.select("repository", "module", "file_count", "line_count", "languages", F.coalesce("best.language", F.lit("")).alias("primary_language"))


def overview(nodes: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Modules with what their files add up to and when they were first seen, and externals."""
    from codelore.operators import history

    seen = history.first_seen(commit_files, "module")
    modules = nodes.where("kind = 'module'").select("repository", "id", "kind", "name")
    rolled = rollup(nodes).withColumnRenamed("module", "name")
    shown = modules.join(rolled, ["repository", "name"], "left").join(seen.withColumnRenamed("module", "name"), ["repository", "name"], "left")
    shown = shown.select("repository", "id", "kind", "name", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("primary_language", F.lit("")).alias("primary_language"), F.col("first_at").alias("first_seen"), F.lit(None).cast("long").alias("uses"))
    none = F.lit(None)
    externals = nodes.where("kind = 'external'").select("repository", "id", "kind", "name", none.cast("long").alias("file_count"), none.cast("long").alias("line_count"), none.cast("string").alias("primary_language"), none.cast("long").alias("first_seen"), "uses")
    return shown.unionByName(externals)


def module_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """DEPENDS_ON edges between modules that are there."""
    return graph.induced(of_kinds(edges, ["DEPENDS_ON"]), nodes.where("kind = 'module'").select(F.col("id").alias("node")))


def expand(nodes: DataFrame, asked: DataFrame, most: int = MOST_CHILDREN, symbols: bool = True) -> DataFrame:
    """(asked, pos, total, truncated, node columns): one level below each asked node.

    A repository shows modules, a module or directory shows directories and files, a file its
    symbols (none without ``symbols``), a class its methods.  Containers come first, then the longest.
    """
    of = nodes.join(asked.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("asked"), F.col("kind").alias("_of"))
    held = nodes.join(of, F.col("parent_id") == F.col("asked"))
    fits = F.when(F.col("_of") == "repository", F.col("kind") == "module").when(F.col("_of").isin("module", "directory"), F.col("kind").isin("directory", "file")).when(F.col("_of") == "file", F.lit(symbols)).otherwise(F.lit(True))
    rank = F.lit(9)
    for i, kind in enumerate(fixed.CONTAINER_KINDS):
        rank = F.when(F.col("kind") == kind, i).otherwise(rank)
    every = held.where(fits).drop("_of").withColumn("total", F.count("*").over(W.partitionBy("asked")))
    shown = numbered(every, "pos", ["asked"], rank, F.desc(F.coalesce("line_count", F.lit(0))), "name", "id", most=most)
    return shown.withColumn("truncated", F.col("total") > most)


def expand_edges(edges: DataFrame, shown: DataFrame) -> DataFrame:
    """(asked, edge columns): relations among the children that :func:`expand` shows."""
    return node_set_edges(edges, shown.select(F.col("asked").alias("request"), "id")).withColumnRenamed("request", "asked")


def node_detail(nodes: DataFrame, edges: DataFrame, commits: DataFrame, commit_files: DataFrame, asked: DataFrame, most_commits: int = 10) -> DataFrame:
    """(asked, part, pos, id, name, n): what is known about each asked node, part by part.

    A file has ``symbols``, ``dependencies``, ``dependents`` (imports) and ``history``; a symbol has
    ``children``, ``parent`` and the history of its file; others have ``children_count`` (n).
    """
    from codelore.operators import history

    subject = lookup(nodes, asked).select("id", "repository", "kind", "key", "parent_id", "relative_path")
    files, symbols = subject.where("kind = 'file'"), of_kinds(subject, fixed.SYMBOL_KINDS)
    others = subject.where(~F.col("kind").isin("file", *fixed.SYMBOL_KINDS))
    none = F.lit(None).cast("long")
    row = lambda df, part: df.select("asked", F.lit(part).alias("part"), F.col("pos").cast("long").alias("pos"), "id", "name", none.alias("n"))
    ordered = lambda df: numbered(df, "pos", ["asked"], "key", "id")
    parts = [row(children(nodes, files, fixed.SYMBOL_KINDS), "symbols")]
    parts.append(row(ordered(resolved(outgoing(edges, files, ["IMPORTS"]), nodes, "target")), "dependencies"))
    parts.append(row(ordered(resolved(incoming(edges, files, ["IMPORTS"]), nodes, "source")), "dependents"))
    parts.append(row(children(nodes, symbols), "children"))
    held = symbols.select(F.col("id").alias("asked"), "parent_id").join(nodes.select("id", "name"), F.col("parent_id") == F.col("id"))
    parts.append(row(held.withColumn("pos", F.lit(1)), "parent"))
    path = files.select(F.col("id").alias("asked"), "repository", F.col("key").alias("relative_path")).unionByName(symbols.where("relative_path <> ''").select(F.col("id").alias("asked"), "repository", "relative_path"))
    touched = path.join(history.commits_of_paths(commits, commit_files, path.select("repository", "relative_path").distinct(), most_commits), ["repository", "relative_path"])
    parts.append(row(touched.select("asked", "pos", F.col("sha").alias("id"), F.col("summary").alias("name")), "history"))
    below = children(nodes, others).groupBy("asked").agg(F.count("*").alias("k"))
    counted = others.select(F.col("id").alias("asked")).join(below, "asked", "left")
    parts.append(counted.select("asked", F.lit("children_count").alias("part"), F.lit(1).cast("long").alias("pos"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("name"), F.coalesce("k", F.lit(0)).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, parts)


# the knowledge graph


def relations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Relations between two different files or symbols that are nodes."""
    # Ids are long and many, whatever the size of their files is: they are merged, not broadcast.
    ends = of_kinds(nodes, fixed.KNOWLEDGE_KINDS).select(F.col("id").alias("node")).hint("merge")
    return graph.induced(of_kinds(edges, fixed.RELATIONS).where("source <> target"), ends)


def degrees(related: DataFrame) -> DataFrame:
    """(id, degree): each relation counts at both of its ends."""
    return related.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def knowledge_rank(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """Files and symbols with ``degree`` and ``rank`` in their repository: connected first, then by
    degree, files first, then by key; the first ``most``.
    """
    every = of_kinds(nodes, fixed.KNOWLEDGE_KINDS).join(degrees(relations(nodes, edges)), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return numbered(every, "rank", ["repository"], F.col("degree") == 0, F.desc("degree"), F.col("kind") != "file", "key", "id", most=most)


def knowledge_data() -> Column:
    """What a tooltip shows of a node: the fields that have a value, as text."""
    entries = [F.struct(F.lit(n).alias("k"), F.col(n).cast("string").alias("v")) for n in fixed.KNOWLEDGE_DATA]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["v"].isNotNull()))


def knowledge(nodes: DataFrame, edges: DataFrame, most: int = 1500) -> DataFrame:
    """(repository, id): the nodes of each repository's knowledge graph, at most ``most``.

    Ranks are read as far as the graphs need to be full: each rank adds its node unless its chain
    overflows, so that is soon.  If one is not full and has more ranks, all are read further.
    """
    reach = 2 * most
    while True:
        ranked = materialise(knowledge_rank(nodes, edges, reach).select("repository", "id", "rank"))
        above = ancestors(nodes, ranked.select("id")).where(F.col("kind").isin(*fixed.KNOWLEDGE_KINDS) & (F.col("id") != F.col("asked")))
        chains = above.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("c")).select(F.col("asked").alias("id"), F.col("c.id").alias("chain"))
        kept = materialise(graph.knowledge_subset(ranked.join(chains, "id", "left").select("repository", F.col("id").alias("node"), "rank", F.coalesce("chain", F.array().cast("array<string>")).alias("chain")), most))
        size = kept.select("repository", F.lit(1).alias("kept"), F.lit(0).alias("rank")).unionByName(ranked.select("repository", F.lit(0).alias("kept"), "rank"))
        if size.groupBy("repository").agg(F.sum("kept").alias("kept"), F.max("rank").alias("rank")).where((F.col("kept") < most) & (F.col("rank") >= reach)).isEmpty():
            return kept.withColumnRenamed("node", "id")
        reach *= 8


def knowledge_edges(nodes: DataFrame, edges: DataFrame, kept: DataFrame) -> DataFrame:
    """(kind, source, target): relations among the kept nodes, and what contains what of them."""
    ids = kept.select(F.col("id").alias("node"))
    related = graph.induced(relations(nodes, edges), ids).select("kind", "source", "target")
    inside = nodes.where("kind <> 'file'").join(ids, F.col("id") == F.col("node"), "left_semi").select(F.lit("CONTAINS").alias("kind"), F.col("parent_id").alias("source"), F.col("id").alias("target"))
    return related.unionByName(inside.join(ids, F.col("source") == F.col("node"), "left_semi"))


def relation_summary(edges: DataFrame, nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, direction, kind, n): how many relations of each kind a node has, either way."""
    out = outgoing(edges, asked).groupBy(F.col("source").alias("asked"), "kind").agg(F.count("*").alias("n")).withColumn("direction", F.lit("out"))
    into = incoming(edges, asked).groupBy(F.col("target").alias("asked"), "kind").agg(F.count("*").alias("n")).withColumn("direction", F.lit("in"))
    return out.unionByName(into).select("asked", "direction", "kind", "n")
