"""Hotspots and flows of repositories, each with what can be said for it.

See :mod:`codelore.operators.reads` for the columns of nodes and edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codelore.functions import paths
from codelore.operators import history, reads, render
from codelore.session import materialise

MOST_HOTSPOTS, LEAST_DEPENDENTS, LEAST_CHANGES, MOST_EVIDENCE = 8, 3, 3, 5
FLOW_DEPTH, FLOW_WIDTH = 4, 6
#: Nodes of a layer that are sent to the imports; more are merged with them.
MOST_SENT = 10_000


def dependents(edges: DataFrame, kinds=("IMPORTS", "DEPENDS_ON")) -> DataFrame:
    """(repository, id, n): how many edges of the kinds end at each node."""
    return reads.of_kinds(edges, kinds).groupBy("repository", F.col("target").alias("id")).agg(F.count("*").alias("n"))


def structural(nodes: DataFrame, edges: DataFrame, most: int = MOST_HOTSPOTS) -> DataFrame:
    """Files and modules that many others import, with up to five importers.

    The cut to ``most`` comes before nodes of other kinds are left out.  What is left is a few rows a
    repository: they are written, and sent to the edges.
    """
    ranked = reads.numbered(dependents(edges).where(F.col("n") >= LEAST_DEPENDENTS), "pos", ["repository"], F.desc("n"), "id", most=most).drop("repository")
    shown = materialise(ranked.join(nodes.where("kind in ('file', 'module')"), "id"))
    into = reads.of_kinds(edges, ("IMPORTS", "DEPENDS_ON")).join(F.broadcast(shown.select(F.col("id").alias("target"))), "target", "left_semi").select(F.col("target").alias("id"), "source", F.col("id").alias("edge"))
    few = reads.numbered(into, "_n", ["id"], "edge", most=MOST_EVIDENCE)
    named = few.join(nodes.select(F.col("id").alias("source"), F.col("name").alias("_name")), "source").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge", "_name"))), lambda x: x["_name"]).alias("evidence"))
    out = shown.join(named, "id", "left")
    reason = render.hotspot_reason(F.lit("structural"), F.col("kind"), F.col("name"), F.col("key"), F.col("n"))
    return _hotspots(out, "structural", F.col("n"), reason, F.coalesce("evidence", F.array().cast("array<string>")))


def churn(nodes: DataFrame, commit_files: DataFrame, most: int = MOST_HOTSPOTS) -> DataFrame:
    """Indexed files that most commits touched; other paths of the history are left out first."""
    counted = history.change_counts(commit_files).where(F.col("commits") >= LEAST_CHANGES)
    files = nodes.where("kind = 'file'").join(counted.withColumnRenamed("relative_path", "key"), ["repository", "key"])
    shown = reads.numbered(files, "pos", ["repository"], F.desc("commits"), "key", most=most)
    reason = render.hotspot_reason(F.lit("churn"), F.col("kind"), F.col("name"), F.col("key"), F.col("commits"))
    return _hotspots(shown, "churn", F.col("commits"), reason)


def complexity(nodes: DataFrame, most: int = MOST_HOTSPOTS) -> DataFrame:
    """Files of the high complexity band, then the longest; files without lines are no hotspot."""
    lines = F.coalesce("line_count", F.lit(0))
    ranked = reads.numbered(nodes.where("kind = 'file'"), "pos", ["repository"], F.when(F.col("complexity") == "high", 0).otherwise(1), F.desc(lines), "key", most=most)
    reason = render.size_reason(F.col("key"), lines, F.coalesce("class_count", F.lit(0)), F.coalesce("function_count", F.lit(0)), F.col("complexity"))
    return _hotspots(ranked.where(lines > 0), "complexity", lines, reason)


def _hotspots(df: DataFrame, category: str, value, reason, evidence=None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select("repository", F.lit(category).alias("category"), "pos", F.col("id").alias("node_id"), "name", "kind", F.col("key").alias("path"), value.cast("long").alias("value"), reason.alias("reason"), (evidence if evidence is not None else none).alias("evidence"))


def hotspots(nodes: DataFrame, edges: DataFrame, commit_files: DataFrame, most: int = MOST_HOTSPOTS) -> DataFrame:
    return structural(nodes, edges, most).unionByName(churn(nodes, commit_files, most)).unionByName(complexity(nodes, most))


def guess_entry(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository, id, key): the file of each repository that looks most like an entry point.

    The first pattern of file names that any file matches decides, then the depth and the length of
    the path; without a match, the most imported node.
    """
    files = nodes.where("kind = 'file'").withColumn("_grade", paths.entry_grade(F.col("key")))
    slashes = F.length("key") - F.length(F.replace("key", F.lit("/"), F.lit("")))
    named = files.where("_grade is not null").groupBy("repository").agg(F.min(F.struct("_grade", slashes.alias("d"), F.length("key").alias("l"), "key", "id")).alias("b")).select("repository", "b.id", "b.key")
    hubs = dependents(edges, ("IMPORTS",)).groupBy("repository").agg(F.min(F.struct((-F.col("n")).alias("o"), "id")).alias("b")).select("repository", "b.id")
    other = hubs.join(named, "repository", "left_anti").join(files.select("repository").distinct(), "repository", "left_semi")
    return named.unionByName(other.join(nodes.select("id", "key"), "id").select("repository", "id", "key"))


def flow(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = FLOW_DEPTH, width: int = FLOW_WIDTH) -> DataFrame:
    """(request, depth, pos, id): layers of imports from each start (request, id), at most ``width``
    new nodes each, in the order of their importers and then by id.

    Each layer of a few nodes a request is written, so it is not computed again for the next one.
    Layers of few nodes are sent to the imports, which are read where they lie; what they reach is
    then looked up among the nodes.
    """
    imports = reads.of_kinds(edges, ["IMPORTS"]).select("source", "target")
    known = nodes.select("id").hint("merge")
    layer = materialise(starts.select("request", F.lit(0).alias("depth"), F.lit(1).alias("pos"), "id").join(known, "id", "left_semi"))
    seen = layer
    for level in range(1, depth):
        few = layer.limit(MOST_SENT + 1).count() <= MOST_SENT
        reached = (F.broadcast(layer) if few else layer).withColumnRenamed("id", "source").join(imports, "source")
        new = reached.groupBy("request", F.col("target").alias("id")).agg(F.min("pos").alias("by")).join(known, "id", "left_semi").join(seen.select("request", "id"), ["request", "id"], "left_anti")
        layer = materialise(reads.numbered(new, "pos", ["request"], "by", "id", most=width).select("request", F.lit(level).alias("depth"), "pos", "id"))
        seen = seen.unionByName(layer)
    return seen


def flow_steps(nodes: DataFrame, layers: DataFrame) -> DataFrame:
    """(request, depth, label, ids, names): each layer under the module or directory it shares.

    The first is named after what its path looks like.
    """
    of = layers.join(nodes.select("id", "name", "key", "module", "directory"), "id")
    listed = F.array_sort(F.collect_list(F.struct("pos", "id", "name")))
    modules = F.collect_set(F.when(F.coalesce("module", F.lit("")) != "", F.col("module")))
    directories = F.collect_set(F.coalesce("directory", F.lit("")))
    each = of.groupBy("request", "depth").agg(listed.alias("l"), modules.alias("m"), directories.alias("d"), F.min("key").alias("key"))
    shared = F.when(F.size("m") == 1, F.element_at("m", 1)).when((F.size("d") == 1) & (F.element_at("d", 1) != ""), F.element_at("d", 1)).otherwise(F.lit("imports"))
    label = F.when(F.col("depth") == 0, paths.entry_label(F.col("key"))).otherwise(shared)
    return each.select("request", "depth", label.alias("label"), F.col("l.id").alias("ids"), F.col("l.name").alias("names"))

