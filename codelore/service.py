"""The reads of a code-intelligence service, as functions of one set of tables.

Each method answers for the ids that it is given, one or many; results are DataFrames.  Repositories
that are not there are an error, unknown nodes have no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, functions as F

from codelore.operators import around, builder, history as past, insights, reads
from codelore.sources import files
from codelore.sources.store import Store


class Service:
    """Reads over ``nodes``, ``edges``, ``commits``, ``commit_files`` and ``refs``."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, commits: DataFrame, commit_files: DataFrame, refs: DataFrame):
        self.nodes, self.edges, self.commits, self.commit_files, self.refs = nodes, edges, commits, commit_files, refs
        self.spark = nodes.sparkSession

    @classmethod
    def of(cls, store: Store, repository: str | None = None) -> Service:
        """The service over what a store holds, of one or all repositories."""
        tables = [store.table("graph", n, repository) for n in ("nodes", "edges")] + [store.table("history", n, repository) for n in ("commits", "commit_files", "refs")]
        if any(t is None for t in tables):
            raise LookupError(f"no graph and history of {repository or 'any repository'}")
        return cls(*tables)

    def _ids(self, ids: str | Iterable[str]) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ([ids] if isinstance(ids, str) else ids)], "id string")

    def _rows(self, rows: Sequence[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _only(self, repository: str, *tables: DataFrame) -> list[DataFrame]:
        if not self.nodes.where(F.col("repository") == repository).limit(1).count():
            raise LookupError(f"no graph of {repository!r}")
        return [t.where(F.col("repository") == repository) for t in tables]

    # a repository
    def repositories(self) -> DataFrame:
        return reads.counts(self.nodes, self.edges, self.commits)

    def overview(self, repository: str) -> dict[str, DataFrame]:
        nodes, edges, commits, touched = self._only(repository, self.nodes, self.edges, self.commits, self.commit_files)
        return {"nodes": reads.overview(nodes, touched), "edges": reads.module_edges(nodes, edges), "counts": reads.counts(nodes, edges, commits), "timeline": past.commit_range(commits)}

    def knowledge_graph(self, repository: str, most: int = 1500) -> dict[str, DataFrame]:
        nodes, edges = self._only(repository, self.nodes, self.edges)
        kept = reads.knowledge(nodes, edges, most)
        shown = nodes.join(kept.select("id"), "id", "left_semi").select("id", "kind", "name", "key", "parent_id", reads.knowledge_data().alias("data"))
        return {"nodes": shown, "edges": reads.knowledge_edges(nodes, edges, kept)}

    def search(self, repository: str, term: str, most: int = reads.MOST_FOUND) -> DataFrame:
        return reads.search(self.nodes, self._rows([(repository, term)], "repository string, term string"), most=most)

    def hotspots(self, repository: str, most: int = insights.MOST_HOTSPOTS) -> DataFrame:
        return insights.hotspots(*self._only(repository, self.nodes, self.edges, self.commit_files), most)

    def flow(self, repository: str, start: str | None = None) -> DataFrame:
        nodes, edges = self._only(repository, self.nodes, self.edges)
        starts = self._ids(start) if start else insights.guess_entry(nodes, edges).select("id")
        return insights.flow_steps(nodes, insights.flow(nodes, edges, starts.select(F.lit(repository).alias("request"), "id")))

    # nodes
    def expand(self, ids: str | Iterable[str], most: int = reads.MOST_CHILDREN, symbols: bool = True) -> dict[str, DataFrame]:
        shown = reads.expand(self.nodes, self._ids(ids), most, symbols)
        return {"nodes": shown, "edges": reads.expand_edges(self.edges, shown)}

    def node_detail(self, ids: str | Iterable[str]) -> DataFrame:
        return reads.node_detail(self.nodes, self.edges, self.commits, self.commit_files, self._ids(ids))

    def node_set(self, ids: Sequence[str]) -> dict[str, DataFrame]:
        shown = reads.node_set(self.nodes, self._rows([("set", i, x) for i, x in enumerate(ids)], "request string, pos int, id string"))
        return {"nodes": shown, "edges": reads.node_set_edges(self.edges, shown)}

    def ancestors(self, ids: str | Iterable[str]) -> DataFrame:
        return reads.ancestors(self.nodes, self._ids(ids))

    def dependencies(self, ids: str | Iterable[str]) -> DataFrame:
        return reads.dependencies(self.nodes, self.edges, self._ids(ids))

    def relation_summary(self, ids: str | Iterable[str]) -> DataFrame:
        return reads.relation_summary(self.edges, self.nodes, self._ids(ids))

    def neighborhood(self, node: str, hops: int = 1, most: int = 40) -> dict[str, DataFrame]:
        rows = self._rows([(0, "", [], node, [], [])], "question long, repository string, mentions array<string>, focus string, explorer array<string>, paths array<string>")
        hits, withheld = around.walk(self.nodes, self.edges, around.seeds(self.nodes, rows), hops, most)
        return {"nodes": hits, "edges": around.edges_among(self.edges, hits), "withheld": withheld}

    def file_content(self, node: str, root: str) -> DataFrame:
        """A file as it is on disk below ``root``, with credentials masked."""
        parts = node.split(builder.SEPARATOR, 2)
        if len(parts) != 3 or parts[1] != "file" or not reads.lookup(self.nodes, self._ids(node)).count():
            raise LookupError(f"no file node: {node}")
        return files.file_content(self.spark, root, parts[2])

    # history
    def history(self, ids: str | Iterable[str], most: int = 20) -> DataFrame:
        path = F.when(F.col("kind") == "file", F.col("key")).otherwise(F.coalesce("relative_path", F.lit("")))
        of = reads.lookup(self.nodes, self._ids(ids)).select("id", "repository", path.alias("relative_path")).where("relative_path <> ''")
        return of.join(past.commits_of_paths(self.commits, self.commit_files, of.select("repository", "relative_path"), most), ["repository", "relative_path"])

    def timeline(self, repository: str) -> dict[str, DataFrame]:
        commits, touched, refs = self._only(repository, self.commits, self.commit_files, self.refs)
        return {"range": past.commit_range(commits), "lanes": past.lanes(touched), "releases": past.releases(refs), "branches": past.references(refs, "branch")}

    def commit_timeline(self, repository: str, most: int = past.MOST_COMMITS) -> DataFrame:
        return past.timeline(*self._only(repository, self.commits, self.commit_files, self.refs), most)

    def commit_detail(self, repository: str, sha: str) -> DataFrame:
        return past.commit_detail(self.commits, self.commit_files, self.nodes, self._rows([(repository, sha)], "repository string, prefix string"))

    def changes_between(self, repository: str, start: str, end: str) -> dict[str, DataFrame]:
        windows = past.windows_between(self.commits, self._rows([(repository, "w", start, end)], "repository string, request string, start string, end string"))
        changed = past.changes(self.commit_files, windows)
        return {"files": changed.where(F.col("pos") <= past.SHOWN_CHANGES), "modules": past.changes_by_module(changed)}

    def snapshot(self, repository: str, at: int) -> dict[str, DataFrame]:
        return self._snapshot(self._rows([(repository, "s", at)], "repository string, request string, at long"))

    def snapshot_at_commit(self, repository: str, sha: str) -> dict[str, DataFrame]:
        return self._snapshot(past.moments_of(self.commits, self._rows([(repository, "s", sha)], "repository string, request string, prefix string")))

    def _snapshot(self, moments: DataFrame) -> dict[str, DataFrame]:
        modules = past.snapshot(self.nodes, self.commit_files, moments)
        there = modules.select(builder.node_id("repository", F.lit("module"), "module").alias("node"))
        return {"modules": modules, "edges": reads.graph.induced(reads.of_kinds(self.edges, ["DEPENDS_ON"]), there)}
