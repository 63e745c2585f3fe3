"""Where the explorer goes after an answer, as one expression over the answer's context.

The decision reads the context only, never the answer's text.  It takes no join and no shuffle,
so it costs a projection however many questions are answered at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The target of each kind of node, and the intents that open a neighbourhood or code.
KIND_TARGETS = {
    "repository": "repository", "module": "module", "directory": "folder", "file": "file", "class": "class", "function": "function", "method": "symbol", "external": "symbol",
}
AROUND = ("dependency_analysis", "flow_analysis", "concept_analysis")
LOCATING = ("repository_search", "file_analysis", "concept_analysis")
MOST_RELATED = 20

TEXT = ("target_type", "repository", "module", "file", "symbol", "node_id", "focus_mode", "label", "commit_sha", "reason")

#: What a context holds: the seed that the graph resolved (or null), the nodes around it, nodes
#: that were computed instead of named, and retrieved code, best first.
CONTEXT = (
    "id long, intent string, repository string, nodes array<string>, "
    "seed struct<id:string,kind:string,key:string,name:string,reason:string,relative_path:string,module:string>, "
    "related array<string>, code array<struct<relative_path:string,symbol:string>>"
)


def _target(available: bool, related: Column | None = None, **fields: Column | str) -> Column:
    texts = [F.coalesce(v, F.lit("")).alias(n) if isinstance(v := fields.get(n, ""), Column) else F.lit(v).alias(n) for n in TEXT]
    return F.struct(F.lit(available).alias("available"), *texts, F.coalesce(related, F.array().cast("array<string>")).alias("related_node_ids") if related is not None else F.array().cast("array<string>").alias("related_node_ids"))


def _mapped(value: Column, table: dict[str, str], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for key, target in table.items():
        out = F.when(value == key, target).otherwise(out)
    return out


def _seed_target() -> Column:
    seed, kind = F.col("seed"), F.col("seed.kind")
    container = kind.isin("module", "directory")
    around = F.col("intent").isin(*AROUND) & (F.size("related") > 0)
    focus = F.when(around, "neighborhood").when(container, "expand").otherwise("center")
    own = _mapped(kind, KIND_TARGETS, "symbol")
    return _target(
        True,
        F.slice("related", 1, MOST_RELATED),
        target_type=F.when(around & (F.col("intent") != "dependency_analysis"), "graph_neighborhood").otherwise(own),
        repository=F.col("repository"),
        module=F.when(F.coalesce(seed["module"], F.lit("")) != "", seed["module"]).when(kind == "module", seed["key"]),
        file=F.when(kind == "file", seed["key"]).otherwise(seed["relative_path"]),
        symbol=F.when(~(container | (kind == "file")), seed["name"]),
        node_id=seed["id"],
        focus_mode=focus,
        label=F.concat(F.when(around, "Explore what connects to ").otherwise("Explore "), seed["name"]),
    )


def _code_target() -> Column:
    path = F.get("code", F.lit(0))["relative_path"]
    return _target(
        True,
        target_type="file",
        repository=F.col("repository"),
        file=path,
        symbol=F.get("code", F.lit(0))["symbol"],
        node_id=F.concat_ws("::", "repository", F.lit("file"), path),
        focus_mode="center",
        label=F.concat(F.lit("Explore "), F.substring_index(path, "/", -1)),
    )


def target() -> Column:
    """The target of a row of :data:`CONTEXT`; the first branch that applies decides."""
    intent, seed = F.col("intent"), F.col("seed")
    computed = F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 1, F.lit(0)))
    repository = {"repository": F.col("repository")}
    history = {"target_type": "timeline", "focus_mode": "timeline", **repository}
    branches = [
        (intent == "readonly_request", _target(False, reason="read-only refusal has no exploration target")),
        (intent == "architecture_analysis", _target(True, target_type="architecture", focus_mode="expand", label="Explore the architecture", **repository)),
        (intent == "structure_analysis", _target(True, target_type="repository", focus_mode="expand", label=F.concat(F.lit("Explore "), "repository"), **repository)),
        (
            (intent == "git_history_analysis") & seed.isNotNull(),
            _target(True, module=seed["module"], file=F.when(seed["kind"] == "file", seed["key"]).otherwise(seed["relative_path"]), node_id=seed["id"], label=F.concat(F.lit("See "), seed["name"], F.lit(" on the timeline")), **history),
        ),
        (intent == "git_history_analysis", _target(True, label="Open the timeline", **history)),
        (
            F.size("nodes") > 0,
            _target(
                True,
                computed,
                target_type="graph_neighborhood",
                node_id=F.get("nodes", F.lit(0)),
                focus_mode=F.when(intent == "flow_analysis", "flow").otherwise("neighborhood"),
                label=F.when(intent == "flow_analysis", "Explore this flow").otherwise("Explore these files"),
                **repository,
            ),
        ),
        # A seed that only retrieval reached was neither named nor selected, so it decides nothing.
        (seed.isNotNull() & (seed["reason"] != "retrieval"), _seed_target()),
        (~intent.isin(*LOCATING), _target(False, reason="no structural subject and intent is not locational")),
        (F.size("code") <= 0, _target(False, reason="no retrieved code to point at")),
        (F.coalesce(F.get("code", F.lit(0))["relative_path"], F.lit("")) == "", _target(False, reason="top chunk has no path")),
    ]
    (condition, first), *rest = branches
    out = F.when(condition, first)
    for condition, value in rest:
        out = out.when(condition, value)
    return out.otherwise(_code_target())


def commit_target(repository: Column, sha: Column, summary: Column) -> Column:
    """The target for one commit that an answer names."""
    short = F.substring(sha, 1, 8)
    label = F.when(F.coalesce(summary, F.lit("")) == "", F.concat(F.lit("View commit "), short)).otherwise(F.concat(F.lit("View "), short, F.lit(" — "), F.substring(summary, 1, 48)))
    return _target(True, target_type="commit", repository=repository, commit_sha=sha, focus_mode="timeline", label=label)


def decide(contexts: DataFrame) -> DataFrame:
    """``id`` and the target's fields for every context."""
    return contexts.select("id", target().alias("t")).select("id", "t.*")
