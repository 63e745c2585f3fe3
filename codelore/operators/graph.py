"""Graph algorithms over edge DataFrames (source, target) that need rounds or an order.

What a round makes is written to the session's shared folder before the next one reads it, so a
plan does not grow with the number of rounds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codelore.session import materialise

MOST_ROUNDS = 20


def label_propagation(edges: DataFrame, rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, label): communities by synchronous label propagation.

    Each round, every node takes the most frequent label of its neighbours; its own if that is one
    of them, else the smallest.  Edges count in both directions and with their multiplicity.  Rounds
    end when no label changes, or after ``rounds``; keeping one's own label on ties makes that soon.
    """
    # Equal edges become one with a weight, and stay where the join with the labels reads them.
    both = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
    weighed = materialise(both.groupBy("source", "target").agg(F.count("*").alias("w")).repartition("target"))
    labels = materialise(weighed.select(F.col("source").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(rounds):
        votes = weighed.join(labels, weighed.target == labels.node).groupBy("source", "label").agg(F.sum("w").alias("n"))
        own = labels.select(F.col("node").alias("source"), F.col("label").alias("own"))
        best = F.min(F.struct((-F.col("n")).alias("n"), (F.col("label") != F.col("own")).alias("new"), "label")).alias("best")
        now = materialise(votes.join(own, "source").groupBy("source").agg(best, F.first("own").alias("own")).select(F.col("source").alias("node"), "best.label", "own"))
        changed = now.where("label <> own").limit(1).count()
        labels = now.select("node", "label")
        if not changed:
            break
    return labels


def communities(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, size, hub): each community with its node of the most edges; ties by node."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    of = labels.join(ends, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return of.groupBy("label").agg(F.count("*").alias("size"), F.min(F.struct((-F.col("degree")).alias("d"), "node")).alias("b")).select("label", "size", F.col("b.node").alias("hub"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (node)."""
    return edges.join(nodes, edges.source == nodes.node, "left_semi").join(nodes, edges.target == nodes.node, "left_semi")


def knowledge_subset(ranked: DataFrame, limit: int = 1500) -> DataFrame:
    """(repository, node): nodes kept by rank while their chains of containers fit into ``limit``.

    ``ranked`` has (repository, node, rank, chain), chain being the containers of the node.  A node
    whose chain would overflow is skipped and later ones are still tried, which is sequential, so
    a repository's nodes are read in rank order by one task.  They stream through it: the task
    holds at most ``limit`` kept nodes, however many there are, and ties go by node.
    """
    dealt = ranked.select("repository", "rank", "node", "chain").repartition("repository").sortWithinPartitions("repository", "rank", "node")
    kind = dealt.schema["repository"].dataType.simpleString()

    def pick(batches):
        here, kept = None, {}

        def done():
            if kept:
                yield pa.RecordBatch.from_pydict({"repository": [here[0]] * len(kept), "node": list(kept)}, pa.schema([("repository", repository_type), ("node", pa.string())]))

        repository_type = pa.string()
        for b in batches:
            repository_type = b.schema.field(0).type
            for repository, node, chain in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if here != (repository,):
                    yield from done()
                    here, kept = (repository,), {}
                if len(kept) < limit:
                    need = dict.fromkeys(x for x in [*(chain or []), node] if x not in kept)
                    if len(kept) + len(need) <= limit:
                        kept.update(need)
        yield from done()

    return dealt.mapInArrow(pick, f"repository {kind}, node string")
