"""What an answer is given: ranked code, facts, and the tail of the conversation, within a budget.

Questions are rows; a question's chunks, paths and turns are joined to it by ``question``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

BUDGET, STRUCTURAL_BUDGET, MOST_TURNS, MOST_HELD = 8, 4, 6, 8
SEED_BOOST, NEAR_BOOST = 1.6, 1.25
CHANNELS = ("score", "vector_score", "keyword_score", "rerank_score")
# Intents whose answer is structure, and how many chunks an intent wants.
STRUCTURAL = ("architecture_analysis", "structure_analysis", "dependency_analysis", "git_history_analysis", "flow_analysis", "hotspot_analysis")
WANTED = {
    "architecture_analysis": 10, "concept_analysis": 10, "flow_analysis": 8, "repository_search": 8, "dependency_analysis": 4, "structure_analysis": 3, "hotspot_analysis": 3, "readonly_request": 4,
}
USUAL = 5


def wanted(intent: Column, asked: Column | None = None) -> Column:
    """How many chunks to retrieve: what was asked for, or what the intent wants if that is more."""
    least = F.coalesce(asked, F.lit(USUAL)) if asked is not None else F.lit(USUAL)
    out = least
    for name, n in WANTED.items():
        out = F.when(intent == name, F.greatest(least, F.lit(n))).otherwise(out)
    return out


def dedupe(chunks: DataFrame, by: tuple[str, ...] = ("question", "id"), channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Chunks once each, with the best score of every channel; other columns are of the first one
    (``ordinal``), of which a missing score counts as 0.
    """
    others = [c for c in chunks.columns if c not in by and c not in channels]
    first = [F.min_by(F.col(c), F.col("ordinal")).alias(c) for c in others]
    return chunks.groupBy(*by).agg(*[F.max(F.coalesce(c, F.lit(0.0))).alias(c) for c in channels if c in chunks.columns], *first)


def rank(chunks: DataFrame, near: DataFrame) -> DataFrame:
    """Chunks (question, id, relative_path, score) with ``graph_linked``, ``graph_boost``, the boosted
    ``context_score`` and the ``rank`` by it.

    ``near`` has (question, path, seed): the files of the graph's neighbourhood, and whether a file
    is a seed's.
    """
    marked = chunks.join(near.select("question", F.col("path").alias("relative_path"), "seed"), ["question", "relative_path"], "left")
    boost = F.when(F.col("seed"), SEED_BOOST).when(F.col("seed").isNotNull(), NEAR_BOOST).otherwise(1.0)
    scored = marked.withColumns({"graph_linked": F.col("seed").isNotNull(), "graph_boost": boost, "context_score": F.coalesce("score", F.lit(0.0)) * boost}).drop("seed")
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("question").orderBy(F.desc("context_score"), "id")))


def within_budget(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """The chunks that fit: eight, or four if the question's ``intent`` is structural."""
    budget = F.when(F.col("intent").isin(*STRUCTURAL), STRUCTURAL_BUDGET).otherwise(BUDGET)
    return ranked.join(questions.select("question", budget.alias("_budget")), "question").where(F.col("rank") <= F.col("_budget")).drop("_budget")


def tail(turns: DataFrame, most: int = MOST_TURNS, by: str = "conv_id") -> DataFrame:
    """The last ``most`` turns of each conversation, numbered from the newest."""
    newest = W.partitionBy(by).orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= most)


def build(questions: DataFrame, chunks: DataFrame, near: DataFrame, turns: DataFrame, facts: DataFrame) -> DataFrame:
    """A row per question (question, intent): its ``code``, ``conversation`` and ``facts`` as arrays, and
    what went in and came out.

    ``turns`` has (question, turn, text), ``facts`` (question, ordinal, fact); blank facts are left out.
    """
    single = dedupe(chunks)
    used = within_budget(rank(single, near), questions)
    listed = lambda df, order, *c: df.groupBy("question").agg(F.array_sort(F.collect_list(F.struct(order, *c))).alias("x"))
    code = listed(used, "rank", "id", "relative_path", "context_score", "graph_linked").withColumnRenamed("x", "code")
    said = listed(tail(turns, by="question"), "turn", "text").withColumnRenamed("x", "conversation")
    stated = listed(facts.where(F.trim(F.coalesce("fact", F.lit(""))) != ""), "ordinal", "fact").select("question", F.col("x.fact").alias("facts"))
    count = lambda df, name: df.groupBy("question").agg(F.count("*").alias(name))
    out = questions
    for part in (code, said, stated, count(chunks, "chunks_in"), count(single, "chunks_deduped"), count(near, "graph_files")):
        out = out.join(part, "question", "left")
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("chunks_in", "chunks_deduped", "graph_files")}
    return out.withColumns(zero | {"chunks_used": size("code"), "conversation_turns": size("conversation"), "fact_blocks": size("facts")})
