"""Answering questions, as far as no model is needed: focus, retrieval, and what the answer drew on.

Everything takes many questions at once.  The model is a function that the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from codelore.functions import fixed
from codelore.functions.text import classify, concepts, mentions, strip_reasoning
from codelore.operators import around, builder, context, reads, retrieval

MOST_HIGHLIGHTED, MOST_SEED_PATHS, MOST_TURNS = 60, 5, 8
NOTHING_FOUND = "I couldn't find that in the indexed repository."


def classified(questions: DataFrame) -> DataFrame:
    """Questions (text) with ``intent``, ``confidence``, ``needs_context``, ``mentions``, ``concepts``."""
    return questions.withColumn("_c", classify(F.col("text"))).select(*questions.columns, "_c.*", mentions(F.col("text")).alias("mentions"), concepts(F.col("text")).alias("concepts"))


def resolve_focus(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, focus, label, source): what each question is about.

    ``questions`` has (question, repository, mentions, explorer, carried).  The first mention that
    names a node wins, then the node that is selected, then the one carried from the turn before.
    """
    asked = questions.select("question", "repository", F.posexplode("mentions").alias("i", "term")).withColumn("term", F.trim("term"))
    best = reads.find_ranked(nodes, asked.select("repository", "term"), most=1).select("repository", "term", "id", "name")
    named = asked.join(best, ["repository", "term"]).groupBy("question").agg(F.min(F.struct("i", "id", "name")).alias("m"))
    selected = questions.join(nodes.select(F.col("id").alias("explorer"), F.col("name").alias("_name")), "explorer").select("question", F.col("explorer").alias("_explorer"), "_name")
    known = nodes.select(F.col("id").alias("carried"), F.col("name").alias("_carried_name"))
    full = questions.join(named, "question", "left").join(selected, "question", "left").join(known, "carried", "left")
    pick = lambda a, b, c: F.when(F.col("m").isNotNull(), a).when(F.col("_explorer").isNotNull(), b).otherwise(c)
    return full.select("question", pick(F.col("m.id"), F.col("_explorer"), F.col("carried")).alias("focus"), pick(F.col("m.name"), F.col("_name"), F.col("_carried_name")).alias("label"), pick(F.lit("mention"), F.lit("explorer"), F.lit("carried")).alias("source"))


def gather(index: retrieval.Index | None, vectors: DataFrame | None, chunks: DataFrame, nodes: DataFrame, edges: DataFrame, questions: DataFrame, ranker: retrieval.Ranker = retrieval.rerank) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, hits, withheld) for questions (question, repository, text, q, intent, mentions, focus,
    explorer): retrieved code, as much as the intent wants, then the graph around the subject, which
    is what the code's files are if the question names nothing.

    Without an index the graph alone answers.
    """
    most = max(context.WANTED.values())
    if index is None or vectors is None:
        found = questions.select("question").limit(0).select("question", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("relative_path"), F.lit(None).cast("int").alias("rank"), F.lit(None).cast("double").alias("score"))
    else:
        asked = questions.select(F.col("question").alias("query"), "text", "q")
        ranked = retrieval.search(index, vectors, chunks, asked, most, ranker).withColumnRenamed("query", "question")
        few = questions.select("question", context.wanted(F.col("intent")).alias("_k"))
        found = ranked.join(few, "question").where(F.col("rank") <= F.col("_k")).drop("_k")
    few = found.where(F.col("rank") <= MOST_SEED_PATHS).groupBy("question").agg(F.array_sort(F.collect_list(F.struct("rank", "relative_path"))).alias("p"))
    seeded = questions.join(few, "question", "left").select("question", "repository", "mentions", "focus", F.when(F.col("explorer").isNotNull(), F.array("explorer")).alias("explorer"), F.coalesce(F.col("p.relative_path"), F.array().cast("array<string>")).alias("paths"))
    hits, withheld = around.walk(nodes, edges, around.seeds(nodes, seeded))
    return found, hits, withheld


def highlight(*sources: Column, most: int = MOST_HIGHLIGHTED) -> Column:
    """The node ids that an answer drew on, most central first: those of the ``sources`` (ids or arrays
    of ids, in order) that a knowledge graph draws, once each.
    """
    arrays = [F.coalesce(s, F.array().cast("array<string>")) for s in sources]
    kind = lambda x: F.get(F.split(x, builder.SEPARATOR, 3), F.lit(1))
    drawn = F.filter(F.concat(*arrays), lambda x: x.isNotNull() & (F.size(F.split(x, builder.SEPARATOR, 3)) == 3) & kind(x).isin(*fixed.KNOWLEDGE_KINDS))
    return F.slice(F.array_distinct(drawn), 1, most)


def sources(chunks: DataFrame) -> DataFrame:
    """Retrieved chunks as they are shown: no nulls, scores with four places."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in chunks.columns else F.lit("").alias(c)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) if c in chunks.columns else F.lit(0).cast("long").alias(c)
    score = lambda c: F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), 4).alias(c) if c in chunks.columns else F.lit(0.0).alias(c)
    shown = [text("relative_path").alias("file"), *[text(c) for c in ("relative_path", "file_name", "repository", "language", "symbol", "chunk_type")]]
    return chunks.select("question", *shown, *[number(c) for c in ("chunk_index", "start_line", "end_line")], (F.coalesce("distance", F.lit(0.0)) if "distance" in chunks.columns else F.lit(0.0)).alias("distance"), *[score(c) for c in ("score", "vector_score", "keyword_score")], text("content"))


def answer(contexts: DataFrame, model: Callable[[Column, Column], Column]) -> DataFrame:
    """``contexts`` (question, text, context) with the model's ``answer``, its reasoning left out.

    A question without any context is not sent to the model.
    """
    empty = F.trim(F.coalesce("context", F.lit(""))) == ""
    return contexts.withColumn("answer", F.when(empty, NOTHING_FOUND).otherwise(strip_reasoning(model(F.col("text"), F.col("context")))))


def recorded(turns: DataFrame, new: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """Turns (conv_id, turn, question, answer, focus_label) with the new ones, the last ones of each."""
    every = turns.unionByName(new.select(*turns.columns))
    return context.tail(every, most).drop("back")


class Tools:
    """Look-ups over one set of tables: find, detail, symbols, and all that is known of a name."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, commits: DataFrame, commit_files: DataFrame):
        self.nodes, self.edges, self.commits, self.commit_files = nodes, edges, commits, commit_files

    def find(self, asked: DataFrame, most: int = 8) -> DataFrame:
        return reads.find_ranked(self.nodes, asked, most)

    def detail(self, asked: DataFrame) -> DataFrame:
        return reads.node_detail(self.nodes, self.edges, self.commits, self.commit_files, asked)

    def symbols(self, asked: DataFrame, most: int = 30) -> DataFrame:
        """Symbols among the ``most`` nodes that hold each name."""
        return reads.of_kinds(reads.search(self.nodes, asked, most=most), fixed.SYMBOL_KINDS)

    def run(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(matches, details): the five best nodes of each (repository, term), and the best one's parts."""
        matches = self.find(asked).where(F.col("pos") <= 5)
        return matches, self.detail(matches.where("pos = 1").select("id").distinct())

