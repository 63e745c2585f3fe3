"""What a question is about, and the bounded neighbourhood around it.

Names are resolved to nodes, nodes become seeds, symbols are lifted to their files, and the walk
along imports is cut by a fan-out per node and direction and a budget per question.  All questions
are walked at once: a hop is one join and two windows.  Questions and repositories are columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from codelore.functions import fixed, paths
from codelore.operators import reads
from codelore.session import materialise

MOST_SEEDS, MOST_FANOUT, MOST_NODES, MOST_EDGES, HOPS, MOST_SEARCHED = 6, 6, 24, 40, 2, 40
KIND_WORDS = {"external": "external package"}
MOST_LINES = 60


def place_of() -> Column:
    """A node's path: of its file for a symbol, else its key."""
    return F.coalesce(F.nullif("relative_path", F.lit("")), F.col("key"))


def resolve(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(repository, term, id): the best node for each asked (repository, term).

    A node of exactly that name, else of that name with a source file's suffix (for terms without a
    point), else one of the 40 shortest names or paths that hold the term.  Of these: exact names,
    then stems, then beginnings; then implementation before tests and examples; files before
    symbols before others; shorter names.
    """
    terms = asked.select("repository", F.trim("term").alias("term")).where("term <> ''").distinct()
    exact = materialise(reads.by_name(nodes, terms))  # few rows, read by each fallback
    bare = terms.where(~F.contains("term", F.lit("."))).join(exact.select("repository", "term"), ["repository", "term"], "left_anti")
    suffixed = bare.select("repository", F.col("term").alias("_term"), F.explode(F.array(*[F.concat("term", F.lit(s)) for s in fixed.STEM_SUFFIXES])).alias("term"))
    stemmed = reads.by_name(nodes, suffixed).join(suffixed, ["repository", "term"]).drop("term").withColumnRenamed("_term", "term")
    named = materialise(exact.unionByName(stemmed).drop("pos"))
    rest = terms.join(named.select("repository", "term"), ["repository", "term"], "left_anti")
    found = named.unionByName(reads.search(nodes, rest, most=MOST_SEARCHED).drop("pos"))
    name, low = F.lower("name"), F.lower("term")
    stem = lambda c: F.when(F.contains(c, F.lit(".")), F.regexp_replace(c, "[.][^.]*$", "")).otherwise(c)
    grade = F.when(name == low, 0).when(stem(name) == stem(low), 1).when(F.startswith(name, low), 2).otherwise(3)
    kind = F.when(F.col("kind") == "file", 0).when(F.col("kind").isin(*fixed.SYMBOL_KINDS), 1).otherwise(2)
    best = F.min(F.struct(grade.alias("a"), (-paths.prior(place_of())).alias("b"), kind.alias("c"), F.length("name").alias("d"), "key", "id")).alias("best")
    return found.groupBy("repository", "term").agg(best).select("repository", "term", "best.id")


def seeds(nodes: DataFrame, questions: DataFrame, most: int = MOST_SEEDS) -> DataFrame:
    """(question, repository, pos, id, reason): what each question is about, most certain first.

    ``questions`` has (question, repository, mentions, focus, explorer, paths): names in the question,
    the carried or selected node, other selected nodes, and paths of retrieved code, which count
    only if nothing else is known.
    """
    asked = questions.select("question", "repository", F.posexplode("mentions").alias("i", "term")).withColumn("term", F.trim("term"))
    named = asked.join(resolve(nodes, asked.select("repository", "term")), ["repository", "term"]).select("question", "repository", F.lit(0).alias("o"), "i", "id", F.lit("mention").alias("reason"))
    picked = F.array_compact(F.concat(F.array("focus"), F.coalesce("explorer", F.array().cast("array<string>"))))
    chosen = questions.select("question", "repository", F.posexplode(picked).alias("i", "id")).join(nodes.select("id"), "id", "left_semi").select("question", "repository", F.lit(1).alias("o"), "i", "id", F.lit("explorer").alias("reason"))
    sure = named.unionByName(chosen)
    vague = questions.join(sure.select("question"), "question", "left_anti").select("question", "repository", F.posexplode(F.slice("paths", 1, most)).alias("i", "key"))
    files = nodes.where("kind = 'file'").select("repository", "key", "id")
    found = vague.join(files, ["repository", "key"]).select("question", "repository", F.lit(2).alias("o"), "i", "id", F.lit("retrieval").alias("reason"))
    every = sure.unionByName(found).groupBy("question", "repository", "id").agg(F.min(F.struct("o", "i", "reason")).alias("m")).select("question", "repository", "id", "m.*")
    return reads.numbered(every, "pos", ["question"], "o", "i", "id", most=most).select("question", "repository", "pos", "id", "reason")


def lifted(nodes: DataFrame, seeded: DataFrame, most: int = MOST_NODES) -> DataFrame:
    """(question, id, reason, via, o): the containers of the seeds up to their modules.

    The file of a symbol ``defines`` it and is walked from; modules, directories and classes only
    tell where it is (``contains``).  Seeds that are containers themselves are not lifted.
    """
    chains = reads.ancestors(nodes, seeded.select("id"))
    size = F.max("pos").over(W.partitionBy("asked"))
    above = chains.withColumn("up", size - F.col("pos")).where("up > 0 and kind <> 'repository'")
    start = seeded.join(nodes.select("id", F.col("kind").alias("_kind"), F.col("name").alias("via")), "id").where(~F.col("_kind").isin("repository", "module", "directory"))
    each = start.select("question", F.col("pos").alias("seed"), F.col("id").alias("asked"), "via").join(above, "asked").select("question", "seed", "up", "id", "kind", "via")
    once = each.groupBy("question", "id", "kind").agg(F.min(F.struct("seed", "up", "via")).alias("m")).select("question", "id", "kind", "m.*")
    new = once.join(seeded.select("question", "id"), ["question", "id"], "left_anti")
    few = reads.numbered(new, "o", ["question"], "seed", "up", "id", most=most)
    return few.select("question", "id", F.when(F.col("kind") == "file", "defines").otherwise("contains").alias("reason"), "via", "o")


def walk(nodes: DataFrame, edges: DataFrame, seeded: DataFrame, hops: int = HOPS, most: int = MOST_NODES, fanout: int = MOST_FANOUT) -> tuple[DataFrame, DataFrame]:
    """((question, pos, id, distance, reason, via), (question, withheld)) around the seeds.

    Hits come in the order in which they are met: containers that only tell the place, seeds, their
    files, then hop by hop, by the order of the nodes walked from, imports before importers, likely
    implementation first, longer files first, then by id.  A node that the budget has no room for
    is withheld, counted each time it is met.
    """
    seeded = materialise(seeded)
    slim = nodes.select("id", F.col("name").alias("_name"), (-paths.prior(place_of())).alias("_prior"), (-F.coalesce("line_count", F.lit(0))).alias("_lines"))
    walked = reads.of_kinds(edges, fixed.WALKED)
    both = walked.select(F.col("source").alias("here"), F.col("target").alias("there"), F.lit(0).alias("way")).unionByName(walked.select(F.col("target").alias("here"), F.col("source").alias("there"), F.lit(1).alias("way")))
    held = materialise(lifted(nodes, seeded, most))
    places = held.where("reason = 'contains'").select("question", F.lit(0).alias("g"), F.col("o").alias("i"), "id", F.lit(1).alias("distance"), "reason", "via")
    own = seeded.select("question", F.lit(1).alias("g"), F.col("pos").alias("i"), "id", F.lit(0).alias("distance"), "reason", F.lit("").alias("via"))
    files = held.where("reason = 'defines'").select("question", F.lit(2).alias("g"), F.col("o").alias("i"), "id", F.lit(1).alias("distance"), "reason", "via")
    start = reads.numbered(places.unionByName(own).unionByName(files), "pos", ["question"], "g", "i").drop("i")
    found = materialise(start)
    frontier = found.where("g > 0")
    withheld = []
    for hop in range(1, hops + 1):
        size = found.groupBy("question").agg(F.max("pos").alias("size"))
        steps = frontier.select("question", F.col("pos").alias("by"), F.col("id").alias("here")).join(both, "here").join(slim.withColumnRenamed("id", "there"), "there")
        cap = W.partitionBy("question", "here", "way").orderBy("_prior", "_lines", "there")
        few = steps.withColumn("n", F.row_number().over(cap)).where(F.col("n") <= fanout)
        met = few.join(found.select("question", F.col("id").alias("there")), ["question", "there"], "left_anti")
        first = met.groupBy("question", F.col("there").alias("id")).agg(F.min(F.struct("by", "way", "n", "here")).alias("m"), F.count("*").alias("times")).select("question", "id", "m.*", "times")
        placed = reads.numbered(first, "r", ["question"], "by", "way", "n", "id").join(size, "question")
        whole = materialise(placed.select("*", (F.col("size") + F.col("r") <= most).alias("fits")))
        named = whole.where("fits").join(slim.select(F.col("id").alias("here"), F.col("_name").alias("via")), "here")
        frontier = named.select("question", F.lit(2 + hop).alias("g"), "id", F.lit(hop).alias("distance"), F.when(F.col("way") == 0, "imports").otherwise("imported-by").alias("reason"), "via", (F.col("size") + F.col("r")).alias("pos"))
        # A question whose budget was spent before a hop ends there.
        withheld.append(whole.where("not fits").select("question", "times"))
        found = materialise(found.unionByName(frontier))
        frontier = found.where(F.col("g") == 2 + hop)
    dropped = reduce(DataFrame.unionByName, withheld).groupBy("question").agg(F.sum("times").alias("withheld"))
    return found.select("question", "pos", "id", "distance", "reason", "via"), dropped


def edges_among(edges: DataFrame, hits: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """(question, n, edge columns): walked edges between hits, in the order of their sources."""
    ends = hits.select("question", F.col("id").alias("target"))
    inside = reads.of_kinds(edges, fixed.WALKED).join(hits.select("question", F.col("id").alias("source"), "pos"), "source").join(ends, ["question", "target"], "left_semi")
    return reads.numbered(inside, "n", ["question"], "pos", "id", most=most).select("question", "n", *edges.columns)


def paths_of(nodes: DataFrame, hits: DataFrame) -> DataFrame:
    """(question, path, seed): the files of the hits, and whether one of them is a seed's."""
    path = F.when(F.col("kind") == "file", F.col("key")).otherwise(F.col("relative_path"))
    each = hits.join(nodes.select("id", path.alias("path")), "id").where("path <> ''")
    return each.groupBy("question", "path").agg(F.max(F.col("reason").isin("mention", "explorer", "retrieval")).alias("seed"))


def text(nodes: DataFrame, hits: DataFrame, among: DataFrame, withheld: DataFrame, most: int = MOST_NODES, lines: int = MOST_LINES) -> DataFrame:
    """(question, text): the neighbourhood as lines: subjects, what they depend on, and the rest."""
    word = F.col("kind")
    for kind, said in KIND_WORDS.items():
        word = F.when(F.col("kind") == kind, said).otherwise(word)
    known = hits.join(nodes.select("id", "name", word.alias("word"), place_of().alias("place")), "id")
    seed = F.col("reason").isin("mention", "explorer", "retrieval")
    subject = seed | (F.col("reason") == "defines")
    names = known.select("question", "id", "name")
    ends = among.select("question", "n", "source", "target")
    listed = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"])), ", ").alias(c)
    uses = ends.join(names.withColumnRenamed("id", "target"), ["question", "target"]).groupBy("question", F.col("source").alias("id")).agg(listed("uses"))
    used = ends.join(names.withColumnRenamed("id", "source"), ["question", "source"]).groupBy("question", F.col("target").alias("id")).agg(listed("used"))
    full = known.join(uses, ["question", "id"], "left").join(used, ["question", "id"], "left")
    about = F.when(subject & (F.col("uses").isNotNull() | F.col("used").isNotNull()), F.concat(F.lit("\n"), "place", F.lit(":"), F.coalesce(F.concat(F.lit("\n  depends on -> "), "uses"), F.lit("")), F.coalesce(F.concat(F.lit("\n  used by <- "), "used"), F.lit(""))))
    # Seeds are stated before the files that define them, in the order of both.
    row = F.struct(F.when(seed, 0).otherwise(1).alias("o"), "pos", F.when(seed, F.concat(F.lit("  "), "word", F.lit(" "), "name", F.lit("  ["), "place", F.lit("]"))).alias("seed"), about.alias("about"), F.when(~subject & (F.col("reason") != "contains"), F.concat(F.lit("  "), "word", F.lit(" "), "place", F.lit(" ("), "reason", F.lit(" "), "via", F.lit(")"))).alias("other"))
    grouped = full.groupBy("question").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(withheld, "question", "left")
    some = lambda c: F.filter(F.transform("rows", lambda r: r[c]), lambda x: x.isNotNull())
    subjects = F.when(F.size(some("seed")) > 0, F.concat(F.lit("Subject of the question, located in the repository graph:\n"), F.array_join(some("seed"), "\n")))
    # Others fill what is left of the lines; a part of several lines counts each.
    count = lambda parts: F.aggregate(parts, F.lit(0), lambda a, x: a + F.size(F.split(x, "\n")))
    stated = F.when(F.size(some("seed")) > 0, F.size(some("seed")) + 1).otherwise(0) + count(some("about"))
    rest = F.slice(some("other"), F.lit(1), F.greatest(F.lit(lines) - stated - 2, F.lit(0)))
    others = F.when(F.size(some("other")) > 0, F.concat(F.lit("\nAlso in this neighbourhood:"), F.array_join(F.transform(rest, lambda x: F.concat(F.lit("\n"), x)), "")))
    more = F.when(F.col("withheld") > 0, F.concat(F.lit("\n("), F.col("withheld").cast("string"), F.lit(f" further related nodes were not included - the neighbourhood is capped at {most} nodes.)")))
    return grouped.select("question", F.array_join(F.array_compact(F.concat(F.array(subjects), some("about"), F.array(others, more))), "\n").alias("text"))
