"""Facts about repositories as texts for a prompt: one row per repository or asked node.

Each is an aggregation of what :mod:`codelore.operators.reads` and its neighbours return, so texts of
many repositories are made by one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from codelore.functions import fixed
from codelore.operators import history, insights, reads, render
from codelore.operators.render import said
from codelore.session import materialise

MOST_LANES, MOST_RELEASES, MOST_PATH_COMMITS, MOST_SHOWN_CHILDREN, MOST_MATCHES, MOST_CONCEPTS, MOST_PER_CONCEPT = 12, 8, 15, 12, 20, 3, 12
MOST_SYMBOLS, MOST_USES = 25, 15
#: Questions, and nodes that they ask about, that are sent to the tables.
MOST_SENT = 10_000
# What is said of the history's window, and of requests to change code.
WINDOW_NOTE = "Older commits were not walked, so dates are window-relative, not creation dates."
TRACE_NOTE = "(This is what the import graph permits, not an observed runtime trace. Dynamic dispatch and runtime registration are not visible to static analysis.)"
HEADINGS = (("structural", "Most depended-on (counted from import edges)"), ("churn", "Most frequently changed (counted from git history)"), ("complexity", "Largest files (line counts from static analysis)"))
NO_HOTSPOT = "No node in this repository crosses the thresholds for a hotspot (at least 3 dependents, or 3 commits in the indexed window)."
NO_FLOW = "No entry point could be identified in the import graph, so no flow was derived. The answer must come from the retrieved code."
NO_SUBJECT = "No specific file or symbol was identified in the question."
READ_ONLY = "The user has asked for a change, and repositories are only read here: say so in one sentence, then explain which files and symbols the change would touch and what to watch out for, without a patch or a replacement file."


def _lines(column: str | Column, order: str = "o") -> Column:
    """The texts of a group as lines, in order; nulls are left out."""
    value = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(F.col(order).alias("o"), value.alias("t"))))), lambda x: x["t"]), "\n")


def structure(nodes: DataFrame, most: int = MOST_SHOWN_CHILDREN) -> DataFrame:
    """(repository, text): modules by size, each with its first children."""
    modules = nodes.where("kind = 'module'").select("repository", "id", "name")
    sizes = reads.rollup(nodes).select("repository", F.col("module").alias("name"), "file_count")
    placed = modules.join(sizes, ["repository", "name"], "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))
    shown = reads.expand(nodes, modules.select("id"), most)
    child = said("    ", F.col("name"), F.when(F.col("kind") != "file", "/").otherwise(""))
    below = shown.groupBy(F.col("asked").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", child.alias("t")))).alias("c"), F.max("total").alias("total"))
    full = placed.join(below, "id", "left")
    more = F.when(F.col("total") > most, said("\n    ... ", F.col("total") - most, " more")).otherwise("")
    inner = F.when(F.col("c").isNotNull(), F.concat(F.lit("\n"), F.array_join(F.transform("c", lambda x: x["t"]), "\n"))).otherwise("")
    part = said("  ", F.col("name"), "/  (", F.col("file_count"), " files)", inner, more)
    rows = full.select("repository", F.struct((-F.col("file_count")).alias("n"), F.col("name").alias("name")).alias("o"), part.alias("t"))
    return rows.groupBy("repository").agg(_lines("t").alias("t")).select("repository", said(F.col("repository"), "/\n", F.col("t")).alias("text"))


def architecture(nodes: DataFrame, edges: DataFrame, commits: DataFrame) -> DataFrame:
    """(repository, text): counts, modules, the history's window, module dependencies, packages."""
    counted = nodes.groupBy("repository", "kind").agg(F.count("*").alias("n")).groupBy("repository").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("counts"))
    sizes = reads.rollup(nodes).withColumnRenamed("module", "name")
    module = F.struct("name", F.coalesce("file_count", F.lit(0)).alias("file_count"), F.coalesce("line_count", F.lit(0)).alias("line_count"), F.coalesce("primary_language", F.lit("")).alias("primary_language"))
    modules = nodes.where("kind = 'module'").select("repository", "name").join(sizes, ["repository", "name"], "left").groupBy("repository").agg(F.collect_list(module).alias("modules"))
    names = nodes.where("kind = 'module'").select("id", "name")
    between = reads.module_edges(nodes, edges).join(names.select(F.col("id").alias("source"), F.col("name").alias("s")), "source").join(names.select(F.col("id").alias("target"), F.col("name").alias("t")), "target")
    arrows = between.groupBy("repository").agg(F.collect_list(F.struct(F.col("s").alias("source"), F.col("t").alias("target"))).alias("edges"))
    packages = nodes.where("kind = 'external'").groupBy("repository").agg(F.collect_list(F.struct("name", F.coalesce("uses", F.lit(0)).alias("uses"))).alias("externals"))
    window = history.commit_range(commits).select("repository", F.struct("total", "first_at", "last_at").alias("window"))
    full = counted.join(modules, "repository", "left").join(arrows, "repository", "left").join(packages, "repository", "left").join(window, "repository", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    text = render.architecture(
        F.col("repository"), F.col("counts"), none("modules", "array<struct<name:string,file_count:bigint,line_count:bigint,primary_language:string>>"), F.col("window"), none("edges", "array<struct<source:string,target:string>>"), none("externals", "array<struct<name:string,uses:bigint>>")
    )
    return full.select("repository", text.alias("text"))


def dependencies(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, text): what each asked node depends on and what depends on it."""
    both = reads.dependencies(nodes, edges, asked)
    end = F.struct(F.col("key").alias("k"), F.col("via").alias("v"), "name", "key")
    listed = both.groupBy("asked").pivot("direction", ["dependencies", "dependents"]).agg(F.array_sort(F.collect_list(end)))
    full = reads.lookup(nodes, asked).select("id", "kind", "name", "key").join(listed, F.col("id") == F.col("asked"), "left")
    side = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<k:string,v:string,name:string,key:string>>")), lambda x: F.struct(x["name"].alias("name"), x["key"].alias("key")))
    return full.select("id", render.dependencies(F.struct("kind", "name", "key"), side(F.col("dependencies")), side(F.col("dependents"))).alias("text"))


def node_history(nodes: DataFrame, commits: DataFrame, commit_files: DataFrame, asked: DataFrame, most: int = MOST_PATH_COMMITS) -> DataFrame:
    """(id, text): the newest commits that touched each asked node's file."""
    path = F.when(F.col("kind") == "file", F.col("key")).otherwise(F.coalesce("relative_path", F.lit("")))
    of = materialise(reads.lookup(nodes, asked).select("id", "name", "repository", path.alias("relative_path")))
    of = F.broadcast(of) if of.limit(MOST_SENT + 1).count() <= MOST_SENT else of
    touched = history.commits_of_paths(commits, commit_files, of.select("repository", "relative_path"), most)
    line = said("  ", history.day(F.col("authored_at")), "  ", F.substring("sha", 1, 8), "  ", F.col("author"), ": ", F.col("summary"))
    listed = touched.select("repository", "relative_path", F.col("pos").alias("o"), line.alias("t")).groupBy("repository", "relative_path").agg(_lines("t").alias("t"))
    some = said("Recent commits touching ", F.col("name"), ":\n", F.col("t"))
    none = said("No recorded commits touch ", F.col("name"), " within the indexed history window.")
    return of.join(listed, ["repository", "relative_path"], "left").select("id", F.when(F.col("t").isNull(), none).otherwise(some).alias("text"))


def repository_history(commits: DataFrame, commit_files: DataFrame, refs: DataFrame) -> DataFrame:
    """(repository, text): the window, the busiest modules, and the newest releases."""
    window = history.commit_range(commits)
    lane = said("  - ", F.col("module"), ": ", F.col("total_commits"), " commits, earliest observed ", history.day(F.col("first_seen")))
    lanes = history.lanes(commit_files).where(F.col("pos") <= MOST_LANES).select("repository", F.col("pos").alias("o"), lane.alias("t")).groupBy("repository").agg(_lines("t").alias("lanes"))
    newest = history.releases(refs, MOST_RELEASES)
    named = newest.groupBy("repository").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said(F.col("name"), " (", history.day(F.col("created_at")), ")").alias("t")))), lambda x: x["t"]), ", ").alias("releases"))
    full = window.join(lanes, "repository", "left").join(named, "repository", "left")
    head = said("Indexed history window for ", F.col("repository"), ": ", F.col("total"), " commits from ", history.day(F.col("first_at")), " to ", history.day(F.col("last_at")), ". ", WINDOW_NOTE, "\n\nActivity by module:")
    text = said(head, F.when(F.col("lanes").isNotNull(), F.concat(F.lit("\n"), "lanes")).otherwise(""), F.when(F.col("releases").isNotNull(), F.concat(F.lit("\n\nRecent releases: "), "releases")).otherwise(""))
    return full.select("repository", text.alias("text"))


def hotspots(found: DataFrame, repositories: DataFrame) -> DataFrame:
    """(repository, text): hotspots by category, each with its reason and importers."""
    evidence = F.when(F.size("evidence") > 0, F.concat(F.lit("\n      importers include: "), F.array_join("evidence", ", "))).otherwise("")
    line = found.withColumn("t", said("  - ", F.col("reason"), evidence))
    each = line.select("repository", "category", F.col("pos").alias("o"), "t").groupBy("repository", "category").agg(_lines("t").alias("t"))
    parts = each.groupBy("repository").agg(F.map_from_entries(F.collect_list(F.struct("category", "t"))).alias("m"))
    blocks = F.array_compact(F.array(*[F.when(F.element_at("m", category).isNotNull(), F.concat(F.lit(f"{title}:\n"), F.element_at("m", category))) for category, title in HEADINGS]))
    full = repositories.select("repository").distinct().join(parts, "repository", "left")
    return full.select("repository", F.when(F.col("m").isNull(), NO_HOTSPOT).otherwise(F.array_join(blocks, "\n\n")).alias("text"))


def flows(steps: DataFrame, asked: DataFrame) -> DataFrame:
    """(request, text): a flow as a chain of layers; without any, that there is none."""
    arrow = F.when(F.col("depth") == 0, "").otherwise("   |\n   v\n")
    line = said(arrow, "  [", F.col("label"), "] ", F.array_join("names", ", "))
    chains = steps.select("request", F.col("depth").alias("o"), line.alias("t"), F.when(F.col("depth") == 0, F.col("label")).alias("entry")).groupBy("request").agg(_lines("t").alias("t"), F.max("entry").alias("entry"))
    text = said("Static call/import path derived from the import graph, starting at the ", F.col("entry"), ":\n\n", F.col("t"), "\n\n", TRACE_NOTE)
    return asked.select("request").distinct().join(chains, "request", "left").select("request", F.when(F.col("t").isNull(), NO_FLOW).otherwise(text).alias("text"))


def file(nodes: DataFrame, edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(id, text): what is known of each asked node: language, size, symbols, imports, importers."""
    of = reads.lookup(nodes, asked).select("id", "kind", "name", "key", "language", "line_count", "complexity")
    files = of.where("kind = 'file'").select("id")
    few = lambda by, most: F.array_join(F.slice(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by), "name"))), lambda x: x["name"]), 1, most), ", ")
    symbols = reads.children(nodes, files, fixed.SYMBOL_KINDS).groupBy(F.col("asked").alias("id")).agg(few("pos", MOST_SYMBOLS).alias("symbols"))
    uses = reads.resolved(reads.outgoing(edges, files, ["IMPORTS"]), nodes, "target").groupBy(F.col("asked").alias("id")).agg(few("key", MOST_USES).alias("uses"))
    used = reads.resolved(reads.incoming(edges, files, ["IMPORTS"]), nodes, "source").groupBy(F.col("asked").alias("id")).agg(few("key", MOST_USES).alias("used"))
    full = of.join(symbols, "id", "left").join(uses, "id", "left").join(used, "id", "left")
    more = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"\n{title}: "), c)).otherwise("") for c, title in (("symbols", "symbols"), ("uses", "imports"), ("used", "used by"))]
    known = lambda c, other: F.coalesce(F.col(c).cast("string"), F.lit(other))
    return full.select("id", said(F.col("kind"), " ", F.col("name"), " (", F.col("key"), ")\nlanguage: ", known("language", "unknown"), ", lines: ", known("line_count", "?"), ", complexity: ", known("complexity", "unknown"), *more).alias("text"))


def concepts(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question, text): nodes whose names or paths hold the concepts (array) of each question.

    The first three concepts are searched, twelve nodes each; of the first twenty matches each node
    is listed once.  Questions without a match have no row.
    """
    asked = questions.select("question", "repository", "concepts", F.posexplode(F.slice("concepts", 1, MOST_CONCEPTS)).alias("i", "term")).withColumn("term", F.trim("term"))
    found = reads.search(nodes, asked.select("repository", "term"), most=MOST_PER_CONCEPT)
    every = asked.join(found.select("repository", "term", "pos", "id", "kind", "name", "key"), ["repository", "term"])
    placed = reads.numbered(every, "o", ["question"], "i", "pos").withColumn("total", F.count("*").over(W.partitionBy("question")))
    first = reads.numbered(placed.where(F.col("o") <= MOST_MATCHES), "_n", ["question", "id"], "o", most=1)
    line = said("  ", F.col("kind"), " ", F.col("name"), "  [", F.col("key"), "]")
    listed = first.withColumn("t", line).groupBy("question").agg(_lines("t").alias("t"), F.first("total").alias("total"), F.first("concepts").alias("concepts"))
    return listed.select("question", said("Nodes whose name or path mentions ", F.array_join("concepts", " / "), " (", F.col("total"), " matches, closest first):\n", F.col("t")).alias("text"))


def by_intent(questions: DataFrame, nodes: DataFrame, edges: DataFrame, commits: DataFrame, commit_files: DataFrame, refs: DataFrame) -> DataFrame:
    """(question, ordinal, fact): the facts that each question's intent calls for.

    ``questions`` has (question, repository, intent, focus, concepts).  Searches and explanations need
    no facts beyond the retrieved code.  A checked number of questions is sent to the graph and its
    history, which are then read where they lie; more are joined with them.
    """
    few = questions.limit(MOST_SENT + 1).count() <= MOST_SENT
    of = lambda intent: (F.broadcast if few else lambda q: q)(questions.where(F.col("intent") == intent))
    whole = lambda intent, texts: of(intent).join(texts, "repository").select("question", F.col("text").alias("fact"))
    focused = lambda asked, texts: asked.join(texts.withColumnRenamed("id", "focus"), "focus").select("question", F.col("text").alias("fact"))
    ids = lambda df: df.where("focus is not null").select(F.col("focus").alias("id"))
    parts = [whole("architecture_analysis", architecture(nodes, edges, commits)), whole("structure_analysis", structure(nodes))]
    asked = of("dependency_analysis")
    parts += [focused(asked, dependencies(nodes, edges, ids(asked))), asked.where("focus is null").select("question", F.lit(NO_SUBJECT).alias("fact"))]
    asked = of("file_analysis")
    parts.append(focused(asked, file(nodes, edges, ids(asked))))
    asked = of("git_history_analysis")
    parts += [focused(asked, node_history(nodes, commits, commit_files, ids(asked))), asked.where("focus is null").join(repository_history(commits, commit_files, refs), "repository").select("question", F.col("text").alias("fact"))]
    asked = of("flow_analysis")
    guessed = asked.where("focus is null").join(insights.guess_entry(nodes, edges).select("repository", "id"), "repository").select(F.col("question").alias("request"), "id")
    starts = asked.where("focus is not null").select(F.col("question").alias("request"), F.col("focus").alias("id")).unionByName(guessed)
    steps = insights.flow_steps(nodes, insights.flow(nodes, edges, starts))
    parts.append(flows(steps, asked.select(F.col("question").alias("request"))).select(F.col("request").alias("question"), F.col("text").alias("fact")))
    parts.append(concepts(nodes, of("concept_analysis")).select("question", F.col("text").alias("fact")))
    parts.append(whole("hotspot_analysis", hotspots(insights.hotspots(nodes, edges, commit_files), reads.repositories(nodes))))
    parts.append(of("readonly_request").select("question", F.lit(READ_ONLY).alias("fact")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("question", F.lit(0).alias("ordinal"), "fact")
