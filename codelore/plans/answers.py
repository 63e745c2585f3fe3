"""Queries over what an answer is given: focus, facts as texts, highlights and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.functions import text as T
from codelore.operators import agent, around, context, facts, insights, reads, render, retrieval
from codelore.plans import graphs, subjects
from codelore.plans.graphs import SOME, Repositories
from codelore.plans.shared import Registry, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def query(name: str, tables: str, duck: str, **ctes: str):
    def add(function):
        graphs.query(name, tables, duck, **ctes)(function)
        QUERIES[name], ORACLES[name] = graphs.QUERIES.pop(name), graphs.ORACLES.pop(name)
        return function

    return add


DAY = "case when coalesce({0}, 0) = 0 then 'unknown' else strftime(to_timestamp({0}) at time zone 'UTC', '%Y-%m-%d') end"
_ROLLUP = "select repository, module, count(*) as file_count, sum(line_count)::bigint as line_count, (select l from (select language as l, count(*) as c from nodes m where m.kind = 'file' and m.repository = n.repository and m.module = n.module group by language order by c desc, l limit 1)) as primary_language from nodes n where kind = 'file' group by repository, module"

# facts
@query(
    "render_architecture",
    "nodes edges commits",
    f"""select r.repository, 'Repository: ' || r.repository || chr(10) || 'Indexed: ' || (select count(*) from nodes n where n.repository = r.repository and kind = 'file') || ' files, ' || (select count(*) from nodes n where n.repository = r.repository and kind = 'class') || ' classes, '
      || (select count(*) from nodes n where n.repository = r.repository and kind in ('function', 'method')) || ' functions/methods.' || chr(10) || chr(10) || 'Modules (largest first):' || chr(10)
      || (select string_agg('  - ' || module || ': ' || file_count || ' files, ' || line_count || ' lines, mainly ' || primary_language, chr(10) order by file_count desc, module) from roll where roll.repository = r.repository)
      || chr(10) || chr(10) || '(Dates below are limited to the indexed history window: ' || c.total || ' commits from ' || {DAY.format('c.first_at')} || ' to ' || {DAY.format('c.last_at')} || '. Earlier history was not walked, so these are not module creation dates.)'
      || chr(10) || chr(10) || 'Module dependencies (source imports target):' || chr(10) || (select string_agg('  - ' || s.name || ' -> ' || t.name, chr(10) order by s.name, t.name) from edges e join nodes s on s.id = e.source join nodes t on t.id = e.target where e.kind = 'DEPENDS_ON' and e.repository = r.repository)
      || coalesce(chr(10) || chr(10) || 'Most used external packages: ' || (select string_agg(name || ' (' || uses || ')', ', ' order by uses desc, name) from (select * from nodes n where n.kind = 'external' and n.repository = r.repository order by uses desc, name limit 12)), '') as text
    from (select distinct repository from nodes) r join (select repository, count(*) as total, min(authored_at) as first_at, max(authored_at) as last_at from commits group by repository) c on c.repository = r.repository""",
    roll=_ROLLUP,
)
def render_architecture(g: Repositories) -> DataFrame:
    return facts.architecture(g.nodes, g.edges, g.commits)


@query(
    "render_structure",
    "nodes",
    """select repository, repository || '/' || chr(10) || string_agg(t, chr(10) order by n desc, name) as text from (
      select m.repository, m.name, coalesce(r.file_count, 0) as n, '  ' || m.name || '/  (' || coalesce(r.file_count, 0) || ' files)' || coalesce(chr(10) || (select string_agg('    ' || name || case when kind = 'file' then '' else '/' end, chr(10) order by k) from below b where b.parent_id = m.id and k <= 12), '')
        || case when (select count(*) from below b where b.parent_id = m.id) > 12 then chr(10) || '    ... ' || ((select count(*) from below b where b.parent_id = m.id) - 12) || ' more' else '' end as t
      from nodes m left join roll r on r.repository = m.repository and r.module = m.name where m.kind = 'module') group by repository""",
    roll=_ROLLUP,
    below="select parent_id, name, kind, row_number() over (partition by parent_id order by case kind when 'directory' then 1 else 2 end, coalesce(line_count, 0) desc, name, id) as k from nodes where kind in ('directory', 'file')",
)
def render_structure(g: Repositories) -> DataFrame:
    return facts.structure(g.nodes)


def _side(title: str, arrow: str, here: str, there: str) -> str:
    ends = f"(select n.name, n.key, e.kind as via from edges e join nodes n on n.id = e.{there} where e.{here} = a.id and {graphs.RELATION.replace('kind', 'e.kind')})"
    return f"case when (select count(*) from {ends}) = 0 then '{title}: nothing inside this repository.' else '{title} (' || (select count(*) from {ends}) || '):' || chr(10) || (select string_agg('  {arrow} ' || name || '  [' || key || ']', chr(10) order by key, via) from (select * from {ends} order by key, via, name limit 20)) end"


@query(
    "render_dependencies",
    "nodes edges",
    f"select a.id, a.kind || ' ' || a.name || ' (' || a.key || ')' || chr(10) || chr(10) || {_side('Depends on', '->', 'source', 'target')} || chr(10) || chr(10) || {_side('Used by', '<-', 'target', 'source')} as text from nodes a where a.id in ({SOME})",
)
def render_dependencies(g: Repositories) -> DataFrame:
    return facts.dependencies(g.nodes, g.edges, g.asked(SOME))


@query(
    "render_node_history",
    "nodes commits commit_files",
    f"""select a.id, coalesce('Recent commits touching ' || a.name || ':' || chr(10) || (select string_agg(t, chr(10) order by k) from (
      select '  ' || {DAY.format('c.authored_at')} || '  ' || substr(c.sha, 1, 8) || '  ' || c.author || ': ' || c.summary as t, row_number() over (order by f.authored_at desc, f.sha, f.change_type) as k from commit_files f join commits c on c.repository = f.repository and c.sha = f.sha
      where f.repository = a.repository and f.relative_path = case when a.kind = 'file' then a.key else a.relative_path end) where k <= 15), 'No recorded commits touch ' || a.name || ' within the indexed history window.') as text from nodes a where a.id in ({SOME})""",
)
def render_node_history(g: Repositories) -> DataFrame:
    return facts.node_history(g.nodes, g.commits, g.commit_files, g.asked(SOME))


@query(
    "render_history",
    "commits commit_files refs",
    f"""select c.repository, 'Indexed history window for ' || c.repository || ': ' || c.total || ' commits from ' || {DAY.format('c.first_at')} || ' to ' || {DAY.format('c.last_at')} || '. {facts.WINDOW_NOTE}' || chr(10) || chr(10) || 'Activity by module:' || chr(10)
      || (select string_agg('  - ' || module || ': ' || total || ' commits, earliest observed ' || {DAY.format('seen')}, chr(10) order by total desc, module) from (select * from lane l where l.repository = c.repository order by total desc, module limit 12))
      || chr(10) || chr(10) || 'Recent releases: ' || (select string_agg(name || ' (' || {DAY.format('created_at')} || ')', ', ' order by created_at, name) from (select * from refs r where r.kind = 'tag' and r.created_at is not null and r.repository = c.repository order by created_at desc, name desc limit 8)) as text
    from (select repository, count(*) as total, min(authored_at) as first_at, max(authored_at) as last_at from commits group by repository) c""",
    lane="select repository, module, sum(commits)::bigint as total, min(first_at) as seen from (select repository, module, strftime(to_timestamp(authored_at) at time zone 'UTC', '%Y-%m') as period, count(distinct sha) as commits, min(authored_at) as first_at from commit_files where module is not null group by all) group by repository, module",
)
def render_history(g: Repositories) -> DataFrame:
    return facts.repository_history(g.commits, g.commit_files, g.refs)


_PARTS = " || chr(10) || chr(10) || ".join(f"'{title}:' || chr(10) || (select string_agg('  - ' || reason || case when evidence <> '' then chr(10) || '      importers include: ' || replace(evidence, ',', ', ') else '' end, chr(10) order by pos) from found f where f.repository = r.repository and f.category = '{category}')" for category, title in facts.HEADINGS)


@query("render_hotspots", "nodes edges commit_files", f"select r.repository, {_PARTS} as text from (select distinct repository from nodes) r", imported=subjects._IMPORTED, found=f"{subjects._STRUCTURAL} union all {subjects._CHURN} union all {subjects._COMPLEX}")
def render_hotspots(g: Repositories) -> DataFrame:
    return facts.hotspots(insights.hotspots(g.nodes, g.edges, g.commit_files), reads.repositories(g.nodes))


@query(
    "render_flow",
    "nodes edges",
    f"""select request, 'Static call/import path derived from the import graph, starting at the ' || max(case when depth = 0 then label end) || ':' || chr(10) || chr(10)
      || string_agg(case when depth = 0 then '' else '   |' || chr(10) || '   v' || chr(10) end || '  [' || label || '] ' || names, chr(10) order by depth) || chr(10) || chr(10) || '{facts.TRACE_NOTE}' as text from steps group by request""",
    **subjects._layers(),
    steps=f"""select l.request, l.depth, string_agg(n.name, ', ' order by l.pos) as names, case when l.depth = 0 then {subjects._LABEL} when count(distinct n.module) = 1 then min(n.module) when count(distinct n.directory) = 1 and min(n.directory) <> '' then min(n.directory) else 'imports' end as label
      from layers l join nodes n on n.id = l.id group by l.request, l.depth""",
)
def render_flow(g: Repositories) -> DataFrame:
    nodes, edges = g.nodes, g.edges
    starts = insights.guess_entry(nodes, edges).select(F.col("repository").alias("request"), "id")
    return facts.flows(insights.flow_steps(nodes, insights.flow(nodes, edges, starts)), starts)


_FEW = "coalesce(chr(10) || '{0}: ' || (select string_agg(name, ', ' order by k) from (select name, row_number() over (order by {1}) as k from ({2})) where k <= {3}), '')"
_HELD = "select n.name, n.kind, n.id from nodes n where n.parent_id = a.id and a.kind = 'file' and n.kind in ('class', 'function', 'method')"
_USES = "select n.name, n.key from edges e join nodes n on n.id = e.target where e.source = a.id and a.kind = 'file' and e.kind = 'IMPORTS'"
_USED = "select n.name, n.key from edges e join nodes n on n.id = e.source where e.target = a.id and a.kind = 'file' and e.kind = 'IMPORTS'"


@query(
    "render_file",
    "nodes edges",
    f"""select a.id, a.kind || ' ' || a.name || ' (' || a.key || ')' || chr(10) || 'language: ' || coalesce(a.language, 'unknown') || ', lines: ' || coalesce(a.line_count::varchar, '?') || ', complexity: ' || coalesce(a.complexity, 'unknown')
      || {_FEW.format('symbols', 'kind, name, id', _HELD, 25)} || {_FEW.format('imports', 'key', _USES, 15)} || {_FEW.format('used by', 'key', _USED, 15)} as text from nodes a where a.id in ({SOME})""",
)
def render_file(g: Repositories) -> DataFrame:
    return facts.file(g.nodes, g.edges, g.asked(SOME))


CONCEPTS = [(1, "alpha", ["routes", "test_p1", "brand3", "docs"]), (2, "beta", ["method", "main"]), (3, "beta", ["nothing"]), (4, "alpha", [])]
_TERMS = subjects._listed([(q, r, i, c, " / ".join(cs)) for q, r, cs in CONCEPTS for i, c in enumerate(cs[:3])], "question, repository, i, term, said", ("bigint", "varchar", "bigint", "varchar", "varchar"))


@query(
    "concept_search",
    "nodes",
    """select question, 'Nodes whose name or path mentions ' || said || ' (' || max(total) || ' matches, closest first):' || chr(10) || string_agg('  ' || kind || ' ' || name || '  [' || key || ']', chr(10) order by o) as text
    from (select *, row_number() over (partition by question, id order by o) as again from placed where o <= 20) where again = 1 group by question, said""",
    asked=_TERMS,
    found="select * from (select a.question, a.said, a.i, n.id, n.kind, n.name, n.key, row_number() over (partition by a.question, a.i order by length(n.name), n.key, n.id) as k from asked a join nodes n on n.repository = a.repository and (n.name ilike '%' || a.term || '%' or n.key ilike '%' || a.term || '%')) where k <= 12",
    placed="select *, row_number() over (partition by question order by i, k) as o, count(*) over (partition by question) as total from found",
)
def concept_search(g: Repositories) -> DataFrame:
    return facts.concepts(g.nodes, g.spark.createDataFrame(CONCEPTS, "question long, repository string, concepts array<string>"))


_WALK = subjects._walk()
_WORD = "case kind when 'external' then 'external package' else kind end"
_PLACE = "coalesce(nullif(relative_path, ''), key)"
_ASKED = "reason in ('mention', 'explorer', 'retrieval')"


@query(
    "neighborhood_text",
    "nodes edges",
    f"""select q.question, concat_ws(chr(10), (select 'Subject of the question, located in the repository graph:' || chr(10) || string_agg('  ' || word || ' ' || name || '  [' || place || ']', chr(10) order by pos) from known k where k.question = q.question and {_ASKED}),
      (select string_agg(chr(10) || place || ':' || coalesce(chr(10) || '  depends on -> ' || uses, '') || coalesce(chr(10) || '  used by <- ' || used, ''), chr(10) order by case when {_ASKED} then 0 else 1 end, pos) from known k where k.question = q.question and ({_ASKED} or reason = 'defines') and (uses is not null or used is not null)),
      (select chr(10) || 'Also in this neighbourhood:' || string_agg(chr(10) || '  ' || word || ' ' || place || ' (' || reason || ' ' || via || ')', '' order by pos) from known k where k.question = q.question and reason in ('imports', 'imported-by')),
      (select chr(10) || '(' || withheld || ' further related nodes were not included - the neighbourhood is capped at 24 nodes.)' from left_out w where w.question = q.question)) as text from (select distinct question from h2) q""",
    **_WALK,
    firsts="select question, source, target, min(k) as k from among group by question, source, target",
    outward="select f.question, f.source as id, string_agg(name, ', ' order by k) as uses from (select f.question, f.source, n.name, min(f.k) as k from firsts f join nodes n on n.id = f.target group by all) f group by f.question, f.source",
    inward="select f.question, f.target as id, string_agg(name, ', ' order by k) as used from (select f.question, f.target, n.name, min(f.k) as k from firsts f join nodes n on n.id = f.source group by all) f group by f.question, f.target",
    known=f"select h.question, h.pos, h.reason, h.via, h.id, n.name, {_WORD} as word, {_PLACE} as place, o.uses, i.used from h2 h join nodes n on n.id = h.id left join outward o on o.question = h.question and o.id = h.id left join inward i on i.question = h.question and i.id = h.id",
)
def neighborhood_text(g: Repositories) -> DataFrame:
    nodes, edges = g.nodes, g.edges
    hits, withheld = around.walk(nodes, edges, around.seeds(nodes, subjects.questions(g)))
    return around.text(nodes, hits, around.edges_among(edges, hits), withheld, lines=1000)


# focus
FOCUS = [
    (1, "alpha", ["nobody", "main.py", "routes"], "alpha::module::app", "alpha::module::brand2"), (2, "beta", ["nothing"], "beta::module::app", None), (3, "beta", [], "no::such::node", "beta::module::brand3"), (4, "alpha", [], None, None),
    (5, "alpha", ["   "], None, "gone::file::x"),
]
_FOCUS = subjects._listed([(q, r, e, c) for q, r, _, e, c in FOCUS], "question, repository, explorer, carried", ("bigint", "varchar", "varchar", "varchar"))
_NAMES = subjects._listed([(q, r, i, m.strip()) for q, r, ms, *_ in FOCUS for i, m in enumerate(ms) if m.strip()], "question, repository, i, term", ("bigint", "varchar", "bigint", "varchar"))


@query(
    "resolve_focus",
    "nodes",
    """select a.question, coalesce(m.id, e.id, a.carried) as focus, coalesce(m.name, e.name, c.name) as label, case when m.id is not null then 'mention' when e.id is not null then 'explorer' else 'carried' end as source
    from asked a left join (select * from best where k = 1 qualify row_number() over (partition by question order by i) = 1) m on m.question = a.question left join nodes e on e.id = a.explorer left join nodes c on c.id = a.carried""",
    asked=_FOCUS,
    terms=_NAMES,
    few="select * from (select t.question, t.i, t.term, n.*, row_number() over (partition by t.question, t.i order by length(n.name), n.key, n.id) as r from terms t join nodes n on n.repository = t.repository and (n.name ilike '%' || t.term || '%' or n.key ilike '%' || t.term || '%')) where r <= 3",
    best="select *, row_number() over (partition by question, i order by case when lower(name) = lower(term) then 0 when starts_with(lower(name), lower(term)) then 1 else 2 end, case when kind = 'file' then 0 else 1 end, length(name), key, id) as k from few",
)
def resolve_focus(g: Repositories) -> DataFrame:
    return agent.resolve_focus(g.nodes, g.spark.createDataFrame(FOCUS, "question long, repository string, mentions array<string>, explorer string, carried string"))


#: What each intent adds, for questions with and without a focus: how the facts begin.
INTENTS = ["architecture_analysis", "structure_analysis", "dependency_analysis", "file_analysis", "git_history_analysis", "flow_analysis", "concept_analysis", "hotspot_analysis", "readonly_request", "repository_search", "code_explanation"]
_FILE = "alpha::file::app/main.py"
STATED = [
    (0, "Repository: "), (1, "alpha/"), (2, "file main.py (app/main.py)"), (3, "file main.py (app/main.py)"), (4, "Recent commits touching main.py:"), (5, "Static call/import path derived from the import graph"), (6, "Nodes whose name or path mentions routes"), (7, "Most depended-on"), (8, facts.READ_ONLY[:30]),
    (100, "Repository: "), (101, "alpha/"), (102, facts.NO_SUBJECT), (104, "Indexed history window for alpha"), (105, "Static call/import path derived from the import graph"), (106, "Nodes whose name or path mentions routes"), (107, "Most depended-on"), (108, facts.READ_ONLY[:30]),
]


@R.frame("facts_by_intent", "select question::bigint as question, said from (values " + ", ".join(f"({q}, '{t}')" for q, t in STATED) + ") v(question, said)")
def facts_by_intent(spark: SparkSession, d: str) -> DataFrame:
    g = Repositories(spark, d)
    rows = [(base + i, "alpha", intent, focus, ["routes"]) for base, focus in ((0, _FILE), (100, None)) for i, intent in enumerate(INTENTS)]
    asked = spark.createDataFrame(rows, "question long, repository string, intent string, focus string, concepts array<string>")
    said = facts.by_intent(asked, g.nodes, g.edges, g.commits, g.commit_files, g.refs)
    begins = spark.createDataFrame(STATED, "question long, said string")
    return said.join(begins, "question", "left").select("question", F.when(F.startswith("fact", F.coalesce("said", F.lit("?"))), F.col("said")).otherwise(F.substring("fact", 1, 60)).alias("said"))


# what an answer shows
@query(
    "highlight",
    "nodes edges",
    """select s.id, array_to_string((list(x.id order by x.o, x.i))[1:60], ',') as ids from (select id from nodes where kind = 'file' or kind = 'class') s join (
      select owner, id, min(o) as o, arg_min(i, (o, i)) as i from (select id as owner, id, 0 as o, '' as i from nodes union all select source, target, 1, target from edges where kind = 'IMPORTS' union all select parent_id, id, 2, id from nodes where parent_id is not null) where split_part(id, '::', 2) in ('file', 'class', 'function', 'method') group by owner, id) x on x.owner = s.id
    group by s.id""",
)
def highlight(g: Repositories) -> DataFrame:
    """A file or class, what it imports, and what it contains."""
    nodes = g.nodes
    imported = g.edges.where("kind = 'IMPORTS'").groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_list("target")).alias("imports"))
    held = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list(F.col("id"))).alias("parts"))
    of = nodes.where("kind in ('file', 'class')").select("id").join(imported, "id", "left").join(held, "id", "left")
    return of.select("id", F.array_join(agent.highlight(F.array("id"), F.col("imports"), F.col("parts")), ",").alias("ids"))


@R.frame(
    "source_projection",
    """select doc_id as question, source || '/' || lang as file, source || '/' || lang as relative_path, '' as file_name, '' as repository, lang as language, '' as symbol, '' as chunk_type, 0::bigint as chunk_index, 1::bigint as start_line, 0::bigint as end_line,
      0.0::double as distance, round_even(n_chars::double / 1024, 4) as score, 0.0::double as vector_score, 0.0::double as keyword_score, md5(text) as content from {documents}""",
)
def source_projection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    chunks = docs.select(F.col("doc_id").alias("question"), F.concat_ws("/", "source", "lang").alias("relative_path"), F.col("lang").alias("language"), F.lit(None).cast("string").alias("symbol"), F.lit(1).alias("start_line"), (F.col("n_chars") / 1024).alias("score"), F.md5("text").alias("content"))
    return agent.sources(chunks)


@query("tools_run", "nodes", "select repository, term, pos, id from (select *, cast(row_number() over (partition by repository, term order by case when lower(name) = lower(term) then 0 when starts_with(lower(name), lower(term)) then 1 else 2 end, case when kind = 'file' then 0 else 1 end, length(name), key, id) as integer) as pos from few where n <= 24) where pos <= 5", found=graphs._FOUND, few="select *, row_number() over (partition by repository, term order by length(name), key, id) as n from found")
def tools_run(g: Repositories) -> DataFrame:
    matches, _ = agent.Tools(g.nodes, g.edges, g.commits, g.commit_files).run(g.asked(graphs.TERMS))
    return matches.select("repository", "term", "pos", "id")


for _key, _most in (("last_turns", 6), ("last_turns_stored", 8)):

    @R.frame(_key, f"select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as r from {{conversations}}) where r <= {_most}")
    def _turns(spark: SparkSession, d: str, most=_most) -> DataFrame:
        return context.tail(table(spark, d, "conversations"), most).select("conv_id", "turn", "role")


@R.frame("truncate_text", "select conv_id, turn, case when length(t) > 400 then substring(t, 1, 400) || '…' else t end as shown from (select conv_id, turn, replace(text, chr(10), ' ') as t from {conversations})")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", T.truncated(F.col("text"), 400).alias("shown"))


@R.frame("top_k_by_intent", "select * from (values " + ", ".join(f"('{i}', {max(5, context.WANTED.get(i, 5))})" for i in INTENTS) + ") v(intent, k)")
def top_k_by_intent(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in INTENTS], "intent string").select("intent", context.wanted(F.col("intent")).alias("k"))


@R.frame(
    "render_prompt",
    """with t as (select conv_id, string_agg('User: ' || coalesce(text, '') , chr(10) order by turn) as said from {conversations} where role <> 'assistant' group by conv_id)
    select conv_id, md5('CURRENT EXPLORER CONTEXT' || chr(10) || 'conversation ' || conv_id || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'CONVERSATION SO FAR' || chr(10) || said || chr(10) || chr(10) || '---' || chr(10) || chr(10)
      || 'REPOSITORY FACTS (computed over the whole repository)' || chr(10) || 'first' || chr(10) || chr(10) || 'second' || case when conv_id % 2 = 0 then chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'REPOSITORY HISTORY (from git)' || chr(10) || 'yesterday' else '' end) as digest from t""",
)
def render_prompt(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "conversations").where("role <> 'assistant'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("question"), F.lit("").alias("answer")))).alias("turns"))
    code = F.array().cast("array<struct<relative_path:string,start_line:int,end_line:int,symbol:string,chunk_type:string,graph_linked:boolean,content:string>>")
    text = render.prompt(
        F.concat(F.lit("conversation "), F.col("conv_id").cast("string")), F.col("turns"), F.lit(None).cast("string"), F.array(F.lit("first"), F.lit(" "), F.lit("second")), F.when(F.col("conv_id") % 2 == 0, "yesterday"), code
    )
    return asked.select("conv_id", F.md5(text).alias("digest"))


@R.frame("median_latency", "select round_even(quantile_cont(value, 0.5), 1) as median_ms from {events}")
def median_latency(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.median_latency(table(spark, d, "events"), "value")
