"""Queries over the two stand-in repositories: graph reads and history.

Every query calls the operator that a user calls; its SQL is written on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.operators import graph, history, reads
from codelore.plans import stand_in
from codelore.plans.shared import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


class Repositories:
    """The stand-in tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in stand_in.PARTS:
            raise AttributeError(name)
        return stand_in.stored(self.spark, self.sf_dir, name)

    def asked(self, sql: str) -> DataFrame:
        return self.spark.sql(sql)


def query(name: str, tables: str, duck: str, **ctes: str):
    """Register a function of the stand-in tables; ``duck`` follows their common table expressions."""

    def add(function):
        more = "".join(f", {n} as ({sql})" for n, sql in ctes.items())
        text = f"with {stand_in.duck(*tables.split())}{more} {duck}"
        R.frame(name, text)(lambda spark, d: function(Repositories(spark, d)))
        return function

    return add


RELATION = "kind in ('IMPORTS', 'DEPENDS_ON', 'CALLS', 'INHERITS', 'IMPLEMENTS')"
#: Nodes that requests ask for: entry files, a class, a method, modules, a repository, an unknown id.
ASKED = """select id from (values ('alpha::file::app/main.py'), ('beta::file::app/core/routes.py'), ('alpha::module::app'), ('beta::module::brand1'), ('alpha::module::brand2'), ('alpha::repository::alpha'), ('no::file::such')) v(id)"""
SOME = f"{ASKED} union all select concat(f.id, '::Class0') from (select 'beta::class::app/main.py' as id) f"


# lookups
@query("counts_by_kind", "nodes edges commits", "select repository, kind, count(*) as n from nodes group by all union all select repository, 'edges', count(*) from edges group by all union all select repository, 'commits', count(*) from commits group by all")
def counts_by_kind(g: Repositories) -> DataFrame:
    return reads.counts(g.nodes, g.edges, g.commits)


@query("lookup_by_ids", "nodes", f"select id, kind, name, level from nodes where id in ({SOME})")
def lookup_by_ids(g: Repositories) -> DataFrame:
    return reads.lookup(g.nodes, g.asked(SOME)).select("id", "kind", "name", "level")


KEYS = "select repository, key, kind from (values ('alpha', 'app/main.py', 'file'), ('beta', 'app', 'module'), ('beta', 'app/main.py', 'module'), ('alpha', 'tests', 'module')) v(repository, key, kind)"


@query("find_node", "nodes", f"select n.id, n.repository, n.key, n.kind from nodes n join ({KEYS}) k on n.repository = k.repository and n.key = k.key and n.kind = k.kind")
def find_node(g: Repositories) -> DataFrame:
    return reads.find(g.nodes, g.asked(KEYS)).select("id", "repository", "key", "kind")


@query("roots", "nodes", "select id, repository, name from nodes where kind = 'repository'")
def roots(g: Repositories) -> DataFrame:
    return reads.of_kinds(g.nodes, ["repository"]).select("id", "repository", "name")


@query("edges_of_kinds", "edges", "select id, kind from edges where kind in ('INHERITS', 'DEPENDS_ON')")
def edges_of_kinds(g: Repositories) -> DataFrame:
    return reads.of_kinds(g.edges, ["INHERITS", "DEPENDS_ON"]).select("id", "kind")


TERMS = "select repository, term from (values ('alpha', 'ROUTES'), ('beta', ' method1'), ('alpha', 'class_'), ('alpha', '%.PY'), ('beta', '   '), ('alpha', 'nothing at all'), ('beta', 'app')) v(repository, term)"
_FOUND = f"select t.repository, trim(t.term) as term, n.id, n.name, n.kind, n.key from nodes n join ({TERMS}) t on n.repository = t.repository and trim(t.term) <> '' and (n.name ilike concat('%', trim(t.term), '%') or n.key ilike concat('%', trim(t.term), '%'))"


@query("search_substring", "nodes", "select repository, term, pos, id from (select *, cast(row_number() over (partition by repository, term order by length(name), key, id) as integer) as pos from found) where pos <= 25", found=_FOUND)
def search_substring(g: Repositories) -> DataFrame:
    return reads.search(g.nodes, g.asked(TERMS)).select("repository", "term", "pos", "id")


@query(
    "find_rank",
    "nodes",
    """select repository, term, pos, id from (select *, cast(row_number() over (partition by repository, term order by case when lower(name) = lower(term) then 0 when starts_with(lower(name), lower(term)) then 1 else 2 end,
      case when kind = 'file' then 0 else 1 end, length(name), key, id) as integer) as pos from few where n <= 24) where pos <= 8""",
    found=_FOUND,
    few="select *, row_number() over (partition by repository, term order by length(name), key, id) as n from found",
)
def find_rank(g: Repositories) -> DataFrame:
    return reads.find_ranked(g.nodes, g.asked(TERMS)).select("repository", "term", "pos", "id")


@query(
    "search_merged",
    "nodes",
    """select repository, term, id, cast(row_number() over (partition by repository, term order by o, n) as integer) as pos from (select *, row_number() over (partition by repository, term, id order by o, n) as again from (
      select repository, term, id, 0 as o, n from near where n <= 12 union all select repository, term, id, 1, n from (select *, row_number() over (partition by repository, term order by length(name), key, id) as n from found) where n <= 20)) where again = 1 qualify pos <= 16""",
    found=_FOUND,
    near="select *, row_number() over (partition by repository, term order by case when lower(name) = lower(term) then 0 when starts_with(lower(name), lower(term)) then 1 when contains(lower(name), lower(term)) then 2 else 3 end, length(name), key, id) as n from found where kind in ('module', 'file')",
)
def search_merged(g: Repositories) -> DataFrame:
    return reads.search_merged(reads.of_kinds(g.nodes, ["module", "file"]), g.nodes, g.asked(TERMS)).select("repository", "term", "id", "pos")


NAMED = "select repository, term from (values ('alpha', 'MAIN.py'), ('beta', 'Class10'), ('alpha', 'app'), ('beta', 'nobody')) v(repository, term)"


@query("search_exact", "nodes", f"select repository, term, pos, id from (select t.repository, t.term, n.id, cast(row_number() over (partition by t.repository, t.term order by length(n.key), n.key, n.id) as integer) as pos from nodes n join ({NAMED}) t on n.repository = t.repository and lower(n.name) = lower(t.term)) where pos <= 10")
def search_exact(g: Repositories) -> DataFrame:
    return reads.by_name(g.nodes, g.asked(NAMED)).select("repository", "term", "pos", "id")


# adjacency
for _name, _end, _read in (("neighbors_out", "source", reads.outgoing), ("neighbors_in", "target", reads.incoming)):

    @query(_name, "edges", f"select id, kind, source, target from edges where {RELATION} and {_end} in ({SOME})")
    def _neighbors(g: Repositories, read=_read) -> DataFrame:
        return read(g.edges, g.asked(SOME)).select("id", "kind", "source", "target")


@query("resolve_edges", "nodes edges", "select e.source as asked, e.kind as via, e.line as edge_line, n.id, n.name from edges e join nodes n on e.target = n.id where e.kind = 'DEPENDS_ON' or e.kind = 'CALLS'")
def resolve_edges(g: Repositories) -> DataFrame:
    return reads.resolved(reads.of_kinds(g.edges, ["DEPENDS_ON", "CALLS"]), g.nodes, "target").select("asked", "via", "edge_line", "id", "name")


@query(
    "dependencies_both",
    "nodes edges",
    f"""select 'dependencies' as direction, e.source as asked, e.kind as via, n.id, n.name, e.n as edge_n from edges e join nodes n on n.id = e.target where {RELATION.replace('kind', 'e.kind')} and e.source in ({SOME})
    union all select 'dependents', e.target, e.kind, n.id, n.name, e.n from edges e join nodes n on n.id = e.source where {RELATION.replace('kind', 'e.kind')} and e.target in ({SOME})""",
)
def dependencies_both(g: Repositories) -> DataFrame:
    return reads.dependencies(g.nodes, g.edges, g.asked(SOME)).select("direction", "asked", "via", "id", "name", "edge_n")


@query("relation_summary", "edges", f"select asked, direction, kind, count(*) as n from (select source as asked, 'out' as direction, kind from edges where {RELATION} union all select target, 'in', kind from edges where {RELATION}) where asked in ({SOME}) group by all")
def relation_summary(g: Repositories) -> DataFrame:
    return reads.relation_summary(g.edges, g.nodes, g.asked(SOME))


SETS = "select request, pos, id from (values ('a', 0, 'alpha::file::app/main.py'), ('a', 1, 'alpha::module::brand3'), ('a', 2, 'none'), ('a', 3, 'alpha::module::app'), ('a', 4, 'alpha::file::app/main.py'), ('b', 0, 'beta::module::brand3'), ('b', 61, 'beta::module::app'), ('b', 2, 'beta::module::brand4')) v(request, pos, id)"
_SET = f"select request, n.id, n.name, min(s.pos) as pos from ({SETS}) s join nodes n on n.id = s.id where s.pos < 60 group by all"


@query("node_set_order", "nodes", "select request, id, name, pos from shown", shown=_SET)
def node_set_order(g: Repositories) -> DataFrame:
    return reads.node_set(g.nodes, g.asked(SETS)).select("request", "id", "name", "pos")


@query("node_set_edges", "nodes edges", f"select a.request, e.id from edges e join shown a on e.source = a.id join shown b on e.target = b.id and a.request = b.request where {RELATION.replace('kind', 'e.kind')}", shown=_SET)
def node_set_edges(g: Repositories) -> DataFrame:
    return reads.node_set_edges(g.edges, reads.node_set(g.nodes, g.asked(SETS))).select("request", "id")


# hierarchy
@query("children", "nodes", f"select parent_id as asked, id, kind, name, cast(row_number() over (partition by parent_id order by kind, name, id) as integer) as pos from nodes where parent_id in ({SOME})")
def children(g: Repositories) -> DataFrame:
    return reads.children(g.nodes, g.asked(SOME)).select("asked", "id", "kind", "name", "pos")


@query("parent_join", "nodes", "select n.id, p.id as parent, p.kind as parent_kind from nodes n left join nodes p on n.parent_id = p.id")
def parent_join(g: Repositories) -> DataFrame:
    nodes = g.nodes
    above = nodes.select(F.col("id").alias("parent"), F.col("kind").alias("parent_kind"))
    return nodes.join(above, F.col("parent_id") == F.col("parent"), "left").select("id", "parent", "parent_kind")


_CHAIN = """select id as asked, id, parent_id, kind, 0 as depth from nodes where kind = 'method' or id in ({0})
  union all select c.asked, n.id, n.parent_id, n.kind, c.depth + 1 from up c join nodes n on n.id = c.parent_id where c.depth < 11"""


@query("ancestors", "nodes", "select asked, id, kind, cast(max(depth) over (partition by asked) - depth as integer) as pos from up", **{"up": _CHAIN.format(SOME)})
def ancestors(g: Repositories) -> DataFrame:
    wanted = g.nodes.where("kind = 'method'").select("id").unionByName(g.asked(SOME))
    return reads.ancestors(g.nodes, wanted).select("asked", "id", "kind", "pos")


ORACLES["ancestors"] = ORACLES["ancestors"].replace("with ", "with recursive ", 1)

_ROLLUP = """select repository, module, count(*) as file_count, sum(line_count)::bigint as line_count, count(distinct language) as n_languages,
  (select l from (select language as l, count(*) as c from nodes m where m.kind = 'file' and m.repository = n.repository and m.module = n.module group by language order by c desc, l limit 1)) as primary_language from nodes n where kind = 'file' group by repository, module"""


@query("module_rollup", "nodes", f"select * from ({_ROLLUP})")
def module_rollup(g: Repositories) -> DataFrame:
    return reads.rollup(g.nodes).withColumn("n_languages", F.size("languages").cast("long")).drop("languages")


@query(
    "overview",
    "nodes commit_files",
    f"""select m.repository, m.id, m.kind, m.name, coalesce(r.file_count, 0)::bigint as file_count, coalesce(r.line_count, 0)::bigint as line_count, coalesce(r.primary_language, '') as primary_language,
      (select min(authored_at) from commit_files c where c.repository = m.repository and c.module = m.name) as first_seen, null::bigint as uses
    from nodes m left join ({_ROLLUP}) r on r.repository = m.repository and r.module = m.name where m.kind = 'module'
    union all select repository, id, kind, name, null, null, null, null, uses from nodes where kind = 'external'""",
)
def overview(g: Repositories) -> DataFrame:
    return reads.overview(g.nodes, g.commit_files)


@query("overview_edges", "nodes edges", "select id, source, target from edges where kind = 'DEPENDS_ON' and source in (select id from nodes where kind = 'module') and target in (select id from nodes where kind = 'module')")
def overview_edges(g: Repositories) -> DataFrame:
    return reads.module_edges(g.nodes, g.edges).select("id", "source", "target")


_SHOWN = f"""select * from (select c.id, c.parent_id as asked, count(*) over (partition by c.parent_id) as total, count(*) over (partition by c.parent_id) > 20 as truncated,
  cast(row_number() over (partition by c.parent_id order by case c.kind when 'module' then 0 when 'directory' then 1 when 'file' then 2 else 9 end, coalesce(c.line_count, 0) desc, c.name, c.id) as integer) as pos
  from nodes c join nodes p on p.id = c.parent_id where p.id in ({SOME})
    and case p.kind when 'repository' then c.kind = 'module' when 'module' then c.kind in ('directory', 'file') when 'directory' then c.kind in ('directory', 'file') else true end) where pos <= 20"""


@query("expand_topk", "nodes", "select asked, pos, total, truncated, id from shown", shown=_SHOWN)
def expand_topk(g: Repositories) -> DataFrame:
    return reads.expand(g.nodes, g.asked(SOME), most=20).select("asked", "pos", "total", "truncated", "id")


@query("expand_edges", "nodes edges", f"select a.asked, e.id from edges e join shown a on e.source = a.id join shown b on e.target = b.id and a.asked = b.asked where {RELATION.replace('kind', 'e.kind')}", shown=_SHOWN)
def expand_edges(g: Repositories) -> DataFrame:
    return reads.expand_edges(g.edges, reads.expand(g.nodes, g.asked(SOME), most=20)).select("asked", "id")


_TOUCHED = """select s.asked, cast(row_number() over (partition by s.asked order by f.authored_at desc, f.sha, f.change_type) as bigint) as pos, f.sha as id, c.summary as name
  from (select id as asked, repository, coalesce(relative_path, key) as path from subject where kind in ('file', 'class', 'function', 'method')) s
  join commit_files f on f.repository = s.repository and f.relative_path = s.path join commits c on c.repository = f.repository and c.sha = f.sha"""


@query(
    "node_detail",
    "nodes edges commits commit_files",
    """select p.id as asked, 'symbols' as part, cast(row_number() over (partition by p.id order by n.kind, n.name, n.id) as bigint) as pos, n.id, n.name, null::bigint as n from subject p join nodes n on n.parent_id = p.id where p.kind = 'file' and n.kind in ('class', 'function', 'method')
    union all select e.source, 'dependencies', row_number() over (partition by e.source order by n.key, n.id), n.id, n.name, null from edges e join subject p on p.id = e.source and p.kind = 'file' join nodes n on n.id = e.target where e.kind = 'IMPORTS'
    union all select e.target, 'dependents', row_number() over (partition by e.target order by n.key, n.id), n.id, n.name, null from edges e join subject p on p.id = e.target and p.kind = 'file' join nodes n on n.id = e.source where e.kind = 'IMPORTS'
    union all select p.id, 'children', row_number() over (partition by p.id order by n.kind, n.name, n.id), n.id, n.name, null from subject p join nodes n on n.parent_id = p.id where p.kind in ('class', 'function', 'method')
    union all select p.id, 'parent', 1, n.id, n.name, null from subject p join nodes n on n.id = p.parent_id where p.kind in ('class', 'function', 'method')
    union all select asked, 'history', pos, id, name, null from touched where pos <= 10
    union all select p.id, 'children_count', 1, null, null, (select count(*) from nodes n where n.parent_id = p.id) from subject p where p.kind not in ('file', 'class', 'function', 'method')""",
    subject=f"select * from nodes where id in ({SOME})",
    touched=_TOUCHED,
)
def node_detail(g: Repositories) -> DataFrame:
    return reads.node_detail(g.nodes, g.edges, g.commits, g.commit_files, g.asked(SOME))


# degrees and the knowledge graph
@query("in_degree", "edges", "select repository, target as id, count(*) as n from edges where kind in ('IMPORTS', 'DEPENDS_ON') group by all")
def in_degree(g: Repositories) -> DataFrame:
    from codelore.operators import insights

    return insights.dependents(g.edges)


_RELATED = f"select * from edges where {RELATION} and source <> target and source in (select id from nodes where kind in ('file', 'class', 'function', 'method')) and target in (select id from nodes where kind in ('file', 'class', 'function', 'method'))"
_DEGREE = "select id, count(*) as degree from (select source as id from related union all select target from related) group by id"


@query("induced_subgraph", "nodes edges", "select id from related", related=_RELATED)
def induced_subgraph(g: Repositories) -> DataFrame:
    return reads.relations(g.nodes, g.edges).select("id")


@query("degree", "nodes edges", _DEGREE, related=_RELATED)
def degree(g: Repositories) -> DataFrame:
    return reads.degrees(reads.relations(g.nodes, g.edges))


_RANKED = """select n.repository, n.id, n.kind, n.parent_id, coalesce(d.degree, 0) as degree, cast(row_number() over (partition by n.repository order by case when d.degree is null then 1 else 0 end, coalesce(d.degree, 0) desc, case when n.kind = 'file' then 0 else 1 end, n.key, n.id) as integer) as rank
  from nodes n left join degree d on d.id = n.id where n.kind in ('file', 'class', 'function', 'method')"""


@query("knowledge_rank", "nodes edges", "select repository, id, degree, rank from ranked", related=_RELATED, degree=_DEGREE, ranked=_RANKED)
def knowledge_rank(g: Repositories) -> DataFrame:
    return reads.knowledge_rank(g.nodes, g.edges).select("repository", "id", "degree", "rank")


#: (repository, rank, id): what each rank needs, itself and the containers above it.
_CLOSED = """select repository, rank, id from ranked union all select r.repository, r.rank, p.id from ranked r join ranked p on p.id = r.parent_id
  union all select r.repository, r.rank, q.id from ranked r join ranked p on p.id = r.parent_id join ranked q on q.id = p.parent_id"""


def _taken(k: int) -> dict[str, str]:
    """One more node per repository after the cut: the first whose needs fit into the room."""
    room = f"select repository, 1500 - count(*) as room from kept{k} group by repository"
    needs = f"select c.repository, c.rank, count(*) as need from closed c left join kept{k} x on x.id = c.id where x.id is null group by all"
    return {
        f"pick{k}": f"select n.repository, min(n.rank) as rank from ({needs}) n join ({room}) r on r.repository = n.repository where n.need <= r.room group by n.repository",
        f"kept{k + 1}": f"select repository, id from kept{k} union select c.repository, c.id from closed c join pick{k} p on p.repository = c.repository and p.rank = c.rank",
    }


#: Ranks are kept up to the first that overflows; a chain has three nodes at most, so the room left
#: is two at most, and two more picks fill it.
@query(
    "knowledge_subset",
    "nodes edges",
    "select repository, id from kept2",
    related=_RELATED,
    degree=_DEGREE,
    ranked=_RANKED,
    closed=_CLOSED,
    firsts="select repository, id, min(rank) as first from closed group by all",
    growing="select repository, first, sum(count(*)) over (partition by repository order by first) as size from firsts group by repository, first",
    cut="select repository, min(first) as at from growing where size > 1500 group by repository",
    kept0="select f.repository, f.id from firsts f left join cut c on c.repository = f.repository where c.at is null or f.first < c.at",
    **_taken(0),
    **_taken(1),
)
def knowledge_subset(g: Repositories) -> DataFrame:
    return reads.knowledge(g.nodes, g.edges)


@query(
    "knowledge_edges",
    "nodes edges",
    "select kind, source, target from related union all select 'CONTAINS', parent_id, id from nodes where kind in ('class', 'function', 'method')",
    related=_RELATED,
)
def knowledge_edges(g: Repositories) -> DataFrame:
    return reads.knowledge_edges(g.nodes, g.edges, reads.of_kinds(g.nodes, ["file", "class", "function", "method"]))


@query(
    "project_nonnull",
    "nodes",
    "select id, array_to_string(list_filter([case when language is not null then 'language=' || language end, case when line_count is not null then 'line_count=' || line_count end, case when relative_path is not null then 'relative_path=' || relative_path end, case when start_line is not null then 'start_line=' || start_line end], lambda x: x is not null), ',') as data from nodes",
)
def project_nonnull(g: Repositories) -> DataFrame:
    data = reads.knowledge_data()
    nodes = g.nodes.withColumn("end_line", F.lit(None).cast("long"))
    return nodes.select("id", F.array_join(F.transform(F.map_entries(data), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("data"))


# history
@query("timeline_buckets", "commit_files", "select repository, module, strftime(to_timestamp(authored_at) at time zone 'UTC', '%Y-%m') as period, count(distinct sha) as commits, count(*) as changes, min(authored_at) as first_at, max(authored_at) as last_at from commit_files where module is not null group by all")
def timeline_buckets(g: Repositories) -> DataFrame:
    return history.buckets(g.commit_files)


_BUCKETS = "select repository, module, strftime(to_timestamp(authored_at) at time zone 'UTC', '%Y-%m') as period, count(distinct sha) as commits, min(authored_at) as first_at from commit_files where module is not null group by all"


@query(
    "timeline_lanes",
    "commit_files",
    """select repository, module, first_seen, total_commits, lane, cast(row_number() over (partition by repository order by total_commits desc, module) as integer) as pos from (
      select repository, module, min(first_at) as first_seen, sum(commits)::bigint as total_commits, string_agg(period || ':' || commits, ',' order by period) as lane from buckets group by repository, module)""",
    buckets=_BUCKETS,
)
def timeline_lanes(g: Repositories) -> DataFrame:
    lane = F.array_join(F.transform("periods", lambda p: F.concat(p["period"], F.lit(":"), p["commits"].cast("string"))), ",")
    return history.lanes(g.commit_files).withColumn("lane", lane).drop("periods")


@query("first_seen", "commit_files", "select repository, relative_path, min(authored_at) as first_at from commit_files group by all")
def first_seen(g: Repositories) -> DataFrame:
    return history.first_seen(g.commit_files)


@query("modules_first_seen", "commit_files", "select repository, module, min(authored_at) as first_at from commit_files where module is not null group by all")
def modules_first_seen(g: Repositories) -> DataFrame:
    return history.first_seen(g.commit_files, "module")


@query("churn_counts", "commit_files", "select repository, relative_path, count(distinct sha) as commits from commit_files group by all")
def churn_counts(g: Repositories) -> DataFrame:
    return history.change_counts(g.commit_files)


@query("commit_range", "commits", "select repository, min(authored_at) as first_at, max(authored_at) as last_at, count(*) as total from commits group by all")
def commit_range(g: Repositories) -> DataFrame:
    return history.commit_range(g.commits)


@query("paths_existing_at", "commit_files", "select distinct repository, relative_path from commit_files where authored_at <= 820000000")
def paths_existing_at(g: Repositories) -> DataFrame:
    return history.existing_at(g.commit_files, 820000000)


@query("time_range", "commit_files", "select repository, relative_path, count(*) as n from commit_files where authored_at > 830000000 and authored_at <= 840000000 group by all")
def time_range(g: Repositories) -> DataFrame:
    window = g.asked("select r as repository, 'w' as request, 830000000L as low, 840000000L as high from values ('alpha'), ('beta') v(r)")
    inside = g.commit_files.join(window, "repository").where("authored_at > low and authored_at <= high")
    return inside.groupBy("repository", "relative_path").agg(F.count("*").alias("n"))


@query(
    "path_history",
    "files commits commit_files",
    """select repository, relative_path, pos, sha, author, change_type from (select f.repository, f.relative_path, f.sha, c.author, f.change_type, cast(row_number() over (partition by f.repository, f.relative_path order by f.authored_at desc, f.sha, f.change_type) as integer) as pos
      from commit_files f join commits c on c.repository = f.repository and c.sha = f.sha) where pos <= 20""",
)
def path_history(g: Repositories) -> DataFrame:
    asked = g.files.select("repository", F.col("path").alias("relative_path"))
    return history.commits_of_paths(g.commits, g.commit_files, asked).select("repository", "relative_path", "pos", "sha", "author", "change_type")


@query("join_left_count", "commits commit_files", "select c.repository, c.sha, count(f.relative_path) as files_changed from commits c left join commit_files f on f.sha = c.sha and f.repository = c.repository group by all")
def join_left_count(g: Repositories) -> DataFrame:
    return history.timeline(g.commits, g.commit_files, g.refs, most=1 << 30).select("repository", "sha", "files_changed")


_NEWEST = """select *, row_number() over (partition by repository order by authored_at, sha desc) as pos from (select *, row_number() over (partition by repository order by authored_at desc, sha) as r from commits) where r <= 60"""
_RELEASE = "select repository, sha, name as release from (select *, row_number() over (partition by repository, sha order by coalesce(created_at, -1) desc, name desc) as r from refs where kind = 'tag') where r = 1"


@query(
    "commit_timeline",
    "commits commit_files refs",
    """select c.repository, cast(c.pos as integer) as pos, c.sha, substr(c.sha, 1, 8) as short_sha, c.author, c.authored_at, c.summary, (select count(*) from commit_files f where f.sha = c.sha and f.repository = c.repository) as files_changed, c.is_merge,
      coalesce(r.release, '') as release, true as truncated from newest c left join release r on r.repository = c.repository and r.sha = c.sha""",
    newest=_NEWEST,
    release=_RELEASE,
)
def commit_timeline(g: Repositories) -> DataFrame:
    return history.timeline(g.commits, g.commit_files, g.refs)


@query("release_marker", "refs", "select repository, sha, release from release", release=_RELEASE)
def release_marker(g: Repositories) -> DataFrame:
    return history.release_of(g.refs)


@query("last_releases", "refs", "select repository, name, created_at, cast(row_number() over (partition by repository order by created_at, name) as integer) as pos from (select *, row_number() over (partition by repository order by created_at desc, name desc) as r from refs where kind = 'tag' and created_at is not null) where r <= 40")
def last_releases(g: Repositories) -> DataFrame:
    return history.releases(g.refs).select("repository", "name", "created_at", "pos")


@query("refs_of_kind", "refs", "select repository, name, sha from refs where kind = 'branch'")
def refs_of_kind(g: Repositories) -> DataFrame:
    return history.references(g.refs, "branch").select("repository", "name", "sha")


#: Shortened shas of the orders 0 to 39, md5 of their numbers.
SHAS = "select case when i % 4 = 0 then 'beta' else 'alpha' end as repository, substr(md5(cast(i as string)), 1, 7) as prefix, i from (select explode(sequence(0, 39)) as i)"
_SHAS = "select case when i % 4 = 0 then 'beta' else 'alpha' end as repository, substr(md5(cast(i as string)), 1, 7) as prefix, i from range(0, 40) r(i)"
_NAMED = "select * from (select c.repository, s.prefix, s.i, c.sha, c.author, c.authored_at, c.is_merge, row_number() over (partition by c.repository, s.prefix order by c.sha) as r from commits c join shas s on s.repository = c.repository and starts_with(c.sha, s.prefix)) where r = 1"


@query("prefix_lookup", "commits", "select repository, prefix, sha, author, is_merge from named", shas=_SHAS, named=_NAMED)
def prefix_lookup(g: Repositories) -> DataFrame:
    return history.commit(g.commits, g.asked(SHAS)).select("repository", "prefix", "sha", "author", "is_merge")


@query(
    "commit_detail",
    "nodes commits commit_files",
    """select n.repository, n.prefix, cast(row_number() over (partition by n.repository, n.prefix order by f.relative_path, f.change_type) as integer) as pos, f.relative_path, coalesce(f.module, '') as module, f.change_type, coalesce(k.id, '') as node_id, k.id is not null as indexed
    from named n join commit_files f on f.repository = n.repository and f.sha = n.sha left join (select * from nodes where kind = 'file' and language <> 'markdown') k on k.repository = f.repository and k.key = f.relative_path""",
    shas=_SHAS,
    named=_NAMED,
)
def commit_detail(g: Repositories) -> DataFrame:
    indexed = g.nodes.where("language is null or language <> 'markdown'")
    return history.commit_detail(g.commits, g.commit_files, indexed, g.asked(SHAS)).drop("sha")


#: Windows between each order of a block and the next one of its repository, in either order.
PAIRS = "select repository, concat('w', cast(i as string)) as request, prefix as start, substr(md5(cast(i + 8 as string)), 1, 7) as end from ({}) where i < 20"
_WINDOWS = """select a.repository, 'w' || a.i as request, least(a.authored_at, b.authored_at) as low, greatest(a.authored_at, b.authored_at) as high from named a join named b on b.i = a.i + 8 and a.repository = b.repository where a.i < 20"""
_CHANGES = """select * from (select *, row_number() over (partition by repository, request order by commits desc, last_at desc, relative_path) as pos from (
  select w.repository, w.request, f.relative_path, any_value(f.module) as module, count(distinct f.sha) as commits, max(f.authored_at) as last_at from windows w join commit_files f on f.repository = w.repository and f.authored_at > w.low and f.authored_at <= w.high group by w.repository, w.request, f.relative_path)) where pos <= 400"""


def _changes(g: Repositories) -> DataFrame:
    windows = history.windows_between(g.commits, g.asked(PAIRS.format(SHAS)))
    return history.changes(g.commit_files, windows)


@query("changes_between", "commits commit_files", "select repository, request, cast(pos as integer) as pos, relative_path, module, commits, last_at from changes where pos <= 60", shas=_SHAS, named=_NAMED, windows=_WINDOWS, changes=_CHANGES)
def changes_between(g: Repositories) -> DataFrame:
    return _changes(g).where(F.col("pos") <= history.SHOWN_CHANGES)


@query("changes_by_module", "commits commit_files", "select repository, request, coalesce(module, '(root)') as module, sum(commits)::bigint as commits, count(*) as files from changes group by repository, request, coalesce(module, '(root)')", shas=_SHAS, named=_NAMED, windows=_WINDOWS, changes=_CHANGES)
def changes_by_module(g: Repositories) -> DataFrame:
    return history.changes_by_module(_changes(g))


MOMENTS = "select * from (values ('alpha', 'a', 789000000), ('alpha', 'b', 850000000), ('beta', 'a', 800000000), ('beta', 'z', 1)) v(repository, request, at)"
_SNAPSHOT = """select m.repository, t.request, m.name as module, s.first_seen, (select count(*) from nodes f left join seen p on p.repository = f.repository and p.path = f.key where f.kind = 'file' and f.repository = m.repository and f.module = m.name and coalesce(p.first_at, 0) <= t."at") as file_count_at,
  (select count(*) from nodes f where f.kind = 'file' and f.repository = m.repository and f.module = m.name) as file_count
  from nodes m join moments t on t.repository = m.repository left join (select repository, module, min(authored_at) as first_seen from commit_files where module is not null group by all) s on s.repository = m.repository and s.module = m.name
  where m.kind = 'module' and (s.first_seen is null or s.first_seen <= t."at")"""
_SEEN = "select repository, relative_path as path, min(authored_at) as first_at from commit_files group by all"


@query("snapshot_at", "nodes commit_files", _SNAPSHOT, moments=MOMENTS.replace("request, at", 'request, "at"'), seen=_SEEN)
def snapshot_at(g: Repositories) -> DataFrame:
    return history.snapshot(g.nodes, g.commit_files, g.asked(MOMENTS))


@query("snapshot_at_commit", "nodes commits commit_files", _SNAPSHOT, seen=_SEEN, shas=_SHAS, named=_NAMED, moments='select repository, prefix as request, authored_at as "at" from named where i < 8')
def snapshot_at_commit(g: Repositories) -> DataFrame:
    asked = g.asked(SHAS).where("i < 8").withColumn("request", F.col("prefix"))
    return history.snapshot(g.nodes, g.commit_files, history.moments_of(g.commits, asked))


__all__ = ["ORACLES", "QUERIES", "Repositories", "graph", "query"]
