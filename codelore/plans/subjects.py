"""Queries over the stand-in repositories: hotspots, flows, seeds and bounded neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codelore.functions import fixed
from codelore.operators import around, insights
from codelore.plans import graphs, textual
from codelore.plans.graphs import Repositories
from codelore.plans.shared import Registry

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def query(name: str, tables: str, duck: str, **ctes: str):
    def add(function):
        graphs.query(name, tables, duck, **ctes)(function)
        QUERIES[name], ORACLES[name] = graphs.QUERIES.pop(name), graphs.ORACLES.pop(name)
        return function

    return add


# hotspots
_IMPORTED = "select repository, target as id, count(*) as n from edges where kind in ('IMPORTS', 'DEPENDS_ON') group by all"
_STRUCTURAL = """select n.repository, 'structural' as category, cast(r.pos as integer) as pos, n.id as node_id, n.key as path, r.n as value,
    r.n || case n.kind when 'module' then ' modules' else ' files' end || ' in this repository import ' || n.name || ', so a change to it can affect all of them.' as reason,
    (select string_agg(s.name, ',' order by e.id) from (select *, row_number() over (partition by target order by id) as k from edges where kind in ('IMPORTS', 'DEPENDS_ON')) e join nodes s on s.id = e.source where e.k <= 5 and e.target = n.id) as evidence
  from (select *, row_number() over (partition by repository order by n desc, id) as pos from imported where n >= 3) r join nodes n on n.id = r.id where r.pos <= 8 and n.kind in ('file', 'module')"""
_CHURN = """select * from (select n.repository, 'churn' as category, cast(row_number() over (partition by n.repository order by c.n desc, n.key) as integer) as pos, n.id as node_id, n.key as path, c.n as value,
    n.key || ' was changed in ' || c.n || ' commits within the indexed history window — the most frequently modified indexed file.' as reason, '' as evidence
  from nodes n join (select repository, relative_path, count(distinct sha) as n from commit_files group by all having count(distinct sha) >= 3) c on c.repository = n.repository and c.relative_path = n.key where n.kind = 'file') where pos <= 8"""
_COMPLEX = """select * from (select repository, 'complexity' as category, cast(row_number() over (partition by repository order by case complexity when 'high' then 0 else 1 end, line_count desc, key) as integer) as pos, id as node_id, key as path, line_count as value,
    key || ' is ' || line_count || ' lines with ' || class_count || ' classes and ' || function_count || ' functions (complexity band: ' || complexity || ').' as reason, '' as evidence from nodes where kind = 'file') where pos <= 8 and value > 0"""


def _shown(hotspots: DataFrame) -> DataFrame:
    return hotspots.withColumn("evidence", F.array_join("evidence", ",")).drop("name", "kind")


@query("hotspot_structural", "nodes edges", _STRUCTURAL, imported=_IMPORTED)
def hotspot_structural(g: Repositories) -> DataFrame:
    return _shown(insights.structural(g.nodes, g.edges))


@query("hotspot_churn", "nodes commit_files", _CHURN)
def hotspot_churn(g: Repositories) -> DataFrame:
    return _shown(insights.churn(g.nodes, g.commit_files))


@query("hotspot_complexity", "nodes", _COMPLEX)
def hotspot_complexity(g: Repositories) -> DataFrame:
    return _shown(insights.complexity(g.nodes))


@query("hotspots_all", "nodes edges commit_files", f"{_STRUCTURAL} union all {_CHURN} union all {_COMPLEX}", imported=_IMPORTED)
def hotspots_all(g: Repositories) -> DataFrame:
    return _shown(insights.hotspots(g.nodes, g.edges, g.commit_files))


# flows
_GRADE = " ".join(f"when regexp_matches(key, '{pattern}') then {i}" for i, (pattern, _) in enumerate(fixed.ENTRIES))
_ENTRY = f"""select repository, id, key from (select *, row_number() over (partition by repository order by case {_GRADE} end, length(key) - length(replace(key, '/', '')), length(key), key, id) as r
  from nodes where kind = 'file' and (case {_GRADE} end) is not null) where r = 1"""


@query("entry_guess", "nodes edges", _ENTRY)
def entry_guess(g: Repositories) -> DataFrame:
    return insights.guess_entry(g.nodes, g.edges)


_HUB = "select repository, id, key from (select n.*, row_number() over (partition by n.repository order by c.n desc, n.id) as r from nodes n join (select target, count(*) as n from edges where kind = 'IMPORTS' group by target) c on c.target = n.id where not regexp_matches(n.key, '^app/')) where r = 1"


@query("entry_hub", "nodes edges", _HUB)
def entry_hub(g: Repositories) -> DataFrame:
    """Without files that look like entries, the most imported one."""
    other = "not key rlike '^app/'"
    nodes = g.nodes.where(other)
    return insights.guess_entry(nodes, g.edges.join(nodes.select(F.col("id").alias("target")), "target", "left_semi"))


def _layers() -> dict[str, str]:
    out = {"entry": _ENTRY, "l0": "select repository as request, 0 as depth, 1 as pos, id from entry"}
    for k in (1, 2, 3):
        seen = " union all ".join(f"select request, id from l{i}" for i in range(k))
        out[f"l{k}"] = f"""select request, {k} as depth, pos, id from (select request, id, row_number() over (partition by request order by min(pos), id) as pos from (
          select l.request, l.pos, e.target as id from l{k - 1} l join edges e on e.source = l.id and e.kind = 'IMPORTS' join nodes n on n.id = e.target) x
          where not exists (select 1 from ({seen}) s where s.request = x.request and s.id = x.id) group by request, id) where pos <= 6"""
    return out | {"layers": " union all ".join(f"select * from l{k}" for k in range(4))}


@query("flow_layers", "nodes edges", "select request, depth, cast(pos as integer) as pos, id from layers", **_layers())
def flow_layers(g: Repositories) -> DataFrame:
    nodes, edges = g.nodes, g.edges
    starts = insights.guess_entry(nodes, edges).select(F.col("repository").alias("request"), "id")
    return insights.flow(nodes, edges, starts)


_LABEL = textual._duck_case([(p, f"'{v}'") for p, v in fixed.ENTRIES], "min(n.key)", f"'{fixed.NO_ENTRY}'")


@query(
    "flow_steps",
    "nodes edges",
    f"""select l.request, l.depth, string_agg(n.name, ',' order by l.pos) as names,
      case when l.depth = 0 then {_LABEL} when count(distinct n.module) = 1 then min(n.module) when count(distinct n.directory) = 1 and min(n.directory) <> '' then min(n.directory) else 'imports' end as label from layers l join nodes n on n.id = l.id group by l.request, l.depth""",
    **_layers(),
)
def flow_steps(g: Repositories) -> DataFrame:
    steps = insights.flow_steps(g.nodes, flow_layers(g))
    return steps.select("request", "depth", F.array_join("names", ",").alias("names"), "label")


# subjects
TERMS = "select repository, term from (values ('alpha', 'main.py'), ('beta', 'Class10'), ('alpha', 'routes'), ('beta', 'p1'), ('alpha', 'thod'), ('beta', 'p2.x'), ('alpha', 'nobody'), ('beta', 'app'), ('alpha', 'test_'), ('beta', 'ROUTES.py')) v(repository, term)"
_PLACE = "coalesce(nullif({0}relative_path, ''), {0}key)"
_PRIOR = f"least({', '.join(textual._duck_case([(p, f'{v}::double')], 'lower(<place>)', '1.0::double') for p, v in fixed.PRIORS)})"


def _prior(prefix: str = "") -> str:
    return _PRIOR.replace("<place>", _PLACE.format(prefix))


def _resolution(terms: str) -> dict[str, str]:
    suffixes = ", ".join(f"'{s}'" for s in fixed.STEM_SUFFIXES)
    stem = lambda c: f"case when contains({c}, '.') then regexp_replace({c}, '[.][^.]*$', '') else {c} end"
    return {
        "asked": terms,
        "same": "select * from (select t.term, n.*, row_number() over (partition by n.repository, t.term order by length(n.key), n.key, n.id) as r from asked t join nodes n on n.repository = t.repository and lower(n.name) = lower(t.term)) where r <= 10",
        "stems": f"""select * from (select t.term, n.*, row_number() over (partition by n.repository, t.term, s order by length(n.key), n.key, n.id) as r from asked t, (select unnest([{suffixes}]) as s), nodes n
          where n.repository = t.repository and lower(n.name) = lower(t.term || s) and not contains(t.term, '.') and not exists (select 1 from same x where x.term = t.term and x.repository = t.repository)) where r <= 10""",
        "named": "select * from same union all select * from stems",
        "parts": """select * from (select t.term, n.*, row_number() over (partition by n.repository, t.term order by length(n.name), n.key, n.id) as r from asked t join nodes n on n.repository = t.repository and (n.name ilike '%' || t.term || '%' or n.key ilike '%' || t.term || '%')
          where not exists (select 1 from named x where x.term = t.term and x.repository = t.repository)) where r <= 40""",
        "resolved": f"""select repository, term, id from (select repository, term, id, row_number() over (partition by repository, term order by case when lower(name) = lower(term) then 0 when {stem('lower(name)')} = {stem('lower(term)')} then 1 when starts_with(lower(name), lower(term)) then 2 else 3 end,
          -({_prior()}), case when kind = 'file' then 0 when kind in ('class', 'function', 'method') then 1 else 2 end, length(name), key, id) as k from (select * from named union all select * from parts)) where k = 1""",
    }


@query("resolve_rank", "nodes", "select repository, term, id from resolved", **_resolution(TERMS))
def resolve_rank(g: Repositories) -> DataFrame:
    return around.resolve(g.nodes, g.asked(TERMS))


#: (question, repository, mentions, focus, explorer, paths)
QUESTIONS = [
    (1, "alpha", ["main.py", "Class3", "nobody"], None, [], ["docs/p8.md"]),
    (2, "beta", [], "beta::method::app/main.py::Class0.method1", ["beta::module::app", "none"], []),
    (3, "alpha", [], None, [], ["docs/p8.md", "missing.py", "app/main.py", "tests/test_p9.py"]),
    (4, "beta", ["routes"], "beta::file::app/core/routes.py", [], []),
    (5, "alpha", [], "alpha::module::brand2", [], []),
    (6, "beta", ["nothing here"], None, [], []),
    (7, "alpha", ["main.py", "routes.py", "tests", "docs", "app", "brand1", "brand2"], None, [], []),
]


def questions(g: Repositories) -> DataFrame:
    return g.spark.createDataFrame(QUESTIONS, "question long, repository string, mentions array<string>, focus string, explorer array<string>, paths array<string>")


def _listed(rows: list[tuple], names: str, kinds: tuple[str, ...]) -> str:
    text = lambda x: "null" if x is None else str(x) if isinstance(x, int) else "'" + x + "'"
    casts = ", ".join(f"{n.strip()}::{k} as {n.strip()}" for n, k in zip(names.split(","), kinds, strict=True))
    return f"select {casts} from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


_MENTIONED = [(q, r, i, m) for q, r, ms, *_ in QUESTIONS for i, m in enumerate(ms)]
_PICKED = [(q, r, i, x) for q, r, _, focus, explorer, _ in QUESTIONS for i, x in enumerate([f for f in [focus] if f] + explorer)]
_RETRIEVED = [(q, r, i, p) for q, r, *_, ps in QUESTIONS for i, p in enumerate(ps[:6])]
_KINDS = ("bigint", "varchar", "bigint", "varchar")
_SEEDS = {
    **_resolution("select distinct repository, term from mentioned"),
    "sure": "select m.question, m.repository, 0 as o, m.i, r.id, 'mention' as reason from mentioned m join resolved r on r.repository = m.repository and r.term = m.term union all select p.question, p.repository, 1, p.i, n.id, 'explorer' from picked p join nodes n on n.id = p.id",
    "every": "select * from sure union all select t.question, t.repository, 2, t.i, n.id, 'retrieval' from retrieved t join nodes n on n.kind = 'file' and n.repository = t.repository and n.key = t.path where t.question not in (select question from sure)",
    "seeds": "select question, repository, id, reason, row_number() over (partition by question order by o, i, id) as pos from (select *, row_number() over (partition by question, id order by o, i) as k from every) where k = 1 qualify pos <= 6",
}
_SEEDS = {"mentioned": _listed(_MENTIONED, "question, repository, i, term", _KINDS), "picked": _listed(_PICKED, "question, repository, i, id", _KINDS), "retrieved": _listed(_RETRIEVED, "question, repository, i, path", _KINDS), **_SEEDS}


@query("seed_priority", "nodes", "select question, cast(pos as integer) as pos, id, reason from seeds", **_SEEDS)
def seed_priority(g: Repositories) -> DataFrame:
    return around.seeds(g.nodes, questions(g)).drop("repository")


def _walk(hops: int = 2) -> dict[str, str]:
    out = dict(_SEEDS)
    out["two_up"] = """select s.question, s.pos as seed, u.* from seeds s join nodes m on m.id = s.id and m.kind not in ('repository', 'module', 'directory'), lateral (
      select 1 as up, a.id, a.kind, m.name as via from nodes a where a.id = m.parent_id union all select 2, b.id, b.kind, m.name from nodes a join nodes b on b.id = a.parent_id where a.id = m.parent_id
      union all select 3, c.id, c.kind, m.name from nodes a join nodes b on b.id = a.parent_id join nodes c on c.id = b.parent_id where a.id = m.parent_id
      union all select 4, d.id, d.kind, m.name from nodes a join nodes b on b.id = a.parent_id join nodes c on c.id = b.parent_id join nodes d on d.id = c.parent_id where a.id = m.parent_id) u where u.kind <> 'repository'"""
    out["lifted"] = """select question, id, kind, via, row_number() over (partition by question order by seed, up, id) as o from (select *, row_number() over (partition by question, id order by seed, up) as k from two_up) x
      where k = 1 and not exists (select 1 from seeds s where s.question = x.question and s.id = x.id) qualify o <= 24"""
    out["h0"] = """select question, id, distance, reason, via, g, row_number() over (partition by question order by g, i) as pos from (
      select question, id, 1 as distance, 'contains' as reason, via, 0 as g, o as i from lifted where kind <> 'file' union all select question, id, 0, reason, '', 1, pos from seeds union all select question, id, 1, 'defines', via, 2, o from lifted where kind = 'file')"""
    out["ways"] = "select source as here, target as there, 0 as way from edges where kind in ('IMPORTS', 'DEPENDS_ON') union all select target, source, 1 from edges where kind in ('IMPORTS', 'DEPENDS_ON')"
    for k in range(1, hops + 1):
        start = "h0 f where f.g > 0" if k == 1 else f"h{k - 1} f where f.g = {k + 1}"
        out[f"met{k}"] = f"""select * from (select f.question, f.pos as by_, w.here, w.way, w.there, row_number() over (partition by f.question, w.here, w.way order by -({_prior('n.')}), -coalesce(n.line_count, 0), w.there) as n
          from (select * from {start}) f join ways w on w.here = f.id join nodes n on n.id = w.there) x where n <= 6 and not exists (select 1 from h{k - 1} z where z.question = x.question and z.id = x.there)"""
        out[f"new{k}"] = f"""select a.*, s.size, row_number() over (partition by a.question order by a.by_, a.way, a.n, a.there) as r from (select *, count(*) over (partition by question, there) as times, row_number() over (partition by question, there order by by_, way, n) as k from met{k}) a
          join (select question, max(pos) as size from h{k - 1} group by question) s on s.question = a.question where a.k = 1"""
        out[f"h{k}"] = f"""select * from h{k - 1} union all select x.question, x.there, {k}, case x.way when 0 then 'imports' else 'imported-by' end, m.name, {k + 2}, x.size + x.r from new{k} x join nodes m on m.id = x.here where x.size + x.r <= 24"""
    out["left_out"] = "select question, sum(times)::bigint as withheld from (" + " union all ".join(f"select question, times from new{k} where size + r > 24" for k in range(1, hops + 1)) + ") group by question"
    out["among"] = f"""select * from (select a.question, e.*, row_number() over (partition by a.question order by a.pos, e.id) as k from h{hops} a join edges e on e.source = a.id and e.kind in ('IMPORTS', 'DEPENDS_ON') join h{hops} b on b.question = a.question and b.id = e.target) where k <= 40"""
    return out


@query("neighborhood_hops", "nodes edges", "select question, cast(pos as integer) as pos, id, distance, reason, via from h2", **_walk())
def neighborhood_hops(g: Repositories) -> DataFrame:
    nodes = g.nodes
    return around.walk(nodes, g.edges, around.seeds(nodes, questions(g)))[0]


@query("neighborhood_withheld", "nodes edges", "select question, withheld from left_out", **_walk())
def neighborhood_withheld(g: Repositories) -> DataFrame:
    nodes = g.nodes
    return around.walk(nodes, g.edges, around.seeds(nodes, questions(g)))[1]


@query("neighborhood_edges", "nodes edges", "select question, cast(k as integer) as n, id from among", **_walk())
def neighborhood_edges(g: Repositories) -> DataFrame:
    nodes, edges = g.nodes, g.edges
    hits, _ = around.walk(nodes, edges, around.seeds(nodes, questions(g)))
    return around.edges_among(edges, hits).select("question", "n", "id")


@query(
    "neighborhood_paths",
    "nodes edges",
    "select h.question, case when n.kind = 'file' then n.key else n.relative_path end as path, bool_or(h.reason in ('mention', 'explorer', 'retrieval')) as seed from h2 h join nodes n on n.id = h.id where n.kind = 'file' or n.relative_path <> '' group by all",
    **_walk(),
)
def neighborhood_paths(g: Repositories) -> DataFrame:
    nodes = g.nodes
    return around.paths_of(nodes, around.walk(nodes, g.edges, around.seeds(nodes, questions(g)))[0])
