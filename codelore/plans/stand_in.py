"""Two repositories made of the driver's tables: nodes, edges, commits, files of commits, refs.

Parts are files, customers are symbols, shared suppliers make imports, orders are commits and
their lines the files that they touch.  The SQL runs in Spark and in DuckDB; it only makes inputs,
the operators that read them have their own code on either side.
"""

from __future__ import annotations

import re
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession

from codelore.plans.shared import TABLES, table
from codelore.session import checkpoint_dir

#: Files: a few entry points, tests and documents, the rest under their brand and type.
FILES = """select p_partkey as k, case when p_partkey % 5 = 0 then 'beta' else 'alpha' end as repository,
    case when p_partkey in (0, 1) then 'app/main.py' when p_partkey in (5, 6) then 'app/core/routes.py'
      when p_partkey % 10 = 9 then concat('tests/test_p', cast(p_partkey as string), '.py') when p_partkey % 10 = 8 then concat('docs/p', cast(p_partkey as string), '.md')
      else concat(lower(replace(p_brand, '#', '')), '/', lower(p_type), '/p', cast(p_partkey as string), case p_partkey % 3 when 0 then '.py' when 1 then '.ts' else '.go' end) end as path,
    case when p_partkey in (0, 1) then 'app' when p_partkey in (5, 6) then 'app/core' when p_partkey % 10 = 9 then 'tests' when p_partkey % 10 = 8 then 'docs' else lower(replace(p_brand, '#', '')) end as module,
    case when p_partkey in (0, 1) then 'app' when p_partkey in (5, 6) then 'app/core' when p_partkey % 10 = 9 then 'tests' when p_partkey % 10 = 8 then 'docs' else concat(lower(replace(p_brand, '#', '')), '/', lower(p_type)) end as directory,
    case when p_partkey in (0, 1, 5, 6) or p_partkey % 10 = 9 then 'python' when p_partkey % 10 = 8 then 'markdown' when p_partkey % 3 = 0 then 'python' when p_partkey % 3 = 1 then 'typescript' else 'go' end as language,
    cast(p_size * 15 + p_partkey % 7 as bigint) as line_count, cast(p_partkey % 3 as bigint) as class_count, cast(p_partkey % 45 as bigint) as function_count
  from {part}"""
#: Symbols: of every three customers of a file one is a class, one its method, one a function.
SYMBOLS = """select c.c_custkey as k, f.repository, f.path, f.module,
    case c.c_custkey % 3 when 0 then 'class' when 1 then 'method' else 'function' end as kind,
    case c.c_custkey % 3 when 0 then concat('Class', cast(c.g as string)) when 1 then concat('Class', cast(c.g as string), '.method', cast(c.c_custkey as string)) else concat('func', cast(c.c_custkey as string)) end as name,
    case when c.c_custkey % 3 = 1 then concat('Class', cast(c.g as string)) end as owner,
    cast(c.c_custkey % 100 + 1 as bigint) as start_line, cast(c.c_nationkey + 1 as bigint) as line_count
  from (select *, cast((c_custkey - c_custkey % 3) / 3 as bigint) as g from {customer} cross join (select count(*) as parts from {part}) t) c
  join files f on f.k = c.g % c.parts"""
NODES = """select cast(concat(repository, '::repository::', repository) as string) as id, repository, 'repository' as kind, repository as name, repository as key, cast(null as string) as parent_id, 0 as level,
    cast(null as string) as language, cast(null as bigint) as line_count, cast(null as string) as module, cast(null as string) as directory, cast(null as string) as relative_path,
    cast(null as bigint) as start_line, cast(null as string) as complexity, cast(null as bigint) as class_count, cast(null as bigint) as function_count, cast(null as bigint) as uses
  from (select distinct repository from files) r
  union all select concat(repository, '::module::', module), repository, 'module', module, module, concat(repository, '::repository::', repository), 1, null, null, null, null, null, null, null, null, null, null from (select distinct repository, module from files) m
  union all select concat(repository, '::directory::', directory), repository, 'directory', regexp_replace(directory, '^.*/', ''), directory, concat(repository, '::module::', module), 2, null, null, null, null, null, null, null, null, null, null
    from (select distinct repository, module, directory from files where directory <> module) d
  union all select concat(repository, '::file::', path), repository, 'file', regexp_replace(path, '^.*/', ''), path, case when directory = module then concat(repository, '::module::', module) else concat(repository, '::directory::', directory) end, 3,
    language, line_count, module, directory, null, null, case when line_count > 600 or class_count + function_count > 40 then 'high' when line_count > 200 or class_count + function_count > 12 then 'medium' else 'low' end, class_count, function_count, null from files
  union all select concat(repository, '::', kind, '::', path, '::', name), repository, kind, name, concat(path, '::', name), case when owner is null then concat(repository, '::file::', path) else concat(repository, '::class::', path, '::', owner) end,
    case kind when 'method' then 5 else 4 end, null, line_count, module, null, path, start_line, null, null, null, null from symbols
  union all select concat('alpha::external::external/', package), 'alpha', 'external', package, concat('external/', package), 'alpha::repository::alpha', 1, null, null, null, null, null, null, null, null, null, uses
    from (select lower(n.n_name) as package, count(*) as uses from {supplier} s join {nation} n on s.s_nationkey = n.n_nationkey group by lower(n.n_name) having count(*) >= 2) x"""
IMPORTS = """select a.repository, concat(a.repository, '::file::', a.path) as source, concat(a.repository, '::file::', b.path) as target, a.module as source_module, b.module as target_module, min(l.l_linenumber) as line, count(*) as n
  from (select l_partkey, l_linenumber, (l_suppkey * 3) % parts as other from {lineitem} cross join (select count(*) as parts from {part}) t) l join files a on a.k = l.l_partkey join files b on b.k = l.other
  where a.repository = b.repository and a.k <> b.k group by a.repository, a.path, b.path, a.module, b.module"""
CALLS = """select a.repository, concat(a.repository, '::', a.kind, '::', a.path, '::', a.name) as source, concat(b.repository, '::', b.kind, '::', b.path, '::', b.name) as target, cast(min(o.o_orderkey % 900) as int) as line, count(*) as n
  from (select o_custkey, o_orderkey, o_orderkey % customers as other from {orders} cross join (select count(*) as customers from {customer}) t) o join symbols a on a.k = o.o_custkey join symbols b on b.k = o.other
  where a.repository = b.repository and a.k <> b.k group by a.repository, a.kind, a.path, a.name, b.repository, b.kind, b.path, b.name"""
EDGES = """select concat(source, '|', kind, '|', target) as id, repository, kind, source, target, line, n from (
    select repository, 'IMPORTS' as kind, source, target, line, n from imports
    union all select repository, 'CALLS', source, target, line, n from calls
    union all select distinct repository, 'DEPENDS_ON', concat(repository, '::module::', source_module), concat(repository, '::module::', target_module), cast(null as int), cast(null as bigint) from imports where source_module <> target_module
    union all select a.repository, 'INHERITS', concat(a.repository, '::class::', a.path, '::', a.name), concat(b.repository, '::class::', b.path, '::', b.name), cast(a.start_line as int), cast(null as bigint)
      from symbols a join symbols b on b.k = a.k + 3 where a.kind = 'class' and a.k % 12 = 0 and a.repository = b.repository
    union all select repository, 'CONTAINS', parent_id, id, cast(start_line as int), cast(null as bigint) from nodes where parent_id is not null) e"""
COMMITS = """select md5(cast(o_orderkey as string)) as sha, case when o_orderkey % 4 = 0 then 'beta' else 'alpha' end as repository, concat('Author ', cast(o_custkey as string)) as author,
    <seconds(o_orderdate)> + o_orderkey % 5000 as authored_at, o_orderpriority as summary, o_orderstatus = 'P' as is_merge, o_orderkey as k from {orders}"""
COMMIT_FILES = """select c.repository, c.sha, f.path as relative_path, case when f.k % 50 = 7 then null else f.module end as module, case l.l_returnflag when 'R' then 'M' when 'A' then 'A' else 'D' end as change_type, c.authored_at
  from {lineitem} l join commits c on c.k = l.l_orderkey join files f on f.k = l.l_partkey where f.repository = c.repository and not c.is_merge"""
REFS = """select repository, concat('v', cast(k as string)) as name, 'tag' as kind, sha, case when k % 7 = 0 then null else authored_at end as created_at from commits where summary like '1-%' and k % 3 = 0
  union all select repository, concat('release-', cast(k as string)), 'tag', sha, authored_at + 60 from commits where summary like '1-%' and k % 30 = 0
  union all select repository, concat('branch', cast(k % 9 as string)), 'branch', max(sha), max(authored_at) from commits where k % 1000 < 9 group by repository, concat('branch', cast(k % 9 as string))"""

PARTS = {"files": FILES, "symbols": SYMBOLS, "nodes": NODES, "imports": IMPORTS, "calls": CALLS, "edges": EDGES, "commits": COMMITS, "commit_files": COMMIT_FILES, "refs": REFS}
NEEDS = {
    "files": (), "symbols": ("files",), "nodes": ("files", "symbols"), "imports": ("files",), "calls": ("files", "symbols"), "edges": ("files", "symbols", "nodes", "imports", "calls"),
    "commits": (), "commit_files": ("files", "commits"), "refs": ("commits",),
}
#: Tables that others are made of, which are written before them.
WRITTEN_FIRST = ("files", "symbols", "nodes", "imports", "calls")
_STORED: set[tuple[str, str]] = set()
SECONDS = {"spark": r"unix_seconds(cast(\1 as timestamp))", "duck": r"cast(epoch(\1) as bigint)"}


def _ctes(names: tuple[str, ...], dialect: str) -> str:
    return ", ".join(f"{n} as ({re.sub(r'<seconds[(](.*?)[)]>', SECONDS[dialect], PARTS[n])})" for n in names)


def stored(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables, written once per application to the shared folder and read from there.

    The tables that it is made of are written first, so each is made once.  They grow with the input
    and hold long texts, of which the size of their files tells little: joins with them are merges,
    as a broadcast would take them whole through the driver.
    """
    folder = f"{checkpoint_dir(spark)}/stand-in-{spark.sparkContext.applicationId}-{md5(sf_dir.encode()).hexdigest()[:12]}"
    if (folder, name) not in _STORED:
        planned(spark, sf_dir, name).write.mode("overwrite").parquet(f"{folder}/{name}")
        _STORED.add((folder, name))
    return spark.read.parquet(f"{folder}/{name}")


def planned(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables as it is written: over the stored tables that it is made of."""
    return frame(spark, sf_dir, name, {n: stored(spark, sf_dir, n).hint("merge") for n in NEEDS[name] if n in WRITTEN_FIRST})


def frame(spark: SparkSession, sf_dir: str, name: str, made_of: dict[str, DataFrame] | None = None) -> DataFrame:
    """One of the tables as a plan over the driver's tables, and over those of ``made_of``."""
    made_of = made_of or {}
    text = f"with {_ctes(tuple(n for n in (*NEEDS[name], name) if n not in made_of), 'spark')} select * from {name}"
    if made_of:
        text = re.sub(rf"\b(from|join) ({'|'.join(made_of)})\b", r"\1 {\2}", text)
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used, **{n: df for n, df in made_of.items() if f"{{{n}}}" in text})


def duck(*names: str) -> str:
    """The tables as common table expressions, for SQL that begins with ``with``."""
    wanted = [n for n in PARTS if any(n == x or n in NEEDS[x] for x in names)]
    return _ctes(tuple(wanted), "duck")
