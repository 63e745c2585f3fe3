"""Queries over stored chunks, file classification, and the upkeep of an index.

Documents are the chunks; where files matter, each document is a file with a path of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.functions import fixed, paths, text as T
from codelore.operators import builder, history, reads
from codelore.plans import graphs
from codelore.plans.graphs import Repositories
from codelore.plans.shared import Registry, table
from codelore.sources import files, gitlog, store
from codelore.streaming import events

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles


def query(name: str, tables: str, duck: str, **ctes: str):
    def add(function):
        graphs.query(name, tables, duck, **ctes)(function)
        QUERIES[name], ORACLES[name] = graphs.QUERIES.pop(name), graphs.ORACLES.pop(name)
        return function

    return add


_PATH = "source || '/' || doc_id::varchar || '.' || lang"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return docs.select("doc_id", F.col("source").alias("repository"), path.alias("relative_path"), F.col("lang").alias("language"), F.lit(0).alias("chunk_index"), F.sha2("text", 256).alias("file_hash"), "n_chars")


# filters
@R.frame("filter_eq_in", f"select doc_id from {{documents}} where lang = 'en' and {_PATH} in ('src1/1.en', 'src2/2.en', 'src3/3.en', 'src4/4.fr') or false")
def filter_eq_in(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where(store.where(language="en", symbol=None, relative_path=["src1/1.en", "src2/2.en", "src3/3.en", "src4/4.fr"])).select("doc_id")


@R.frame("filter_twin", "select doc_id, doc_id % 3 = 0 or lang not in ('fr', 'de') as other from {documents}")
def filter_twin(spark: SparkSession, d: str) -> DataFrame:
    """The same condition over rows at hand, of which every third has no language."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("language"))
    return rows.select("doc_id", (~store.fits(language=("fr", "de"))).alias("other"))


@R.frame("filter_extra", "select doc_id from {documents} where lang = 'de' and n_chars > 2000")
def filter_extra(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where(store.where("n_chars > 2000", language="de")).select("doc_id")


@R.frame("all_chunks", f"select source as repository, {_PATH} as relative_path, lang as language, n_chars from {{documents}}")
def all_chunks(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).select("repository", "relative_path", "language", "n_chars")


@R.frame("collection_counts", "select source as repository, count(*) as chunks from {documents} group by source")
def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    return store.collections(_chunks(spark, d))


# files
#: A path for each document, by its number, that meets one rule of the classifier; its size and bytes.
_NAMES = ["src/a{}.py", "README.md", "pkg/package-lock.json", "x/app{}.min.js", "img/a{}.png", "data/x{}.xyz", "big{}.ts", "blank{}.go", "nul{}.rs", "LICENSE", "gone{}.c", "lib/b{}.go", "noext", "Dir/UPPER{}.PY"]
_REASONS = [None, "ignored_stem", "ignored_filename", "generated_file", "ignored_extension", "unsupported_extension", "too_large", "empty", "binary_content", "ignored_stem", "read_error", None, "unsupported_extension", None]


def _files(spark: SparkSession, d: str) -> DataFrame:
    kind = (F.col("doc_id") % len(_NAMES)).cast("int")
    names = F.get(F.array(*[F.lit(n) for n in _NAMES]), kind)
    body = F.when(kind == 7, F.lit(" \n\t ").cast("binary")).when(kind == 8, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("00")))).when(kind == 10, F.lit(None).cast("binary")).otherwise(F.col("text").cast("binary"))
    rows = table(spark, d, "documents").select("doc_id", F.replace(names, F.lit("{}"), F.col("doc_id").cast("string")).alias("path"), F.when(kind == 6, 1_000_001).otherwise(F.col("n_chars")).alias("size"), body.alias("content"))
    return rows.withColumn("skip_reason", files.skip_reason(F.col("path"), F.col("size"), F.col("content")))


_LISTED = ", ".join("null" if r is None else f"'{r}'" for r in _REASONS)
_REASON = f"([{_LISTED}])[(doc_id % {len(_NAMES)} + 1)::int]"


@R.frame("file_skip_reason", f"select doc_id, {_REASON} as skip_reason from {{documents}}")
def file_skip_reason(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("doc_id", "skip_reason")


@R.frame("skip_histogram", f"select coalesce({_REASON}, 'kept') as reason, count(*) as files from {{documents}} group by 1")
def skip_histogram(spark: SparkSession, d: str) -> DataFrame:
    return files.statistics(_files(spark, d)).select("reason", "files")


_EXTENSION = "lower(regexp_extract(replace(([" + ", ".join(f"'{n}'" for n in _NAMES) + f"])[(doc_id % {len(_NAMES)} + 1)::int], '{{}}', ''), '^.+[.]([^.]+)$', 1))"


@R.frame("extension_histogram", f"select {_EXTENSION} as extension, count(*) as files, count(*) filter ({_REASON} is null) as kept from {{documents}} group by 1")
def extension_histogram(spark: SparkSession, d: str) -> DataFrame:
    return files.extensions(_files(spark, d))


_LANGUAGES = " ".join(f"when '{e[1:]}' then '{name}'" for e, name in fixed.LANGUAGES.items())


@R.frame("language_histogram", f"select case {_EXTENSION} {_LANGUAGES} else 'unknown' end as language, count(*) as files from {{documents}} where {_REASON} is null group by 1")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return files.languages(_files(spark, d))


@R.frame("scan_filter", f"select doc_id, sha256(replace(text, chr(13), chr(10)))[1:32] as file_hash, lang from {{documents}} where {_REASON} is null")
def scan_filter(spark: SparkSession, d: str) -> DataFrame:
    """The files that are kept, decoded and hashed."""
    kept = _files(spark, d).withColumn("repository", F.lit("r")).join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    records = files.parsed(kept.withColumn("path", F.concat("path", F.lit("#"), F.col("doc_id").cast("string"), F.lit("#"), "lang", F.lit(".py"))))
    name = F.split("relative_path", "#")
    return records.select(F.get(name, F.lit(1)).cast("long").alias("doc_id"), "file_hash", F.regexp_replace(F.get(name, F.lit(2)), "[.]py$", "").alias("lang"))


@R.frame("complexity_band", "select case when n > 600 or n > 40 then 'high' when n > 200 or n > 12 then 'medium' else 'low' end as band, count(*) as files from (select length(text) - length(replace(text, chr(10), '')) + 1 as n from {documents}) group by 1")
def complexity_band(spark: SparkSession, d: str) -> DataFrame:
    """Every line of a document stands for a symbol."""
    lines = table(spark, d, "documents").select(T.line_count(F.col("text")).alias("n"))
    return lines.groupBy(paths.complexity_band(F.col("n"), F.col("n")).alias("band")).agg(F.count("*").alias("files"))


@R.frame("line_count", "select doc_id, (length(text) - length(replace(text, chr(10), '')) + 1)::bigint as line_count from {documents}")
def line_count(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.line_count(F.col("text")).alias("line_count"))


# upkeep of an index
_STORED = f"select {_PATH} as path, sha256(text) as h from {{documents}} where lang <> 'fr'"
_CURRENT = f"select {_PATH} as path, sha256(case when lang = 'de' then text || '.' else text end) as h from {{documents}} where lang <> 'es'"


def _versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Stored chunks, and a current manifest: a language is missing on either side, one is edited."""
    edited = F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))
    docs = table(spark, d, "documents").where("lang <> 'es'")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return _chunks(spark, d).where("language <> 'fr'"), docs.select(path.alias("path"), F.sha2(edited, 256).alias("file_hash"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    stored, current = _versions(spark, d)
    return store.difference(store.manifest(stored), current)


@R.frame("file_manifest", f"select path, h as file_hash from ({_STORED})")
def file_manifest(spark: SparkSession, d: str) -> DataFrame:
    return store.manifest(_versions(spark, d)[0])


@R.frame("incremental_diff", f"select coalesce(s.path, c.path) as path, case when s.path is null then 'added' when c.path is null then 'removed' when s.h <> c.h then 'changed' else 'unchanged' end as status from ({_STORED}) s full outer join ({_CURRENT}) c on s.path = c.path")
def incremental_diff(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d)


@R.frame("set_diff", f"select path from ({_CURRENT}) except select path from ({_STORED})")
def set_diff(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).where("status = 'added'").select("path")


@R.frame("set_intersect", f"select path from ({_CURRENT}) intersect select path from ({_STORED})")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    return _changes(spark, d).where("status in ('changed', 'unchanged')").select("path")


_GONE = f"select s.path from ({_STORED}) s left join ({_CURRENT}) c on c.path = s.path where c.path is null or c.h <> s.h"


@R.frame("delete_paths", f"select path from ({_STORED}) where path not in ({_GONE})")
def delete_paths(spark: SparkSession, d: str) -> DataFrame:
    stored, _ = _versions(spark, d)
    return store.delete_paths(stored, _changes(spark, d).where("status in ('removed', 'changed')")).select(F.col("relative_path").alias("path"))


@R.frame("removed_counts", f"select path, count(*) as chunks from ({_STORED}) where path in ({_GONE}) group by path")
def removed_counts(spark: SparkSession, d: str) -> DataFrame:
    stored, _ = _versions(spark, d)
    return store.removed(stored, _changes(spark, d).where("status in ('removed', 'changed')"))


@R.frame("incremental_index", f"select path, file_hash from (select path, h as file_hash from ({_STORED}) where path not in ({_GONE}) union all select path, h from ({_CURRENT}) where path in ({_GONE}) or path not in (select path from ({_STORED})))")
def incremental_index(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table after the current files were taken in."""
    stored, current = _versions(spark, d)
    held = stored.select("relative_path", "file_hash")
    batch = current.withColumnRenamed("path", "relative_path")
    return events.incremental_index(batch, held, lambda files_: files_.select("relative_path", "file_hash")).select(F.col("relative_path").alias("path"), "file_hash")


@R.frame("upsert_latest", "select doc_id, case when lang = 'de' then n_chars + 2 else n_chars end as n_chars from {documents}")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """Of two new rows of a key the last one is kept."""
    stored = table(spark, d, "documents").select("doc_id", "n_chars", F.lit(0).alias("at"))
    german = table(spark, d, "documents").where("lang = 'de'")
    new = german.select("doc_id", (F.col("n_chars") + 2).alias("n_chars"), F.lit(2).alias("at")).unionByName(german.select("doc_id", (F.col("n_chars") + 1).alias("n_chars"), F.lit(1).alias("at")))
    return store.upsert(stored, new, "doc_id", "at").select("doc_id", "n_chars")


@query("dedupe_refs", "refs", "select repository, kind, name, sha from (select *, row_number() over (partition by repository, kind, name order by created_at desc nulls last, sha desc) as r from refs2) where r = 1", refs2="select * from refs union all select repository, name, kind, md5(sha), created_at + 1 from refs where kind = 'tag'")
def dedupe_refs(g: Repositories) -> DataFrame:
    refs = g.refs
    twice = refs.unionByName(refs.where("kind = 'tag'").select("repository", "name", "kind", F.md5("sha").alias("sha"), (F.col("created_at") + 1).alias("created_at")))
    return store.sound_history(g.commits, g.commit_files, twice)["refs"].select("repository", "kind", "name", "sha")


@R.frame("bulk_commit_filter", "select l_orderkey::varchar as sha, count(*) as files from {lineitem} where l_orderkey % 5 <> 0 group by l_orderkey having count(*) <= 6")
def bulk_commit_filter(spark: SparkSession, d: str) -> DataFrame:
    """Orders as commits with their lines as name-status lines; every fifth is a merge, over six lines is bulk."""
    line = F.concat(F.lit("M\tdir/p"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    headers = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(line).alias("body")).select(F.col("k").cast("string").alias("sha"), F.col("k").alias("authored_at"), (F.col("k") % 5 == 0).alias("is_merge"), "body")
    return gitlog.commit_files(headers, 6).groupBy("sha").agg(F.count("*").alias("files"))


# joins and sets
@query("semi_join", "files commit_files", "select distinct f.repository, f.path from files f where exists (select 1 from commit_files c where c.repository = f.repository and c.relative_path = f.path)")
def semi_join(g: Repositories) -> DataFrame:
    indexed = g.files.select("repository", F.col("path").alias("relative_path")).distinct()
    return indexed.join(history.change_counts(g.commit_files), ["repository", "relative_path"], "left_semi").select("repository", F.col("relative_path").alias("path"))


@query("left_default", "files commit_files", "select f.repository, f.path, coalesce((select min(authored_at) from commit_files c where c.repository = f.repository and c.relative_path = f.path), 0) as first_at from (select distinct repository, path from files) f")
def left_default(g: Repositories) -> DataFrame:
    seen = history.first_seen(g.commit_files)
    indexed = g.files.select("repository", F.col("path").alias("relative_path")).distinct()
    return indexed.join(seen, ["repository", "relative_path"], "left").select("repository", F.col("relative_path").alias("path"), F.coalesce("first_at", F.lit(0)).cast("long").alias("first_at"))


@R.frame("join_indexed_flag", "select d.doc_id, l.doc_id is not null as indexed from {documents} d left join (select distinct doc_id from {labels}) l on d.doc_id = l.doc_id")
def join_indexed_flag(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("indexed", F.lit(True))
    return table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("indexed", F.lit(False)).alias("indexed"))


@query("union_distinct", "nodes", "select distinct repository as name from nodes union select source from {documents}")
def union_distinct(g: Repositories) -> DataFrame:
    """Repositories that have a graph or chunks."""
    chunks = store.collections(_chunks(g.spark, g.sf_dir)).select("repository")
    return reads.repositories(g.nodes).union(chunks).distinct().withColumnRenamed("repository", "name")


@R.frame("edge_dedupe", "select source::varchar || '|SUPPLIES|' || target::varchar as id, line from (select l_suppkey as source, l_partkey as target, min(l_orderkey * 10 + l_linenumber) as line from {lineitem} group by all)")
def edge_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Of equal edges the first one stays."""
    raw = table(spark, d, "lineitem").select(F.lit("r").alias("repository"), F.lit("SUPPLIES").alias("kind"), F.col("l_suppkey").cast("string").alias("source"), F.col("l_partkey").cast("string").alias("target"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"))
    return store.dedupe(builder.edges_of(raw), ["id"], "line").select("id", "line")


@R.frame(
    "fanout_cap",
    """with e as (select distinct l.l_suppkey, l.l_partkey, p.p_retailprice from {lineitem} l join {part} p on l.l_partkey = p.p_partkey)
    select l_suppkey, l_partkey, rank from (select *, cast(row_number() over (partition by l_suppkey order by p_retailprice desc, l_partkey) as integer) as rank from e) where rank <= 6""",
)
def fanout_cap(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return reads.numbered(pairs, "rank", ["l_suppkey"], F.desc("p_retailprice"), "l_partkey", most=6).select("l_suppkey", "l_partkey", "rank")


@R.frame("chunk_index", "select doc_id, source, (row_number() over (partition by source, doc_id % 50 order by n_chars, doc_id) - 1)::integer as chunk_index from {documents}")
def chunk_index(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "documents").select("doc_id", "source", (F.col("doc_id") % 50).alias("file"), F.col("n_chars").alias("start"))
    return reads.numbered(units, "n", ["source", "file"], "start", "doc_id").select("doc_id", "source", (F.col("n") - 1).alias("chunk_index"))


# scalars
@R.frame("json_extract", "select event_id, cast(json_extract_string(case when event_id % 9 = 0 then null else props end, '$.k') as bigint) as k from {events}")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    """A field of JSON; text that is none has no fields."""
    props = F.when(F.col("event_id") % 9 == 0, F.lit("{not json")).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", T.json_field(props, "k").cast("bigint").alias("k"))


@R.frame("json_write", "select user_id, '{' || string_agg('\"' || event_type || '\":' || n::varchar, ',' order by event_type) || '}' as counts from (select user_id, event_type, count(*) as n from {events} group by all) group by user_id")
def json_write(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return each.groupBy("user_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n"))))).alias("counts"))


@R.frame("coerce_scalar", "select d.doc_id, coalesce(cast(l.q as varchar), '') as quality, coalesce(cast(l.q > 0 as varchar), '') as good from {documents} d left join (select doc_id, max(quality) as q from {labels} group by doc_id) l on d.doc_id = l.doc_id")
def coerce_scalar(spark: SparkSession, d: str) -> DataFrame:
    best = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return table(spark, d, "documents").select("doc_id").join(best, "doc_id", "left").select("doc_id", T.coerced(F.col("q")).alias("quality"), T.coerced(F.col("q") > 0).alias("good"))


@R.frame("date_stamp", "select event_id, case when event_id % 7 = 0 then 'unknown' else strftime(ts, '%Y-%m-%d') end as day, strftime(ts, '%Y-%m') as month from {events}")
def date_stamp(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", history.day(F.when(F.col("event_id") % 7 != 0, seconds)).alias("day"), history.month(seconds).alias("month"))


_HREFS = "select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as href from {pages}"


@R.frame("regex_imports", f"select page_id, count(*) as imports, count(distinct href) as targets from ({_HREFS}) group by page_id")
def regex_imports(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
    return links.groupBy("page_id").agg(F.count("*").alias("imports"), F.countDistinct("href").alias("targets"))


@query("import_edges", "edges", "select id, line from edges where kind = 'IMPORTS'")
def import_edges(g: Repositories) -> DataFrame:
    """Each shared line of two files is a statement that names it; the first statement's line is kept."""
    once = builder.merge_imports(g.imports.select("repository", "source", "target", F.lit("x").alias("name"), "line"))
    return builder.edges_of(once.withColumn("kind", F.lit("IMPORTS"))).select("id", F.col("line").cast("int").alias("line"))


@R.frame("tumbling_events", "select event_type, epoch_us(ts) // 86400000000 * 86400000000 as start, count(*) as n from {events} group by all")
def tumbling_events(spark: SparkSession, d: str) -> DataFrame:
    return events.windowed_counts(table(spark, d, "events"), "1 day").select("event_type", F.unix_micros("start").alias("start"), "n")
