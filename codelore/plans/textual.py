"""Queries over text functions, paths, retrieval, chunking and bounded graph walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.functions import fixed, paths, text as T
from codelore.operators import chunking, graph, render
from codelore.plans import stand_in
from codelore.plans.shared import Registry, oracle_of, spread, table

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

#: DuckDB form of the identifier tokenizer: borders become spaces in two steps, then a split.
STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)


def _duck_tokens(column: str, stop: bool = True) -> str:
    pieces = f"""string_split(trim(regexp_replace(regexp_replace(r, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')), ' ')"""
    every = f"""flatten(list_transform(list_filter(string_split_regex({column}, '[^A-Za-z0-9]+'), lambda r: r <> ''),
      lambda r: case when len({pieces}) > 1 then list_append(list_transform({pieces}, lambda p: lower(p)), lower(r)) else [lower(r)] end))"""
    return f"list_filter({every}, lambda t: len(t) > 1 and t not in ({STOP}))" if stop else every


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


# tokens and hashes
@R.frame("tokenize_identifier", f"select doc_id, len(t)::bigint as n_tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id, {_duck_tokens('text', False)} as t from {{documents}})")
def tokenize_identifier(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("doc_id", T.identifier_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@R.frame("tokenize_stop", f"select doc_id, len(t)::bigint as n_tokens, md5(array_to_string(t, ' ')) as digest from (select doc_id, {_duck_tokens('text')} as t from {{documents}})")
def tokenize_stop(spark: SparkSession, d: str) -> DataFrame:
    rows = _documents(spark, d).select("doc_id", T.search_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@R.frame("tokenize_path", f"select page_id, array_to_string({_duck_tokens("regexp_replace(url, '[.][A-Za-z0-9]+$', '')")}, ' ') as tokens from {{pages}}")
def tokenize_path(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.array_join(T.path_tokens(F.col("url")), " ").alias("tokens"))


@R.frame(
    "chunk_terms",
    f"select doc_id, (3 * len({_duck_tokens("source || '/' || doc_id::varchar")}) + 4 * len({_duck_tokens('lang')}) + len({_duck_tokens('text')}))::bigint as n_terms from {{documents}}",
)
def chunk_terms(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", F.size(T.chunk_terms(path, F.col("lang"), F.col("text"))).cast("long").alias("n_terms"))


@R.frame("content_hash", "select doc_id, substr(sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')), 1, 32) as h from {documents}")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("h"))


# literal tables
PATHS = ["main.py", "src/core/app.py", "src/x.py", "tests/test_a.py", "docs/guide.md", "lib/a/b/c.go", "examples/run.py", "scripts/build.sh", "a/b/c.tsx", "test_top.py", "pkg/api/routes.ts", "src//double/y.py", "tools/cli.py", "a/wsgi.py", "deep/er/Server.JS", "noext", "docs_src/tutorial/a.py", "Pkg/net/dial.go", "a/testing/b.py", "x_test.py", ".hidden", "web/Handlers/h.ts", "notes.md", "trailing."]


def _values(names: str, rows: list[tuple]) -> str:
    return f"(values {', '.join('(' + ', '.join(f'cast({x} as bigint)' if isinstance(x, int) else chr(39) + str(x).replace(chr(39), chr(39) * 2) + chr(39) for x in r) + ')' for r in rows)}) v({names})"


def _literal(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    kinds = ["long" if isinstance(x, int) else "string" for x in rows[0]]
    return spark.createDataFrame(rows, ", ".join(f"{n.strip()} {k}" for n, k in zip(names.split(","), kinds, strict=True)))


#: The literal paths and those of all stand-in files.
DUCK_PATHS = f"with {stand_in.duck('files')}, p as (select path from {_values('path', [(p,) for p in PATHS])} union select path from files)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, "path", [(p,) for p in PATHS]).union(stand_in.stored(spark, d, "files").select("path")).distinct()


def _path_query(name: str, expression, duck: str) -> None:
    """A path function over the paths; ``duck`` is its DuckDB form."""
    @R.frame(name, f"{DUCK_PATHS} select path, {duck} as value from p")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _paths(spark, d).select("path", expression(F.col("path")).alias("value"))


def _duck_case(pairs, subject: str, otherwise: str) -> str:
    arms = " ".join(f"when regexp_matches({subject}, '{pattern}') then {value}" for pattern, value in pairs)
    return f"case {arms} else {otherwise} end"


_path_query("path_role", paths.role, _duck_case([(p, f"'{v}'") for p, v in fixed.ROLES], "lower(path)", "'implementation'"))
_path_query("path_prior", paths.prior, f"least({', '.join(_duck_case([(p, f'{v}::double')], 'lower(path)', '1.0::double') for p, v in fixed.PRIORS)})")
_SEGMENTS = "list_filter(string_split(path, '/'), lambda p: p <> '')"
_ROOTS = ", ".join(f"'{r}'" for r in fixed.SOURCE_ROOTS)
_path_query("module_of", paths.module_of, f"case when len({_SEGMENTS}) <= 1 then '(root)' when lower({_SEGMENTS}[1]) in ({_ROOTS}) and len({_SEGMENTS}) > 2 then array_to_string({_SEGMENTS}[1:2], '/') else {_SEGMENTS}[1] end")
_path_query("entry_label", paths.entry_label, _duck_case([(p, f"'{v}'") for p, v in fixed.ENTRIES], "path", f"'{fixed.NO_ENTRY}'"))
_path_query("language_of", paths.language, "''")
ORACLES["language_of"] = f"{oracle_of(DUCK_PATHS)} select path, coalesce(e.lang, 'unknown') as value from p left join {_values('ext, lang', list(fixed.LANGUAGES.items())).replace(') v(', ') e(')} on e.ext = '.' || lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+[.]([^.]+)$', 1))"


@R.frame("path_parts", f"{DUCK_PATHS} select path, regexp_extract(path, '[^/]*$') as base, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as directory, regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', '') as stem from p")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, d).select("path", paths.basename(p).alias("base"), paths.directory(p).alias("directory"), paths.stem(p).alias("stem"))


NAMES = ["flask", "my repo!", "a", "x..y", "10.0.0.1", "Owner/Project", "ok_name-1", "-lead", "é accent", "a" * 80, " padded ", "!!!", "1000.2.3.4"]


@R.frame("collection_name")
def collection_name(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, "name", [(x,) for x in NAMES]).select("name", paths.collection_name(F.col("name")).alias("collection"))


_LEGAL = "regexp_matches(n, '^[a-zA-Z0-9][a-zA-Z0-9._-]{1,61}[a-zA-Z0-9]$') and not contains(n, '..') and not regexp_matches(n, '^[0-9]{1,3}([.][0-9]{1,3}){3}$')"
_SLUG = "substr(regexp_replace(regexp_replace(n, '[^a-zA-Z0-9._-]', '-', 'g'), '^[._-]+|[._-]+$', '', 'g'), 1, 40)"
ORACLES["collection_name"] = f"select name, case when {_LEGAL} then n else 'repo-' || coalesce(nullif({_SLUG}, ''), 'repo') || '-' || substr(sha1(n), 1, 8) end as collection from (select name, trim(name) as n from {_values('name', [(x,) for x in NAMES])})"

URLS = [
    "https://github.com/a/b", "https://www.github.com/a/b.git", "https://github.com/a-b/c_d/", "http://github.com/a/b", "https://gitlab.com/a/b", "https://github.com/a", "https://github.com/a/b/c", "https://github.com/a/b?x=1",
    "https://u:p@github.com/a/b", "https://github.com:8443/a/b", "https://github.com/-a/b", "https://github.com/.a/b", "https://github.com/a/..", "git@github.com:a/b", " https://GitHub.com/a/b.c ", "https://github.com//a//b//", "https://github.com/a/b#f", "https://github.com/a/b c",
]


@R.frame("url_validate")
def url_validate(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, "url", [(x,) for x in URLS]).select("url", paths.valid_repository_url(F.col("url")).alias("accepted"), paths.repository_name(F.col("url")).alias("name"))


ORACLES["url_validate"] = f"select url, regexp_matches(trim(url), '{paths.REPOSITORY_URL}') as accepted, regexp_extract(trim(url), '{paths.REPOSITORY_URL}', 2) as name from {_values('url', [(x,) for x in URLS])}"

THOUGHTS = ["<think>plan</think> answer", "a <THINK>x\ny</THINK> b", "cut <think>never ends", "plain", " <think></think> ", "a </think> b <think>c", "<THINK>open"]


@R.frame("strip_reasoning")
def strip_reasoning(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, "t", [(x,) for x in THOUGHTS]).select("t", T.strip_reasoning(F.col("t")).alias("answer"))


ORACLES["strip_reasoning"] = f"""select t, regexp_replace(case when contains(c, '<think>') and not contains(c, '</think>') then string_split(c, '<think>')[1] else c end, '^\\s+|\\s+$', '', 'g') as answer
  from (select t, regexp_replace(t, '(?is)<think>.*?</think>\\s*', '', 'g') as c from {_values('t', [(x,) for x in THOUGHTS])})"""


@R.frame("relevance_score", "select event_id, case when event_id % 11 = 0 or value < 20 then 0.0::double else round(1 / (1 + value - 20), 6) end as score from {events}")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    """Some distances are negative, and every eleventh is missing."""
    distance = F.when(F.col("event_id") % 11 != 0, F.col("value") - 20)
    return table(spark, d, "events").select("event_id", F.round(T.relevance(distance), 6).alias("score"))


#: A token whose shape is a credential; it is made up.
SAMPLES = [
    "key AKIA" + "ABCDEFGHIJKLMNOP", "password = 'changeme'", "db_password = 'correct horse battery'", "https://me:pw123456@host/x", "api_key=\"${SECRET}\"", "plain text", "token ghp_" + "a1" * 20,
    "auth_token: 'abcdefgh1'", "API_KEY = \"sk-" + "ant-" + "x1" * 12 + "\"", "password = compute(value)", "client-secret: 'os.getenv(1)'", "secret = 'short'",
]


#: What each sample becomes, and the labels of what was found in it.
MASKED = [
    ("key [REDACTED]", "aws_access_key"), ("password = 'changeme'", ""), ("db_password = '[REDACTED]'", "assignment:db_password"), ("[REDACTED]/x", "connection_string"), ("api_key=\"${SECRET}\"", ""), ("plain text", ""), ("token [REDACTED]", "github_token"),
    ("auth_token: '[REDACTED]'", "assignment:auth_token"), ("API_KEY = \"[REDACTED]\"", "assignment:API_KEY,openai_key"), ("password = compute(value)", ""), ("client-secret: 'os.getenv(1)'", ""), ("secret = 'short'", ""),
]


@R.frame("redact_patterns", f"select * from {_values('t, masked, labels', [(t, *m) for t, m in zip(SAMPLES, MASKED, strict=True)])}")
def redact_patterns(spark: SparkSession, d: str) -> DataFrame:
    rows = _literal(spark, "t", [(x,) for x in SAMPLES])
    return rows.select("t", T.redact(F.col("t")).alias("masked"), F.array_join(T.redaction_labels(F.col("t")), ",").alias("labels"))


@R.frame("redact_documents", f"select doc_id, md5(text || chr(10) || v.masked) as digest, v.labels from {{documents}} join {_values('i, masked, labels', [(i, *m) for i, m in enumerate(MASKED)])} on v.i = doc_id % {len(MASKED)}")
def redact_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document, which holds no credential itself, with one of the samples at its end."""
    samples = F.array(*[F.lit(x) for x in SAMPLES])
    whole = F.concat("text", F.lit("\n"), F.get(samples, (F.col("doc_id") % len(SAMPLES)).cast("int")))
    rows = _documents(spark, d).select("doc_id", whole.alias("text"))
    found = rows.select("doc_id", T.redacted(F.col("text")).alias("r"))
    return found.select("doc_id", F.md5("r.text").alias("digest"), F.array_join("r.labels", ",").alias("labels"))


QUESTIONS = [
    (1, "Where is `UserService` defined?"), (2, "How does authentication work?"), (3, "What depends on app/core/db.py?"), (4, "Show the history of user_service"), (5, "Which files are the most complex?"),
    (6, "Explain the architecture"), (7, "What calls parse_file()?"), (8, ""), (9, "hello there"), (10, "Refactor the database module"), (11, "what changed in version 2 of flask.app"), (12, "How does a request flow through the system?"),
    (13, "Show me everything related to authentication"), (14, "Explain the indexing file and the class AuthService"), (15, "Tell me about the service layer, the caching layer and APIRouter.include_router"), (16, "Create tests for this function"),
    (17, "why"), (18, "What is in this repository?"), (19, "Where can I find module app.rag.parser or Settings.PY?"), (20, "function called build_context in the main module"),
]


@R.frame("intent_score")
def intent_score(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, "id, question", QUESTIONS).select("id", T.classify(F.col("question")).alias("c")).select("id", "c.*")


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


_ASKED = _values("id, question", QUESTIONS)
_RULES = _values("o, intent, weight, pattern", [(i, intent, weight, T.rule_pattern(pattern)) for i, (intent, weight, pattern) in enumerate(fixed.RULES)]).replace(") v(", ") r(")
ORACLES["intent_score"] = f"""with q as (select * from {_ASKED}), r as (select * from {_RULES}),
  hits as (select q.id, r.intent, sum(r.weight) as score, min(r.o) as o from q join r on regexp_matches(q.question, r.pattern) group by q.id, r.intent),
  best as (select *, row_number() over (partition by id order by score desc, o) as n, sum(score) over (partition by id) as total from hits)
  select q.id, case when b.id is null then '{fixed.DEFAULT_INTENT}' else b.intent end as intent,
    case when trim(q.question) = '' then 0.0::double when b.id is null then {fixed.GUESS}::double else round_even(b.score::double / b.total::double, 3) end as confidence,
    regexp_matches(q.question, '{_quoted(fixed.PRONOUNS)}') as needs_context
  from q left join best b on b.id = q.id and b.n = 1"""


@R.frame("extract_mentions")
def extract_mentions(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, "id, question", QUESTIONS).select("id", F.array_join(T.mentions(F.col("question")), ",").alias("mentions"))


def _duck_family(family: str, pattern: str) -> str:
    found = f"regexp_extract_all(question, '{_quoted(pattern)}', 1)"
    common, slots = (", ".join(f"'{w}'" for w in words) for words in (fixed.COMMON_WORDS, fixed.SLOT_WORDS))
    if family == "qualified":
        other = f"regexp_extract_all(question, '{_quoted(pattern)}', 2)"
        found = f"list_transform(range(1, len({found}) + 1), lambda i: case when {found}[i] <> '' then {found}[i] else {other}[i] end)"
    if family == "symbol":
        return f"list_filter({found}, lambda x: len(x) >= 3 and lower(x) not in ({common}))"
    return f"list_filter({found}, lambda x: lower(x) not in ({common}, {slots}))" if family in ("qualified", "bare") else found


#: list_distinct does not keep order in DuckDB, so first places are looked up.
_FIRST = "coalesce(array_to_string(list_transform(list_filter(range(1, len(m) + 1), lambda i: list_position(m, m[i]) = i), lambda i: m[i]), ','), '')"
ORACLES["extract_mentions"] = f"with q as (select id, flatten([{', '.join(_duck_family(f, p) for f, p in fixed.MENTIONS)}]) as m from {_ASKED}) select id, {_FIRST} as mentions from q"


@R.frame("extract_concepts")
def extract_concepts(spark: SparkSession, d: str) -> DataFrame:
    return _literal(spark, "id, question", QUESTIONS).select("id", F.array_join(T.concepts(F.col("question")), ",").alias("concepts"))


ORACLES["extract_concepts"] = f"with q as (select id, flatten([{', '.join(_duck_family('bare', p) for p in fixed.CONCEPTS)}]) as c from {_ASKED}), l as (select id, list_transform(c, lambda x: lower(x)) as m from q) select id, {_FIRST} as concepts from l"

LOG = ["a1\x1fAnn\x1f1700000000\x1fp1\x1ffirst", "b2\x1fBob\x1f1700000100\x1fp1 p2\x1fmerge", "bad\x1fno time", "c3\x1fCy\x1fx\x1f\x1fno int"]


@R.frame("git_log_parse")
def git_log_parse(spark: SparkSession, d: str) -> DataFrame:
    from codelore.sources.gitlog import parse_headers

    return parse_headers(_literal(spark, "raw", [("\x00".join(LOG),)]), "raw").select("sha", "author", "authored_at", "is_merge", "summary")


ORACLES["git_log_parse"] = f"""with r as (select unnest(string_split(raw, '|')) as h from {_values('raw', [('|'.join(LOG).replace(chr(31), ';'),)])}), f as (select string_split(h, ';') as f from r)
  select f[1] as sha, f[2] as author, try_cast(f[3] as bigint) as authored_at, len(list_filter(string_split(f[4], ' '), lambda p: p <> '')) > 1 as is_merge, f[5] as summary from f where len(f) >= 5 and try_cast(f[3] as bigint) is not null"""

STATUS = ["M\tsrc/a.py", "A\tb.txt", "D\tdir\\c.py", "\tno.status", "R100\told.py"]


@R.frame("name_status", f"select line, coalesce(nullif(substr(string_split(line, chr(9))[1], 1, 1), ''), 'M') as change_type, replace(string_split(line, chr(9))[2], chr(92), '/') as path from {_values('line', [(x,) for x in STATUS])}")
def name_status(spark: SparkSession, d: str) -> DataFrame:
    from codelore.sources.gitlog import parse_name_status

    return parse_name_status(_literal(spark, "line", [(x,) for x in STATUS]), "line")


# chunks
_STRIP = "regexp_replace(regexp_replace({}, '^[ \\t\\n\\r\\v\\f]+', ''), '[ \\t\\n\\r\\v\\f]+$', '')"
_NL = "(length({0}) - length(replace({0}, chr(10), '')))"


@R.frame(
    "chunk_windows",
    f"""with b as (select doc_id, {_STRIP.format('text')} as t from {{documents}}), s as (select doc_id, t, unnest(range(0, greatest(length(t), 1), 1900)) as pos from b where length(t) > 0),
    c as (select doc_id, pos, substr(t, pos + 1, 2000) as piece, {_NL.format('substr(t, 1, pos)')} + 1 as start_line from s), k as (select *, {_STRIP.format('piece')} as content from c)
    select doc_id, row_number() over (partition by doc_id order by pos) - 1 as chunk_index, start_line::bigint as start_line, (start_line + {_NL.format('piece')})::bigint as end_line, md5(content) as digest from k where length(content) >= 24""",
)
def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunking.character_windows(_documents(spark, d)).select("doc_id", "chunk_index", "start_line", "end_line", F.md5("content").alias("digest"))


_DOC_PATH = "source || '/' || doc_id::varchar || '.' || lang"


@R.frame(
    "render_excerpts",
    f"""with d as (select doc_id, {_DOC_PATH} as path, {_NL.format('text')} + 1 as n, text from {{documents}})
    select doc_id, md5('[1] ' || path || ':1-' || n::varchar || '  kind: block  role: ' || {_duck_case([(p, f"'{v}'") for p, v in fixed.ROLES], 'lower(path)', "'implementation'")} || chr(10) || '```' || chr(10)
      || case when length(text) > 2400 then regexp_replace(substr(text, 1, 2400), '\\s+$', '') || chr(10) || '… (excerpt truncated)' else text end || chr(10) || '```') as digest from d""",
)
def render_excerpts(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    chunk = F.struct(
        path.alias("relative_path"), F.lit(1).alias("start_line"), T.line_count(F.col("text")).alias("end_line"), F.lit("").alias("symbol"), F.lit("block").alias("chunk_type"), F.lit(False).alias("graph_linked"), F.col("text").alias("content")
    )
    return table(spark, d, "documents").select("doc_id", F.md5(render.excerpts(F.array(chunk))).alias("digest"))


# graph walks
def _edges(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target")).distinct()


_E = "e as (select distinct 's' || l_suppkey::varchar as source, 'p' || l_partkey::varchar as target from {lineitem}), u as (select source as a, target as b from e union all select target, source from e)"


def _duck_labels(rounds: int) -> str:
    text = f"with {_E}, r0 as (select distinct a as node, a as label from u)"
    for k in range(1, rounds + 1):
        votes = f"select a as node, label, count(*) as n from u join r{k - 1} on b = node group by a, label"
        text += f", r{k} as (select node, label from (select v.node, v.label, row_number() over (partition by v.node order by v.n desc, v.label <> o.label, v.label) as i from ({votes}) v join r{k - 1} o on o.node = v.node) where i = 1)"
    return text


@R.frame("label_propagation", _duck_labels(4) + " select node, label from r4")
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    return graph.label_propagation(_edges(spark, d), 4)


@R.frame(
    "community_sizes",
    _duck_labels(2) + """, g as (select a as node, count(*) as degree from u group by a)
    select label, count(*) as size, arg_min(node, (-degree, node)) as hub from r2 join g using (node) group by label""",
)
def community_sizes(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    return graph.communities(graph.label_propagation(edges, 2), edges)
