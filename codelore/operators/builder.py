"""The graph of repositories from their parsed files: nodes, edges, and what was counted on the way.

Files are (repository, language, file_name, relative_path, extension, file_hash, content).  Syntax is
read by a parser or by patterns, file by file; everything after that is joins: the hierarchy is
distinct projections of paths, imports of other languages are candidates joined with files, and
names of Python are resolved by :mod:`codelore.operators.pycode`.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from codelore.functions import fixed, paths
from codelore.functions.text import line_count
from codelore.operators import othercode, pycode
from codelore.session import materialise

MOST_NAMES, MOST_LINES, LEAST_USES = 8, 20, 2
SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.js")
SEPARATOR = "::"

NODE = (
    "id string, repository string, kind string, name string, key string, parent_id string, level int, language string, extension string, module string, directory string, size long, line_count long, class_count long, "
    "function_count long, import_count long, complexity string, file_hash string, parse_failed boolean, relative_path string, start_line long, end_line long, is_async boolean, bases array<string>, uses long"
)
EDGE = "id string, repository string, kind string, source string, target string, file string, line long, lines array<long>, count long, via string, names array<string>"


class Graph(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame


def node_id(repository: Column | str, kind: Column | str, key: Column | str) -> Column:
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(as_column(repository), F.lit(SEPARATOR), as_column(kind), F.lit(SEPARATOR), as_column(key))


def split_node_id(identifier: Column) -> Column:
    """(repository, kind, key) of a node id; the key may hold the separator; else an error."""
    parts = F.split(identifier, SEPARATOR, 3)
    part = lambda i: F.get(parts, F.lit(i))
    whole = F.struct(part(0).alias("repository"), part(1).alias("kind"), part(2).alias("key"))
    return F.when(F.size(parts) == 3, whole).otherwise(F.raise_error(F.concat(F.lit("no node id: "), F.coalesce(identifier, F.lit("null")))))


def level_of(kind: Column) -> Column:
    out = F.lit(fixed.UNKNOWN_LEVEL)
    for name, level in fixed.NODE_LEVELS.items():
        out = F.when(kind == name, level).otherwise(out)
    return out


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with the columns of ``schema``; those that it lacks are null."""
    wanted = [c.strip().split(" ") for c in schema.split(", ")]
    return df.select(*[F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in wanted])


# the hierarchy


def hierarchy(files: DataFrame) -> DataFrame:
    """Repository, module, directory and file nodes of ``files`` (repository, relative_path, ...).

    A directory is always below its module, however deep it is; a file whose directory is its module
    is below that, and a file at the top is below the module '(root)'.
    """
    path = F.col("relative_path")
    placed = files.where("relative_path <> ''").withColumns({"module": paths.module_of(path), "directory": paths.directory(path)})
    repository = placed.select("repository").distinct().select("repository", F.lit("repository").alias("kind"), F.col("repository").alias("name"), F.col("repository").alias("key"), F.lit(None).cast("string").alias("parent_id"))
    top = node_id("repository", F.lit("repository"), "repository")
    module = placed.select("repository", "module").distinct().select("repository", F.lit("module").alias("kind"), F.col("module").alias("name"), F.col("module").alias("key"), top.alias("parent_id"))
    below = node_id("repository", F.lit("module"), "module")
    inside = (F.col("directory") != "") & (F.col("directory") != F.col("module"))
    directory = placed.where(inside).select("repository", "module", "directory").distinct().select("repository", F.lit("directory").alias("kind"), paths.basename(F.col("directory")).alias("name"), F.col("directory").alias("key"), below.alias("parent_id"))
    parent = F.when(inside, node_id("repository", F.lit("directory"), "directory")).otherwise(below)
    file = placed.select("*", F.lit("file").alias("kind"), F.coalesce(F.nullif("file_name", F.lit("")), paths.basename(path)).alias("name"), path.alias("key"), parent.alias("parent_id")).drop("relative_path")
    every = [df.withColumns({"id": node_id("repository", "kind", "key"), "level": level_of(F.col("kind"))}) for df in (repository, module, directory, file)]
    return reduce(DataFrame.unionByName, [_shaped(df, NODE) for df in every])


def contains(nodes: DataFrame) -> DataFrame:
    """CONTAINS edges of the parents; a symbol's has its file and line."""
    below = nodes.where(F.col("parent_id").isNotNull())
    return edges_of(below.select("repository", F.lit("CONTAINS").alias("kind"), F.col("parent_id").alias("source"), F.col("id").alias("target"), F.col("relative_path").alias("file"), F.col("start_line").alias("line")))


def edges_of(df: DataFrame) -> DataFrame:
    return _shaped(df.withColumn("id", F.concat_ws("|", "source", "kind", "target")), EDGE)


# merging


def merge_calls(sites: DataFrame, most: int = MOST_LINES) -> DataFrame:
    """(repository, source, target, count, line, via, lines) of call sites (repository, source, target,
    line, via): the number of sites, the first one's line and way, and the first lines.

    Sites are cut to the first ``most`` before they are listed, so a much repeated call holds no
    long list anywhere.
    """
    by = ["repository", "source", "target"]
    first = sites.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("line", "via"))).where(F.col("_n") <= most)
    listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_n", "line", "via"))).alias("l"))
    counted = sites.groupBy(*by).agg(F.count("*").alias("count"))
    return counted.join(listed, by).select(*by, "count", F.col("l")[0]["line"].alias("line"), F.col("l")[0]["via"].alias("via"), F.col("l.line").alias("lines"))


def merge_imports(statements: DataFrame, most: int = MOST_NAMES) -> DataFrame:
    """(repository, source, target, line, names) of imports (repository, source, target, name, line):
    the first line, and the first ``most`` different names in their order.  A file's import of
    itself is none.
    """
    by = ["repository", "source", "target"]
    named = statements.where("source <> target").groupBy(*by, "name").agg(F.min("line").alias("line"))
    few = named.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy("line", "name"))).where(F.col("_n") <= most)
    return few.groupBy(*by).agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("_n", "name"))).alias("l")).select(*by, "line", F.col("l.name").alias("names"))


def depends(imports: DataFrame) -> DataFrame:
    """(repository, source, target): modules that import another (source_module, target_module)."""
    return imports.where("source_module <> target_module").select("repository", node_id("repository", F.lit("module"), "source_module").alias("source"), node_id("repository", F.lit("module"), "target_module").alias("target")).distinct()


def externals(used: DataFrame, least: int = LEAST_USES) -> DataFrame:
    """External nodes of packages (repository, package, n) that are imported ``least`` times or more."""
    counted = used.where("package <> ''").groupBy("repository", "package").agg(F.sum("n").alias("uses")).where(F.col("uses") >= least)
    key = F.concat(F.lit("external/"), "package")
    rows = counted.select("repository", F.lit("external").alias("kind"), F.col("package").alias("name"), key.alias("key"), node_id("repository", F.lit("repository"), "repository").alias("parent_id"), "uses")
    return _shaped(rows.withColumns({"id": node_id("repository", "kind", "key"), "level": level_of(F.col("kind"))}), NODE)


def namespaces(bindings: DataFrame) -> DataFrame:
    """(repository, path, name, value): what each name of a file is bound to; null for a name that is
    bound to different things.
    """
    known = bindings.groupBy("repository", "path", "name").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value"))
    return known.select("repository", "path", "name", F.when(F.col("n") == 1, F.col("value")).alias("value"))


# imports of other languages


def import_index(files: DataFrame) -> DataFrame:
    """(repository, module, path): the names by which files can be imported without a relative path.

    A Python file has every dotted end of its path, another its path without extension and its stem;
    of several files the first path has the name.
    """
    path = F.col("relative_path")
    stem = F.regexp_replace(path, "[.][^./]*$", "")
    segments = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, "[.]py$", ""), "/__init__$", ""), "/"), lambda p: p != "")
    dotted = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.array_join(F.slice(segments, i, F.size(segments)), "."))
    named = F.when(F.endswith(path, F.lit(".py")), F.when(F.size(segments) > 0, dotted)).otherwise(F.array(stem, paths.basename(stem)))
    return files.select("repository", F.explode(named).alias("module"), path.alias("path")).groupBy("repository", "module").agg(F.min("path").alias("path"))


def relative_candidates(importer: Column, target: Column) -> Column:
    """The paths that a relative import can mean, best first."""
    marks = F.regexp_extract(target, r"^((?:\.{1,2}/)*)", 1)
    rest = F.substring(target, F.length(marks) + 1, F.length(target))
    ups = F.size(F.filter(F.split(marks, "/"), lambda m: m == ".."))
    here = F.filter(F.split(paths.directory(importer), "/"), lambda p: p != "")
    base = F.array_join(F.slice(here, F.lit(1), F.greatest(F.size(here) - ups, F.lit(0))), "/")
    whole = F.when(base == "", rest).otherwise(F.concat_ws("/", base, rest))
    return F.array(*[F.concat(whole, F.lit(s)) for s in SUFFIXES])


def other_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(repository, source, module, line, target) of imports (repository, path, module, line): the
    path of the imported file, or null.
    """
    known = files.select("repository", F.col("relative_path").alias("target"))
    relative = imports.where(F.col("module").rlike("^[./]"))
    tried = relative.select("repository", F.col("path").alias("source"), "module", "line", F.posexplode(relative_candidates(F.col("path"), F.col("module"))).alias("rank", "target"))
    on = ["repository", "source", "module", "line"]
    hit = tried.join(known, ["repository", "target"]).groupBy(*on).agg(F.min_by("target", "rank").alias("target"))
    start = lambda df: df.select("repository", F.col("path").alias("source"), "module", "line")
    found = start(relative).join(hit, on, "left")
    named = start(imports.where(~F.col("module").rlike("^[./]"))).join(import_index(files).withColumnRenamed("path", "target"), ["repository", "module"], "left")
    return found.unionByName(named)


# everything


def build(files: DataFrame, definitions: dict | None = None) -> Graph:
    """Nodes, edges and counts of all repositories in ``files``; ``definitions`` as in
    :func:`codelore.operators.othercode.analyse`.
    """
    files = files.where("relative_path <> ''")
    python = F.coalesce(F.col("language") == "python", F.lit(False))
    parsed = materialise(pycode.analyse(files.where(python).select("repository", F.col("relative_path").alias("path"), "content")))
    others = materialise(othercode.analyse(files.where(~python).select("repository", F.col("relative_path").alias("path"), "language", "content"), definitions))

    symbol = lambda df, *more: df.select("repository", "path", F.explode("symbols").alias("s")).select("repository", F.col("path").alias("relative_path"), "s.kind", "s.name", *more)
    own = symbol(parsed, F.col("s.parent").alias("owner"), "s.start_line", "s.end_line", "s.is_async", "s.bases")
    read = symbol(others, F.lit("").alias("owner"), F.col("s.line").alias("start_line"), F.col("s.line").alias("end_line"), F.lit(False).alias("is_async"), "s.bases")
    # A name that is defined twice in a file is one node, with what the last definition says.
    every = own.unionByName(read).withColumn("key", F.concat_ws(SEPARATOR, "relative_path", "name"))
    once = every.groupBy("repository", "kind", "key").agg(F.max_by(F.struct("relative_path", "name", "owner", "start_line", "end_line", "is_async", "bases"), F.struct("start_line", "end_line")).alias("s")).select("repository", "kind", "key", "s.*")
    owners = once.where("kind = 'class'").select("repository", F.col("key").alias("_owner"), node_id("repository", "kind", "key").alias("_owner_id"))
    held = once.withColumn("_owner", F.when(F.col("owner") != "", F.concat_ws(SEPARATOR, "relative_path", "owner"))).join(owners, ["repository", "_owner"], "left")
    symbols = materialise(
        held.withColumns(
            {
                "id": node_id("repository", "kind", "key"), "level": level_of(F.col("kind")), "line_count": F.col("end_line") - F.col("start_line") + 1,
                "parent_id": F.coalesce("_owner_id", node_id("repository", F.lit("file"), "relative_path")),
            }
        )
    )

    counted = every.groupBy("repository", "relative_path").agg(F.count(F.when(F.col("kind") == "class", 1)).alias("class_count"), F.count(F.when(F.col("kind") != "class", 1)).alias("function_count"), F.count("*").alias("_symbols"))
    statements = F.size(F.array_distinct(F.transform("imports", lambda i: F.struct(i["line"], i["module"], i["level"]))))
    read_of = parsed.select("repository", F.col("path").alias("relative_path"), statements.alias("import_count"), F.col("failed").alias("parse_failed")).unionByName(others.select("repository", F.col("path").alias("relative_path"), F.size("imports").alias("import_count"), F.lit(False).alias("parse_failed")))
    on = ["repository", "relative_path"]
    measured = files.withColumns({"size": F.length("content").cast("long"), "line_count": line_count(F.col("content"))}).drop("content").join(read_of, on, "left").join(counted, on, "left")
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("class_count", "function_count", "import_count", "_symbols")}
    banded = measured.withColumns(zero).withColumn("complexity", paths.complexity_band(F.col("line_count"), F.col("_symbols")))

    resolved = materialise(pycode.resolve(parsed))
    elsewhere = materialise(other_imports(files, others.select("repository", "path", F.explode("imports").alias("i")).select("repository", "path", "i.module", "i.line")))
    inside = elsewhere.where("target is not null and target <> source").groupBy("repository", "source", "target").agg(F.min("line").alias("line")).withColumn("names", F.array().cast("array<string>"))
    imported = resolved.where("kind = 'IMPORTS'").select("repository", "source", "target", F.col("first_line").alias("line"), "names").unionByName(inside)
    file_id = lambda c: node_id("repository", F.lit("file"), c)
    imports = edges_of(imported.select("repository", F.lit("IMPORTS").alias("kind"), file_id("source").alias("source"), file_id("target").alias("target"), F.col("source").alias("file"), "line", "names"))
    between = depends(imported.select("repository", paths.module_of(F.col("source")).alias("source_module"), paths.module_of(F.col("target")).alias("target_module")))

    known = symbols.select("repository", "key", "id")
    calls = resolved.where("kind in ('CALLS', 'INHERITS', 'IMPLEMENTS')").withColumnRenamed("source", "_s").withColumnRenamed("target", "_t")
    linked = calls.join(known.select("repository", F.col("key").alias("_s"), F.col("id").alias("source")), ["repository", "_s"]).join(known.select("repository", F.col("key").alias("_t"), F.col("id").alias("target")), ["repository", "_t"])
    linked = edges_of(linked.select("repository", "kind", "source", "target", F.substring_index("_s", SEPARATOR, 1).alias("file"), F.col("first_line").alias("line"), "lines", "count", "via"))
    # Other languages know a base only by its name in the file.
    based = symbols.where("kind = 'class'").join(files.where(~python).select(*on), on, "left_semi").select("repository", "relative_path", "id", "start_line", F.explode("bases").alias("base"))
    bases = symbols.where("kind = 'class'").select("repository", "relative_path", F.col("name").alias("base"), F.col("id").alias("target"))
    inherits = edges_of(based.join(bases, ["repository", "relative_path", "base"]).select("repository", F.lit("INHERITS").alias("kind"), F.col("id").alias("source"), "target", F.col("relative_path").alias("file"), F.col("start_line").alias("line")))

    package = F.get(F.split(F.get(F.split("module", "[.]"), F.lit(0)), "/"), F.lit(0))
    # An import of the file itself names a package too, as it is no edge.
    outside = elsewhere.where("(target is null or target = source) and not module rlike '^[./]'").select("repository", package.alias("package"), F.lit(1).alias("n"))
    used = resolved.where("kind = 'EXTERNAL'").select("repository", F.col("target").alias("package"), F.col("count").alias("n")).unionByName(outside)

    nodes = materialise(reduce(DataFrame.unionByName, [hierarchy(banded), _shaped(symbols, NODE), externals(used)]))
    edges = reduce(DataFrame.unionByName, [contains(nodes), imports, edges_of(between.withColumn("kind", F.lit("DEPENDS_ON"))), linked, inherits])
    lost = resolved.where("kind = 'UNRESOLVED'").select("repository", "count").unionByName(elsewhere.where("target is null and module rlike '^[./]'").select("repository", F.lit(1).cast("long").alias("count")))
    per = nodes.groupBy("repository").agg(F.count(F.when(F.col("kind") == "file", 1)).alias("files"), F.count(F.when(F.col("kind").isin(*fixed.SYMBOL_KINDS), 1)).alias("symbols"), F.count(F.when(F.col("parse_failed"), 1)).alias("parse_failures"))
    stats = per.join(imported.groupBy("repository").agg(F.count("*").alias("imports")), "repository", "left").join(used.groupBy("repository").agg(F.sum("n").alias("external_imports")), "repository", "left").join(lost.groupBy("repository").agg(F.sum("count").alias("unresolved_imports")), "repository", "left").na.fill(0)
    return Graph(nodes, materialise(edges.dropDuplicates(["id"])), stats)
