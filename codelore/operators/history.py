"""History of repositories: commits, the files they touched, and references.

``commits`` has (repository, sha, author, authored_at, summary, is_merge), ``commit_files``
(repository, sha, relative_path, module, change_type, authored_at) and ``refs`` (repository, name,
kind, sha, created_at).  Times are seconds since the epoch, days and months are UTC.  Ties end in
sha, path or name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from codelore.session import materialise

MOST_COMMITS, MOST_FILES, MOST_CHANGES, SHOWN_CHANGES, MOST_RELEASES = 60, 200, 400, 60, 40


def month(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM")


def day(seconds: Column) -> Column:
    """``yyyy-MM-dd``; no time, or the epoch itself, is ``unknown``."""
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, "unknown").otherwise(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd"))


def first_seen(commit_files: DataFrame, what: str = "relative_path") -> DataFrame:
    """(repository, what, first_at): the first change of every path or module that has one."""
    return commit_files.where(F.col(what).isNotNull()).groupBy("repository", what).agg(F.min("authored_at").alias("first_at"))


def existing_at(commit_files: DataFrame, at: int | Column) -> DataFrame:
    """(repository, relative_path): the paths that were touched at or before a time."""
    return commit_files.where(F.col("authored_at") <= at).select("repository", "relative_path").distinct()


def change_counts(commit_files: DataFrame) -> DataFrame:
    """(repository, relative_path, commits): how many commits touched each path."""
    return commit_files.groupBy("repository", "relative_path").agg(F.countDistinct("sha").alias("commits"))


def commit_range(commits: DataFrame) -> DataFrame:
    """(repository, first_at, last_at, total)."""
    return commits.groupBy("repository").agg(F.min("authored_at").alias("first_at"), F.max("authored_at").alias("last_at"), F.count("*").alias("total"))


def commits_of_paths(commits: DataFrame, commit_files: DataFrame, asked: DataFrame, most: int = 20) -> DataFrame:
    """(repository, relative_path, pos, sha, author, authored_at, summary, change_type): the newest
    commits of each asked path; a commit that lists a path twice is there twice.
    """
    touched = commit_files.join(asked.select("repository", "relative_path").distinct(), ["repository", "relative_path"], "left_semi").select("repository", "relative_path", "sha", "change_type", F.col("authored_at").alias("_at"))
    # The cut comes before the join, which then reads few rows of each path.
    newest = W.partitionBy("repository", "relative_path").orderBy(F.desc("_at"), "sha", "change_type")
    known = touched.join(commits.select("repository", "sha"), ["repository", "sha"], "left_semi")
    few = known.withColumn("pos", F.row_number().over(newest)).where(F.col("pos") <= most)
    return few.join(commits.select("repository", "sha", "author", "authored_at", "summary"), ["repository", "sha"]).drop("_at")


def buckets(commit_files: DataFrame) -> DataFrame:
    """(repository, module, period, commits, changes, first_at, last_at): activity by month."""
    known = commit_files.where(F.col("module").isNotNull())
    grouped = known.groupBy("repository", "module", month(F.col("authored_at")).alias("period"))
    return grouped.agg(F.countDistinct("sha").alias("commits"), F.count("*").alias("changes"), F.min("authored_at").alias("first_at"), F.max("authored_at").alias("last_at"))


def lanes(commit_files: DataFrame) -> DataFrame:
    """(repository, pos, module, first_seen, total_commits, periods): a module's months in order.

    The busiest module comes first; a commit counts in each month's number of its module.
    """
    period = F.struct("period", "commits", "changes", "first_at", "last_at")
    each = buckets(commit_files).groupBy("repository", "module").agg(F.min("first_at").alias("first_seen"), F.sum("commits").alias("total_commits"), F.array_sort(F.collect_list(period)).alias("periods"))
    order = W.partitionBy("repository").orderBy(F.desc("total_commits"), "module")
    return each.withColumn("pos", F.row_number().over(order))


def references(refs: DataFrame, kind: str | None = None) -> DataFrame:
    return refs if kind is None else refs.where(F.col("kind") == kind)


def releases(refs: DataFrame, most: int = MOST_RELEASES) -> DataFrame:
    """(repository, pos, name, sha, created_at): the newest dated tags, oldest first."""
    dated = references(refs, "tag").where(F.coalesce("created_at", F.lit(0)) != 0)
    newest = W.partitionBy("repository").orderBy(F.desc("created_at"), F.desc("name"))
    few = dated.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    shown = W.partitionBy("repository").orderBy("created_at", "name")
    return few.withColumn("pos", F.row_number().over(shown)).select("repository", "pos", "name", "sha", "created_at")


def release_of(refs: DataFrame) -> DataFrame:
    """(repository, sha, release): the tag of each commit; the last one made wins."""
    tags = references(refs, "tag").where(F.coalesce("sha", F.lit("")) != "")
    return tags.groupBy("repository", "sha").agg(F.max_by("name", F.struct(F.coalesce("created_at", F.lit(-1)), "name")).alias("release"))


def newest(commits: DataFrame, most: int = MOST_COMMITS, before: int | None = None) -> DataFrame:
    """The newest commits of each repository, with their place from the newest ``_n``."""
    known = commits if before is None else commits.where(F.col("authored_at") <= before)
    order = W.partitionBy("repository").orderBy(F.desc("authored_at"), "sha")
    return known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)


def timeline(commits: DataFrame, commit_files: DataFrame, refs: DataFrame, most: int = MOST_COMMITS, before: int | None = None) -> DataFrame:
    """The newest commits of each repository, oldest first, with their number of files and release.

    The commits are cut before their files are joined, so only those of a few commits are counted.
    ``truncated`` says that there are as many commits as were asked for, or more.
    """
    few = newest(commits, most, before)
    touched = commit_files.join(few.select("repository", "sha"), ["repository", "sha"], "left_semi").groupBy("repository", "sha").agg(F.count("*").alias("files_changed"))
    shown = few.join(touched, ["repository", "sha"], "left").join(release_of(refs), ["repository", "sha"], "left")
    size = F.count("*").over(W.partitionBy("repository"))
    return shown.select(
        "repository", (size - F.col("_n") + 1).cast("int").alias("pos"), "sha", F.substring("sha", 1, 8).alias("short_sha"), F.coalesce(F.nullif("author", F.lit("")), F.lit("unknown")).alias("author"), "authored_at",
        F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("files_changed", F.lit(0)).cast("long").alias("files_changed"), "is_merge", F.coalesce("release", F.lit("")).alias("release"), (size >= most).alias("truncated"),
    )


def commit(commits: DataFrame, asked: DataFrame, least: int = 4) -> DataFrame:
    """(repository, prefix, commit columns): the first commit whose sha begins with each prefix.

    A prefix shorter than ``least`` is an error, as it would name no commit in particular.
    """
    left = asked.select(F.col("repository").alias("_r"), F.col("prefix")).distinct()
    left = left.withColumn("prefix", F.when(F.length("prefix") >= least, F.col("prefix")).otherwise(F.raise_error(F.concat(F.lit("too short to name a commit: "), F.coalesce("prefix", F.lit("null"))))))
    found = commits.join(left, (F.col("_r") == F.col("repository")) & F.startswith("sha", F.col("prefix"))).drop("_r")
    one = W.partitionBy("repository", "prefix").orderBy("sha")
    return found.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")


def commit_detail(commits: DataFrame, commit_files: DataFrame, nodes: DataFrame, asked: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """(repository, prefix, sha, pos, relative_path, module, change_type, node_id, indexed): the
    files of each asked commit; those that are no node have an empty ``node_id``.
    """
    of = commit(commits, asked).select("repository", "prefix", "sha")
    files = commit_files.join(of, ["repository", "sha"])
    order = W.partitionBy("repository", "prefix").orderBy("relative_path", "change_type")
    few = files.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most)
    known = nodes.where("kind = 'file'").select("repository", F.col("key").alias("relative_path"), F.col("id").alias("_id"))
    return few.join(known, ["repository", "relative_path"], "left").select(
        "repository", "prefix", "sha", "pos", "relative_path", F.coalesce("module", F.lit("")).alias("module"), F.coalesce(F.nullif("change_type", F.lit("")), F.lit("M")).alias("change_type"),
        F.coalesce("_id", F.lit("")).alias("node_id"), F.col("_id").isNotNull().alias("indexed"),
    )


def changes(commit_files: DataFrame, windows: DataFrame, most: int = MOST_CHANGES) -> DataFrame:
    """(repository, request, pos, relative_path, module, commits, last_at) of each asked window.

    ``windows`` has (repository, request, low, high), a row for each request; a change after ``low`` and up to ``high``
    counts.  The most changed paths come first.
    """
    # A repository's times are cut at the bounds of its windows: a change lies in one piece, the
    # number of bounds before it, and a window is some pieces in a row.  Rows are added up by piece
    # before they meet the windows, so they are not repeated for each window that they lie in.
    ends = materialise(windows.where("low < high").select("repository", "request", "low", "high"))
    bounds = ends.groupBy("repository").agg(F.array_sort(F.array_union(F.collect_set("low"), F.collect_set("high"))).alias("_b"))
    piece = lambda b, at: F.size(F.filter(b, lambda x: x < at))
    touched = commit_files.select("repository", "relative_path", "sha", "module", "authored_at")
    cut = touched.join(F.broadcast(bounds), "repository").withColumn("_piece", piece(F.col("_b"), F.col("authored_at"))).where("_piece > 0 and _piece < size(_b)").drop("_b")
    # A commit counts once in a window, whatever its times: where its time before is not inside.
    before = F.coalesce(F.lag("_piece").over(W.partitionBy("repository", "relative_path", "sha").orderBy("authored_at")), F.lit(0)).alias("_before")
    added = cut.select("*", before).groupBy("repository", "relative_path", "_piece", "_before").agg(F.count("sha").alias("n"), F.max(F.struct("authored_at", "sha", "module")).alias("last"))
    spans = ends.join(bounds, "repository").select("repository", "request", piece(F.col("_b"), F.col("low")).alias("_low"), piece(F.col("_b"), F.col("high")).alias("_high"))
    inside = added.join(F.broadcast(spans), "repository").where("_piece > _low and _piece <= _high")
    each = inside.groupBy("repository", "request", "relative_path").agg(F.max("last").alias("last"), F.sum(F.when(F.col("_before") <= F.col("_low"), F.col("n")).otherwise(0)).alias("commits"))
    each = each.select("repository", "request", "relative_path", "last.module", "commits", F.col("last.authored_at").alias("last_at"))
    order = W.partitionBy("repository", "request").orderBy(F.desc("commits"), F.desc("last_at"), "relative_path")
    return each.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most)


def windows_between(commits: DataFrame, asked: DataFrame) -> DataFrame:
    """(repository, request, low, high) of asked (repository, request, start, end) shas, which may
    be shortened and stand in either order.
    """
    named = asked.select("repository", "request", F.explode(F.array("start", "end")).alias("prefix"))
    times = commit(commits, named).select("repository", "prefix", "authored_at")
    both = named.join(times, ["repository", "prefix"]).groupBy("repository", "request").agg(F.min("authored_at").alias("low"), F.max("authored_at").alias("high"), F.count("*").alias("n"))
    return both.where("n = 2").drop("n")


def changes_by_module(changed: DataFrame) -> DataFrame:
    """(repository, request, module, commits, files): the changed paths by module, '(root)' if none."""
    return changed.groupBy("repository", "request", F.coalesce("module", F.lit("(root)")).alias("module")).agg(F.sum("commits").alias("commits"), F.count("*").alias("files"))


def snapshot(nodes: DataFrame, commit_files: DataFrame, moments: DataFrame) -> DataFrame:
    """(repository, request, module, first_seen, file_count_at, file_count): the modules that were
    there at each asked moment (repository, request, at), and how many of their files.

    Approximate: a path counts from its first change on, one without any was there before, and
    deletions are not modelled.
    """
    modules = nodes.where("kind = 'module'").select("repository", F.col("name").alias("module"))
    seen = first_seen(commit_files, "module").withColumnRenamed("first_at", "first_seen")
    files = nodes.where("kind = 'file'").select("repository", "module", F.col("key").alias("relative_path")).join(first_seen(commit_files), ["repository", "relative_path"], "left")
    # A module's files by first change: one row for each, whatever the number of moments.
    then = files.select("repository", "module", F.coalesce("first_at", F.lit(0)).alias("first_at")).join(moments, "repository")
    present = then.groupBy("repository", "request", "module").agg(F.count(F.when(F.col("first_at") <= F.col("at"), 1)).alias("file_count_at"), F.count("*").alias("file_count"))
    shown = modules.join(moments, "repository").join(seen, ["repository", "module"], "left").where("first_seen is null or first_seen <= at")
    out = shown.join(present, ["repository", "request", "module"], "left")
    return out.select("repository", "request", "module", "first_seen", F.coalesce("file_count_at", F.lit(0)).cast("long").alias("file_count_at"), F.coalesce("file_count", F.lit(0)).cast("long").alias("file_count"))


def moments_of(commits: DataFrame, asked: DataFrame) -> DataFrame:
    """(repository, request, at) of asked (repository, request, prefix): the time of each commit."""
    found = commit(commits, asked).select("repository", "prefix", F.col("authored_at").alias("at"))
    return asked.select("repository", "request", "prefix").join(found, ["repository", "prefix"]).drop("prefix")
