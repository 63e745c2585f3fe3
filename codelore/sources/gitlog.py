"""Commit history: parsing of raw log records, and a data source that reads a checkout's log."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codelore.functions import paths

RECORD, FIELD = "\x00", "\x1f"
AUTHOR, SUMMARY, BULK = 120, 200, 200


def parse_headers(df: DataFrame, raw_col: str) -> DataFrame:
    """(sha, author, authored_at, is_merge, summary, body) of NUL-separated log records.

    A record has five fields separated by 0x1f: sha, author, epoch seconds, parents, and the
    summary with the name-status lines after it.  Records with fewer fields or another time are
    dropped.
    """
    records = df.select(F.explode(F.split(raw_col, RECORD)).alias("r")).select(F.split("r", FIELD).alias("f")).where(F.size("f") >= 5)
    lines = F.split(F.get("f", F.lit(4)), "\n")
    parents = F.filter(F.split(F.get("f", F.lit(3)), " "), lambda p: p != "")
    return records.select(
        F.get("f", F.lit(0)).alias("sha"),
        F.substring(F.get("f", F.lit(1)), 1, AUTHOR).alias("author"),
        F.get("f", F.lit(2)).try_cast("bigint").alias("authored_at"),
        (F.size(parents) > 1).alias("is_merge"),
        F.substring(F.get(lines, F.lit(0)), 1, SUMMARY).alias("summary"),
        F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("body"),
    ).where(F.col("authored_at").isNotNull())


def _change(line):
    """(type, path) of a name-status line; a missing status counts as modified."""
    status = F.substring(F.trim(F.substring_index(line, "\t", 1)), 1, 1)
    path = F.replace(F.trim(F.substring(line, F.instr(line, "\t") + 1, F.char_length(line))), F.lit("\\"), F.lit("/"))
    return F.when(status == "", F.lit("M")).otherwise(status), path


def parse_name_status(df: DataFrame, line_col: str) -> DataFrame:
    """(line, change_type, path) of name-status lines."""
    kind, path = _change(F.col(line_col))
    return df.select(F.col(line_col).alias("line"), kind.alias("change_type"), path.alias("path"))


def commit_files(headers: DataFrame, bulk: int = BULK) -> DataFrame:
    """(sha, authored_at, path, module, change_type); merges and commits of over ``bulk`` files give none."""
    kept = headers.where(~F.col("is_merge")).withColumn("changes", F.filter("body", lambda x: x.contains("\t"))).where(F.size("changes") <= bulk)
    lines = kept.select("sha", "authored_at", F.explode("changes").alias("line"))
    kind, path = _change(F.col("line"))
    return lines.select("sha", "authored_at", path.alias("path"), kind.alias("change_type")).where("path <> ''").withColumn("module", paths.module_of(F.col("path")))


def parse_refs(df: DataFrame) -> DataFrame:
    """(kind, name, sha, created_at) of raw references (refname, sha, created_at).

    Local branches come before remote ones of the same name, which lose their remote's name;
    ``HEAD`` of a remote is no branch.
    """
    ref = F.col("refname")
    local, remote, tag = ref.startswith("refs/heads/"), ref.startswith("refs/remotes/"), ref.startswith("refs/tags/")
    name = F.when(local, F.expr("substring(refname, 12)")).when(remote, F.regexp_replace(ref, "^refs/remotes/[^/]+/", "")).otherwise(F.expr("substring(refname, 11)"))
    rows = df.where(local | remote | tag).select(F.when(tag, "tag").otherwise("branch").alias("kind"), name.alias("name"), F.when(remote, 1).otherwise(0).alias("place"), "refname", "sha", "created_at")
    first = F.min(F.struct("place", "refname", "sha", "created_at")).alias("r")
    return rows.where(~((F.col("place") == 1) & (F.col("name") == "HEAD"))).groupBy("kind", "name").agg(first).select("kind", "name", "r.sha", "r.created_at")


class GitLogSource(DataSource):
    """``spark.read.format("gitlog").load(checkout)``: one row ``raw`` with the newest commits.

    The checkout must be readable where the task runs.  Option ``limit`` bounds the commits.
    """

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return "raw string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.limit = options.get("path"), int(options.get("limit", "1500"))

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        out = subprocess.run(
            ["git", "-C", self.path, "log", f"-{self.limit}", "--no-renames", "--name-status", "--format=%x00" + "%x1f".join(("%H", "%an", "%at", "%P", "%s"))],
            capture_output=True, check=True,
        ).stdout.decode("utf-8", "replace")
        for record in out.split(RECORD)[1:]:
            yield (record,)


class GitRefsSource(DataSource):
    """``spark.read.format("gitrefs").load(checkout)``: branches and tags (refname, sha, created_at).

    A tag's commit and date are those of what it points at; references to anything but a commit
    have no date and are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "gitrefs"

    def schema(self) -> str:
        return "refname string, sha string, created_at long"

    def reader(self, schema) -> DataSourceReader:
        return _RefReader(self.options.get("path"))


class _RefReader(DataSourceReader):
    FIELDS = ("refname", "objectname", "*objectname", "committerdate:unix", "*committerdate:unix")

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self):
        return [InputPartition(self.path)]

    def read(self, partition):
        wanted = "%1f".join(f"%({f})" for f in self.FIELDS)
        out = subprocess.run(["git", "-C", self.path, "for-each-ref", f"--format={wanted}", "refs/heads", "refs/remotes", "refs/tags"], capture_output=True, check=True).stdout.decode("utf-8", "replace")
        for line in out.splitlines():
            name, own, target, date, target_date = line.split(FIELD)
            if made := target_date or date:
                yield name, target or own, int(made)
