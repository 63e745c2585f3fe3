"""Repository files: scan, classification of what to skip, and parsed-file records."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codelore.functions import fixed, paths
from codelore.functions.text import content_hash, line_count, redacted

#: Files of a repository that one task reads.
FILES_AT_ONCE = 256
#: Bytes of a file that are shown.
MOST_SHOWN = 400_000


def pruned(path: Column) -> Column:
    """Whether a relative path lies in a directory that is never descended into."""
    folders = F.slice(F.split(F.lower(path), "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*[F.lit(p) for p in fixed.IGNORED_DIRECTORIES]))


def skip_reason(path: Column, size: Column, content: Column) -> Column:
    """Why a file is not indexed (the first rule that holds), or null.  ``content`` is binary."""
    name, extension = F.lower(paths.basename(path)), paths.extension(path)
    dotted = F.concat(F.lit("."), extension)
    generated = F.lit(False)
    for suffix in fixed.GENERATED_SUFFIXES:
        generated = generated | name.endswith(suffix)
    stem = F.when(extension == "", name).otherwise(F.substring(name, F.lit(1), F.char_length(name) - F.char_length(extension) - 1))
    # Bytes that are not UTF-8 are dropped from texts, so they do not make a file less empty.
    printed = F.regexp_replace(content.cast("string"), r"(?U)[\s\x1c-\x1f\ufffd]+", "")
    return (
        F.when(name.isin(*fixed.IGNORED_FILENAMES), "ignored_filename")
        .when(generated, "generated_file")
        .when(stem.isin(*fixed.IGNORED_STEMS), "ignored_stem")
        .when(dotted.isin(*fixed.IGNORED_EXTENSIONS), "ignored_extension")
        .when(~dotted.isin(*fixed.SUPPORTED_EXTENSIONS), "unsupported_extension")
        .when(size > fixed.MOST_BYTES, "too_large")
        .when(content.isNull(), "read_error")
        .when(F.contains(content, F.unhex(F.lit("00"))), "binary_content")
        .when(printed == "", "empty")
    )


def lenient_text(df: DataFrame, column: str) -> DataFrame:
    """``column`` (binary) as text; bytes that are not UTF-8 are dropped, not replaced."""
    schema = ", ".join(f"`{f.name}` {'string' if f.name == column else f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([None if v is None else v.decode("utf-8", "ignore") for v in b.column(at).to_pylist()], pa.string())
            columns = [texts if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return df.mapInArrow(run, schema)


class RepositoryFiles(DataSource):
    """``spark.read.format("repository").load(root)``: (path, size, content) of a checkout's files.

    The engine's own file listing leaves out names that begin with a point or an underscore, such
    as ``__init__.py``.  Here directories are walked on the driver and ignored ones are never
    descended into; contents are read by the tasks.  The checkout must be readable where they
    run.  Content is null if the file is larger than is indexed or cannot be read.
    """

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return "path string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Walk(self.options.get("path"))


@dataclass
class _Part(InputPartition):
    paths: list[str]


class _Walk(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        parts: list[InputPartition] = []
        held: list[str] = []
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)
        for folder, folders, names in os.walk(self.root):
            folders[:] = sorted(f for f in folders if f.lower() not in fixed.IGNORED_DIRECTORIES)
            for name in sorted(names):
                held.append(os.path.relpath(os.path.join(folder, name), self.root))
                if len(held) >= FILES_AT_ONCE:
                    parts.append(_Part(held))
                    held = []
        return [*parts, _Part(held)] if held or not parts else parts

    def read(self, partition):
        for path in partition.paths:
            whole, size, content = os.path.join(self.root, path), None, None
            try:
                size = os.stat(whole).st_size
                if size <= fixed.MOST_BYTES:
                    with open(whole, "rb") as file:
                        content = file.read()
            except OSError:
                pass
            yield path.replace(os.sep, "/"), size, content


def scan(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """(repository, path, size, content, skip_reason) of the files below ``root`` that are not pruned."""
    spark.dataSource.register(RepositoryFiles)
    found = spark.read.format("repository").load(os.path.abspath(root)).select(F.lit(repository).alias("repository"), "path", "size", "content")
    return found.withColumn("skip_reason", skip_reason(F.col("path"), F.col("size"), F.col("content")))


def parsed(files: DataFrame) -> DataFrame:
    """Records of the kept files: repository, language, names, hash and text."""
    kept = lenient_text(files.where(F.col("skip_reason").isNull()).select("repository", "path", "content"), "content")
    path = F.col("path")
    return kept.select(
        "repository", paths.language(path).alias("language"), paths.basename(path).alias("file_name"), path.alias("relative_path"), F.concat(F.lit("."), paths.extension(path)).alias("extension"), content_hash(F.col("content")).alias("file_hash"), "content"
    )


def statistics(files: DataFrame, examples: int = 5) -> DataFrame:
    """(reason, files, examples): how many files each reason skips, with a few of their paths."""
    reason = F.coalesce("skip_reason", F.lit("kept"))
    return files.groupBy(reason.alias("reason")).agg(F.count("*").alias("files"), F.min("path").alias("first"), F.slice(F.array_sort(F.collect_set(F.substring("path", 1, 200))), 1, examples).alias("examples"))


def extensions(files: DataFrame) -> DataFrame:
    """(extension, files, kept): files by extension, and those that are kept."""
    return files.groupBy(paths.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.count(F.when(F.col("skip_reason").isNull(), 1)).alias("kept"))


def languages(files: DataFrame) -> DataFrame:
    """(language, files): kept files by language."""
    return files.where(F.col("skip_reason").isNull()).groupBy(paths.language(F.col("path")).alias("language")).agg(F.count("*").alias("files"))


def file_content(spark: SparkSession, root: str, path: str) -> DataFrame:
    """(relative_path, language, content, line_count, truncated, redacted, findings) of one file.

    The file is read as it is now, up to ``MOST_SHOWN`` bytes, and credentials are masked.  A path
    that leads out of the checkout, by links too, is refused.
    """
    base = os.path.realpath(root)
    target = os.path.realpath(os.path.join(base, path))
    if os.path.commonpath([base, target]) != base:
        raise PermissionError("the path leads out of the repository")
    if not os.path.isfile(target):
        raise FileNotFoundError(path)
    with open(target, "rb") as file:
        text = file.read(MOST_SHOWN).decode("utf-8", "replace")
    rows = spark.createDataFrame([(path, text, os.path.getsize(target) > MOST_SHOWN)], "relative_path string, raw string, truncated boolean")
    masked, findings = F.col("r.text"), F.col("r.labels")
    return rows.withColumn("r", redacted(F.col("raw"))).select("relative_path", paths.language(F.col("relative_path")).alias("language"), masked.alias("content"), line_count(masked).alias("line_count"), "truncated", (F.size(findings) > 0).alias("redacted"), findings.alias("findings"))
