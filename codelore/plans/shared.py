"""Helpers for query modules: table access and SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is read from fewer files than there are cores.

    Work on texts is bound by the processor, and one small file is one task.  A table of many
    files is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def query_of(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query from SQL text that names its tables as ``{table}``."""
    used = sorted(set(re.findall(r"\{(\w+)\}", sql)))
    if strange := set(used) - set(TABLES):
        raise ValueError(f"unknown tables {strange}")

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})

    return run


def oracle_of(sql: str) -> str:
    return re.sub(rf"\{{({'|'.join(TABLES)})\}}", r"\1", sql)


class Registry:
    """Collects the queries of one module and their oracle SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def sql(self, name: str, text: str, duck: str | None = None) -> None:
        """Register SQL that both engines run, or two dialects of it."""
        self.queries[name] = query_of(text)
        self.oracles[name] = oracle_of(duck or text)

    def frame(self, name: str, duck: str | None = None):
        """Register a DataFrame function."""

        def add(function):
            self.queries[name] = function
            if duck:
                self.oracles[name] = oracle_of(duck)
            return function

        return add
