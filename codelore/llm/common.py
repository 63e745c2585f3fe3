"""What the training-data operators share: column hygiene, materialisation, Arrow helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.session import checkpoint_dir, materialise

#: Rows of texts sent to a Python worker at once, where the session does not say.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Rows handed to a downstream Arrow consumer at once.
OUT_ROWS = 2048


__all__ = ["batch", "checkpoint_dir", "fresh", "hash_pool", "in_batches", "materialise", "partitions", "row_batches", "table", "text_or_empty"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def row_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Group a stream of row tuples into record batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch(schema, list(zip(*held, strict=True)))
            held = []
    if held:
        yield batch(schema, list(zip(*held, strict=True)))


def in_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` over batches of bounded size.

    The engine's default of 10,000 rows in a batch is made for short rows; with texts a batch of it
    takes hundreds of megabytes in the executor and its Python worker.  Where the session has that
    default, batches get ``BATCH_ROWS`` rows; a session's own setting is kept.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING) == "10000":
        conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have in any letter case."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def hash_pool(df: DataFrame, key: str, most: int) -> DataFrame:
    """The rows of ``df`` with the smallest hashes of ``key``: about twice ``most`` of them.

    A sample of ``most`` rows is then picked from the pool, whose size does not grow with the
    table.  A table of up to ``most`` rows passes whole.
    """
    share = min(1.0, 2 * most / max(1, df.count()))
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 40)) < F.lit(round(share * (1 << 40))))
