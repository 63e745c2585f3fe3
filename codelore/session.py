"""Session settings that the engine's plans assume."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: UTC keeps time buckets stable; adaptive execution sizes and splits partitions at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(name: str, cores: int | str = "*", shuffle_partitions: int = 8, **more: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, pass SETTINGS to your own builder."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        **more,
    }.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for what an iterative plan writes between its rounds.

    Read from the session: a checkpoint folder that is set, or ``spark.checkpoint.dir``.  Only a
    local session without either gets a temporary folder, removed at exit.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="codelore-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


#: Rows of narrow tables in a file, where their number is known.
ROWS_IN_FILE = 20_000


def materialise(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder: its plan ends there, and lost executors lose nothing.

    ``rows`` is a number that ``df`` does not much exceed.  A small table is then written in a few
    files, not in one for each partition of its plan; a large one keeps its partitions.
    """
    checkpoint_dir(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS_IN_FILE)))
    return df.checkpoint(eager=True)
