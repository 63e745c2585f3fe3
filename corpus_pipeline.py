"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, PII, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and returns the rows that it keeps; all but the last
return the columns of ``documents``.  A stage works on whatever its predecessor kept, so learned
models, links and corpus statistics are those of its own input.  ``run`` writes each stage's rows
as Parquet to the shared folder of the session and reads them again for the next one; the rows of
the last stage stay there.

Rows: a stage keeps clean rows as they are, in any order.  Null and empty texts pass toxicity,
decontamination and PII; of all texts without words one stays after near-duplicates, as they
have the same shingles; encoding gives them no identifiers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codelore.llm import byte_bpe, decontaminate, minhash, pii, simhash, toxicity
from codelore.llm.common import checkpoint_dir, table

#: Words in a shingle, and the Jaccard similarity from which texts are near-duplicates.
SHINGLE, SIMILAR = minhash.SHINGLE, minhash.SIMILAR


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not find toxic; trained on the labels of docs."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of linked texts.

    Texts are linked by SimHash fingerprints within 3 bits, as operator 6 links them, and at a
    Jaccard similarity of 0.8 of their 5-word shingles, most of which 3 bits miss; groups are the
    components of both kinds of links together.  The README has figures of each.
    """
    return minhash.keep_one(docs, shingle=SHINGLE, least=SIMILAR, bits=simhash.MOST_BITS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of any benchmark item occurs."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), least=1)


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with personal data masked and disclosing terms generalised or removed."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the identifiers (little-endian uint32), their number, and the decoded text."""
    rows = byte_bpe.encode(docs, decoded=True)
    return rows.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash", one_of_each_group),
    ("decontamination", decontaminated),
    ("pii", without_pii),
    ("byte_bpe", encoded),
]

#: Learned and iterative stages are not SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads the stage before the last one any more
            _drop(spark, before)
        before = path
    return docs


def _drop(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
