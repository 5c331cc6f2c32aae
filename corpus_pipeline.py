"""A training corpus from raw documents: the stages in order, each over all that the one before kept.

Null or empty texts stay until the mix, which takes nothing from them. Rows without doc_id, repeated rows, ties, very
long texts and columns of other names are handled as the stages' modules state. Empty documents give an empty corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajspark.llm import decontam, mixing, neardup, pii, quality
from trajspark.plans.scratch import scratch_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    return quality.kept(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash tiles, confirmed at a similarity of 0.8 of five-word shingles."""
    return neardup.deduplicated(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), unnamed=True)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pii.masked(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: the text of every slot of every shard, and the documents it comes from."""
    return mixing.mixture(docs)


STAGES = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", unseen),
    ("PII", private),
    ("mixing sources", mixed),
]

#: SQL has no form for the classifier, the fingerprints' hash or the templates.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
