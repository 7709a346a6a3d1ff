"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again.

All stages but the last return the columns of ``documents``; the last adds ``shard`` and ``slot``. A document that the
mix takes twice is there twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inquest.llm.common import scratch, table
from inquest.llm.decontam import drop_contaminated
from inquest.llm.mixing import mixed_copies
from inquest.llm.nearcopies import keep_one_copy
from inquest.llm.quality import quality_filter
from inquest.llm.sharding import shard_rows

SHARDS = 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8 or more) the document with the least id stays.

    Links are those of method 1, confirmed, and of bands for copies that differ in more than its 3 bits.
    """
    return keep_one_copy(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target words: documents are taken never, once or twice."""
    return mixed_copies(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A shuffled order, dealt to shards of equal row counts."""
    return shard_rows(docs, SHARDS)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The fingerprints' hash and the connected groups have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
