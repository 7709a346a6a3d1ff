"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inquest.session import shared_scratch

#: White space that separates words: space and the five ASCII controls tab to carriage return.
SPACES = "\t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also when lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " ")
    return F.array_remove(parts, "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """128 bits that tell rows apart by id and text, the same in every pass over a table."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), doc_id, text)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared place that ``spark.checkpoint.dir`` names."""
    return shared_scratch(spark, name)


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a step to the shared folder and read it back: later steps restart from files."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
