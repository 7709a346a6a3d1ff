"""Sharding: a Feistel permutation over global row numbers gives every row a shard and a slot that can be computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inquest.llm.common import land, scratch
from inquest.llm.permute import permuted

SEED = 20240


def with_row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's number from 0 in the order of the columns, gapless over the whole table.

    Rows are dealt by ranges of the order columns, so tasks stay of like size; only the row counts of the parts meet.
    The parts are written to the shared folder first, so the numbers do not change when a task is run again.
    Rows that are equal in all order columns may swap numbers.
    """
    part, within = f"{name}_part", f"{name}_within"
    keys = [F.asc_nulls_last(c) for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn(part, F.spark_partition_id()).withColumn(within, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    parts = land(dealt, scratch(df.sparkSession, "numbered"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = parts.join(offsets, part).withColumn(name, F.col("offset") + F.col(within))
    return numbered.select(*df.columns, name)


def shard_of(place: Column, shards: int) -> Column:
    return (place % shards).cast("int")


def slot_of(place: Column, shards: int) -> Column:
    return ((place - place % shards) / shards).cast("int")


def shard_rows(docs: DataFrame, shards: int = 16, order: tuple[str, ...] = ("doc_id",), seed: int = SEED, prefix: str = "") -> DataFrame:
    """All columns of ``docs`` and ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in each shard), named with ``prefix``.

    Rows are numbered in the order of ``order`` (nulls last); the number is permuted and dealt in turn, so shards differ
    by one row at most, and any row's shard and slot follow from its number, the row count and the seed alone. Equal
    rows get places of their own. An empty table gives an empty result. Names that clash raise ValueError.
    """
    clash = {prefix + x for x in ("shard", "slot")} & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist; choose another prefix")
    number = "".join(docs.columns) + "_row"
    rows = with_row_numbers(docs, list(order), number)
    total = rows.count()
    placed = rows.withColumn(number, permuted(F.col(f"`{number}`"), F.lit(total), F.lit(seed)))
    place = F.col(f"`{number}`")
    return placed.select(*(F.col(f"`{c}`") for c in docs.columns), shard_of(place, shards).alias(f"{prefix}shard"), slot_of(place, shards).alias(f"{prefix}slot"))
