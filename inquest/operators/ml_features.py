"""Feature columns, labels, samples and fingerprints of a table for the models."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inquest.functions.scalar import binary_label

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns in schema order, without the excluded ones."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def feature_frame(df: DataFrame, columns: list[str], keep: tuple[str, ...] = (), target: str | None = None) -> DataFrame:
    """``features`` as one vector per row, nulls and NaN as 0; label 0/1 where a target is named."""
    from pyspark.ml.feature import VectorAssembler

    filled = df.select(*keep, *([binary_label(F.col(target)).alias("label")] if target else []),
                       *[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_f{i}") for i, c in enumerate(columns)])
    made = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(columns))], outputCol="features").transform(filled)
    return made.drop(*[f"_f{i}" for i in range(len(columns))])


def sample_rows(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """About ``rows`` rows by a seeded draw; a sampling operator, not used by the detectors."""
    total = df.count()
    return df if total <= rows else df.sample(fraction=rows / total, seed=seed)


def dataset_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """(n_rows, row_digest, schema_digest): equal for equal rows in any order.

    Row digests are added up, so the figure needs no order and combines on the map side.
    """
    kinds = dict(df.dtypes)
    schema_text = ",".join(f"{c}:{kinds[c]}" for c in sorted(columns))
    row = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns])), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(row).cast("string").alias("row_digest")).withColumn(
        "schema_digest", F.lit(hashlib.sha256(schema_text.encode()).hexdigest())
    )
