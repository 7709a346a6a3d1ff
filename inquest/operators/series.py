"""Activity series, and the ready-made profiles of an amount column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions.scalar import truncate_ts
from inquest.operators.keyed import global_row_number

# Points of the series, and the quantile that marks a busy hour.
HOURS = 24
BUSY_QUANTILE = 0.85


def activity_series(df: DataFrame, ts: str, value: str, reference: Column, keys: list[str]) -> DataFrame:
    """(keys, slot, value, threshold): sums per filled hour in the day before ``reference``.

    A key with fewer filled hours is padded on the left with its first value.
    ``reference`` is a time given by the caller, or a scalar subquery on the data.
    """
    v = F.col(value).try_cast("double")
    recent = df.select(*keys, F.col(ts).alias("_ts"), v.alias("_v")).filter(F.col("_ts").isNotNull() & F.col("_v").isNotNull())
    recent = recent.filter(F.col("_ts") >= reference - F.expr(f"INTERVAL '{HOURS}' HOUR"))
    hourly = recent.groupBy(*keys, truncate_ts(F.col("_ts"), "hour").alias("hb")).agg(F.sum("_v").alias("value"))
    # At most 25 hours per key are left, so a short array per key holds the series.
    per_key = hourly.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("hb", "value"))).alias("s"))
    values = F.transform("s", lambda p: p["value"])
    last = F.slice(values, F.greatest(F.lit(1), F.size(values) - HOURS + 1), HOURS)
    padded = F.concat(F.array_repeat(F.get(last, F.lit(0)), F.greatest(F.lit(0), HOURS - F.size(last))), last)
    points = per_key.select(*keys, F.posexplode(padded).alias("slot", "value"))
    limit = points.groupBy(*keys).agg(
        F.when(F.max("value") > 0, F.percentile("value", BUSY_QUANTILE)).otherwise(F.avg("value") + 1e-6).alias("threshold")
    )
    return points.join(limit, keys) if keys else points.withColumn("threshold", limit.scalar())


def position_series(df: DataFrame, order: str, tie: str, value: str, parts: int = HOURS) -> DataFrame:
    """(slot, value, n): the table cut into equal slices by position, every row in one of them."""
    numbered = global_row_number(df.select(order, tie, F.col(value).try_cast("double").alias("_v")), order, tie)
    n = df.agg(F.count("*")).scalar()
    small, extra = F.floor(n / parts), n % parts
    cut = extra * (small + 1)
    at = F.col("row_number") - 1
    slot = F.when(at < cut, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - cut) / F.greatest(small, F.lit(1))))
    return numbered.groupBy(slot.cast("int").alias("slot")).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"), F.count("*").alias("n"))


def velocity_profile(df: DataFrame, user: str, amount: str) -> DataFrame:
    return df.groupBy(user).agg(
        F.count("*").alias("txn_count"), F.sum(amount).alias("volume"), F.avg(amount).alias("avg_amount"), F.max(amount).alias("max_amount")
    )


def segment_profile(df: DataFrame, segment: str, amount: str) -> DataFrame:
    return df.groupBy(segment).agg(F.count("*").alias("txn_count"), F.sum(amount).alias("volume"), F.avg(amount).alias("avg_amount"))


def daily_profile(df: DataFrame, ts: str, amount: str) -> DataFrame:
    return df.groupBy(truncate_ts(F.col(ts), "day").alias("day")).agg(F.count("*").alias("txns"), F.sum(amount).alias("volume"))


def chargeback_rate(df: DataFrame, segment: str, disputed: str) -> DataFrame:
    out = df.groupBy(segment).agg(F.count("*").alias("total_txns"), F.count_if(F.col(disputed)).alias("chargebacks"))
    return out.withColumn("cb_rate", F.col("chargebacks") / F.col("total_txns"))


def z_scores(df: DataFrame, amount: str) -> DataFrame:
    """Adds ``amount_z``; null where all amounts are equal. Mean and deviation are one-row subqueries."""
    stats = df.agg(F.struct(F.avg(amount).alias("m"), F.stddev_samp(amount).alias("s")).alias("st")).scalar()
    return df.withColumn("amount_z", F.when(stats["s"] > 0, (F.col(amount) - stats["m"]) / stats["s"]))


def shared_attribute(df: DataFrame, attribute: str, user: str) -> DataFrame:
    keyed = df.filter(F.col(attribute).isNotNull() & F.col(user).isNotNull())
    return keyed.groupBy(attribute).agg(F.count_distinct(user).alias("distinct_users")).filter("distinct_users > 1")


def describe_table(df: DataFrame) -> DataFrame:
    return df.summary()
