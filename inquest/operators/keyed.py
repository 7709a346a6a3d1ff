"""Per-key windows, quantiles and member lists that survive one very large key.

A plain window hands every row of a key to one task. The functions here first
cut a key into buckets along its order column, work inside the buckets, and
carry a small summary from bucket to bucket. Only the summaries of a key, one
row per bucket, ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inquest.functions.scalar import epoch_us
from inquest.session import cut_lineage

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


def trailing_count(df: DataFrame, keys: list[str], ts: str, span_us: int) -> DataFrame:
    """(keys, ts, n, in_window): rows per key and instant, and rows in ``[ts - span, ts]``.

    Equal instants are merged first. An instant is then placed in its own slot of
    one span's width and, as context only, in the next; a window per (key, slot)
    sees all that can lie within one span back. Rows without a key or a time belong
    to nobody and have no row here.
    """
    merged = df.dropna(subset=[*keys, ts]).groupBy(*keys, ts).agg(F.count("*").alias("n"))
    at = merged.withColumn("_us", epoch_us(F.col(ts)))
    home = F.floor(F.col("_us") / span_us)
    placed = at.withColumn("_home", home).withColumn("_slot", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = W.partitionBy(*keys, "_slot").orderBy("_us").rangeBetween(-span_us, 0)
    counted = placed.withColumn("in_window", F.sum("n").over(w)).filter("_slot = _home")
    return counted.select(*keys, ts, "n", "in_window")


#: A key with more rows is cut by quantiles of its times, not by days alone.
BUSY_ROWS = 100_000
#: Quantiles of a busy key; a bucket has about so small a part of its rows.
BUSY_CUTS = 1000


def with_time_buckets(df: DataFrame, keys: list[str], us: str, bucket_us: int = DAY_US, busy_rows: int = BUSY_ROWS, cuts: int = BUSY_CUTS) -> DataFrame:
    """Adds ``_slot`` and ``_sub``, which rise with the time ``us`` within a key: the day, and in a busy key the quantile in it.

    Equal times of a key are in one bucket. Keys are counted first; only for the busy ones a sketch of their times is
    made, and written, so that every use of the result agrees on it. Rows without a key must not come here.
    """
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > busy_rows).select(*keys)
    busy = df.select(*keys, us).join(cut_lineage(sizes), keys, "left_semi")
    marks = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    found = busy.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(us, marks, F.lit(SKETCH))).alias("_cuts"))
    # Cuts are joined by day, so a row looks through those of its day alone.
    day = F.floor(F.col("_cut") / bucket_us)
    by_day = cut_lineage(found.select(*keys, F.explode("_cuts").alias("_cut")).groupBy(*keys, day.alias("_slot")).agg(F.sort_array(F.collect_list("_cut")).alias("_cuts")))
    placed = df.withColumn("_slot", F.floor(F.col(us) / bucket_us)).join(by_day, [*keys, "_slot"], "left")
    below = F.size(F.filter("_cuts", lambda c: c < F.col(us)))
    return placed.withColumn("_sub", F.when(F.col("_cuts").isNull(), 0).otherwise(below)).drop("_cuts")


def previous_row(
    df: DataFrame, keys: list[str], ts: str, payload: list[str], tie: str, bucket_us: int = DAY_US, name: str = "previous", usable: Column | None = None, busy_rows: int = BUSY_ROWS
) -> DataFrame:
    """Adds struct ``name`` with ``ts``, ``tie`` and ``payload`` of the latest row strictly before.

    Rows where ``usable`` is false get an answer but are never one. Rows of one
    instant do not see each other. A row without a key gets no answer and is none; it takes part in nothing.
    A key's rows are worked on in buckets of time, one day at most, and smaller ones where a key has many rows.
    """
    ok, keyed = usable if usable is not None else F.lit(True), F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    seen = F.when(ok, F.struct(F.col("_us").alias("us"), F.col(tie).alias(tie), F.col(ts).alias(ts), *[F.col(c).alias(c) for c in payload]))
    timed = df.withColumn("_us", epoch_us(F.col(ts)))
    known = keyed & F.col("_us").isNotNull()
    rows = with_time_buckets(timed.filter(known), keys, "_us", bucket_us, busy_rows).withColumn("_seen", seen)
    inside = W.partitionBy(*keys, "_slot", "_sub").orderBy("_us").rangeBetween(W.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.max("_seen").over(inside))
    # One row per key and bucket: the last usable row of all earlier buckets.
    heads = rows.groupBy(*keys, "_slot", "_sub").agg(F.max("_seen").alias("_last"))
    before = W.partitionBy(*keys).orderBy("_slot", "_sub").rowsBetween(W.unboundedPreceding, -1)
    carry = heads.withColumn("_carry", F.max("_last").over(before)).drop("_last")
    joined = local.join(carry, [*keys, "_slot", "_sub"], "left")
    prev = F.coalesce("_local", "_carry")
    packed = F.when(prev.isNotNull(), F.struct(prev[ts].alias(ts), prev[tie].alias(tie), *[prev[c].alias(c) for c in payload]))
    found = joined.withColumn(name, packed).select(*df.columns, name)
    none = timed.filter(~F.coalesce(known, F.lit(False))).select(*df.columns, F.lit(None).cast(found.schema[name].dataType).alias(name))
    return found.unionByName(none)


#: Rank error of the sketch is one in so many rows; keys of fewer rows are ranked whole.
SKETCH = 10_000


def quantile_by_key(df: DataFrame, keys: list[str], value: str, q: float, name: str = "quantile") -> DataFrame:
    """Exact continuous quantile per key.

    A sketch per key, combined on the map side, gives two values that the wanted ranks surely lie between; rows
    below are counted, and only the few values between are ranked. So one key may hold nearly all rows, in any
    range of values. Rows without a key have no quantile.
    """
    v = F.col(value).try_cast("double")
    rows = df.select(*keys, v.alias("_v")).dropna()
    ends = F.array(F.lit(max(0.0, q - 3 / SKETCH)), F.lit(min(1.0, q + 3 / SKETCH)))
    sketch = rows.groupBy(*keys).agg(F.percentile_approx("_v", ends, F.lit(SKETCH)).alias("_c"), F.count("*").alias("_total"))
    few = F.col("_total") <= SKETCH
    sketch = sketch.select(*keys, "_total", F.when(few, float("-inf")).otherwise(F.col("_c")[0]).alias("_from"), F.when(few, float("inf")).otherwise(F.col("_c")[1]).alias("_to"))
    near = rows.join(sketch, keys).filter("_v <= _to")
    # Values below the range are one row per key, under the name of the range's beginning.
    below = F.col("_v") < F.col("_from")
    counts = near.groupBy(*keys, "_total", below.alias("_below"), F.when(~below, F.col("_v")).alias("_v")).agg(F.count("*").alias("_n"))
    upto = W.partitionBy(*keys).orderBy(F.desc("_below"), "_v").rowsBetween(W.unboundedPreceding, 0)
    placed = counts.withColumn("_at", F.sum("_n").over(upto) - F.col("_n")).filter("NOT _below")
    at = (F.col("_total") - 1) * F.lit(float(q))
    placed = placed.withColumns({"_lo": F.floor(at), "_hi": F.ceil(at), "_frac": at - F.floor(at)})
    holds = lambda rank: (F.col(rank) >= F.col("_at")) & (F.col(rank) < F.col("_at") + F.col("_n"))
    found = placed.groupBy(*keys).agg(
        F.max(F.when(holds("_lo"), F.col("_v"))).alias("_vlo"), F.max(F.when(holds("_hi"), F.col("_v"))).alias("_vhi"), F.max("_frac").alias("_frac")
    )
    return found.select(*keys, (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")).alias(name))


def packed_members(df: DataFrame, keys: list[str], member: str, chunk: int = 1000) -> DataFrame:
    """(keys, group_size, chunk_no, members): distinct members in sorted arrays of about ``chunk``.

    A group of any size is whole, spread over as many rows as it needs.
    """
    pairs = df.select(*keys, member).filter(F.col(member).isNotNull()).distinct()
    sizes = pairs.groupBy(*keys).agg(F.count("*").alias("group_size"))
    placed = pairs.join(sizes, keys).withColumn("chunk_no", F.pmod(F.xxhash64(member), F.ceil(F.col("group_size") / chunk)).cast("int"))
    return placed.groupBy(*keys, "group_size", "chunk_no").agg(F.array_sort(F.collect_list(member)).alias("members"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark cuts each task's rows to ``n`` per key before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def running_total(df: DataFrame, order: str, values: list[str], band: Column) -> DataFrame:
    """Adds ``cum_<v>``: totals over all rows with ``order`` >= the row's own, with no global window.

    ``band`` is a whole number that grows with ``order`` and takes few values. Rows
    are summed inside their band; band totals, one row each, give the offsets.
    """
    rows = df.withColumn("_band", band)
    inside = W.partitionBy("_band").orderBy(F.col(order).desc()).rangeBetween(W.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(v).over(inside).alias(f"_in_{v}") for v in values])
    totals = rows.groupBy("_band").agg(*[F.sum(v).alias(f"_all_{v}") for v in values])
    above = W.orderBy(F.col("_band").desc()).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("_band", *[F.coalesce(F.sum(f"_all_{v}").over(above), F.lit(0)).alias(f"_off_{v}") for v in values])
    joined = local.join(offsets, "_band")
    return joined.withColumns({f"cum_{v}": F.col(f"_in_{v}") + F.col(f"_off_{v}") for v in values}).drop(
        "_band", *[f"_in_{v}" for v in values], *[f"_off_{v}" for v in values]
    )


def global_row_number(df: DataFrame, order: str, tie: str, cuts: int | None = None, name: str = "row_number") -> DataFrame:
    """1-based position over the whole table, without moving all rows to one task.

    Quantiles of the order column, from one sketch, cut the table into bands of about
    equal size. A value so frequent that it is a cut twice gets bands of its own,
    made from quantiles of ``tie``; so even a constant order column is spread. Both
    columns are numeric and filled. There are as many bands as shuffle partitions, 64 at least.
    """
    cuts = cuts or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    sketch = df.agg(F.struct(F.percentile_approx(order, marks, F.lit(10_000)).alias("o"), F.percentile_approx(tie, marks, F.lit(10_000)).alias("t")).alias("c"))
    key, second = F.col(order), F.col(tie)
    # The cuts, ``2 * cuts`` numbers, become constants: both uses below must agree on
    # them, and two runs of a sketch need not.
    found = sketch.first()["c"]
    if found["o"] is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    first, then = (F.array(*[F.lit(x) for x in found[k]]) for k in ("o", "t"))
    hot = F.size(F.filter(first, lambda c: c == key)) >= 2
    placed = df.withColumns({
        "_band": F.size(F.filter(first, lambda c: c < key)),
        "_hot": hot,
        "_sub": F.when(hot, F.size(F.filter(then, lambda c: c < second))).otherwise(0),
    })
    band = ["_band", "_hot", "_sub"]
    sizes = placed.groupBy(*band).agg(F.count("*").alias("_n"))
    below = W.orderBy(*band).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*band, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    inside = W.partitionBy(*band).orderBy(key, second)
    ranked = placed.withColumn("_in", F.row_number().over(inside)).join(offsets, band)
    return ranked.withColumn(name, F.col("_in") + F.col("_off")).drop(*band, "_in", "_off")
