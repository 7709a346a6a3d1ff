"""Analyst playbook: digit law, robust z per cohort, duplicate references, round-amount spikes, fuzzy names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions.scalar import clean_key
from inquest.operators.keyed import quantile_by_key
from inquest.session import cut_lineage


def first_digits(df: DataFrame, amount: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, digit, n, share, expected, chi2): leading digits 1 to 9 of the amounts beside the law log10(1 + 1/d).

    Amounts that are null, zero or no number have no leading digit; signs do not count. ``chi2`` is a digit's part of
    the test statistic. All digits are there, also those that no amount has.
    """
    keys = keys or []
    digits = F.regexp_extract(F.format_string("%.6e", F.abs(F.col(amount).try_cast("double"))), "^([1-9])", 1).try_cast("int")
    counts = df.select(*keys, digits.alias("digit")).dropna(subset=["digit"]).groupBy(*keys, "digit").agg(F.count("*").alias("n"))
    # One row per key: nine conditional sums make every digit appear.
    spread = counts.groupBy(*keys).agg(F.sum("n").alias("total"), *(F.coalesce(F.sum(F.when(F.col("digit") == d, F.col("n"))), F.lit(0)).alias(f"d{d}") for d in range(1, 10)))
    rows = spread.select(*keys, "total", F.explode(F.array(*(F.struct(F.lit(d).alias("digit"), F.col(f"d{d}").alias("n")) for d in range(1, 10)))).alias("x")).select(*keys, "total", "x.digit", "x.n")
    expected = F.log10(1 + 1 / F.col("digit"))
    rows = rows.filter("total > 0").withColumns({"share": F.col("n") / F.col("total"), "expected": expected})
    wanted = F.col("total") * F.col("expected")
    return rows.withColumn("chi2", (F.col("n") - wanted) * (F.col("n") - wanted) / wanted).drop("total")


# Fixed value: a normal distribution's median absolute deviation in standard deviations.
MAD_SCALE = 0.6745


def robust_z(df: DataFrame, cohort: str, value: str) -> DataFrame:
    """All rows with ``median``, ``mad`` and ``robust_z`` = 0.6745 (value - median) / mad of their cohort.

    Both medians are exact and taken by a sketch that is refined, so one cohort may hold nearly all rows; only one row
    per cohort is joined back. A deviation of nothing gives a null z. Rows without a cohort or a number have nulls.
    """
    v = F.col(value).try_cast("double")
    slim = df.select(cohort, v.alias("_v"))
    medians = cut_lineage(quantile_by_key(slim, [cohort], "_v", 0.5, "median"))
    spread = slim.join(medians, cohort).select(cohort, F.abs(F.col("_v") - F.col("median")).alias("_d"))
    scale = cut_lineage(medians.join(quantile_by_key(spread, [cohort], "_d", 0.5, "mad"), cohort, "left"))
    z = F.when((F.col("mad") > 0) & v.isNotNull(), MAD_SCALE * (v - F.col("median")) / F.col("mad"))
    return df.join(scale, cohort, "left").withColumn("robust_z", z)


def duplicate_refs(df: DataFrame, ref: str, account: str, amount: str) -> DataFrame:
    """(ref, rows, accounts, amounts, total): references on more than one row.

    References are compared without case, spaces and punctuation, so a receipt typed twice is found. Accounts and amounts are
    distinct counts, made by (ref, account) and (ref, amount) first, so one reference may be on most rows.
    """
    plain = F.nullif(F.upper(F.regexp_replace(clean_key(F.col(ref)), "[^0-9A-Za-z]", "")), F.lit(""))
    rows = df.select(plain.alias("ref"), clean_key(F.col(account)).alias("account"), F.col(amount).try_cast("double").alias("amount")).filter("ref IS NOT NULL")
    totals = rows.groupBy("ref").agg(F.count("*").alias("rows"), F.sum("amount").alias("total")).filter("rows > 1")
    of = lambda c: rows.groupBy("ref", c).agg(F.count("*").alias("k")).groupBy("ref").agg(F.count(c).alias(f"{c}s"))
    return totals.join(of("account"), "ref").join(of("amount"), "ref").select("ref", "rows", "accounts", "amounts", "total")


def round_amount_spikes(df: DataFrame, account: str, amount: str, period: Column, unit: int = 100, min_round: int = 3, factor: float = 2.0) -> DataFrame:
    """(account, period, n, round_n, share, usual): periods in which an account's round amounts stand out.

    An amount is round if ``unit`` divides it. A period stands out with ``min_round`` round amounts and a share of at
    least ``factor`` times the account's share in its other periods; an account without other periods has no usual share and none that stand out.
    """
    v = F.col(amount).try_cast("decimal(38,6)")
    rows = df.select(clean_key(F.col(account)).alias("account"), period.alias("period"), v.alias("v")).filter("account IS NOT NULL AND period IS NOT NULL AND v IS NOT NULL")
    per = rows.groupBy("account", "period").agg(F.count("*").alias("n"), F.count_if((F.col("v") != 0) & (F.col("v") % unit == 0)).alias("round_n"))
    per = cut_lineage(per)
    whole = per.groupBy("account").agg(F.sum("n").alias("all_n"), F.sum("round_n").alias("all_round"))
    share, usual = F.col("round_n") / F.col("n"), (F.col("all_round") - F.col("round_n")) / (F.col("all_n") - F.col("n"))
    out = per.join(whole, "account").filter("all_n > n").withColumns({"share": share, "usual": usual})
    return out.filter((F.col("round_n") >= min_round) & (F.col("share") >= factor * F.col("usual"))).select("account", "period", "n", "round_n", "share", "usual")


GRAM = 2


def fuzzy_name_pairs(df: DataFrame, name: str, distance: int = 2, chunk: int = 2000) -> DataFrame:
    """(name_a, name_b, distance): distinct names, letters and digits in lower case, within ``distance`` edits of each other.

    Only names of more than ``GRAM * (distance - 1) + 1`` characters take part: two such names within the distance share one
    of the first ``GRAM * distance + 1`` of their q-grams in the order of rarity, since each edit spoils at most ``GRAM`` of them. So
    only those few rare q-grams of a name are joined, never the frequent ones. A q-gram that many names have among
    their rarest all the same is cut into chunks by a hash, and each two chunks meet once, in a task of their own.
    """
    plain = F.lower(F.regexp_replace(F.col(name), r"[^\p{L}\p{N}]", ""))
    names = cut_lineage(df.select(plain.alias("s")).filter(F.length("s") > GRAM * (distance - 1) + 1).distinct().withColumn("id", F.monotonically_increasing_id()))
    padded = F.concat(F.lit("\u0001" * (GRAM - 1)), "s", F.lit("\u0002" * (GRAM - 1)))
    grams = names.select("id", "s", F.explode(F.transform(F.sequence(F.lit(1), F.length(padded) - GRAM + 1), lambda i: F.substring(padded, i, F.lit(GRAM)))).alias("g"))
    # A q-gram that comes twice in a name is two, so that names are sets of them.
    times = grams.groupBy("id", "s", "g").agg(F.count("*").alias("k")).select("id", "s", "g", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("k"))
    grams = cut_lineage(times.select("id", "s", F.concat_ws(":", "g", "k").alias("g")))
    df_of = grams.groupBy("g").agg(F.count("*").alias("df"))
    # A name's q-grams are as many as its characters, so its list is short.
    rare = grams.join(df_of, "g").groupBy("id", "s").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("gs"))
    prefix = cut_lineage(rare.select("id", "s", F.explode(F.slice("gs", 1, GRAM * distance + 1)["g"]).alias("g")))
    sizes = prefix.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    placed = prefix.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    left = placed.select("g", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"), F.col("s").alias("name_a"))
    right = placed.select("g", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.col("own").alias("j"), F.col("s").alias("name_b"))
    met = left.join(right, ["g", "i", "j"]).filter((F.col("name_a") < F.col("name_b")) & (F.abs(F.length("name_a") - F.length("name_b")) <= distance))
    # The distance is cheaper than a shuffle of all that met.
    close = met.withColumn("distance", F.levenshtein("name_a", "name_b", distance)).filter("distance >= 0")
    return close.select("name_a", "name_b", "distance").distinct()
