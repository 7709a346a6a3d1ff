"""Filters, joins, aggregates and set operations in the shapes the detectors need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inquest.functions.scalar import clean_key, is_disputed, norm_postal
from inquest.operators.keyed import DAY_US, previous_row, trailing_count

# ---- filters -----------------------------------------------------------------


def nonempty_pair(df: DataFrame, a: str, b: str, different: bool = False) -> DataFrame:
    """Rows whose two keys are both filled, cleaned, and different where asked."""
    out = df.withColumns({a: clean_key(F.col(a)), b: clean_key(F.col(b))}).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return out.filter(F.col(a) != F.col(b)) if different else out


def search_rows_text(rows: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Distinct (case, file, upload time) of ledger rows that contain the needle in any case."""
    if len(needle.strip()) < 2:
        raise ValueError("a search text has two characters at least")
    want = needle.strip().lower()
    hit = F.lower("row_json").contains(want) | F.lower("source_filename").contains(want)
    found = rows.filter(hit).select("source_case_id", "source_filename", "upload_timestamp").distinct()
    return found.orderBy("upload_timestamp", "source_case_id").limit(limit) if limit else found


def postal_differs(billing: str, shipping: str) -> Column:
    """Both codes are filled and not the same."""
    return F.nullif(norm_postal(F.col(billing)), F.lit("")) != F.nullif(norm_postal(F.col(shipping)), F.lit(""))


def postal_mismatch(df: DataFrame, billing: str, shipping: str, disputed: str) -> DataFrame:
    return df.filter(is_disputed(F.col(disputed)) & postal_differs(billing, shipping))


def activity_after_dispute(df: DataFrame, disputed: str, dispute_date: str, activities: dict[str, str]) -> DataFrame:
    """One row per disputed row and kind of activity that comes later than the dispute."""
    d = F.col(dispute_date)
    kinds = F.array(*[F.when(F.col(c) > d, F.lit(label)) for label, c in activities.items()])
    found = df.filter(is_disputed(F.col(disputed)) & d.isNotNull())
    return found.withColumn("activity", F.explode(F.array_compact(kinds)))


def with_membership(df: DataFrame, key: str, flagged: DataFrame, name: str = "is_member") -> DataFrame:
    """Marks rows whose key is in the flagged set; the set stays a table."""
    marks = flagged.select(F.col(flagged.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
    return df.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


# ---- joins -------------------------------------------------------------------


def matches_clean_history(df: DataFrame, user: str, value: str, disputed: str, ts: str, strictly_prior: bool = True) -> DataFrame:
    """Disputed rows whose (user, value) also occurs on an undisputed row.

    The clean side shrinks to one row per (user, value): its first time. A disputed
    row that is later than this has a prior match, so no range join is needed and
    a hot pair carries one row on the clean side.
    """
    bad = is_disputed(F.col(disputed))
    first_clean = df.filter(~bad & F.col(value).isNotNull()).groupBy(user, value).agg(F.min(ts).alias("_first_clean"))
    joined = df.filter(bad).join(first_clean, [user, value])
    return (joined.filter(F.col("_first_clean") < F.col(ts)) if strictly_prior else joined).drop("_first_clean")


def clean_match_multiplicity(df: DataFrame, user: str, value: str, disputed: str) -> DataFrame:
    """Disputed rows with the number of undisputed rows of the same (user, value), in any order of time."""
    bad = is_disputed(F.col(disputed))
    clean = df.filter(~bad & F.col(value).isNotNull()).groupBy(user, value).agg(F.count("*").alias("clean_rows"))
    return df.filter(bad).join(clean, [user, value])


def window_counts(df: DataFrame, slot: str, user: str, flag: str) -> DataFrame:
    """Distinct users and flagged users per slot in one aggregation."""
    return df.groupBy(slot).agg(
        F.count_distinct(user).alias("total_users"), F.count_distinct(F.when(F.col(flag), F.col(user))).alias("bot_users")
    )


def window_counts_by_join(df: DataFrame, slot: str, user: str, flag: str) -> DataFrame:
    """The same by a left join of two aggregates, missing counts read as 0."""
    total = df.groupBy(slot).agg(F.count_distinct(user).alias("total_users"))
    bots = df.filter(flag).groupBy(slot).agg(F.count_distinct(user).alias("bot_users"))
    return total.join(bots, slot, "left").fillna(0, ["bot_users"])


def trailing_disputes(df: DataFrame, user: str, when: str, days: int = 180) -> DataFrame:
    """(user, when, n, in_window): disputes of a user within ``days`` back from each dispute."""
    return trailing_count(df, [user], when, days * DAY_US)


def last_valid_before(df: DataFrame, user: str, ts: str, lat: str, lon: str, tie: str) -> DataFrame:
    """As-of join with the user's own history: the latest earlier row with a full position."""
    usable = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    return previous_row(df, [user], ts, [lat, lon], tie, name="last_login", usable=usable)


def latest_per_key(df: DataFrame, keys: list[str], ts: str, tie: str, payload: list[str]) -> DataFrame:
    """The latest row per key whatever the time of the session it is compared with."""
    best = F.max(F.struct(ts, tie, *payload))
    return df.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def asof_history(sessions: DataFrame, history: DataFrame, user: str, ts: str, payload: list[str], tie: str) -> DataFrame:
    """As-of join of a separate session table: latest history row strictly before the session.

    Both tables become one stream of rows; history rows alone may be an answer.
    """
    left = sessions.withColumn("_is_session", F.lit(True))
    right = history.select(user, ts, tie, *payload).withColumn("_is_session", F.lit(False))
    both = left.unionByName(right, allowMissingColumns=True)
    seen = previous_row(both, [user], ts, payload, tie, name="as_of", usable=~F.col("_is_session"))
    return seen.filter("_is_session").drop("_is_session")


def shared_value_stars(links: DataFrame, account: str, kinds: dict[str, str]) -> DataFrame:
    """Members of every shared value, each tied to the group's least account.

    Output (kind, value, anchor, account, group_size), values with two accounts and
    more. It is the linear form of "all pairs that share a value": the same groups
    and components, n rows for n members.
    """
    cells = F.array(*[F.struct(F.lit(kind).alias("kind"), clean_key(F.col(c)).alias("value")) for kind, c in kinds.items()])
    long = links.select(clean_key(F.col(account)).alias("account"), F.explode(cells).alias("cell")).select("account", "cell.kind", "cell.value")
    pairs = long.filter("account IS NOT NULL AND value IS NOT NULL").distinct()
    groups = pairs.groupBy("kind", "value").agg(F.count("*").alias("group_size"), F.min("account").alias("anchor")).filter("group_size >= 2")
    return pairs.join(groups, ["kind", "value"]).select("kind", "value", "anchor", "account", "group_size")


# ---- aggregates --------------------------------------------------------------


def count_distinct_by_key(df: DataFrame, keys: list[str], distinct: dict[str, str], having: Column | None = None, approx: bool = False) -> DataFrame:
    """Row and distinct counts per key. Exact counts are spread by (key, value) before they meet."""
    fn = F.approx_count_distinct if approx else F.count_distinct
    out = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *[fn(c).alias(name) for c, name in distinct.items()])
    return out.filter(having) if having is not None else out


def payment_edges(df: DataFrame, payer: str, payee: str, amount: str | None = None) -> DataFrame:
    """One row per (payer, payee): transfer count and total."""
    pairs = nonempty_pair(df, payer, payee)
    aggs = [F.count("*").alias("transfer_count")]
    if amount:
        aggs.append(F.coalesce(F.sum(F.col(amount).try_cast("double")), F.lit(0.0)).alias("total_amount"))
    return pairs.groupBy(F.col(payer).alias("payer"), F.col(payee).alias("payee")).agg(*aggs)


def employee_account_touches(
    df: DataFrame, employee: str, account: str, amount: str | None, min_pair_n: int = 3, amount_threshold: float = 5_000.0
) -> DataFrame:
    """Hot (employee, account) pairs with severity."""
    pairs = nonempty_pair(df, employee, account, different=True)
    money = F.col(amount).try_cast("double") if amount else F.lit(None).cast("double")
    agg = pairs.groupBy(F.col(employee).alias("employee_id"), F.col(account).alias("account_id")).agg(
        F.count("*").alias("touch_count"), F.coalesce(F.sum(money), F.lit(0.0)).alias("total_amount")
    )
    big = F.col("total_amount") >= amount_threshold if amount else F.lit(False)
    hot = agg.filter((F.col("touch_count") >= min_pair_n) | big)
    return hot.withColumn("severity", F.when(big | (F.col("touch_count") >= 3 * min_pair_n), "high").otherwise("medium"))


def amount_stats(df: DataFrame, keys: list[str], amount: str) -> DataFrame:
    v = F.col(amount).try_cast("double")
    return df.groupBy(*keys).agg(F.avg(v).alias("avg_amount"), F.max(v).alias("max_amount"), F.count("*").alias("samples"))


def share_of_total(df: DataFrame, key: str, distinct: str) -> DataFrame:
    """Rows, distinct values and percent of all counted rows per key; the total is a scalar subquery."""
    base = df.select(clean_key(F.col(key)).alias(key), clean_key(F.col(distinct)).alias("_d")).filter(F.col(key).isNotNull() & F.col("_d").isNotNull())
    per_key = base.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_distinct("_d").alias("n_distinct"))
    total = base.agg(F.count("*")).scalar()
    return per_key.withColumn("pct_of_rows", 100.0 * F.col("n_rows") / total)


# ---- order, runs, series -----------------------------------------------------


def consecutive_suffixes(ids: DataFrame, account: str, keys: list[str] | None = None, min_ids: int = 4, min_steps: int = 3) -> DataFrame:
    """Prefixes whose numbered handles run in steps of one.

    A step is a pair (n, n + 1), found by an equality join on the next number, so
    no prefix is sorted in one task.
    """
    keys = keys or []
    shape = r"^([a-zA-Z]+[._-]?)([0-9]{1,6})$"
    s = F.trim(F.col(account).cast("string"))
    handles = ids.filter(s.rlike(shape)).select(
        *keys, F.regexp_extract(s, shape, 1).alias("prefix"), F.regexp_extract(s, shape, 2).cast("int").alias("number"), s.alias("_id")
    )
    numbers = handles.groupBy(*keys, "prefix", "number").agg(F.count_distinct("_id").alias("_ids"))
    nxt = numbers.select(*keys, "prefix", (F.col("number") - 1).alias("number"), F.lit(1).alias("_step"))
    joined = numbers.join(nxt, [*keys, "prefix", "number"], "left")
    per = joined.groupBy(*keys, "prefix").agg(F.sum("_ids").alias("n_ids"), F.count("_step").alias("n_steps"))
    return per.filter((F.col("n_ids") >= min_ids) & (F.col("n_steps") >= min_steps))


def threshold_runs(series: DataFrame, keys: list[str], at: str, value: str, threshold: Column) -> DataFrame:
    """Stretches of a bounded series that stay above, or not above, a threshold."""
    w = W.partitionBy(*keys).orderBy(at)
    above = series.withColumn("above", F.col(value) > threshold)
    starts = above.withColumn("_new", F.coalesce((F.col("above") != F.lag("above").over(w)).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("_new").over(w))
    return runs.groupBy(*keys, "run", "above").agg(F.min(at).alias("start"), F.max(at).alias("stop"), F.count("*").alias("n_points"))


def pad_series(series: DataFrame, keys: list[str], at: str, value: str, last: Column, points: int = 24) -> DataFrame:
    """The last ``points`` filled hours per key, padded on the left with the first value.

    Output (keys, slot, value), slot 0 is the oldest. The input has one row per
    key and hour.
    """
    recent = series.filter(F.col(at) > last - F.expr(f"INTERVAL '{points}' HOUR"))
    w = W.partitionBy(*keys).orderBy(F.col(at).desc())
    placed = recent.withColumn("slot", points - F.row_number().over(w)).filter("slot >= 0")
    first = placed.groupBy(*keys).agg(F.min("slot").alias("_from"), F.min_by(value, at).alias("_first"))
    grid = first.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    return grid.join(placed.select(*keys, "slot", value), [*keys, "slot"], "left").select(
        *keys, "slot", F.when(F.col("slot") < F.col("_from"), F.col("_first")).otherwise(F.col(value)).alias(value)
    )


# ---- sets --------------------------------------------------------------------


def flagged_density(all_rows: DataFrame, user: str, flagged: DataFrame) -> DataFrame:
    """One row: users, flagged users, and the percentage."""
    users = all_rows.select(clean_key(F.col(user)).alias("u")).filter("u IS NOT NULL").agg(F.count_distinct("u").alias("all_users"))
    marks = flagged.agg(F.count_distinct(flagged.columns[0])).scalar()
    return users.select("all_users", marks.alias("flagged_users")).withColumn(
        "density_pct", F.round(100.0 * F.col("flagged_users") / F.greatest(F.col("all_users"), F.lit(1)), 2)
    )
