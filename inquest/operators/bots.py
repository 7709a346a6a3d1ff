"""Signup clusters: bursts, shared devices and networks, throw-away mail, odd handles.

Every rule names a group key for a row. All rules run in one pass: a row turns
into its (rule, key) entries, each with the facets the rule counts (account, ip,
name, mail address). Facet values are made distinct first, spread by value, and
only then counted per key, so one huge cluster is shared by all tasks.

Findings come as two tables. ``clusters`` has one row per cluster; ``members`` has
one row per cluster and account, whole for any size. No member list is ever built
in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions import scalar as S
from inquest.operators.relational import consecutive_suffixes, share_of_total, window_counts, with_membership
from inquest.roles import ColumnRoles
from inquest.session import cut_lineage


@dataclass(frozen=True)
class BotParams:
    burst_min_accounts: int = 8
    burst_window_minutes: int = 1
    infra_min_size: int = 5
    disposable_min_size: int = 2
    gmail_dot_min_size: int = 4
    high_entropy_min: float = 4.25
    high_entropy_len_min: int = 10
    chrome_stale_below: int = 115
    # Optional top-k per rule; off unless set.
    max_clusters_per_rule: int | None = None


# Signals per rule, and the extra one a rule can add.
SIGNALS = {
    "time_burst": ("TIME_BURST", "SEQUENTIAL_ID_PATTERN"),
    "humanoid_bot_ring": ("HUMANOID_BOT_RING,CANVAS_HARDWARE_COLLISION", None),
    "infrastructure_ua": ("SHARED_SUBNET_UA", "STALE_CHROME_UA"),
    "infrastructure_canvas": ("SHARED_SUBNET_CANVAS", None),
    "disposable_email": ("DISPOSABLE_EMAIL_DOMAIN", None),
    "gmail_dot_trick": ("GMAIL_DOT_VARIANTS", None),
    "high_entropy_email_subnet": ("HIGH_ENTROPY_LOCAL,INFRA_GEO_CONTEXT", None),
}
# Texts of the hardware verdict.
SPOOFING_LABEL = "High-Confidence Hardware Spoofing Ring"
VERDICT_CRITICAL = "CRITICAL: HARDWARE SPOOFING DETECTED"
VERDICT_RING = "Verified Bot Ring (High Confidence)"
VERDICT_STRONG = "Strong Hardware Concentration"
VERDICT_REVIEW = "Review Canvas / IP Distribution"

RULES = (
    "time_burst",
    "humanoid_bot_ring",
    "infrastructure_ua",
    "infrastructure_canvas",
    "disposable_email",
    "gmail_dot_trick",
    "high_entropy_email_subnet",
)
KEY = ["cluster_type", "cluster_key"]


def _slot(ts: Column, minutes: int) -> Column:
    start = S.truncate_ts(ts, "minute") if minutes == 1 else S.truncate_ts(ts, f"{minutes} minutes")
    return F.date_format(start, "yyyy-MM-dd HH:mm:ss")


def facets(df: DataFrame, roles: ColumnRoles, p: BotParams, rules: tuple[str, ...] = RULES) -> DataFrame:
    """Distinct (cluster_type, cluster_key, facet, value) over the rules, from one scan."""
    role_columns = {
        "account": roles.user, "ts": roles.timestamp, "ip": roles.ip, "ua": roles.user_agent,
        "fp": roles.fingerprint, "email": roles.email, "name": roles.name,
    }
    picked = [F.col(c).alias(r) if c else F.lit(None).cast("string").alias(r) for r, c in role_columns.items()]
    rows = df.select(*picked)
    if roles.timestamp and df.schema[roles.timestamp].dataType.typeName() == "string":
        rows = rows.withColumn("ts", S.parse_ts_tolerant(F.col("ts")))
    slim = rows.filter(F.col("ts").isNotNull()).select(
        S.text(F.col("account")).alias("account"), _slot(F.col("ts"), p.burst_window_minutes).alias("slot"),
        S.text(F.col("ip")).alias("ip"), S.ipv4_subnet24(F.col("ip")).alias("subnet"), S.text(F.col("ua")).alias("ua"),
        S.text(F.col("fp")).alias("fp"), S.clean_key(F.col("fp")).alias("fp_key"), S.text(F.col("name")).alias("name"),
        S.text(F.col("email")).alias("email"), S.email_local(F.col("email")).alias("local"), S.email_domain(F.col("email")).alias("domain"),
    )
    dotless = F.col("domain").isin(*S.DOTLESS_DOMAINS)
    gibberish = (F.length("local") >= p.high_entropy_len_min) & (S.shannon_entropy(F.col("local")) >= p.high_entropy_min)
    normal = F.nullif(S.gmail_normal_local(F.col("local"), F.col("domain")), F.lit(""))
    bar = F.lit(" | ")
    keys = {
        "time_burst": F.col("slot"),
        "humanoid_bot_ring": F.col("fp_key") if roles.ip else F.lit(None),
        "infrastructure_ua": F.concat("subnet", bar, "ua"),
        "infrastructure_canvas": F.concat("subnet", bar, "fp"),
        "disposable_email": F.when(S.is_disposable(F.col("domain")), F.col("domain")),
        "gmail_dot_trick": F.when(dotless, F.concat(normal, F.lit("@"), "domain")),
        "high_entropy_email_subnet": F.when(gibberish, F.col("subnet")),
    }
    counted = {"humanoid_bot_ring": ("ip", "name"), "gmail_dot_trick": ("email",)}
    entries = []
    for rule in rules:
        for facet in ("account", *counted.get(rule, ())):
            value = F.col(facet)
            entries.append(
                F.when(
                    keys[rule].isNotNull() & value.isNotNull(),
                    F.struct(F.lit(rule).alias("cluster_type"), keys[rule].cast("string").alias("cluster_key"), F.lit(facet).alias("facet"), value.alias("value")),
                )
            )
    long = slim.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*")
    return long.distinct()


def _signals(p: BotParams) -> Column:
    stale = S.chrome_is_stale(F.element_at(F.split("cluster_key", r" \| "), 2), p.chrome_stale_below)
    extra = {"time_burst": F.col("sequential"), "infrastructure_ua": stale}
    out = F.lit(None).cast("string")
    for rule, (base, more) in SIGNALS.items():
        text = F.when(extra[rule], f"{base},{more}").otherwise(base) if more else F.lit(base)
        out = F.when(F.col("cluster_type") == rule, text).otherwise(out)
    return out


def _qualifies(roles: ColumnRoles, p: BotParams) -> Column:
    rule, n = F.col("cluster_type"), F.col("size")
    ring_min = max(5, p.infra_min_size)
    if roles.name:
        spread = (F.col("n_ip") >= 3) & (F.col("n_name") >= 3)
    else:
        spread = F.col("n_ip") >= 5
    return (
        F.when(rule == "time_burst", n >= p.burst_min_accounts)
        .when(rule == "humanoid_bot_ring", (n >= ring_min) & spread)
        .when(rule.isin("infrastructure_ua", "infrastructure_canvas"), n >= p.infra_min_size)
        .when(rule == "disposable_email", n >= p.disposable_min_size)
        .when(rule == "gmail_dot_trick", (n >= 2) & ((n >= p.gmail_dot_min_size) | (F.col("n_email") >= p.gmail_dot_min_size)))
        .otherwise(n >= max(3, p.infra_min_size // 2))
    )


def _sized(entries: DataFrame, roles: ColumnRoles, p: BotParams) -> DataFrame:
    per = entries.groupBy(*KEY).agg(
        F.count_if(F.col("facet") == "account").alias("size"),
        *[F.count_if(F.col("facet") == f).alias(f"n_{f}") for f in ("ip", "name", "email")],
    )
    kept = per.filter(_qualifies(roles, p))
    if p.max_clusters_per_rule:
        from inquest.operators.keyed import top_per_key

        kept = top_per_key(kept, ["cluster_type"], [F.col("size").desc(), F.col("cluster_key")], p.max_clusters_per_rule).drop("rank")
    return kept


def members(df: DataFrame, roles: ColumnRoles, p: BotParams = BotParams(), rules: tuple[str, ...] = RULES) -> DataFrame:
    """(cluster_type, cluster_key, account_id) of every qualified cluster. The table is read once; its facets are written."""
    return _members(cut_lineage(facets(df, roles, p, rules)), roles, p)


def _members(entries: DataFrame, roles: ColumnRoles, p: BotParams) -> DataFrame:
    accounts = entries.filter("facet = 'account'").select(*KEY, F.col("value").alias("account_id"))
    return accounts.join(_sized(entries, roles, p).select(*KEY), KEY, "left_semi")


def clusters(df: DataFrame, roles: ColumnRoles, p: BotParams = BotParams(), rules: tuple[str, ...] = RULES) -> DataFrame:
    """One row per cluster: type, key, size, signals, and the counts behind them. The table is read once; its facets are written."""
    entries = cut_lineage(facets(df, roles, p, rules))
    sized = _sized(entries, roles, p)
    if "time_burst" in rules:
        bursts = _members(entries.filter("cluster_type = 'time_burst'"), roles, p)
        runs = consecutive_suffixes(bursts, "account_id", KEY).select(*KEY).distinct().withColumn("sequential", F.lit(True))
        marked = sized.join(runs, KEY, "left").withColumn("sequential", F.coalesce("sequential", F.lit(False)))
    else:
        marked = sized.withColumn("sequential", F.lit(False))
    ring, dots = F.col("cluster_type") == "humanoid_bot_ring", F.col("cluster_type") == "gmail_dot_trick"
    return marked.select(
        *KEY, "size", _signals(p).alias("signals"),
        F.when(ring, F.col("n_ip")).alias("distinct_ips"), F.when(ring, F.col("n_name")).alias("distinct_names"),
        F.when(dots, F.col("n_email")).alias("raw_addresses"),
    )


def flagged_users(df: DataFrame, roles: ColumnRoles, p: BotParams = BotParams()) -> DataFrame:
    """Distinct accounts in any cluster."""
    return members(df, roles, p).select("account_id").distinct()


def sequential_ids(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Handle prefixes that count up, over all accounts of the table."""
    return consecutive_suffixes(df.select(roles.user), roles.user)


# Fixed value: share of flagged users in five minutes that raises the alert.
WINDOW_ALERT_PCT = 40.0


def ratio_5m(df: DataFrame, roles: ColumnRoles, flagged: DataFrame) -> DataFrame:
    """Users, flagged users and percentages per five minutes."""
    rows = df.select(S.truncate_ts(F.col(roles.timestamp), "5 minutes").alias("window_start"), S.clean_key(F.col(roles.user)).alias("uid"))
    rows = rows.filter("uid IS NOT NULL AND window_start IS NOT NULL")
    counts = window_counts(with_membership(rows, "uid", flagged, "bot"), "window_start", "uid", "bot")
    pct = 100.0 * F.col("bot_users") / F.col("total_users")
    return counts.select(
        "window_start", "total_users", "bot_users", (F.col("total_users") - F.col("bot_users")).alias("human_users"),
        pct.alias("bot_pct"), (100.0 - pct).alias("human_pct"), (pct > WINDOW_ALERT_PCT).alias("alert"),
    )


# ---- one fingerprint, many addresses -------------------------------------------


def canvas_distribution(df: DataFrame, roles: ColumnRoles, top: int | None = 12) -> DataFrame:
    """Fingerprints by rows: share of all rows and distinct addresses."""
    per = df.filter(F.col(roles.fingerprint).isNotNull()).groupBy(S.text(F.col(roles.fingerprint)).alias("fingerprint")).agg(
        F.count("*").alias("row_count"), F.count_distinct(roles.ip).alias("distinct_ips")
    )
    total = df.agg(F.count("*")).scalar()
    out = per.withColumn("share_pct", 100.0 * F.col("row_count") / total)
    return out.orderBy(F.col("row_count").desc(), "fingerprint").limit(top) if top else out


def _diverse(share: float, floor: int, ratio: float) -> Column:
    return (F.col("share_pct") >= share) & (F.col("distinct_ips") >= F.greatest(F.lit(floor), F.floor(ratio * F.col("row_count"))))


def hardware_spoofing(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """The top fingerprint, if it covers nearly all rows from many addresses."""
    top = canvas_distribution(df, roles, 1)
    hit = _diverse(95.0, 5, 0.45) & (F.col("row_count") >= 5)
    return top.filter(hit).withColumn("label", F.lit(SPOOFING_LABEL))


def hardware_forensics(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """One row on the dominant fingerprint: addresses, accounts, verdict, and whether to pin it."""
    # One pass over the table, then one row per fingerprint; rows without one count among all rows.
    user = F.count_distinct(roles.user) if roles.user else F.count("*")
    per = df.groupBy(S.text(F.col(roles.fingerprint)).alias("fingerprint")).agg(F.count("*").alias("row_count"), F.count_distinct(roles.ip).alias("distinct_ips"), user.alias("accounts"))
    per = cut_lineage(per)
    n_rows, n_prints = per.agg(F.sum("row_count")).scalar(), per.agg(F.count("fingerprint")).scalar()
    top = per.filter("fingerprint IS NOT NULL").orderBy(F.col("row_count").desc(), "fingerprint").limit(1)
    top, accounts = top.withColumn("share_pct", 100.0 * F.col("row_count") / n_rows), F.col("accounts")
    spoofed = _diverse(95.0, 5, 0.45) & (F.col("row_count") >= 5)
    critical = (F.col("share_pct") >= 99.5) | ((n_prints == 1) & (F.col("row_count") >= 0.99 * n_rows))
    pin = spoofed | _diverse(90.0, 5, 0.0) & (F.col("distinct_ips") >= F.greatest(F.lit(3), F.floor(0.15 * F.col("row_count"))))
    verdict = (
        F.when(critical, VERDICT_CRITICAL).when(spoofed, VERDICT_RING)
        .when(F.col("share_pct") >= 80.0, VERDICT_STRONG).otherwise(VERDICT_REVIEW)
    )
    rotation = F.col("distinct_ips") >= F.greatest(F.lit(10), F.floor(F.col("row_count") / 2))
    return top.select(
        "fingerprint", "row_count", "distinct_ips", accounts.alias("distinct_accounts"), "share_pct",
        critical.alias("critical"), verdict.alias("verdict"), pin.alias("pin_eligible"), rotation.alias("proxy_rotation"),
    )


def hardware_addresses(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """The distinct addresses behind the dominant fingerprint, one row each."""
    top = canvas_distribution(df, roles, 1).select(F.col("fingerprint").alias(roles.fingerprint))
    # One row by construction, so the broadcast does not grow with the data.
    rows = df.join(F.broadcast(top), roles.fingerprint, "left_semi")
    return rows.select(S.clean_key(F.col(roles.ip)).alias("ip")).filter("ip IS NOT NULL").distinct()


def primary_signal(cluster_rows: DataFrame) -> DataFrame:
    """One row: ``canvas_hardware`` if any ring was found, with the widest address spread."""
    ring = F.col("cluster_type") == "humanoid_bot_ring"
    return cluster_rows.agg(
        F.when(F.coalesce(F.max(ring.cast("int")), F.lit(0)) == 1, "canvas_hardware").alias("primary_signal"),
        F.max(F.when(ring, F.col("distinct_ips"))).alias("top_distinct_ips"),
    )


def degraded_report(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """What is left without time or user column: reason codes and the fingerprint verdict."""
    reasons = [r for r, c in (("missing_timestamp_column", roles.timestamp), ("missing_user_id_column", roles.user)) if not c]
    if roles.timestamp:
        # The table has a time column; it is the reason only if nothing in it can be read.
        readable = df.agg(F.count(S.parse_ts_tolerant(F.col(roles.timestamp)))).scalar()
        late = F.when(readable == 0, F.lit("no_parseable_timestamps"))
    else:
        late = F.lit(None).cast("string")
    code = F.concat_ws(",", *[F.lit(r) for r in reasons], late)
    return hardware_forensics(df, roles).withColumn("degraded_reason", F.coalesce(F.nullif(code, F.lit("")), F.lit("unknown")))
