"""Account takeover: behaviour baselines for all users, and sessions held against them.

A baseline is the few most frequent values per user and attribute. It is counted
per (user, attribute, value) first, so even a user with a third of all rows meets
one task only as a list of distinct values cut to the top few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions import scalar as S
from inquest.operators.keyed import HOUR_US, previous_row, quantile_by_key, top_per_key, trailing_count
from inquest.operators.relational import asof_history, share_of_total
from inquest.roles import ColumnRoles

# Outcome words of a session that got in.
SUCCESS_WORDS = ("success", "true", "1", "ok", "passed", "succeeded", "successful", "completed")
# Kinds of account change that often come before a theft.
SENSITIVE_TYPES = ("password_change", "email_change", "email_update", "mfa_reset", "mfa_disable", "phone_change")
# Severities with their rank.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
# Finding code, compared field, severity, label.
FINDINGS = {
    "IMPOSSIBLE_TRAVEL": ("geo_velocity", "critical", "Geographic anomaly: impossible travel"),
    "USER_AGENT_MISMATCH": ("user_agent", "high", "Device signature: first-time login on this hardware (user agent)"),
    "SCREEN_ENV_MISMATCH": ("screen_resolution", "medium", "Device signature: unfamiliar screen resolution"),
    "HOSTING_OR_PROXY_ISP": ("isp_reputation", "high", "Network type: data center / VPN pattern detected"),
    "ISP_MISMATCH": ("isp", "medium", "Network ISP differs from typical residential history"),
    "NEW_HARDWARE_ID": ("hardware_id", "low", "Device signature: first-time hardware id for this account"),
    "SENSITIVE_CHAIN_HIGH_VALUE": ("account_change_chain", "critical", "Account change followed by high-value movement"),
    "NAVIGATION_SPEED_ANOMALY": ("checkout_duration_seconds", "medium", "Session timing: unusually fast navigation vs baseline"),
}
# Headlines of a session's verdict.
HEADLINE_TRAVEL = "Physically impossible travel vs prior session"
HEADLINE_HIGH = "Elevated account takeover risk"
HEADLINE_MEDIUM = "Moderate environment drift vs baseline"
HEADLINE_LOW = "Limited automated ATO signals"
# Least amount, and multiple of the average, of a high-value movement.
HIGH_VALUE_FLOOR = 500.0
HIGH_VALUE_MULTIPLE = 3
# A checkout this much shorter than a usual session, of at least this length.
SPEED_RATIO = 0.15
SPEED_MIN_MEDIAN = 30
TRAVEL_MPH = 500.0


def top_users(df: DataFrame, user: str, n: int | None = None) -> DataFrame:
    """Users by number of rows; the first one is the best guess for a file about one user."""
    counts = df.select(S.clean_key(F.col(user)).alias(user)).filter(F.col(user).isNotNull()).groupBy(user).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), user).limit(n) if n else counts


def last_sessions(df: DataFrame, roles: ColumnRoles, n: int = 10) -> DataFrame:
    """The latest ``n`` sessions per user, successful ones only where the table has an outcome."""
    rows = df.filter(F.col(roles.user).isNotNull() & F.col(roles.timestamp).isNotNull())
    if roles.outcome:
        rows = rows.filter(F.lower(F.trim(F.col(roles.outcome).cast("string"))).isin(*SUCCESS_WORDS))
    tie = [F.col(roles.row_id).desc()] if roles.row_id else []
    return top_per_key(rows, [roles.user], [F.col(roles.timestamp).desc(), *tie], n)


# ---- baselines -----------------------------------------------------------------


def behavior_profile(df: DataFrame, roles: ColumnRoles, top: int = 5) -> DataFrame:
    """(user, attribute, value, n, rank): most frequent values per user and attribute, ties by value."""
    attributes: dict[str, Column] = {}
    if roles.timestamp:
        attributes["hour"] = F.hour(roles.timestamp).cast("string")
    for name, column in (("user_agent", roles.user_agent), ("isp", roles.isp), ("hardware_id", roles.hardware)):
        if column:
            attributes[name] = F.col(column).cast("string")
    if roles.screen_w and roles.screen_h:
        attributes["screen"] = S.screen_resolution(F.col(roles.screen_w), F.col(roles.screen_h))
    if roles.latitude and roles.longitude:
        attributes["location"] = F.concat_ws(",", *[F.format_string("%.3f", S.round_geo(F.col(c))) for c in (roles.latitude, roles.longitude)])
        attributes["location"] = F.when(F.col(roles.latitude).isNotNull() & F.col(roles.longitude).isNotNull(), attributes["location"])
    cells = F.array(*[F.struct(F.lit(k).alias("attribute"), v.alias("value")) for k, v in attributes.items()])
    long = df.select(S.text(F.col(roles.user)).alias("user"), F.explode(cells).alias("c")).select("user", "c.attribute", "c.value")
    counts = long.filter("user IS NOT NULL AND value IS NOT NULL").groupBy("user", "attribute", "value").agg(F.count("*").alias("n"))
    return top_per_key(counts, ["user", "attribute"], [F.col("n").desc(), F.col("value")], top)


def behavior_stats(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """One row per user: events, amount average and maximum, session length mean and exact median."""
    keyed = df.withColumn("user", S.text(F.col(roles.user))).filter("user IS NOT NULL")
    aggs = [F.count("*").alias("event_count")]
    if roles.amount:
        v = F.col(roles.amount).try_cast("double")
        aggs += [F.avg(v).alias("avg_amount"), F.max(v).alias("max_amount"), F.count("*").alias("samples")]
    if roles.duration:
        aggs.append(F.avg(F.col(roles.duration).try_cast("double")).alias("mean_duration"))
    stats = keyed.groupBy("user").agg(*aggs)
    if roles.duration:
        stats = stats.join(quantile_by_key(keyed, ["user"], roles.duration, 0.5, "median_duration"), "user", "left")
    return stats


def baseline_lists(profile: DataFrame) -> DataFrame:
    """One row per user with short lists: top three agents, screens and networks, up to five devices."""
    def ranked(attribute: str, n: int) -> Column:
        hit = F.when((F.col("attribute") == attribute) & (F.col("rank") <= n), F.struct("rank", "value"))
        return F.transform(F.array_sort(F.collect_list(hit)), lambda s: s["value"])

    # At most five values per attribute are left per user, so the lists are short.
    return profile.groupBy("user").agg(
        ranked("user_agent", 3).alias("top_agents"), ranked("screen", 3).alias("top_screens"),
        ranked("isp", 3).alias("top_isps"), ranked("hardware_id", 5).alias("known_hardware"),
    )


# ---- single checks -------------------------------------------------------------


def agent_mismatch(current: Column, known: Column) -> Column:
    return (F.size(known) > 0) & ~F.exists(known, lambda k: k.contains(current))


def value_mismatch(current: Column, known: Column) -> Column:
    return (F.size(known) > 0) & ~F.array_contains(known, current)


def isp_mismatch(current: Column, known: Column) -> Column:
    low = F.lower(current)
    return (F.size(known) > 0) & ~F.exists(known, lambda k: F.lower(k).contains(low) | low.contains(F.lower(k)))


def event_name(e: Column) -> Column:
    return F.replace(F.lower(e), F.lit(" "), F.lit("_"))


def is_sensitive(name: Column) -> Column:
    return event_name(name).rlike("|".join(SENSITIVE_TYPES))


def has_sensitive_event(events: Column) -> Column:
    return F.coalesce(F.exists(events, lambda e: is_sensitive(e["type"])), F.lit(False))


def high_value(amount: Column, average: Column) -> Column:
    return amount >= F.greatest(F.lit(HIGH_VALUE_FLOOR), average * HIGH_VALUE_MULTIPLE)


def trusted_email(columns: dict[str, Column], events: Column) -> Column:
    """First filled address known before the session, else the old address of a mail change."""
    # Fields that hold an address from before the session.
    order = ("original_email", "pre_change_email", "email_on_file", "registered_email", "trusted_contact_email", "email_before_change")
    filled = [S.clean_key(columns[k]) for k in order if k in columns]

    def mail_change(e: Column) -> Column:
        n = event_name(e["type"])
        return n.contains("email") & n.rlike("change|update|edit") & S.clean_key(e["previous_email"]).isNotNull()

    old = F.trim(F.get(F.filter(events, mail_change), F.lit(0))["previous_email"])
    return F.coalesce(*filled, old)


def travel_speed(df: DataFrame, roles: ColumnRoles, previous: str = "last_login") -> DataFrame:
    """Adds miles, hours and mph from the earlier position in struct ``previous``."""
    p = F.col(previous)
    miles = S.haversine_miles(p[roles.latitude], p[roles.longitude], F.col(roles.latitude), F.col(roles.longitude))
    hours = F.abs(S.epoch_us(F.col(roles.timestamp)) - S.epoch_us(p[roles.timestamp])) / HOUR_US
    return df.withColumn("miles", miles).withColumn("hours", hours).withColumn("mph", F.when(F.col("hours") > 1e-6, F.col("miles") / F.col("hours")))


def impossible_travel(df: DataFrame, roles: ColumnRoles, mph: float = TRAVEL_MPH) -> DataFrame:
    """Consecutive events of a user that no traveller could make; every user in one job."""
    placed = F.col(roles.latitude).isNotNull() & F.col(roles.longitude).isNotNull()
    seen = previous_row(df, [roles.user], roles.timestamp, [roles.latitude, roles.longitude], roles.row_id, name="last_login", usable=placed)
    return travel_speed(seen, roles).filter(F.col("mph") > mph)


def change_then_transfer(events: DataFrame, roles: ColumnRoles, stats: DataFrame, within_us: int = HOUR_US) -> DataFrame:
    """Event-table form of the sensitive chain: a high transfer within an hour after an account change."""
    usable = is_sensitive(F.col(roles.event_type))
    seen = previous_row(events, [roles.user], roles.timestamp, [roles.event_type], roles.row_id, name="change", usable=usable)
    near = F.col("change").isNotNull() & (S.epoch_us(F.col(roles.timestamp)) - S.epoch_us(F.col("change")[roles.timestamp]) <= within_us)
    joined = seen.filter(near).join(stats.select(F.col("user").alias(roles.user), "avg_amount"), roles.user)
    return joined.filter(high_value(F.col(roles.amount), F.col("avg_amount")))


# ---- sessions against baselines --------------------------------------------------


def session_findings(
    sessions: DataFrame,
    history: DataFrame,
    roles: ColumnRoles,
    *,
    mph: float = TRAVEL_MPH,
    events: str | None = None,
    transfer: str | None = None,
    checkout: str | None = None,
    hosting_flag: str | None = None,
    changed_flags: tuple[str, ...] = (),
) -> DataFrame:
    """One row per session and deviation: code, field, severity, label, baseline and current value.

    A check whose columns the tables do not have is skipped; user, time and row id are needed.
    """
    lists = baseline_lists(behavior_profile(history, roles))
    stats = behavior_stats(history, roles)
    positions = [c for c in (roles.latitude, roles.longitude) if c]
    needed = [c for c in ("avg_amount", "median_duration") if c in stats.columns]
    s = sessions
    if len(positions) == 2:
        placed = history.dropna(subset=positions)
        s = travel_speed(asof_history(sessions, placed, roles.user, roles.timestamp, positions, roles.row_id), roles, "as_of")
    s = s.withColumn("user", S.text(F.col(roles.user)))
    joined = s.join(lists, "user", "left").join(stats.select("user", *needed), "user", "left")

    own = lambda c: F.col(c) if c else F.lit(None).cast("string")
    ua, isp = S.clean_key(own(roles.user_agent)), S.clean_key(own(roles.isp))
    screen = S.screen_resolution(F.col(roles.screen_w), F.col(roles.screen_h)) if roles.screen_w and roles.screen_h else F.lit(None).cast("string")
    hw = S.text(own(roles.hardware))
    hosting = F.coalesce(S.is_hosting_isp(isp), F.lit(False))
    if hosting_flag:
        hosting = hosting | F.coalesce(F.col(hosting_flag).cast("boolean"), F.lit(False))
    changed = has_sensitive_event(F.col(events)) if events else F.lit(False)
    for flag in changed_flags:
        changed = changed | F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    amount = S.parse_loose_amount(F.col(transfer)) if transfer else F.lit(None).cast("double")
    csec = F.col(checkout).try_cast("double") if checkout else F.lit(None).cast("double")
    median = F.col("median_duration") if roles.duration else F.lit(None).cast("double")
    avg_amount = F.col("avg_amount") if roles.amount else F.lit(None).cast("double")

    def joined_text(c: str) -> Column:
        return F.array_join(c, "; ")

    tests = {
        "IMPOSSIBLE_TRAVEL": (F.col("mph") > mph, F.concat_ws(",", *[F.format_string("%.4f", F.col("as_of")[c]) for c in positions]), F.concat_ws(",", *[F.format_string("%.4f", F.col(c)) for c in positions])),
        "USER_AGENT_MISMATCH": (agent_mismatch(ua, F.col("top_agents")), joined_text("top_agents"), ua),
        "SCREEN_ENV_MISMATCH": (value_mismatch(screen, F.col("top_screens")), joined_text("top_screens"), screen),
        "HOSTING_OR_PROXY_ISP": (hosting, joined_text("top_isps"), isp),
        "ISP_MISMATCH": (~hosting & isp_mismatch(isp, F.col("top_isps")), joined_text("top_isps"), isp),
        "NEW_HARDWARE_ID": (value_mismatch(hw, F.col("known_hardware")), joined_text("known_hardware"), hw),
        "SENSITIVE_CHAIN_HIGH_VALUE": (changed & high_value(amount, avg_amount), F.format_string("avg %.2f", avg_amount), F.format_string("%.2f", amount)),
        "NAVIGATION_SPEED_ANOMALY": ((median > SPEED_MIN_MEDIAN) & (csec < median * SPEED_RATIO), F.format_string("%.1f", median), F.format_string("%.1f", csec)),
    }
    if len(positions) < 2:
        del tests["IMPOSSIBLE_TRAVEL"]
    found = []
    for code, (hit, base, now) in tests.items():
        field, severity, label = FINDINGS[code]
        found.append(
            F.when(
                hit,
                F.struct(
                    F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity"),
                    F.lit(label).alias("label"), base.alias("baseline_value"), now.alias("current_value"),
                ),
            )
        )
    return joined.select(F.col(roles.row_id).alias("session_id"), "user", F.explode(F.array_compact(F.array(*found))).alias("f")).select("session_id", "user", "f.*")


def risk_scores(findings: DataFrame) -> DataFrame:
    """One row per session with findings: risk, safety, headline."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, r) for s, r in SEVERITY_RANK.items()], F.lit(1))
    per = findings.groupBy("session_id", "user").agg(
        F.count("*").alias("n_flags"),
        F.least(F.lit(100.0), (F.sum(rank) * 12 + F.count("*") * 3).cast("double")).alias("risk"),
        F.max(F.col("code") == "IMPOSSIBLE_TRAVEL").alias("_travel"),
    )
    headline = (
        F.when(F.col("_travel"), HEADLINE_TRAVEL).when(F.col("risk") >= 60, HEADLINE_HIGH)
        .when(F.col("risk") >= 35, HEADLINE_MEDIUM).otherwise(HEADLINE_LOW)
    )
    return per.select("session_id", "user", "n_flags", "risk", (100.0 - F.col("risk")).alias("safety"), headline.alias("headline"))


def canvas_ip_velocity(df: DataFrame, roles: ColumnRoles, min_events: int = 8, top: int | None = 20) -> DataFrame:
    """(user, ip) pairs by their busiest hour."""
    rows = df.select(S.clean_key(F.col(roles.user)).alias("uid"), S.clean_key(F.col(roles.ip)).alias("ip"), F.col(roles.timestamp).alias("ts"))
    counted = trailing_count(rows.filter("uid IS NOT NULL AND ip IS NOT NULL"), ["uid", "ip"], "ts", HOUR_US)
    peaks = counted.groupBy("uid", "ip").agg(F.max("in_window").alias("peak_events_1h")).filter(F.col("peak_events_1h") >= min_events)
    return peaks.orderBy(F.col("peak_events_1h").desc(), "uid", "ip").limit(top) if top else peaks


def dominant_fingerprints(df: DataFrame, roles: ColumnRoles, top: int | None = 12) -> DataFrame:
    shares = share_of_total(df, roles.fingerprint, roles.ip)
    return shares.orderBy(F.col("n_rows").desc(), roles.fingerprint).limit(top) if top else shares
