"""Account-takeover queries: baselines from all rows but purchases, purchases as the sessions to judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.operators import ato as A
from inquest.operators.keyed import HOUR_US
from inquest.plans.registry import query

SESSIONS = ("v_sessions",)


def _roles(t):
    return t.session_roles.with_roles(duration="session_seconds", screen_w="screen_width", screen_h="screen_height", event_type="action")


# Every fifth purchase comes from a strange machine.
STRANGE = "event_id % 5 = 0"
CURRENT = f"""SELECT event_id, acc_id, created_at, latitude, longitude, checkout_seconds, transfer_amount, action, previous_email,
 CASE WHEN {STRANGE} THEN 'curl/8.0' ELSE user_agent END AS user_agent, CASE WHEN {STRANGE} AND isp <> 'OVH Hosting' THEN 'Elsewhere Net' ELSE isp END AS isp,
 CASE WHEN {STRANGE} THEN 'hw_new' ELSE hardware_id END AS hardware_id, screen_width + CASE WHEN {STRANGE} THEN 1 ELSE 0 END AS screen_width, screen_height FROM {{v_sessions}} WHERE event_type = 'purchase'"""


def _current(t):
    rows = t.sql(CURRENT, v_sessions=t.v_sessions)
    event = F.struct(F.col("action").alias("type"), F.col("previous_email").alias("previous_email"))
    return rows.withColumn("events", F.array(event))


def _history(t):
    return t.v_sessions.filter("event_type <> 'purchase'")


PROFILE = """hist AS (SELECT * FROM v_sessions WHERE event_type <> 'purchase'),
cells AS (SELECT acc_id AS "user", unnest(['hour', 'user_agent', 'isp', 'hardware_id', 'screen', 'location']) AS attribute,
 unnest([CAST(hour(created_at) AS VARCHAR), user_agent, isp, hardware_id, CAST(screen_width AS VARCHAR) || 'x' || CAST(screen_height AS VARCHAR), printf('%.3f,%.3f', latitude, longitude)]) AS value FROM hist),
prof AS (SELECT "user", attribute, value, n, CAST(row_number() OVER (PARTITION BY "user", attribute ORDER BY n DESC, value) AS INT) AS "rank" FROM (SELECT "user", attribute, value, count(*) AS n FROM cells GROUP BY ALL) QUALIFY "rank" <= 5)"""
STATS = """stats AS (SELECT acc_id AS "user", count(*) AS event_count, avg(amount) AS avg_amount, max(amount) AS max_amount, count(*) AS samples, avg(session_seconds) AS mean_duration, quantile_cont(session_seconds, 0.5) AS median_duration FROM hist GROUP BY 1)"""
LISTS = """lists AS (SELECT "user", list(value ORDER BY "rank") FILTER (attribute = 'user_agent' AND "rank" <= 3) AS agents, list(value ORDER BY "rank") FILTER (attribute = 'screen' AND "rank" <= 3) AS screens,
 list(value ORDER BY "rank") FILTER (attribute = 'isp' AND "rank" <= 3) AS isps, list(value ORDER BY "rank") FILTER (attribute = 'hardware_id') AS hw FROM prof GROUP BY 1)"""
HAVERSINE = "2 * 3958.7613 * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h)))"


def hav(a: str, b: str) -> str:
    return f"pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)"


JOINED = f"""cur AS ({CURRENT.replace("{v_sessions}", "v_sessions")}),
prior AS (SELECT c.event_id, h.latitude AS plat, h.longitude AS plon, CASE WHEN h.event_id IS NOT NULL THEN {hav('h', 'c')} END AS h, abs(epoch_us(c.created_at) - epoch_us(h.created_at)) / 3600000000.0 AS hours FROM cur c ASOF LEFT JOIN hist h ON c.acc_id = h.acc_id AND c.created_at > h.created_at),
j AS (SELECT c.*, CAST(c.screen_width AS VARCHAR) || 'x' || CAST(c.screen_height AS VARCHAR) AS screen, p.plat, p.plon, CASE WHEN p.hours > 1e-6 THEN {HAVERSINE} / p.hours END AS mph, l.agents, l.screens, l.isps, l.hw, s.avg_amount, s.median_duration
 FROM cur c JOIN prior p ON p.event_id = c.event_id LEFT JOIN lists l ON l."user" = c.acc_id LEFT JOIN stats s ON s."user" = c.acc_id)"""
CASES = {
    "IMPOSSIBLE_TRAVEL": ("mph > 500", "printf('%.4f,%.4f', plat, plon)", "printf('%.4f,%.4f', latitude, longitude)"),
    "USER_AGENT_MISMATCH": ("len(agents) > 0 AND len(list_filter(agents, lambda k: contains(k, user_agent))) = 0", "array_to_string(agents, '; ')", "user_agent"),
    "SCREEN_ENV_MISMATCH": ("len(screens) > 0 AND NOT list_contains(screens, screen)", "array_to_string(screens, '; ')", "screen"),
    "HOSTING_OR_PROXY_ISP": ("isp = 'OVH Hosting'", "array_to_string(isps, '; ')", "isp"),
    "ISP_MISMATCH": ("isp <> 'OVH Hosting' AND len(isps) > 0 AND len(list_filter(isps, lambda k: contains(lower(k), lower(isp)) OR contains(lower(isp), lower(k)))) = 0", "array_to_string(isps, '; ')", "isp"),
    "NEW_HARDWARE_ID": ("len(hw) > 0 AND NOT list_contains(hw, hardware_id)", "array_to_string(hw, '; ')", "hardware_id"),
    "SENSITIVE_CHAIN_HIGH_VALUE": ("action IN ('email_change', 'password_change') AND transfer_amount >= greatest(500.0, avg_amount * 3)", "printf('avg %.2f', avg_amount)", "printf('%.2f', transfer_amount)"),
    "NAVIGATION_SPEED_ANOMALY": ("median_duration > 30 AND checkout_seconds < median_duration * 0.15", "printf('%.1f', median_duration)", "printf('%.1f', checkout_seconds)"),
}


def _case_sql(code: str) -> str:
    hit, base, now = CASES[code]
    field, severity, label = A.FINDINGS[code]
    return f"""SELECT event_id AS session_id, acc_id AS "user", '{code}' AS code, '{field}' AS field, '{severity}' AS severity, '{label}' AS label, {base} AS baseline_value, {now} AS current_value FROM j WHERE {hit}"""


def _findings(t):
    return A.session_findings(_current(t), _history(t), _roles(t), events="events", transfer="transfer_amount", checkout="checkout_seconds")


CHAIN = f"WITH {PROFILE}, {STATS}, {LISTS}, {JOINED}"

for _key, _code in {
    "ato_session_travel": "IMPOSSIBLE_TRAVEL",
    "ato_ua_mismatch": "USER_AGENT_MISMATCH",
    "ato_screen_mismatch": "SCREEN_ENV_MISMATCH",
    "ato_new_hardware": "NEW_HARDWARE_ID",
    "ato_sensitive_chain": "SENSITIVE_CHAIN_HIGH_VALUE",
    "ato_speed_anomaly": "NAVIGATION_SPEED_ANOMALY",
}.items():

    @query(_key, f"{CHAIN} {_case_sql(_code)}", SESSIONS)
    def _(t, code=_code):
        return _findings(t).filter(F.col("code") == code)


@query("ato_isp_flags", f"{CHAIN} {_case_sql('HOSTING_OR_PROXY_ISP')} UNION ALL {_case_sql('ISP_MISMATCH')}", SESSIONS)
def _(t):
    return _findings(t).filter(F.col("code").isin("HOSTING_OR_PROXY_ISP", "ISP_MISMATCH"))


ALL = " UNION ALL ".join(_case_sql(c) for c in CASES)


@query("ato_discrepancies", f"{CHAIN} {ALL}", SESSIONS)
def _(t):
    return _findings(t)


@query(
    "ato_risk_score",
    f"""{CHAIN}, f AS ({ALL}), r AS (SELECT session_id, "user", count(*) AS n_flags, CAST(least(100, sum(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) * 12 + count(*) * 3) AS DOUBLE) AS risk, bool_or(code = 'IMPOSSIBLE_TRAVEL') AS travel FROM f GROUP BY ALL)
SELECT session_id, "user", n_flags, risk, 100.0 - risk AS safety, CASE WHEN travel THEN 'Physically impossible travel vs prior session' WHEN risk >= 60 THEN 'Elevated account takeover risk' WHEN risk >= 35 THEN 'Moderate environment drift vs baseline' ELSE 'Limited automated ATO signals' END AS headline FROM r""",
    SESSIONS,
)
def _(t):
    return A.risk_scores(_findings(t))


@query("ato_behavior_profile", f'WITH {PROFILE} SELECT "user", attribute, value, n, "rank" FROM prof', SESSIONS)
def _(t):
    return A.behavior_profile(_history(t), _roles(t))


@query(
    "ato_behavior_stats",
    f'WITH {PROFILE}, {STATS} SELECT "user", event_count, round(avg_amount * samples, 2) AS amount_total, max_amount, samples, round(mean_duration, 6) AS mean_duration, round(median_duration, 6) AS median_duration FROM stats',
    SESSIONS,
)
def _(t):
    out = A.behavior_stats(_history(t), _roles(t))
    # Averages of cents fall on rounding edges; their totals do not.
    total = F.round(F.col("avg_amount") * F.col("samples"), 2).alias("amount_total")
    return out.select("user", "event_count", total, "max_amount", "samples", *[F.round(c, 6).alias(c) for c in ("mean_duration", "median_duration")])


@query(
    "ato_last_sessions",
    """SELECT acc_id, event_id, CAST(row_number() OVER (PARTITION BY acc_id ORDER BY created_at DESC, event_id DESC) AS INT) AS "rank" FROM v_sessions WHERE outcome = 'success' QUALIFY "rank" <= 50""",
    SESSIONS,
)
def _(t):
    return A.last_sessions(t.v_sessions, t.session_roles, 50).select("acc_id", "event_id", "rank")


@query(
    "ato_impossible_travel",
    f"""WITH p AS (SELECT s.event_id, s.acc_id, q.event_id AS last_event_id, {hav('q', 's')} AS h, abs(epoch_us(s.created_at) - epoch_us(q.created_at)) / 3600000000.0 AS hours FROM v_sessions s ASOF JOIN v_sessions q ON s.acc_id = q.acc_id AND s.created_at > q.created_at)
SELECT event_id, acc_id, last_event_id, round({HAVERSINE}, 4) AS miles FROM p WHERE hours > 1e-6 AND {HAVERSINE} / hours > 500""",
    SESSIONS,
)
def _(t):
    hits = A.impossible_travel(t.v_sessions, t.session_roles)
    return hits.select("event_id", "acc_id", F.col("last_login.event_id").alias("last_event_id"), F.round("miles", 4).alias("miles"))


@query(
    "ato_change_then_transfer",
    """WITH ch AS (SELECT acc_id, created_at, event_id FROM v_sessions WHERE action IN ('email_change', 'password_change')), st AS (SELECT acc_id, avg(amount) AS a FROM v_sessions GROUP BY 1)
SELECT s.event_id, s.acc_id, ch.event_id AS change_event_id FROM v_sessions s ASOF JOIN ch ON s.acc_id = ch.acc_id AND s.created_at > ch.created_at JOIN st ON st.acc_id = s.acc_id
 WHERE epoch_us(s.created_at) - epoch_us(ch.created_at) <= 6 * 3600000000 AND s.transfer_amount >= greatest(500.0, 3 * st.a)""",
    SESSIONS,
)
def _(t):
    roles = _roles(t)
    stats = A.behavior_stats(t.v_sessions, roles)
    hits = A.change_then_transfer(t.v_sessions, roles.with_roles(amount="transfer_amount"), stats, 6 * HOUR_US)
    return hits.select("event_id", "acc_id", F.col("change.event_id").alias("change_event_id"))


@query(
    "ato_trusted_email",
    """SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'kept@corp.example' ELSE previous_email END AS trusted_email FROM v_sessions WHERE event_type = 'purchase'""",
    SESSIONS,
)
def _(t):
    kept = F.when(F.col("event_id") % 10 == 0, " kept@corp.example ").otherwise("  ")
    return _current(t).select("event_id", A.trusted_email({"email_on_file": kept}, F.col("events")).alias("trusted_email"))


@query(
    "ato_canvas_ip_velocity",
    """WITH w AS (SELECT acc_id AS uid, hardware_id AS ip, count(*) OVER (PARTITION BY acc_id, hardware_id ORDER BY created_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS c FROM v_sessions)
SELECT uid, ip, max(c) AS peak_events_1h FROM w GROUP BY ALL HAVING max(c) >= 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""",
    SESSIONS,
)
def _(t):
    return A.canvas_ip_velocity(t.v_sessions, t.session_roles.with_roles(ip="hardware_id"), min_events=2)


@query(
    "ato_dominant_fingerprints",
    """SELECT canvas_fingerprint, count(*) AS n_rows, count(DISTINCT ip) AS n_distinct, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_of_rows FROM v_sessions GROUP BY 1 ORDER BY n_rows DESC, 1 LIMIT 12""",
    SESSIONS,
)
def _(t):
    return A.dominant_fingerprints(t.v_sessions, t.session_roles).withColumn("pct_of_rows", F.round("pct_of_rows", 6))


@query("ato_infer_user", "SELECT acc_id, count(*) AS n FROM v_sessions GROUP BY acc_id ORDER BY n DESC, acc_id LIMIT 1", SESSIONS)
def _(t):
    return A.top_users(t.v_sessions, "acc_id", 1)
