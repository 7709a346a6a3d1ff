"""Signup-cluster rules over the session view."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.operators import bots as B
from inquest.operators.relational import flagged_density
from inquest.plans.registry import query
from inquest.sources.sinks import bulk_flags

SESSIONS = ("v_sessions",)

# The small sample has few users per minute, so the burst queries look at one hour.
HOURLY = B.BotParams(burst_window_minutes=60, burst_min_accounts=20)

PARTS = """s AS (SELECT *, regexp_replace(ip, '\\.[0-9]+$', '.0/24') AS subnet, split_part(email, '@', 1) AS local, split_part(email, '@', 2) AS domain, strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS slot FROM v_sessions)"""

RULE_SQL = {
    "time_burst": """SELECT 'time_burst' AS cluster_type, slot AS cluster_key, count(DISTINCT acc_id) AS size, 'TIME_BURST' ||
 CASE WHEN (SELECT count(*) FROM (SELECT DISTINCT CAST(substr(q.acc_id, 3) AS INT) AS n FROM s q WHERE q.slot = s.slot) a WHERE EXISTS (SELECT 1 FROM s r WHERE r.slot = s.slot AND CAST(substr(r.acc_id, 3) AS INT) = a.n + 1)) >= 3 THEN ',SEQUENTIAL_ID_PATTERN' ELSE '' END AS signals,
 NULL::BIGINT AS distinct_ips, NULL::BIGINT AS distinct_names, NULL::BIGINT AS raw_addresses FROM s GROUP BY slot HAVING count(DISTINCT acc_id) >= 20""",
    "humanoid_bot_ring": """SELECT 'humanoid_bot_ring' AS cluster_type, canvas_fingerprint AS cluster_key, count(DISTINCT acc_id) AS size, 'HUMANOID_BOT_RING,CANVAS_HARDWARE_COLLISION' AS signals,
 count(DISTINCT ip) AS distinct_ips, count(DISTINCT name) AS distinct_names, NULL::BIGINT AS raw_addresses FROM s GROUP BY canvas_fingerprint HAVING count(DISTINCT acc_id) >= 5 AND count(DISTINCT ip) >= 3 AND count(DISTINCT name) >= 3""",
    "infrastructure_ua": """SELECT 'infrastructure_ua' AS cluster_type, subnet || ' | ' || user_agent AS cluster_key, count(DISTINCT acc_id) AS size,
 'SHARED_SUBNET_UA' || CASE WHEN CAST(regexp_extract(user_agent, 'Chrome/([0-9]+)', 1) AS INT) < 115 THEN ',STALE_CHROME_UA' ELSE '' END AS signals,
 NULL::BIGINT AS distinct_ips, NULL::BIGINT AS distinct_names, NULL::BIGINT AS raw_addresses FROM s GROUP BY subnet, user_agent HAVING count(DISTINCT acc_id) >= 5""",
    "infrastructure_canvas": """SELECT 'infrastructure_canvas' AS cluster_type, subnet || ' | ' || canvas_fingerprint AS cluster_key, count(DISTINCT acc_id) AS size, 'SHARED_SUBNET_CANVAS' AS signals,
 NULL::BIGINT AS distinct_ips, NULL::BIGINT AS distinct_names, NULL::BIGINT AS raw_addresses FROM s GROUP BY subnet, canvas_fingerprint HAVING count(DISTINCT acc_id) >= 5""",
    "disposable_email": """SELECT 'disposable_email' AS cluster_type, domain AS cluster_key, count(DISTINCT acc_id) AS size, 'DISPOSABLE_EMAIL_DOMAIN' AS signals,
 NULL::BIGINT AS distinct_ips, NULL::BIGINT AS distinct_names, NULL::BIGINT AS raw_addresses FROM s WHERE domain = 'mailinator.com' GROUP BY domain HAVING count(DISTINCT acc_id) >= 2""",
    "gmail_dot_trick": """SELECT 'gmail_dot_trick' AS cluster_type, replace(local, '.', '') || '@' || domain AS cluster_key, count(DISTINCT acc_id) AS size, 'GMAIL_DOT_VARIANTS' AS signals,
 NULL::BIGINT AS distinct_ips, NULL::BIGINT AS distinct_names, count(DISTINCT email) AS raw_addresses FROM s WHERE domain = 'gmail.com' GROUP BY replace(local, '.', ''), domain
 HAVING count(DISTINCT acc_id) >= 2 AND (count(DISTINCT acc_id) >= 4 OR count(DISTINCT email) >= 4)""",
    "high_entropy_email_subnet": """SELECT 'high_entropy_email_subnet' AS cluster_type, subnet AS cluster_key, count(DISTINCT acc_id) AS size, 'HIGH_ENTROPY_LOCAL,INFRA_GEO_CONTEXT' AS signals,
 NULL::BIGINT AS distinct_ips, NULL::BIGINT AS distinct_names, NULL::BIGINT AS raw_addresses FROM s WHERE length(local) >= 10 AND list_aggregate(string_split(local, ''), 'entropy') >= 4.25 GROUP BY subnet HAVING count(DISTINCT acc_id) >= 3""",
}
KEYS = {
    "bot_time_burst": "time_burst",
    "bot_humanoid_ring": "humanoid_bot_ring",
    "bot_infra_subnet_ua": "infrastructure_ua",
    "bot_infra_subnet_canvas": "infrastructure_canvas",
    "bot_disposable_domain": "disposable_email",
    "bot_gmail_dots": "gmail_dot_trick",
    "bot_high_entropy_subnet": "high_entropy_email_subnet",
}


def _rule(key: str, rule: str) -> None:
    @query(key, f"WITH {PARTS} {RULE_SQL[rule]}", SESSIONS)
    def _(t):
        return B.clusters(t.v_sessions, t.session_roles, HOURLY, (rule,))


for _key, _name in KEYS.items():
    _rule(_key, _name)

ALL_SQL = " UNION ALL ".join(f"({RULE_SQL[r]})" for r in RULE_SQL)


@query("bot_clusters", f"WITH {PARTS} {ALL_SQL}", SESSIONS)
def _(t):
    return B.clusters(t.v_sessions, t.session_roles, HOURLY)


MEMBER_SQL = f"""WITH {PARTS}, keyed AS (SELECT acc_id, unnest(['time_burst', 'humanoid_bot_ring', 'infrastructure_ua', 'infrastructure_canvas', 'disposable_email', 'gmail_dot_trick', 'high_entropy_email_subnet']) AS cluster_type,
 unnest([slot, canvas_fingerprint, subnet || ' | ' || user_agent, subnet || ' | ' || canvas_fingerprint, CASE WHEN domain = 'mailinator.com' THEN domain END,
 CASE WHEN domain = 'gmail.com' THEN replace(local, '.', '') || '@' || domain END, CASE WHEN length(local) >= 10 AND list_aggregate(string_split(local, ''), 'entropy') >= 4.25 THEN subnet END]) AS cluster_key FROM s),
cl AS ({ALL_SQL}), mem AS (SELECT DISTINCT k.cluster_type, k.cluster_key, k.acc_id AS account_id FROM keyed k JOIN cl ON k.cluster_type = cl.cluster_type AND k.cluster_key = cl.cluster_key)"""


@query("bot_cluster_members", f"{MEMBER_SQL} SELECT * FROM mem", SESSIONS)
def _(t):
    return B.members(t.v_sessions, t.session_roles, HOURLY)


@query("union_flagged_users", f"{MEMBER_SQL} SELECT DISTINCT account_id FROM mem", SESSIONS)
def _(t):
    return B.flagged_users(t.v_sessions, t.session_roles, HOURLY)


# Stricter limits than the default, so that part of the users stay unflagged.
STRICT = B.BotParams(burst_min_accounts=10**6, infra_min_size=10**6, high_entropy_min=9.0)
STRICT_SQL = "flagged AS (SELECT DISTINCT acc_id FROM v_sessions WHERE email LIKE '%@mailinator.com' OR email LIKE '%@gmail.com')"


@query(
    "flagged_density",
    f"""WITH {STRICT_SQL} SELECT (SELECT count(DISTINCT acc_id) FROM v_sessions) AS all_users, (SELECT count(*) FROM flagged) AS flagged_users,
 round(100.0 * (SELECT count(*) FROM flagged) / (SELECT count(DISTINCT acc_id) FROM v_sessions), 2) AS density_pct""",
    SESSIONS,
)
def _(t):
    return flagged_density(t.v_sessions, "acc_id", B.flagged_users(t.v_sessions, t.session_roles, STRICT))


@query("bulk_flag_accounts", f"{MEMBER_SQL} SELECT cluster_type, cluster_key, account_id, 'BOT_CLUSTER' AS reason FROM mem", SESSIONS)
def _(t):
    return bulk_flags(B.members(t.v_sessions, t.session_roles, HOURLY), ("cluster_type", "cluster_key"), "account_id")


@query(
    "bot_sequential_ids",
    """WITH n AS (SELECT DISTINCT CAST(substr(acc_id, 3) AS INT) AS n FROM v_sessions) SELECT 'U_' AS prefix, count(*) AS n_ids, count(*) FILTER (n + 1 IN (SELECT n FROM n)) AS n_steps FROM n""",
    SESSIONS,
)
def _(t):
    return B.sequential_ids(t.v_sessions, t.session_roles)


@query(
    "bot_ratio_5m",
    f"""WITH {STRICT_SQL}, w AS (SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, count(DISTINCT acc_id) AS total_users, count(DISTINCT acc_id) FILTER (acc_id IN (SELECT acc_id FROM flagged)) AS bot_users FROM v_sessions GROUP BY 1)
SELECT *, total_users - bot_users AS human_users, 100.0::DOUBLE * bot_users / total_users AS bot_pct, 100.0 - 100.0::DOUBLE * bot_users / total_users AS human_pct, 100.0::DOUBLE * bot_users / total_users > 40 AS alert FROM w""",
    SESSIONS,
)
def _(t):
    return B.ratio_5m(t.v_sessions, t.session_roles, B.flagged_users(t.v_sessions, t.session_roles, STRICT))


CANVAS_SQL = """SELECT canvas_fingerprint AS fingerprint, count(*) AS row_count, count(DISTINCT ip) AS distinct_ips, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM v_sessions) AS share_pct FROM v_sessions GROUP BY 1 ORDER BY row_count DESC, fingerprint LIMIT 12"""


@query("bot_canvas_distribution", CANVAS_SQL, SESSIONS)
def _(t):
    return B.canvas_distribution(t.v_sessions, t.session_roles)


# One fingerprint for nearly all rows: the shape of a hardware ring.
RING = "CASE WHEN event_id % 200 = 0 THEN canvas_fingerprint ELSE 'fp_ring' END"
RING_SQL = f"r AS (SELECT {RING} AS fp, CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE ip END AS ip, acc_id FROM v_sessions), d AS (SELECT fp AS fingerprint, count(*) AS row_count, count(DISTINCT ip) AS distinct_ips, count(DISTINCT acc_id) AS distinct_accounts, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM r) AS share_pct FROM r GROUP BY 1 ORDER BY row_count DESC, fingerprint LIMIT 1)"


def _ring(t):
    ip = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise(F.col("ip"))
    return t.v_sessions.withColumns({"canvas_fingerprint": F.expr(RING), "ip": ip})


@query(
    "bot_hardware_spoofing",
    f"""WITH {RING_SQL} SELECT fingerprint, row_count, distinct_ips, share_pct, 'High-Confidence Hardware Spoofing Ring' AS label FROM d WHERE share_pct >= 95 AND distinct_ips >= greatest(5, floor(0.45 * row_count)) AND row_count >= 5""",
    SESSIONS,
)
def _(t):
    return B.hardware_spoofing(_ring(t), t.session_roles)


VERDICT_SQL = """SELECT fingerprint, row_count, distinct_ips, distinct_accounts, share_pct, share_pct >= 99.5 AS critical,
 CASE WHEN share_pct >= 99.5 THEN 'CRITICAL: HARDWARE SPOOFING DETECTED' WHEN share_pct >= 95 AND distinct_ips >= greatest(5, floor(0.45 * row_count)) THEN 'Verified Bot Ring (High Confidence)' WHEN share_pct >= 80 THEN 'Strong Hardware Concentration' ELSE 'Review Canvas / IP Distribution' END AS verdict,
 (share_pct >= 95 AND distinct_ips >= greatest(5, floor(0.45 * row_count))) OR (share_pct >= 90 AND distinct_ips >= greatest(5, floor(0.15 * row_count))) AS pin_eligible,
 distinct_ips >= greatest(10, floor(row_count / 2)) AS proxy_rotation"""


@query("bot_hardware_forensics", f"WITH {RING_SQL} {VERDICT_SQL} FROM d", SESSIONS)
def _(t):
    return B.hardware_forensics(_ring(t), t.session_roles)


@query("bot_hardware_addresses", f"WITH {RING_SQL} SELECT DISTINCT ip FROM r WHERE fp = (SELECT fingerprint FROM d)", SESSIONS)
def _(t):
    return B.hardware_addresses(_ring(t), t.session_roles)


@query(
    "bot_primary_signal",
    f"WITH {PARTS}, cl AS ({ALL_SQL}) SELECT max(CASE WHEN cluster_type = 'humanoid_bot_ring' THEN 'canvas_hardware' END) AS primary_signal, max(distinct_ips) AS top_distinct_ips FROM cl",
    SESSIONS,
)
def _(t):
    return B.primary_signal(B.clusters(t.v_sessions, t.session_roles, HOURLY))


@query("bot_degraded_path", f"WITH {RING_SQL} {VERDICT_SQL}, 'missing_timestamp_column' AS degraded_reason FROM d", SESSIONS)
def _(t):
    return B.degraded_report(_ring(t).drop("created_at"), t.session_roles.with_roles(timestamp=None))
