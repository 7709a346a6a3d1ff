"""Streaming jobs replayed over the event table, with the SQL of the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.operators import ato as A
from inquest.operators.warehouse import extract_entities
from inquest.plans.ato_suite import CHAIN, _case_sql, _roles
from inquest.plans.registry import query
from inquest.plans.tables import JSON_KEY_SPARK, VIEWS
from inquest.session import shared_scratch
from inquest.streaming import jobs as J

SESSIONS = ("v_sessions",)


def _events(t):
    return J.read_table_stream(t.spark, t.sf_dir, t.events.schema, "events.parquet")


def _view(t, name: str):
    """An adapter view with the event table as a stream."""
    return t.sql(VIEWS[name].replace("{K}", JSON_KEY_SPARK), events=_events(t))


def _table(t, stream):
    return J.run_to_table(stream, shared_scratch(t.spark, "stream"))


@query("stream_lead_feed", "SELECT DISTINCT case_id, pin_kind, fingerprint FROM v_leads", ("v_leads",))
def _(t):
    return J.lead_feed(_view(t, "v_leads"), shared_scratch(t.spark, "stream")).select("case_id", "pin_kind", "fingerprint")


MARK = "(SELECT max(created_at) - INTERVAL 10 MINUTE FROM v_sessions)"


@query(
    "stream_burst_tumbling",
    f"SELECT date_trunc('hour', created_at) AS window_start, count(DISTINCT acc_id) AS users FROM v_sessions GROUP BY 1 HAVING count(DISTINCT acc_id) >= 20 AND date_trunc('hour', created_at) + INTERVAL 1 HOUR <= {MARK}",
    SESSIONS,
)
def _(t):
    out = _table(t, J.burst_tumbling(_view(t, "v_sessions"), "created_at", "acc_id", "1 hour", 20))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "users")


@query(
    "stream_velocity_sliding",
    f"""SELECT acc_id, time_bucket(INTERVAL 5 MINUTE, created_at) - i * INTERVAL 5 MINUTE AS window_start, count(*) AS n FROM v_sessions, (SELECT unnest(range(0, 12)) AS i)
 GROUP BY 1, 2 HAVING count(*) >= 2 AND window_start + INTERVAL 1 HOUR <= {MARK}""",
    SESSIONS,
)
def _(t):
    out = _table(t, J.velocity_sliding(_view(t, "v_sessions"), "created_at", ["acc_id"], 2))
    return out.select("acc_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


@query(
    "stream_bot_ratio_5m",
    f"""SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, count(DISTINCT acc_id) AS total_users, count(DISTINCT acc_id) FILTER (email LIKE '%mailinator%') AS bot_users FROM v_sessions GROUP BY 1 HAVING window_start + INTERVAL 5 MINUTE <= {MARK}""",
    SESSIONS,
)
def _(t):
    flagged = t.v_sessions.filter(F.col("email").contains("mailinator")).select("acc_id")
    out = _table(t, J.ratio_5m(_view(t, "v_sessions"), "created_at", "acc_id", flagged))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "total_users", "bot_users")


@query(
    "stream_impossible_travel",
    f"""WITH o AS (SELECT acc_id AS "user", event_id, latitude, longitude, created_at, lag(event_id) OVER w AS previous_event_id, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(created_at) OVER w AS pts FROM v_sessions WINDOW w AS (PARTITION BY acc_id ORDER BY created_at, event_id)),
d AS (SELECT *, pow(sin(radians(latitude - plat) / 2), 2) + cos(radians(plat)) * cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2) AS h, (epoch_us(created_at) - epoch_us(pts)) / 3.6e9::DOUBLE AS hours FROM o WHERE pts IS NOT NULL)
SELECT "user", event_id, previous_event_id, round(2 * 3958.7613 * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h))), 4) AS miles FROM d WHERE hours > 1e-6 AND 2 * 3958.7613 * atan2(sqrt(h), sqrt(greatest(0.0, 1 - h))) / hours > 500 AND created_at <= {MARK}""",
    SESSIONS,
)
def _(t):
    out = _table(t, J.impossible_travel(_view(t, "v_sessions"), "acc_id", "created_at", "latitude", "longitude", "event_id"))
    return out.select("user", "event_id", "previous_event_id", F.round("miles", 4).alias("miles"))


@query(
    "stream_sessionize",
    f"""WITH o AS (SELECT acc_id, created_at, CASE WHEN created_at - lag(created_at) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM v_sessions WINDOW w AS (PARTITION BY acc_id ORDER BY created_at)),
g AS (SELECT *, sum(s) OVER (PARTITION BY acc_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT acc_id, min(created_at) AS session_start, count(*) AS n, round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6::DOUBLE, 6) AS seconds FROM g GROUP BY acc_id, k HAVING max(created_at) + INTERVAL 30 MINUTE <= {MARK}""",
    SESSIONS,
)
def _(t):
    out = _table(t, J.sessionize(_view(t, "v_sessions"), "created_at", "acc_id"))
    return out.select("acc_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n", F.round("seconds", 6).alias("seconds"))


_COMPARED = ("USER_AGENT_MISMATCH", "SCREEN_ENV_MISMATCH", "HOSTING_OR_PROXY_ISP", "ISP_MISMATCH", "NEW_HARDWARE_ID")


@query(
    "stream_baseline_compare",
    f"""{CHAIN}, f AS ({' UNION ALL '.join(_case_sql(c) for c in _COMPARED)}) SELECT session_id, "user", code FROM f""",
    SESSIONS,
)
def _(t):
    from inquest.functions.scalar import screen_resolution
    from inquest.plans.ato_suite import CURRENT

    lists = A.baseline_lists(A.behavior_profile(t.v_sessions.filter("event_type <> 'purchase'"), _roles(t)))
    current = t.sql(CURRENT, v_sessions=_view(t, "v_sessions")).withColumn("screen", screen_resolution(F.col("screen_width"), F.col("screen_height")))
    return _table(t, J.baseline_compare(current, lists, "acc_id", "event_id", "user_agent", "screen", "isp", "hardware_id"))


@query(
    "stream_sensitive_chain",
    """WITH st AS (SELECT acc_id, avg(amount) AS a FROM v_sessions GROUP BY 1) SELECT s.acc_id AS "user", s.event_id, c.event_id AS change_event_id FROM v_sessions s JOIN v_sessions c ON c.acc_id = s.acc_id AND c.action IN ('email_change', 'password_change') AND s.created_at > c.created_at AND s.created_at <= c.created_at + INTERVAL 1 HOUR
 JOIN st ON st.acc_id = s.acc_id WHERE s.transfer_amount >= greatest(500.0, 3 * st.a)""",
    SESSIONS,
)
def _(t):
    stats = A.behavior_stats(t.v_sessions, _roles(t).with_roles(duration=None))
    return _table(t, J.sensitive_chain(_view(t, "v_sessions"), "acc_id", "created_at", "action", "event_id", "transfer_amount", stats))


@query(
    "stream_entity_ingest",
    """WITH occ AS (SELECT source_case_id, upload_timestamp, 'user_id' AS entity_type, user_id AS entity_value FROM v_case_rows UNION ALL SELECT source_case_id, upload_timestamp, 'ip_address', ip_address FROM v_case_rows)
SELECT entity_type, entity_value, count(DISTINCT source_case_id) AS distinct_case_count, min(upload_timestamp) AS first_seen, max(upload_timestamp) AS last_seen FROM occ GROUP BY ALL""",
    ("v_case_rows",),
)
def _(t):
    rows = _view(t, "v_case_rows").drop("row_index")
    return J.entity_ingest(extract_entities(rows, "source_case_id", "upload_timestamp"), shared_scratch(t.spark, "stream"))
