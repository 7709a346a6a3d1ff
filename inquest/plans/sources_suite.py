"""Sources, sinks and role profiling over the driver tables.

Queries that write put their files beside the session's checkpoints and return
what a reader gets back.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest import roles as R
from inquest.plans.registry import query
from inquest.session import shared_scratch
from inquest.sources import external, files, sinks


def _events_csv(t, sep: str) -> str:
    path = shared_scratch(t.spark, "events-csv")
    files.sink_csv(t.events.select("event_id", "ts", "user_id", "event_type", "value", "props"), path, sep)
    return path


@query("scan_csv_tolerant", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(t):
    rows, _rejected = files.scan_csv_tolerant(t.spark, _events_csv(t, ";"))
    return rows


@query("scan_csv_typed_dates", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def _(t):
    path = _events_csv(t, ",")
    return files.scan_csv_typed(t.spark, path, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING")


@query("preview_rows")
def _(t):
    return files.preview_rows(t.events, 5)


_EVENT_KINDS = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string", "value": "double", "props": "string"}


@query(
    "preview_schema",
    f"""SELECT unnest({list(_EVENT_KINDS)}) AS column_name, unnest({list(_EVENT_KINDS.values())}) AS dtype,
 unnest([{", ".join(f"first({c}::VARCHAR) FILTER ({c} IS NOT NULL)" for c in _EVENT_KINDS)}]) AS sample FROM (SELECT * FROM events LIMIT 5)""",
)
def _(t):
    return files.preview_schema(t.events)


@query("ingest_dataset", "SELECT source_case_id AS case_id, count(*) AS n, round(sum(amount), 4) AS total FROM v_case_rows GROUP BY ALL", ("v_case_rows",))
def _(t):
    root = shared_scratch(t.spark, "datasets")
    rows = t.v_case_rows.withColumnRenamed("source_case_id", "case_id")
    files.ingest_dataset(rows, root)
    # The same cases arrive again: their rows are replaced, not doubled.
    stored = files.ingest_dataset(rows, root)
    return stored.groupBy("case_id").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 4).alias("total"))


_TXN_KINDS = {
    "transaction_id": "string", "user_id": "bigint", "amount": "double", "disputed": "boolean", "status": "string", "ip": "string", "device_id": "string",
    "transaction_date": "timestamp_ntz", "dispute_date": "timestamp_ntz", "login_ts": "timestamp_ntz", "access_ts": "timestamp_ntz",
    "billing_zip": "string", "shipping_zip": "string", "avs": "string", "cvv": "string", "segment": "string", "employee_id": "string",
}


@query(
    "schema_summary",
    f"""SELECT unnest({list(_TXN_KINDS)}) AS column_name, unnest({list(_TXN_KINDS.values())}) AS dtype,
 unnest([{", ".join(f"count(*) - count({c})" for c in _TXN_KINDS)}]) AS null_count, count(*) AS row_count FROM v_txn""",
    ("v_txn",),
)
def _(t):
    return files.schema_summary(t.v_txn)


@query(
    "source_sql_warehouse",
    "SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey",
)
def _(t):
    # The remote side of the connector is played by a query over the given tables.
    answer = t.sql("SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey", orders=t.orders)
    return external.land_result(answer, shared_scratch(t.spark, "landing"))


@query("scan_sink_parquet", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 1000")
def _(t):
    path = shared_scratch(t.spark, "orders")
    back = files.sink_parquet(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path, ("o_orderstatus",))
    return back.filter("o_totalprice > 1000").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query(
    "sink_leads_dedup",
    """WITH existing AS (SELECT DISTINCT case_id, pin_kind, fingerprint FROM v_leads WHERE status = 'OPEN' AND pin_kind IN ('click', 'view')),
fresh AS (SELECT l.* FROM v_leads l WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.case_id = l.case_id AND e.pin_kind = l.pin_kind AND e.fingerprint = l.fingerprint))
SELECT case_id, pin_kind, fingerprint, lead_id, round(least(greatest(severity, 0.0), 1.0), 6) AS severity, 'OPEN' AS status FROM fresh
QUALIFY row_number() OVER (PARTITION BY case_id, pin_kind, fingerprint ORDER BY created_at, lead_id) = 1""",
    ("v_leads",),
)
def _(t):
    existing = t.v_leads.filter(F.col("pin_kind").isin("click", "view"))
    out = sinks.new_leads(t.v_leads, existing)
    return out.select("case_id", "pin_kind", "fingerprint", "lead_id", F.round("severity", 6).alias("severity"), "status")


@query("sink_audit_append", "SELECT audit_id, case_id, action, code, notes FROM v_audit", ("v_audit",))
def _(t):
    return sinks.append_audit(t.v_audit, shared_scratch(t.spark, "audit")).select("audit_id", "case_id", "action", "code", "notes")


@query(
    "roles_value_profile",
    """SELECT 'ip' AS "column", count(*) AS row_count, count(ip) AS filled, 1.0::DOUBLE AS ipv4_share, 0.0::DOUBLE AS email_share, 0.0::DOUBLE AS time_share, 0.0::DOUBLE AS number_share, round(avg(length(ip)), 6) AS mean_length FROM v_sessions
UNION ALL SELECT 'email', count(*), count(email), 0.0, 1.0, 0.0, 0.0, round(avg(length(email)), 6) FROM v_sessions
UNION ALL SELECT 'previous_email', count(*), count(previous_email), 0.0, 1.0, 0.0, 0.0, round(avg(length(previous_email)), 6) FROM v_sessions
UNION ALL SELECT 'event_id', count(*), count(event_id), 0.0, 0.0, 0.0, 1.0, round(avg(length(CAST(event_id AS VARCHAR))), 6) FROM v_sessions""",
    ("v_sessions",),
)
def _(t):
    profile = R.profile_values(t.v_sessions.select("ip", "email", "previous_email", "event_id"))
    return profile.select(
        "column", "row_count", "filled", "ipv4_share", "email_share", "time_share", "number_share", F.round("mean_length", 6).alias("mean_length")
    )


@query("profile_column_roles")
def _(t):
    return R.profile_column_roles(t.v_sessions, R.ColumnRoles(event_type="action"))
