"""Cross-case ledger, access rules, overlap, and the case register."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.operators import cases as B
from inquest.operators import warehouse as H
from inquest.plans.registry import query
from inquest.session import shared_scratch

ROWS = ("v_case_rows",)
ROWS_CASES = ("v_case_rows", "v_cases")
ALL = ("v_case_rows", "v_cases", "v_shares")
LEADS = ("v_leads",)
BOARD = ("v_leads", "v_audit")

OCC = """occ AS (SELECT source_case_id, upload_timestamp, 'user_id' AS entity_type, user_id AS entity_value, 'user_id' AS source_column FROM v_case_rows
 UNION ALL SELECT source_case_id, upload_timestamp, 'ip_address', ip_address, 'ip_address' FROM v_case_rows),
ec AS (SELECT DISTINCT entity_type, entity_value, source_case_id FROM occ),
em AS (SELECT entity_type, entity_value, count(DISTINCT source_case_id) AS distinct_case_count, min(upload_timestamp) AS first_seen, max(upload_timestamp) AS last_seen FROM occ GROUP BY ALL)"""
# The active case is the one uploaded last.
ACTIVE = "(SELECT arg_max(source_case_id, (upload_timestamp, row_index)) FROM v_case_rows)"


def _occ(t):
    return H.extract_entities(t.v_case_rows.drop("row_index"), "source_case_id", "upload_timestamp")


def _events(t):
    return H.append_events(t.v_case_rows, "source_case_id", "upload_timestamp", "row_index")


def _active(t):
    return t.v_case_rows.agg(F.max_by("source_case_id", F.struct("upload_timestamp", "row_index"))).scalar()


def _allowed(t):
    return H.allowed_cases(t.v_cases, t.v_shares)


@query(
    "wh_append_events",
    """SELECT source_case_id, upload_timestamp, source_case_id || '.csv' AS source_filename, row_index, user_id, ip_address, event_type FROM v_case_rows""",
    ROWS,
)
def _(t):
    body = {c: F.get_json_object("row_json", f"$.{c}") for c in ("user_id", "ip_address", "event_type")}
    return _events(t).withColumns(body).drop("row_json")


@query("wh_extract_entities", f"WITH {OCC} SELECT * FROM occ", ROWS)
def _(t):
    return _occ(t)


@query("wh_entity_map", f"WITH {OCC} SELECT * FROM em", ROWS)
def _(t):
    return H.entity_map(_occ(t))


@query("agg_entity_map", f"WITH {OCC} SELECT entity_type, entity_value, count(*) AS group_size, 0 AS chunk_no, string_agg(source_case_id, ',' ORDER BY source_case_id) AS members FROM ec GROUP BY ALL", ROWS)
def _(t):
    return H.entity_case_lists(_occ(t)).withColumn("members", F.array_join("members", ","))


@query("wh_refresh_entity_map", f"WITH {OCC} SELECT * FROM em", ROWS)
def _(t):
    # The active case arrives after the others: the old map is brought up to date.
    occ, active = _occ(t), F.col("source_case_id") == _active(t)
    old = H.entity_map(occ.filter(~active))
    return H.refresh_entity_map(old, occ, occ.filter(active))


@query(
    "wh_remove_case",
    f"WITH {OCC} SELECT entity_type, entity_value, count(DISTINCT source_case_id) AS distinct_case_count, min(upload_timestamp) AS first_seen, max(upload_timestamp) AS last_seen FROM occ WHERE source_case_id <> {ACTIVE} GROUP BY ALL",
    ROWS,
)
def _(t):
    occ = _occ(t)
    return H.remove_case(occ, H.entity_map(occ), _active(t))[1]


ALLOWED = """al AS (SELECT case_id AS viewer_case_id, case_id FROM v_cases UNION SELECT s.viewer_case_id, s.owner_case_id FROM v_shares s JOIN v_cases a ON a.case_id = s.viewer_case_id JOIN v_cases b ON b.case_id = s.owner_case_id WHERE a.tenant_id = b.tenant_id)"""


@query("wh_allowed_cases", f"WITH {ALLOWED} SELECT * FROM al", ("v_cases", "v_shares"))
def _(t):
    return _allowed(t)


@query(
    "wh_acl_views",
    f"""WITH {OCC}, {ALLOWED} SELECT entity_type, entity_value, count(DISTINCT source_case_id) AS distinct_case_count, min(upload_timestamp) AS first_seen, max(upload_timestamp) AS last_seen FROM occ WHERE source_case_id IN (SELECT case_id FROM al WHERE viewer_case_id = 'case_1') GROUP BY ALL""",
    ALL,
)
def _(t):
    return H.visible_entity_map(_occ(t), _allowed(t), "case_1")


@query(
    "semi_acl_entities",
    f"""WITH {OCC}, {ALLOWED} SELECT * FROM em WHERE EXISTS (SELECT 1 FROM ec WHERE ec.entity_type = em.entity_type AND ec.entity_value = em.entity_value AND ec.source_case_id IN (SELECT case_id FROM al WHERE viewer_case_id = 'case_1'))""",
    ALL,
)
def _(t):
    occ = _occ(t)
    return H.entities_touching(H.entity_map(occ), occ, _allowed(t), "case_1")


WH_SQL = """WITH busy AS (SELECT entity_type, entity_value FROM entity_map WHERE distinct_case_count > 2)
SELECT e.source_case_id, e.entity_type, count(*) AS n FROM entity_occurrences e JOIN busy b ON b.entity_type = e.entity_type AND b.entity_value = e.entity_value GROUP BY e.source_case_id, e.entity_type"""


@query("wh_query", f"WITH {OCC}, entity_occurrences AS (SELECT * FROM occ), entity_map AS (SELECT * FROM em), {WH_SQL[5:]}", ROWS)
def _(t):
    ledger = H.Ledger(t.spark, shared_scratch(t.spark, "ledger"))
    ledger.put(t.v_case_rows, "source_case_id", "upload_timestamp", "row_index")
    return ledger.query(WH_SQL)


@query(
    "wh_query_scoped",
    f"""WITH {OCC} SELECT entity_type, entity_value, count(DISTINCT source_case_id) AS distinct_case_count FROM occ WHERE source_case_id IN ('case_0', 'case_3') GROUP BY ALL""",
    ROWS,
)
def _(t):
    ledger = H.Ledger(t.spark, shared_scratch(t.spark, "ledger"))
    ledger.put(t.v_case_rows, "source_case_id", "upload_timestamp", "row_index")
    return ledger.query("SELECT entity_type, entity_value, distinct_case_count FROM entity_map", ["case_0", "case_3"])


@query(
    "wh_text_search",
    f"""WITH {ALLOWED} SELECT DISTINCT source_case_id, source_case_id || '.csv' AS source_filename, upload_timestamp FROM v_case_rows WHERE event_type = 'purchase' AND source_case_id IN (SELECT case_id FROM al WHERE viewer_case_id = 'case_1')""",
    ALL,
)
def _(t):
    return H.text_search(_events(t), _allowed(t), "case_1", "PURCHASE")


@query(
    "wh_overlap",
    f"""WITH {OCC} SELECT ec.source_case_id, entity_type, entity_value, distinct_case_count - 1 AS other_cases, distinct_case_count - 1 > 2 AS recidivist,
 CASE WHEN distinct_case_count - 1 > 2 THEN 'Recidivist Fraudster' WHEN distinct_case_count > 1 THEN 'Elevated' ELSE 'Normal' END AS priority FROM ec JOIN em USING (entity_type, entity_value)""",
    ROWS,
)
def _(t):
    return H.entity_overlap(_occ(t))


@query(
    "wh_case_overlap_by_case",
    f"""WITH {OCC} SELECT ec.source_case_id, entity_type, count(*) AS entities, count(*) FILTER (distinct_case_count > 1) AS shared, count(*) FILTER (distinct_case_count > 3) AS recidivists, sum(distinct_case_count - 1)::BIGINT AS links FROM ec JOIN em USING (entity_type, entity_value) GROUP BY ALL""",
    ROWS,
)
def _(t):
    return H.overlap_by_case(_occ(t))


@query(
    "wh_case_overlap_matrix",
    f"""WITH {OCC} SELECT o.source_case_id, o.entity_type, count(*) AS shared FROM ec o JOIN ec m ON m.entity_type = o.entity_type AND m.entity_value = o.entity_value AND m.source_case_id = {ACTIVE} WHERE o.source_case_id <> {ACTIVE} GROUP BY ALL""",
    ROWS,
)
def _(t):
    return H.overlap_with(_occ(t), _active(t))


META = """meta AS (SELECT ec.*, coalesce(c.case_name, ec.source_case_id) AS case_name, CASE WHEN c.case_id IS NULL THEN 'UNKNOWN' ELSE coalesce(c.status, 'INVESTIGATING') END AS status,
 CASE WHEN c.case_id IS NULL THEN 'Unknown' ELSE CASE upper(trim(c.status)) WHEN 'FLAGGED' THEN 'Fraud Confirmed' WHEN 'CLEARED' THEN 'Cleared' ELSE 'Under Investigation' END END AS result_label, c.created_at FROM ec LEFT JOIN v_cases c ON c.case_id = ec.source_case_id)"""


@query("join_case_meta", f"WITH {OCC}, {META} SELECT entity_type, entity_value, source_case_id, case_name, status, result_label, created_at FROM meta", ROWS_CASES)
def _(t):
    return H.with_case_meta(H.entity_cases(_occ(t)).select("entity_type", "entity_value", "source_case_id"), t.v_cases)


@query(
    "wh_linkage_timeline",
    f"""WITH {OCC}, {META} SELECT entity_type, entity_value, source_case_id AS case_id, case_name AS title, strftime(created_at, '%b %Y') AS month_label, CASE WHEN source_case_id = {ACTIVE} THEN 'current' ELSE 'historical' END AS position,
 CASE WHEN source_case_id = {ACTIVE} THEN 'active_investigation' WHEN lower(case_name) LIKE '%bot%' THEN 'bot_activity' ELSE 'prior_case' END AS theme, result_label, created_at FROM meta m
 WHERE EXISTS (SELECT 1 FROM ec a WHERE a.entity_type = m.entity_type AND a.entity_value = m.entity_value AND a.source_case_id = {ACTIVE})""",
    ROWS_CASES,
)
def _(t):
    return H.linkage_timeline(_occ(t), t.v_cases, _active(t))


@query(
    "wh_linkage_edges",
    f"""WITH {OCC}, mine AS (SELECT * FROM ec WHERE source_case_id = {ACTIVE}), sh AS (SELECT o.* FROM ec o WHERE o.source_case_id <> {ACTIVE} AND EXISTS (SELECT 1 FROM mine m WHERE m.entity_type = o.entity_type AND m.entity_value = o.entity_value))
SELECT 'case:' || source_case_id AS src, entity_type || ':' || entity_value AS dst, 'seen_in' AS relation FROM sh
 UNION ALL SELECT DISTINCT m.entity_type || ':' || m.entity_value, 'case:' || m.source_case_id, 'active' FROM mine m JOIN sh ON sh.entity_type = m.entity_type AND sh.entity_value = m.entity_value""",
    ROWS,
)
def _(t):
    return H.linkage_edges(_occ(t), _active(t))


@query(
    "wh_probe_pattern",
    """SELECT DISTINCT source_case_id, 'text' AS source FROM v_case_rows WHERE event_type = 'signup' AND ip_address LIKE '%10.9.1%'""",
    ROWS,
)
def _(t):
    # No entity has exactly this value, so the rows' text decides.
    return H.probe_pattern(_events(t), _occ(t), "SignUp", "ip_address", "10.9.1")


@query("wh_probe_entity", """SELECT DISTINCT source_case_id, 'entity' AS source FROM v_case_rows WHERE ip_address = '10.9.17.1'""", ROWS)
def _(t):
    return H.probe_pattern(_events(t), _occ(t), "signup", "ip_address", "10.9.17.1")


# ---- case register ----------------------------------------------------------------


@query(
    "agg_case_memory",
    """WITH n AS (SELECT case_id, count(*) AS leads FROM v_leads GROUP BY 1), a AS (SELECT case_id, count(*) AS audit_events, max(logged_at) AS last_event, count(code) AS scripts FROM v_audit GROUP BY 1)
SELECT coalesce(n.case_id, a.case_id) AS case_id, coalesce(leads, 0) AS leads, coalesce(audit_events, 0) AS audit_events, last_event, coalesce(scripts, 0) AS scripts FROM n FULL JOIN a ON a.case_id = n.case_id""",
    BOARD,
)
def _(t):
    return B.case_memory(t.v_leads, t.v_audit)


@query("case_board", """SELECT case_id, 'lead' AS kind, lead_id AS item_id, created_at FROM v_leads UNION ALL SELECT case_id, 'audit', audit_id, logged_at FROM v_audit""", BOARD)
def _(t):
    return B.case_board(t.v_leads, t.v_audit)


@query(
    "case_state_latest",
    """SELECT case_id, pin_kind, fingerprint, arg_max(status, (created_at, lead_id)) AS status, max(created_at) AS created_at FROM v_leads GROUP BY ALL""",
    LEADS,
)
def _(t):
    return B.latest_state(t.v_leads, ["case_id", "pin_kind", "fingerprint"], "created_at", "lead_id", "status")


@query("case_active", "SELECT case_id, created_at, case_id = (SELECT arg_max(case_id, (created_at, case_id)) FROM v_cases) AS is_active FROM v_cases", ("v_cases",))
def _(t):
    return B.active_case(t.v_cases).select("case_id", "created_at", "is_active")


@query(
    "case_shares_valid",
    """SELECT s.owner_case_id, s.viewer_case_id, min(s.shared_at) AS shared_at FROM v_shares s JOIN v_cases a ON a.case_id = s.owner_case_id JOIN v_cases b ON b.case_id = s.viewer_case_id
 WHERE s.owner_case_id <> s.viewer_case_id AND a.tenant_id = b.tenant_id AND s.viewer_case_id <> 'case_1' GROUP BY ALL""",
    ("v_cases", "v_shares"),
)
def _(t):
    return B.valid_shares(t.v_shares, t.v_cases, t.v_shares.filter("viewer_case_id = 'case_1'"))


@query(
    "case_purge",
    """WITH gone AS (SELECT case_id FROM v_cases WHERE upper(trim(status)) = 'CLEARED'), rest AS (SELECT * FROM v_cases WHERE case_id NOT IN (SELECT case_id FROM gone))
SELECT r.case_id, r.case_id = (SELECT arg_max(case_id, (created_at, case_id)) FROM rest) AS is_active, count(e.row_index) AS events FROM rest r LEFT JOIN v_case_rows e ON e.source_case_id = r.case_id GROUP BY ALL""",
    ROWS_CASES,
)
def _(t):
    gone = t.v_cases.filter(F.upper(F.trim("status")) == "CLEARED")
    rest = B.active_case(B.purge(t.v_cases, gone))
    events = B.purge(t.v_case_rows, gone, "source_case_id").groupBy(F.col("source_case_id").alias("case_id")).agg(F.count("*").alias("events"))
    return rest.join(events, "case_id", "left").fillna(0, ["events"]).select("case_id", "is_active", "events")


@query(
    "case_pins",
    """SELECT case_id, lead_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY created_at DESC, lead_id DESC) AS INT) AS slot FROM v_leads QUALIFY slot <= 24""",
    LEADS,
)
def _(t):
    return B.pinned_cards(t.v_leads, "created_at", "lead_id").select("case_id", "lead_id", "slot")


@query(
    "anti_open_leads",
    """SELECT count(*) AS fresh FROM v_leads l WHERE status <> 'OPEN' AND NOT EXISTS (SELECT 1 FROM v_leads o WHERE o.status = 'OPEN' AND o.case_id = l.case_id AND o.pin_kind = l.pin_kind AND o.fingerprint = l.fingerprint)""",
    LEADS,
)
def _(t):
    key = ["case_id", "pin_kind", "fingerprint"]
    opened = t.v_leads.filter("status = 'OPEN'").select(*key).distinct()
    return t.v_leads.filter("status <> 'OPEN'").join(opened, key, "left_anti").agg(F.count("*").alias("fresh"))
