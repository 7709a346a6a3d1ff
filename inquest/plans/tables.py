"""Driver tables, and views over them in the shape of fraud-case data."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# {K} is the number under "k" in the JSON text column; only its spelling differs
# between the two SQL dialects.
JSON_KEY_SPARK = "CAST(get_json_object(props, '$.k') AS BIGINT)"
JSON_KEY_ORACLE = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

VIEWS: dict[str, str] = {
    "v_sessions": """
SELECT e.event_id, 'U_' || CAST(e.user_id AS VARCHAR(20)) AS acc_id, 'Name ' || CAST(e.event_id % 97 AS VARCHAR(20)) AS name, e.ts AS created_at,
 '10.' || CAST(e.user_id % 4 AS VARCHAR(20)) || '.' || CAST(e.user_id % 3 AS VARCHAR(20)) || '.' || CAST(e.event_id % 250 AS VARCHAR(20)) AS ip,
 'fp_' || CAST(e.user_id % 6 AS VARCHAR(20)) AS canvas_fingerprint,
 'Mozilla/5.0 Chrome/' || CAST(110 + e.user_id % 3 * 5 AS VARCHAR(20)) || '.0' AS user_agent,
 CASE e.user_id % 4 WHEN 0 THEN substr('abcdefgh', 1, CAST(1 + e.event_id % 7 AS INT)) || '.' || substr('abcdefgh', CAST(2 + e.event_id % 7 AS INT)) || '@gmail.com'
   WHEN 1 THEN 'x' || CAST(e.user_id AS VARCHAR(20)) || '@mailinator.com'
   WHEN 2 THEN 'q7zk2vw9xj4mbt8ycn' || CAST(e.event_id AS VARCHAR(20)) || 'ed@corp.example'
   ELSE 'user' || CAST(e.user_id AS VARCHAR(20)) || '@corp.example' END AS email,
 CAST((e.user_id * 37) % 120 - 60 AS DOUBLE) + CASE WHEN e.event_id % 41 = 0 THEN 25.0 ELSE 0.0 END AS latitude,
 CAST((e.user_id * 91) % 300 - 150 AS DOUBLE) AS longitude,
 'hw_' || CAST(e.user_id * 2 + CASE WHEN e.event_id % 29 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)) AS hardware_id,
 CASE WHEN e.event_id % 37 = 0 THEN 'OVH Hosting' ELSE 'ISP ' || CAST(e.user_id % 5 AS VARCHAR(20)) END AS isp,
 1280 + e.user_id % 3 * 320 + CASE WHEN e.event_id % 31 = 0 THEN 7 ELSE 0 END AS screen_width, 720 + e.user_id % 3 * 90 AS screen_height,
 CAST(60 + (e.event_id * 17) % 541 AS DOUBLE) AS session_seconds,
 CASE WHEN e.event_id % 43 = 0 THEN 5.0 ELSE CAST(40 + e.event_id % 50 AS DOUBLE) END AS checkout_seconds,
 CASE WHEN e.event_id % 23 = 0 THEN 'email_change' WHEN e.event_id % 19 = 0 THEN 'password_change' ELSE 'page_view' END AS action,
 CASE WHEN e.event_id % 23 = 0 THEN 'old' || CAST(e.user_id AS VARCHAR(20)) || '@corp.example' END AS previous_email,
 CASE WHEN e.event_id % 3 = 0 THEN e.value * 40 ELSE e.value END AS transfer_amount,
 CASE WHEN e.event_type = 'error' THEN 'failed' ELSE 'success' END AS outcome, e.event_type, e.value AS amount
FROM {events} e""",
    "v_txn": """
SELECT CAST(l.l_orderkey AS VARCHAR(20)) || '-' || CAST(l.l_linenumber AS VARCHAR(20)) || '-' || CAST(l.l_partkey AS VARCHAR(20)) AS transaction_id,
 o.o_custkey AS user_id, l.l_extendedprice AS amount, l.l_returnflag = 'R' AS disputed,
 CASE WHEN l.l_returnflag = 'R' THEN 'disputed' WHEN l.l_linestatus = 'F' THEN 'completed' ELSE 'pending' END AS status,
 '172.16.' || CAST(o.o_custkey % 200 AS VARCHAR(20)) || '.' || CAST(l.l_suppkey % 5 AS VARCHAR(20)) AS ip,
 'dev_' || CAST(o.o_custkey AS VARCHAR(20)) || '_' || CAST(l.l_partkey % 3 AS VARCHAR(20)) AS device_id,
 o.o_orderdate AS transaction_date, CASE WHEN l.l_returnflag = 'R' THEN l.l_shipdate END AS dispute_date,
 CASE WHEN l.l_quantity > 25 THEN l.l_shipdate + INTERVAL 3 DAY ELSE o.o_orderdate END AS login_ts,
 CASE WHEN l.l_quantity > 40 THEN l.l_shipdate + INTERVAL 9 DAY END AS access_ts,
 CAST(c.c_nationkey AS VARCHAR(20)) AS billing_zip, CAST(s.s_nationkey AS VARCHAR(20)) AS shipping_zip,
 CASE WHEN l.l_linenumber % 2 = 0 THEN 'Match' ELSE 'N' END AS avs,
 CASE WHEN l.l_linenumber % 3 = 0 THEN 'P' ELSE 'X' END AS cvv,
 c.c_mktsegment AS segment, 'emp_' || CAST(l.l_suppkey % 7 AS VARCHAR(20)) AS employee_id
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "v_payments": """
SELECT user_id AS payer, {K} AS payee, value AS amount, ts FROM {events} WHERE event_type = 'purchase'""",
    "v_links": """
SELECT acc_id AS account_id, CASE WHEN event_id % 11 = 0 THEN 'hw_shared_' || CAST(event_id % 53 AS VARCHAR(20)) ELSE hardware_id END AS device_id, 'addr ' || CAST(event_id % 400 AS VARCHAR(20)) AS address,
 'tel ' || CAST(event_id % 1100 AS VARCHAR(20)) AS phone FROM {v_sessions}""",
    "v_case_rows": """
SELECT 'case_' || CAST(EXTRACT(DAY FROM ts) % 7 AS VARCHAR(20)) AS source_case_id, event_id AS row_index, ts AS upload_timestamp, 'U_' || CAST(user_id AS VARCHAR(20)) AS user_id, '10.9.' || CAST({K} AS VARCHAR(20)) || '.1' AS ip_address, event_type, value AS amount FROM {events}""",
    # Case register: one row per supplier, as the cases of a small team.
    "v_cases": """
SELECT 'case_' || CAST(s_suppkey % 13 AS VARCHAR(20)) || CASE WHEN s_suppkey < 13 THEN '' ELSE '_' || CAST(s_suppkey AS VARCHAR(20)) END AS case_id,
 CASE WHEN s_suppkey % 4 = 0 THEN 'Bot sweep ' ELSE 'Review ' END || s_name AS case_name,
 CASE s_suppkey % 5 WHEN 0 THEN 'FLAGGED' WHEN 1 THEN 'cleared' WHEN 2 THEN ' investigating ' WHEN 3 THEN 'odd' END AS status,
 'tenant_' || CAST(s_nationkey % 2 AS VARCHAR(20)) AS tenant_id,
 TIMESTAMP_NTZ '2024-01-01 00:00:00' + CAST(s_suppkey AS INT) * INTERVAL 7 HOUR AS created_at, s_suppkey AS case_no FROM {supplier}""",
    # Share list: an owner case opens its rows to a viewer case.
    "v_shares": """
SELECT a.case_id AS owner_case_id, b.case_id AS viewer_case_id, a.created_at AS shared_at FROM {v_cases} a JOIN {v_cases} b ON b.case_no = (a.case_no * 3 + 1) % 13""",
    # Leads and the audit trail, taken from the event stream.
    "v_leads": """
SELECT event_id AS lead_id, 'case_' || CAST(user_id % 7 AS VARCHAR(20)) AS case_id, event_type AS pin_kind,
 'fp_' || CAST({K} % 20 AS VARCHAR(20)) AS fingerprint, value / 100.0 AS severity,
 CASE event_id % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'VERIFIED' WHEN 2 THEN 'DISMISSED' ELSE 'ESCALATED' END AS status, ts AS created_at FROM {events}""",
    "v_audit": """
SELECT event_id AS audit_id, 'case_' || CAST(user_id % 7 AS VARCHAR(20)) AS case_id, event_type AS action,
 CASE WHEN event_id % 3 = 0 THEN props END AS code, event_type || ' ' || props AS notes, ts AS logged_at FROM {events}""",
    # A score per labelled document, for the threshold queries.
    "v_scores": """
SELECT d.doc_id, CAST(l.toxic AS INT) AS label, CAST(d.n_chars % 997 AS DOUBLE) / 997.0 AS score
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    # Numeric document features with both labels.
    "v_features": """
SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS n_spaces,
 CAST(length(d.text) - length(replace(d.text, '.', '')) AS DOUBLE) AS n_stops, l.quality, l.toxic
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
}

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_NEEDS = {name: [v for v in VIEWS if "{" + v + "}" in text] for name, text in VIEWS.items()}


class Tables:
    """Attribute access to the driver tables and the adapter views, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = VIEWS[name].replace("{K}", JSON_KEY_SPARK)
                inputs = {n: getattr(self, n) for n in [*BASE, *VIEWS] if "{" + n + "}" in text}
                self._made[name] = self.spark.sql(text, **inputs)
        return self._made[name]

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)

    @cached_property
    def session_roles(self):
        from inquest.roles import ColumnRoles

        return ColumnRoles(
            user="acc_id", timestamp="created_at", ip="ip", user_agent="user_agent", fingerprint="canvas_fingerprint",
            email="email", name="name", latitude="latitude", longitude="longitude", hardware="hardware_id", isp="isp",
            amount="amount", outcome="outcome", row_id="event_id",
        )

    @cached_property
    def txn_roles(self):
        from inquest.roles import ColumnRoles

        return ColumnRoles(
            user="user_id", transaction="transaction_id", amount="amount", status="status", disputed="disputed", ip="ip",
            device="device_id", timestamp="transaction_date", dispute_date="dispute_date", login="login_ts", access="access_ts",
            billing_zip="billing_zip", shipping_zip="shipping_zip", avs="avs", cvv="cvv", employee="employee_id",
        )


def _closure(views: tuple[str, ...]) -> list[str]:
    out: list[str] = []

    def visit(name: str) -> None:
        for dep in _NEEDS[name]:
            visit(dep)
        if name not in out:
            out.append(name)

    for v in views:
        visit(v)
    return out


def oracle_view(name: str) -> str:
    text = VIEWS[name].replace("{K}", JSON_KEY_ORACLE).replace("TIMESTAMP_NTZ '", "TIMESTAMP '")
    for n in [*BASE, *VIEWS]:
        text = text.replace("{" + n + "}", n)
    return text.strip()


def oracle_prefix(sql: str, views: tuple[str, ...]) -> str:
    body = sql.strip()
    names = _closure(views)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({oracle_view(n)})" for n in names)
    upper = body[:15].upper()
    if upper.startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}"
    if upper.startswith("WITH"):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"
