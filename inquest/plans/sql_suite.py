"""The SQL surface: functions by name, and read-only SQL on a case table."""

from __future__ import annotations

from inquest.functions.sql import register_functions, run_select
from inquest.plans.functions_suite import CHUNK_SQL
from inquest.plans.registry import query

SESSIONS, TXN = ("v_sessions",), ("v_txn",)


@query(
    "sql_functions",
    """SELECT event_id, regexp_replace(ip, '\\.[0-9]+$', '.0/24') AS subnet, split_part(email, '@', 2) = 'mailinator.com' AS disposable,
 round(list_aggregate(string_split(split_part(email, '@', 1), ''), 'entropy'), 6) AS bits, CAST(regexp_extract(user_agent, 'Chrome/([0-9]+)', 1) AS INT) AS chrome, isp = 'OVH Hosting' AS hosting,
 round(2 * 3958.7613 * asin(least(1.0, sqrt(pow(sin(radians(latitude - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(latitude)) * pow(sin(radians(longitude + 74.0) / 2), 2)))), 5) AS miles FROM v_sessions""",
    SESSIONS,
)
def _(t):
    register_functions(t.spark)
    return t.sql(
        """SELECT event_id, subnet24(ip) AS subnet, is_disposable(email) AS disposable, round(shannon_entropy(split_part(email, '@', 1)), 6) AS bits,
 chrome_major(user_agent) AS chrome, is_hosting_isp(isp) AS hosting, round(haversine_miles(40.0D, -74.0D, latitude, longitude), 5) AS miles FROM {s}""",
        s=t.v_sessions,
    )


CASE_SQL = """SELECT status, count(*) AS n, round(sum(amount), 2) AS total FROM {dataset} GROUP BY status"""


@query("sql_dataset", CASE_SQL.replace("{dataset}", "v_txn"), TXN)
def _(t):
    return run_select(t.v_txn, CASE_SQL)


@query("sql_chunk_table", f"WITH {CHUNK_SQL} SELECT doc_id, count(*) AS chunks, sum(length(text))::BIGINT AS chars, sha256(string_agg(text, '|' ORDER BY chunk_index)) AS digest FROM chunk_rows GROUP BY doc_id")
def _(t):
    register_functions(t.spark)
    return t.sql(
        """SELECT doc_id, count(*) AS chunks, sum(length(text)) AS chars, sha2(array_join(transform(array_sort(collect_list(struct(chunk_index, text))), x -> x.text), '|'), 256) AS digest
 FROM (SELECT d.doc_id, c.chunk_index, c.text FROM {d} d, LATERAL chunk_text(d.text, 900, 150) c) GROUP BY doc_id""",
        d=t.documents,
    )
