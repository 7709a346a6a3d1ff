"""Filters, joins, aggregates, windows, orders and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inquest.functions import scalar as S
from inquest.operators import keyed as K
from inquest.operators import relational as R
from inquest.plans.registry import query

SESSIONS, TXN, LINKS, PAY, CASES = ("v_sessions",), ("v_txn",), ("v_links",), ("v_payments",), ("v_case_rows",)

# ---- D filters ---------------------------------------------------------------


@query(
    "filter_nonempty_pair",
    """SELECT event_id, payer, payee FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS payer, nullif(CASE WHEN event_id % 6 = 0 THEN '' ELSE json_extract_string(props, '$.k') END, '') AS payee FROM events)
 WHERE payee IS NOT NULL AND payer <> payee""",
)
def _(t):
    payee = F.when(F.col("event_id") % 6 == 0, "  ").otherwise(F.get_json_object("props", "$.k"))
    pairs = t.events.select("event_id", F.col("user_id").alias("payer"), payee.alias("payee"))
    return R.nonempty_pair(pairs, "payer", "payee", different=True)


@query(
    "search_rows_text",
    """SELECT DISTINCT source_case_id, source_case_id || '.csv' AS source_filename, upload_timestamp FROM v_case_rows WHERE ip_address LIKE '%10.9.7.%'""",
    CASES,
)
def _(t):
    from inquest.operators.warehouse import append_events

    return R.search_rows_text(append_events(t.v_case_rows, "source_case_id", "upload_timestamp", "row_index"), "10.9.7.")


@query("filter_postal_mismatch", "SELECT transaction_id, amount, billing_zip, shipping_zip FROM v_txn WHERE disputed AND billing_zip <> shipping_zip", TXN)
def _(t):
    return R.postal_mismatch(t.v_txn, "billing_zip", "shipping_zip", "disputed").select("transaction_id", "amount", "billing_zip", "shipping_zip")


@query(
    "filter_activity_after_dispute",
    """SELECT transaction_id, amount, 'login' AS activity FROM v_txn WHERE disputed AND login_ts > dispute_date
 UNION ALL SELECT transaction_id, amount, 'digital_access' FROM v_txn WHERE disputed AND access_ts > dispute_date""",
    TXN,
)
def _(t):
    found = R.activity_after_dispute(t.v_txn, "disputed", "dispute_date", {"login": "login_ts", "digital_access": "access_ts"})
    return found.select("transaction_id", "amount", "activity")


@query(
    "filter_isin_members",
    """SELECT event_id, acc_id IN (SELECT acc_id FROM v_sessions WHERE email LIKE '%mailinator%') AS is_member FROM v_sessions""",
    SESSIONS,
)
def _(t):
    flagged = t.v_sessions.filter(F.col("email").contains("mailinator")).select("acc_id")
    return R.with_membership(t.v_sessions, "acc_id", flagged).select("event_id", "is_member")


# ---- E joins -----------------------------------------------------------------


@query(
    "join_prior_match",
    """SELECT transaction_id, amount, ip FROM v_txn d WHERE disputed AND EXISTS (SELECT 1 FROM (SELECT user_id, ip, min(transaction_date) AS f FROM v_txn WHERE NOT disputed GROUP BY ALL) c
 WHERE c.user_id = d.user_id AND c.ip = d.ip AND c.f < d.transaction_date)""",
    TXN,
)
def _(t):
    return R.matches_clean_history(t.v_txn, "user_id", "ip", "disputed", "transaction_date").select("transaction_id", "amount", "ip")


@query(
    "join_window_counts_left",
    """SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS slot, count(DISTINCT acc_id) AS total_users, count(DISTINCT acc_id) FILTER (email LIKE '%mailinator%') AS bot_users FROM v_sessions GROUP BY 1""",
    SESSIONS,
)
def _(t):
    rows = t.v_sessions.select(S.truncate_ts(F.col("created_at"), "5 minutes").alias("slot"), "acc_id", F.col("email").contains("mailinator").alias("bot"))
    return R.window_counts(rows, "slot", "acc_id", "bot")


@query(
    "join_self_trailing_range",
    """WITH d AS (SELECT user_id, dispute_date FROM v_txn WHERE disputed AND dispute_date IS NOT NULL),
w AS (SELECT user_id, dispute_date, count(*) OVER (PARTITION BY user_id ORDER BY dispute_date RANGE BETWEEN INTERVAL 180 DAY PRECEDING AND CURRENT ROW) AS in_window FROM d)
SELECT user_id, dispute_date, count(*) AS n, max(in_window) AS in_window FROM w GROUP BY ALL""",
    TXN,
)
def _(t):
    return R.trailing_disputes(t.v_txn.filter("disputed"), "user_id", "dispute_date")


@query(
    "asof_last_login",
    """WITH h AS (SELECT acc_id, created_at, event_id, latitude, longitude FROM v_sessions WHERE event_id % 11 <> 0)
SELECT s.event_id, h.event_id AS last_event_id, h.latitude AS last_latitude FROM v_sessions s ASOF LEFT JOIN h ON s.acc_id = h.acc_id AND s.created_at > h.created_at""",
    SESSIONS,
)
def _(t):
    # Every eleventh row has no position and can be no answer.
    rows = t.v_sessions.withColumn("latitude", F.when(F.col("event_id") % 11 != 0, F.col("latitude")))
    seen = R.last_valid_before(rows, "acc_id", "created_at", "latitude", "longitude", "event_id")
    return seen.select("event_id", F.col("last_login.event_id").alias("last_event_id"), F.col("last_login.latitude").alias("last_latitude"))


@query(
    "asof_latest_login",
    """SELECT acc_id, max(created_at) AS created_at, arg_max(event_id, created_at) AS event_id, arg_max(latitude, created_at) AS latitude FROM v_sessions GROUP BY acc_id""",
    SESSIONS,
)
def _(t):
    return R.latest_per_key(t.v_sessions, ["acc_id"], "created_at", "event_id", ["latitude"])


@query(
    "asof_session_table",
    """SELECT s.event_id, h.event_id AS last_event_id FROM (SELECT * FROM v_sessions WHERE event_type = 'purchase') s
 ASOF LEFT JOIN (SELECT * FROM v_sessions WHERE event_type = 'signup') h ON s.acc_id = h.acc_id AND s.created_at > h.created_at""",
    SESSIONS,
)
def _(t):
    cols = ["acc_id", "created_at", "event_id", "latitude"]
    s = t.v_sessions
    joined = R.asof_history(
        s.filter("event_type = 'purchase'").select(*cols), s.filter("event_type = 'signup'").select(*cols), "acc_id", "created_at", ["latitude"], "event_id"
    )
    return joined.select("event_id", F.col("as_of.event_id").alias("last_event_id"))


@query(
    "co_membership_stars",
    """WITH p AS (SELECT DISTINCT 'shared_address' AS kind, address AS value, account_id AS account FROM v_links UNION SELECT 'shared_phone', phone, account_id FROM v_links UNION SELECT 'shared_device', device_id, account_id FROM v_links),
g AS (SELECT kind, value, count(*) AS group_size, min(account) AS anchor FROM p GROUP BY ALL HAVING count(*) >= 2)
SELECT p.kind, p.value, g.anchor, p.account, g.group_size FROM p JOIN g ON p.kind = g.kind AND p.value = g.value""",
    LINKS,
)
def _(t):
    kinds = {"shared_device": "device_id", "shared_address": "address", "shared_phone": "phone"}
    return R.shared_value_stars(t.v_links, "account_id", kinds)


ALL_JOINS = """SELECT c.c_mktsegment AS segment, count(*) AS n_rows, count(o.o_orderkey) AS n_orders, count(DISTINCT c.c_custkey) AS n_customers,
 sum(CASE WHEN EXISTS (SELECT 1 FROM {nation} n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1) THEN 1 ELSE 0 END) AS n_region_1,
 sum(CASE WHEN c.c_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {supplier} s WHERE s.s_nationkey = c.c_nationkey) THEN 1 ELSE 0 END) AS n_no_supplier
 FROM {customer} c FULL JOIN (SELECT * FROM {orders} WHERE o_orderstatus = 'P') o ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment"""


@query(
    "join_all_kinds",
    ALL_JOINS.replace("{", "").replace("}", "").replace("sum(CASE", "sum(CASE").replace("AS n_region_1", "::BIGINT AS n_region_1").replace("AS n_no_supplier", "::BIGINT AS n_no_supplier"),
)
def _(t):
    return t.sql(ALL_JOINS, nation=t.nation, supplier=t.supplier, customer=t.customer, orders=t.orders)


# ---- F aggregates ------------------------------------------------------------


@query(
    "agg_count_distinct_by_key",
    """SELECT canvas_fingerprint, count(*) AS n_rows, count(DISTINCT acc_id) AS n_users, count(DISTINCT ip) AS n_ip, count(DISTINCT name) AS n_name FROM v_sessions GROUP BY 1 HAVING count(DISTINCT acc_id) >= 5""",
    SESSIONS,
)
def _(t):
    return R.count_distinct_by_key(t.v_sessions, ["canvas_fingerprint"], {"acc_id": "n_users", "ip": "n_ip", "name": "n_name"}, F.col("n_users") >= 5)


@query(
    "agg_members_list",
    """SELECT address, count(DISTINCT account_id) AS group_size, 0 AS chunk_no, array_to_string(list_sort(list(DISTINCT account_id)), ',') AS members FROM v_links GROUP BY address""",
    LINKS,
)
def _(t):
    packed = K.packed_members(t.v_links, ["address"], "account_id")
    return packed.withColumn("members", F.array_join("members", ","))


@query(
    "agg_payment_edges",
    "SELECT CAST(payer AS VARCHAR) AS payer, CAST(payee AS VARCHAR) AS payee, count(*) AS transfer_count, round(sum(amount), 4) AS total_amount FROM v_payments GROUP BY ALL",
    PAY,
)
def _(t):
    return R.payment_edges(t.v_payments, "payer", "payee", "amount").withColumn("total_amount", F.round("total_amount", 4))


@query(
    "agg_employee_account",
    """SELECT employee_id, CAST(user_id AS VARCHAR) AS account_id, count(*) AS touch_count, round(sum(amount), 2) AS total_amount,
 CASE WHEN sum(amount) >= 5000 OR count(*) >= 9 THEN 'high' ELSE 'medium' END AS severity FROM v_txn GROUP BY ALL HAVING count(*) >= 3 OR sum(amount) >= 5000""",
    TXN,
)
def _(t):
    return R.employee_account_touches(t.v_txn, "employee_id", "user_id", "amount").withColumn("total_amount", F.round("total_amount", 2))


@query(
    "agg_mode",
    """SELECT acc_id, count(*) AS n FROM v_sessions GROUP BY acc_id ORDER BY n DESC, acc_id LIMIT 5""",
    SESSIONS,
)
def _(t):
    from inquest.operators.ato import top_users

    return top_users(t.v_sessions, "acc_id", 5)


@query("agg_amount_stats", "SELECT acc_id, round(avg(amount) * count(*), 2) AS amount_total, max(amount) AS max_amount, count(*) AS samples FROM v_sessions GROUP BY 1", SESSIONS)
def _(t):
    # Averages of cents fall on rounding edges; their totals do not.
    total = F.round(F.col("avg_amount") * F.col("samples"), 2).alias("amount_total")
    return R.amount_stats(t.v_sessions, ["acc_id"], "amount").select("acc_id", total, "max_amount", "samples")


@query(
    "agg_duration_stats",
    "SELECT acc_id, round(avg(session_seconds), 6) AS mean_seconds, round(quantile_cont(session_seconds, 0.5), 6) AS median_seconds FROM v_sessions GROUP BY 1",
    SESSIONS,
)
def _(t):
    mean = t.v_sessions.groupBy("acc_id").agg(F.round(F.avg("session_seconds"), 6).alias("mean_seconds"))
    mid = K.quantile_by_key(t.v_sessions, ["acc_id"], "session_seconds", 0.5, "median_seconds")
    return mean.join(mid.withColumn("median_seconds", F.round("median_seconds", 6)), "acc_id")


@query(
    "agg_percentile_threshold",
    """SELECT source_case_id, round(quantile_cont(y, 0.85), 4) AS threshold FROM (SELECT source_case_id, hour(upload_timestamp) AS h, sum(amount) AS y FROM v_case_rows GROUP BY ALL) GROUP BY 1""",
    CASES,
)
def _(t):
    hourly = t.v_case_rows.groupBy("source_case_id", F.hour("upload_timestamp").alias("h")).agg(F.sum("amount").alias("y"))
    return hourly.groupBy("source_case_id").agg(F.round(F.percentile("y", 0.85), 4).alias("threshold"))


GROUPING = """SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping(o_orderstatus) + 0 AS g FROM {orders} GROUP BY %s"""


def _grouping(key: str, clause: str) -> None:
    text = GROUPING % clause

    @query(key, text.replace("{orders}", "orders").replace("grouping(o_orderstatus) + 0", "CAST(grouping(o_orderstatus) AS INT)"))
    def _(t):
        return t.sql(text, orders=t.orders).withColumn("g", F.col("g").cast("int"))


_grouping("agg_rollup", "ROLLUP (o_orderstatus, o_orderpriority)")
_grouping("agg_cube", "CUBE (o_orderstatus, o_orderpriority)")
_grouping("agg_grouping_sets", "GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), (o_orderpriority))")


# ---- G windows ---------------------------------------------------------------


@query(
    "win_share_of_total",
    """SELECT canvas_fingerprint, count(*) AS n_rows, count(DISTINCT ip) AS n_distinct, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct_of_rows FROM v_sessions GROUP BY 1""",
    SESSIONS,
)
def _(t):
    return R.share_of_total(t.v_sessions, "canvas_fingerprint", "ip").withColumn("pct_of_rows", F.round("pct_of_rows", 6))


@query(
    "win_range_1h_velocity",
    """WITH w AS (SELECT acc_id, hardware_id, count(*) OVER (PARTITION BY acc_id, hardware_id ORDER BY created_at RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS c FROM v_sessions)
SELECT acc_id, hardware_id, max(c) AS peak FROM w GROUP BY ALL HAVING max(c) >= 2""",
    SESSIONS,
)
def _(t):
    counted = K.trailing_count(t.v_sessions, ["acc_id", "hardware_id"], "created_at", K.HOUR_US)
    return counted.groupBy("acc_id", "hardware_id").agg(F.max("in_window").alias("peak")).filter("peak >= 2")


@query(
    "win_range_180d_disputes",
    """WITH d AS (SELECT user_id, dispute_date FROM v_txn WHERE disputed), w AS (SELECT user_id, dispute_date, count(*) OVER (PARTITION BY user_id ORDER BY dispute_date RANGE BETWEEN INTERVAL 180 DAY PRECEDING AND CURRENT ROW) AS c FROM d)
SELECT user_id, dispute_date, sum(c)::BIGINT AS cb_6mo FROM w GROUP BY ALL HAVING sum(c) >= 3""",
    TXN,
)
def _(t):
    seen = R.trailing_disputes(t.v_txn.filter("disputed"), "user_id", "dispute_date")
    return seen.select("user_id", "dispute_date", (F.col("n") * F.col("in_window")).alias("cb_6mo")).filter("cb_6mo >= 3")


@query(
    "win_gaps_islands",
    """WITH n AS (SELECT DISTINCT 'U_' AS prefix, CAST(substr(acc_id, 3) AS INT) AS number FROM v_sessions), s AS (SELECT prefix, number, lead(number) OVER (PARTITION BY prefix ORDER BY number) = number + 1 AS step FROM n)
SELECT prefix, count(*) AS n_ids, count(*) FILTER (step) AS n_steps FROM s GROUP BY prefix""",
    SESSIONS,
)
def _(t):
    return R.consecutive_suffixes(t.v_sessions, "acc_id")


@query(
    "win_above_threshold_runs",
    """WITH h AS (SELECT source_case_id, date_trunc('hour', upload_timestamp) AS hb, sum(amount) AS y FROM v_case_rows GROUP BY ALL),
a AS (SELECT *, y > 700.0 AS above FROM h), s AS (SELECT *, CASE WHEN above = lag(above) OVER w THEN 0 ELSE 1 END AS new_run FROM a WINDOW w AS (PARTITION BY source_case_id ORDER BY hb)),
r AS (SELECT *, sum(new_run) OVER (PARTITION BY source_case_id ORDER BY hb) AS run FROM s)
SELECT source_case_id, run::BIGINT AS run, above, min(hb) AS start, max(hb) AS stop, count(*) AS n_points FROM r GROUP BY ALL""",
    CASES,
)
def _(t):
    hourly = t.v_case_rows.groupBy("source_case_id", S.truncate_ts(F.col("upload_timestamp"), "hour").alias("hb")).agg(F.sum("amount").alias("y"))
    return R.threshold_runs(hourly, ["source_case_id"], "hb", "y", F.lit(700.0))


@query(
    "win_topn_per_user",
    """SELECT acc_id, ip, n, "rank" FROM (SELECT *, CAST(row_number() OVER (PARTITION BY acc_id ORDER BY n DESC, ip) AS INT) AS "rank" FROM (SELECT acc_id, ip, count(*) AS n FROM v_sessions GROUP BY ALL)) WHERE "rank" <= 5""",
    SESSIONS,
)
def _(t):
    counts = t.v_sessions.groupBy("acc_id", "ip").agg(F.count("*").alias("n"))
    return K.top_per_key(counts, ["acc_id"], [F.col("n").desc(), F.col("ip")], 5)


@query(
    "win_pad_series",
    """WITH lim AS (SELECT date_trunc('hour', max(ts)) AS last_hour FROM events),
h AS (SELECT user_id, date_trunc('hour', ts) AS hb, sum(value) AS y FROM events, lim WHERE date_trunc('hour', ts) > last_hour - INTERVAL 24 HOUR GROUP BY ALL),
p AS (SELECT user_id, 24 - row_number() OVER (PARTITION BY user_id ORDER BY hb DESC) AS slot, y FROM h),
f AS (SELECT user_id, min(slot) AS from_slot, arg_min(y, slot) AS first_y FROM p GROUP BY 1)
SELECT f.user_id, CAST(g.slot AS INT) AS slot, round(CASE WHEN g.slot < f.from_slot THEN f.first_y ELSE p.y END, 4) AS y FROM f, (SELECT unnest(range(0, 24)) AS slot) g LEFT JOIN p ON p.user_id = f.user_id AND p.slot = g.slot""",
)
def _(t):
    hour = S.truncate_ts(F.col("ts"), "hour")
    hourly = t.events.groupBy("user_id", hour.alias("hb")).agg(F.sum("value").alias("y"))
    last = t.events.agg(F.max(hour)).scalar()
    return R.pad_series(hourly, ["user_id"], "hb", "y", last).withColumn("y", F.round("y", 4))


# ---- H orders ----------------------------------------------------------------


@query(
    "topk_groups",
    "SELECT ip, count(DISTINCT acc_id) AS n_users FROM v_sessions GROUP BY ip ORDER BY n_users DESC, ip LIMIT 25",
    SESSIONS,
)
def _(t):
    counts = R.count_distinct_by_key(t.v_sessions, ["ip"], {"acc_id": "n_users"}).drop("n_rows")
    return counts.orderBy(F.col("n_users").desc(), "ip").limit(25)


@query(
    "top1_focal_row",
    """SELECT user_id, transaction_id, amount, disputed FROM v_txn QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY disputed DESC, amount DESC, transaction_id) = 1""",
    TXN,
)
def _(t):
    order = [F.col("disputed").desc(), F.col("amount").desc_nulls_last(), F.col("transaction_id")]
    return K.top_per_key(t.v_txn, ["user_id"], order, 1).select("user_id", "transaction_id", "amount", "disputed")


@query(
    "last_n_sessions",
    """SELECT acc_id, event_id, created_at, CAST(row_number() OVER (PARTITION BY acc_id ORDER BY created_at DESC, event_id DESC) AS INT) AS "rank" FROM v_sessions WHERE outcome = 'success' QUALIFY "rank" <= 10""",
    SESSIONS,
)
def _(t):
    from inquest.operators.ato import last_sessions

    return last_sessions(t.v_sessions, t.session_roles, 10).select("acc_id", "event_id", "created_at", "rank")


@query(
    "sort_case_status",
    """SELECT case_id, CASE WHEN upper(trim(status)) IN ('FLAGGED', 'CLEARED') THEN upper(trim(status)) ELSE 'INVESTIGATING' END AS status, created_at FROM v_cases""",
    ("v_cases",),
)
def _(t):
    from inquest.operators.cases import order_by_status

    return order_by_status(t.v_cases).select("case_id", "status", "created_at")


# ---- I sets ------------------------------------------------------------------


@query(
    "intersect_allowed_cases",
    """SELECT DISTINCT ip_address, source_case_id FROM v_case_rows WHERE source_case_id IN (SELECT case_id FROM v_cases WHERE tenant_id = 'tenant_0')""",
    ("v_case_rows", "v_cases"),
)
def _(t):
    allowed = t.v_cases.filter("tenant_id = 'tenant_0'").select(F.col("case_id").alias("source_case_id"))
    return t.v_case_rows.select("ip_address", "source_case_id").distinct().join(allowed, "source_case_id", "left_semi").select("ip_address", "source_case_id")


@query(
    "except_active_case",
    """SELECT ip_address, count(DISTINCT source_case_id) AS other_cases FROM v_case_rows WHERE source_case_id <> (SELECT arg_max(source_case_id, (upload_timestamp, row_index)) FROM v_case_rows) GROUP BY 1""",
    CASES,
)
def _(t):
    # The active case is the one uploaded last.
    active = t.v_case_rows.agg(F.max_by("source_case_id", F.struct("upload_timestamp", "row_index"))).scalar()
    return t.v_case_rows.filter(F.col("source_case_id") != active).groupBy("ip_address").agg(F.count_distinct("source_case_id").alias("other_cases"))


@query("distinct_rows", "SELECT DISTINCT source_case_id, user_id, ip_address FROM v_case_rows", CASES)
def _(t):
    return t.v_case_rows.select("source_case_id", "user_id", "ip_address").distinct()
