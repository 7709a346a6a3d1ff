"""Chargeback queries over the transaction view."""

from __future__ import annotations

from pyspark.sql import functions as F

from inquest.operators import chargeback as C
from inquest.plans.registry import query
from inquest.session import cut_lineage, shared_scratch
from inquest.sources.sinks import sink_evidence_packages

TXN = ("v_txn",)

SIG = """clean AS (SELECT user_id, kind, value, min(transaction_date) AS f, count(*) AS m FROM (SELECT user_id, transaction_date, unnest(['ip', 'device']) AS kind, unnest([ip, device_id]) AS value FROM v_txn WHERE NOT disputed) GROUP BY ALL),
prior AS (SELECT d.transaction_id, d.user_id, d.amount, d.kind, d.value, c.f < d.transaction_date AS strict, c.m FROM (SELECT *, unnest(['ip', 'device']) AS kind, unnest([ip, device_id]) AS value FROM v_txn WHERE disputed) d JOIN clean c ON c.user_id = d.user_id AND c.kind = d.kind AND c.value = d.value),
post AS (SELECT transaction_id, user_id, amount, 'activity_after_dispute_login' AS signal FROM v_txn WHERE disputed AND login_ts > dispute_date UNION ALL SELECT transaction_id, user_id, amount, 'activity_after_dispute_digital_access' FROM v_txn WHERE disputed AND access_ts > dispute_date),
vel AS (SELECT user_id, dispute_date AS anchor, sum(c)::BIGINT AS cb_6mo FROM (SELECT user_id, dispute_date, count(*) OVER (PARTITION BY user_id ORDER BY dispute_date RANGE BETWEEN INTERVAL 180 DAY PRECEDING AND CURRENT ROW) AS c FROM v_txn WHERE disputed) GROUP BY ALL HAVING sum(c) >= 3),
ship AS (SELECT transaction_id, user_id, amount, 'billing_shipping_mismatch' AS signal FROM v_txn WHERE disputed AND billing_zip <> shipping_zip),
strong AS (SELECT transaction_id, user_id, amount, 'strong_avs' AS signal FROM v_txn WHERE disputed AND avs = 'Match' UNION ALL SELECT transaction_id, user_id, amount, 'strong_cvv' FROM v_txn WHERE disputed AND cvv = 'P'),
counts AS (SELECT user_id, sum(CASE kind WHEN 'a' THEN n ELSE 0 END)::BIGINT AS ip_device, sum(CASE kind WHEN 'b' THEN n ELSE 0 END)::BIGINT AS post_dispute, sum(CASE kind WHEN 'c' THEN n ELSE 0 END)::BIGINT AS velocity, sum(CASE kind WHEN 'd' THEN n ELSE 0 END)::BIGINT AS ship_bill, sum(CASE kind WHEN 'e' THEN n ELSE 0 END)::BIGINT AS avs_cvv, sum(CASE kind WHEN 'f' THEN n ELSE 0 END)::BIGINT AS disputed_rows FROM (
 SELECT user_id, 'a' AS kind, count(*) AS n FROM prior WHERE strict GROUP BY ALL UNION ALL SELECT user_id, 'b', count(*) FROM post GROUP BY ALL UNION ALL SELECT user_id, 'c', count(*) FROM vel GROUP BY ALL
 UNION ALL SELECT user_id, 'd', count(*) FROM ship GROUP BY ALL UNION ALL SELECT user_id, 'e', count(*) FROM strong GROUP BY ALL UNION ALL SELECT user_id, 'f', count(*) FROM v_txn WHERE disputed GROUP BY ALL) GROUP BY user_id),
scored AS (SELECT *, least(100.0, least(36.0, ip_device * 3.5) + least(28.0, post_dispute * 4.0) + least(18.0, velocity * 6.0) + least(14.0, ship_bill * 2.5) + least(14.0, avs_cvv * 2.0))::DOUBLE AS evidence_score FROM counts)"""


@query("cb_ip_device_prior_match", f"WITH {SIG} SELECT transaction_id, user_id, amount, kind, value, kind || '_matches_prior_undisputed' AS signal FROM prior WHERE strict", TXN)
def _(t):
    return C.prior_matches(t.v_txn, t.txn_roles)


@query("cb_ip_device_any_match", f"WITH {SIG} SELECT transaction_id, user_id, amount, kind, value, m AS clean_rows, kind || '_matches_prior_undisputed' AS signal FROM prior", TXN)
def _(t):
    return C.prior_matches(t.v_txn, t.txn_roles, strictly_prior=False)


@query("cb_post_dispute_activity", f"WITH {SIG} SELECT * FROM post", TXN)
def _(t):
    return C.post_dispute_activity(t.v_txn, t.txn_roles)


@query("cb_dispute_velocity", f"WITH {SIG} SELECT * FROM vel", TXN)
def _(t):
    return C.dispute_velocity(t.v_txn, t.txn_roles)


@query("cb_ship_bill_mismatch", f"WITH {SIG} SELECT * FROM ship", TXN)
def _(t):
    return C.ship_bill_mismatch(t.v_txn, t.txn_roles)


@query("cb_avs_cvv_strong", f"WITH {SIG} SELECT * FROM strong", TXN)
def _(t):
    return C.strong_checks(t.v_txn, t.txn_roles)


@query("cb_evidence_score", f"WITH {SIG} SELECT * FROM scored", TXN)
def _(t):
    return C.evidence_scores(C.evidence_counts(t.v_txn, t.txn_roles)).drop("win_probability")


@query(
    "cb_win_probability",
    f"""WITH {SIG} SELECT user_id, round(least(0.92, 0.28 + evidence_score / 125 + 0.07 * least(1.0, post_dispute / 4.0) + 0.05 * least(1.0, ip_device / 5.0)), 6) AS win_probability FROM scored""",
    TXN,
)
def _(t):
    scored = C.evidence_scores(C.evidence_counts(t.v_txn, t.txn_roles))
    return scored.select("user_id", F.round("win_probability", 6).alias("win_probability"))


# Amounts of disputed rows are raised, so that the warm-up pattern occurs.
RAISED = "CASE WHEN disputed AND user_id % 3 = 0 THEN amount * 25 ELSE amount END"
TRUST = f"""r AS (SELECT CAST(user_id AS VARCHAR) AS user_id, transaction_id, {RAISED} AS amount, status, ip, device_id FROM v_txn),
f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY status = 'disputed' DESC, amount DESC, transaction_id DESC) = 1),
c AS (SELECT user_id, count(*) AS completed_n, avg(amount) AS avg_completed FROM r WHERE status = 'completed' GROUP BY 1),
tv AS (SELECT f.user_id, f.transaction_id AS focal_transaction, f.amount AS focal_amount, f.ip AS focal_ip, f.device_id AS focal_device, coalesce(c.completed_n, 0) AS completed_n, coalesce(c.avg_completed, 0.0) AS avg_completed,
 EXISTS (SELECT 1 FROM r WHERE r.user_id = f.user_id AND r.status = 'completed' AND r.ip = f.ip) AS same_ip, EXISTS (SELECT 1 FROM r WHERE r.user_id = f.user_id AND r.status = 'completed' AND r.device_id = f.device_id) AS same_device,
 f.amount / greatest(coalesce(c.avg_completed, 0.0), 0.01) AS ratio FROM f LEFT JOIN c ON c.user_id = f.user_id),
full_tv AS (SELECT *, ratio > 10 AND completed_n >= 3 AS seasoning, same_ip OR same_device AS consistent FROM tv)"""


# Averages of cents fall on rounding edges; their totals do not.
COMPLETED_TOTAL = "round(avg_completed * completed_n, 2) AS completed_total"


def _raised(t):
    return C.trust_velocity(t.v_txn.withColumn("amount", F.expr(RAISED)), t.txn_roles)


@query("cb_trust_velocity", f"WITH {TRUST} SELECT user_id, focal_transaction, round(focal_amount, 4) AS focal_amount, completed_n, round(avg_completed * completed_n, 2) AS completed_total, round(ratio, 6) AS ratio, seasoning FROM full_tv", TXN)
def _(t):
    return _raised(t).select(
        "user_id", "focal_transaction", F.round("focal_amount", 4).alias("focal_amount"), "completed_n", F.expr(COMPLETED_TOTAL), F.round("ratio", 6).alias("ratio"), "seasoning"
    )


@query(
    "cb_trust_velocity_no_status",
    f"""WITH r AS (SELECT CAST(user_id AS VARCHAR) AS user_id, transaction_id, amount FROM v_txn), f AS (SELECT user_id, max(amount) AS focal_amount FROM r GROUP BY 1)
SELECT f.user_id, f.focal_amount, count(r.amount) AS completed_n, round(coalesce(avg(r.amount), 0.0) * count(r.amount), 2) AS completed_total FROM f LEFT JOIN r ON r.user_id = f.user_id AND r.amount < f.focal_amount * 0.99 GROUP BY ALL""",
    TXN,
)
def _(t):
    out = C.trust_velocity(t.v_txn, t.txn_roles.with_roles(status=None))
    return out.select("user_id", "focal_amount", "completed_n", F.expr(COMPLETED_TOTAL))


@query("cb_infra_consistency", f"WITH {TRUST} SELECT user_id, focal_transaction, focal_ip, focal_device, same_ip, same_device, consistent FROM full_tv", TXN)
def _(t):
    return _raised(t).select("user_id", "focal_transaction", "focal_ip", "focal_device", "same_ip", "same_device", "consistent")


@query(
    "cb_seasoning_risk",
    f"""WITH {TRUST} SELECT user_id, CAST(round_even(least(100.0, least(100.0, least(95.0, 35.0 + least(100.0, greatest(0.0, (ratio - 1.0) * 12.0))) + CASE WHEN consistent THEN 15.0 ELSE 0.0 END) + CASE WHEN seasoning THEN 12.0 ELSE 0.0 END)::DOUBLE, 0) AS INT) AS risk_score,
 CASE WHEN seasoning AND consistent THEN 'High risk: potential account seasoning, device or address consistent with warm-up' WHEN seasoning THEN 'Elevated friendly-fraud / seasoning risk' ELSE 'Review recommended' END AS verdict FROM full_tv""",
    TXN,
)
def _(t):
    return C.seasoning_risk(_raised(t)).select("user_id", "risk_score", "verdict")


@query(
    "cb_manifests",
    """SELECT transaction_id, amount, ip AS ip_logs, billing_zip AS billing, shipping_zip AS shipping, avs AS avs, cvv AS cvv, access_ts IS NOT NULL AS has_access, 5 + CASE WHEN access_ts IS NOT NULL THEN 1 ELSE 0 END - 1 AS sections FROM v_txn WHERE disputed""",
    TXN,
)
def _(t):
    m = C.manifests(t.v_txn, t.txn_roles)
    filled = [F.col("service.ip_logs"), F.col("service.logins"), F.col("service.digital_access"), F.col("delivery.shipping"), F.col("policy"), F.col("authentication"), F.col("communication")]
    return m.select(
        "transaction_id", F.col("source_row.amount").alias("amount"), F.col("service.ip_logs")["ip"].alias("ip_logs"), F.col("delivery.billing")["billing_zip"].alias("billing"),
        F.col("delivery.shipping")["shipping_zip"].alias("shipping"), F.col("authentication")["avs"].alias("avs"), F.col("authentication")["cvv"].alias("cvv"),
        F.col("service.digital_access").isNotNull().alias("has_access"), sum((c.isNotNull().cast("int") for c in filled), F.lit(0)).alias("sections"),
    )


def evidence_rows(txn, roles):
    """Manifests with their bucket, one row per bucket of the transaction id.

    A row has its own bucket at hand, so wide rows meet no other rows by a shuffle unless an id comes with several buckets.
    """
    bucket = lambda c: (F.col(c) % 10).alias("bucket")
    rows = C.manifest_summary(C.manifests(txn, roles), bucket("source_row.user_id")).filter("transaction_id IS NOT NULL")
    pairs = txn.filter("disputed").select("transaction_id", bucket("user_id"))
    kinds = pairs.groupBy("transaction_id").agg(F.min("bucket").alias("low"), F.max("bucket").alias("high"), F.count("bucket").alias("filled"), F.count("*").alias("n"))
    several = cut_lineage(kinds.filter("low <> high OR filled > 0 AND filled < n").select("transaction_id"))
    if several.isEmpty():
        return rows
    all_of = pairs.join(several, "transaction_id", "left_semi").distinct()
    return rows.join(several, "transaction_id", "left_anti").unionByName(rows.drop("bucket").join(all_of, "transaction_id"))


@query("sink_evidence_packages", "SELECT transaction_id, user_id % 10 AS bucket, 4 + CASE WHEN access_ts IS NOT NULL THEN 1 ELSE 0 END AS sections FROM v_txn WHERE disputed", TXN)
def _(t):
    rows = evidence_rows(t.v_txn, t.txn_roles)
    back = sink_evidence_packages(rows, shared_scratch(t.spark, "evidence"), "bucket")
    return back.select("transaction_id", "bucket", "sections")


@query(
    "cb_case_payload",
    f"""WITH {SIG}, sig AS (SELECT transaction_id, kind || '_matches_prior_undisputed' AS signal FROM prior WHERE strict UNION ALL SELECT transaction_id, signal FROM post UNION ALL SELECT transaction_id, signal FROM ship UNION ALL SELECT transaction_id, signal FROM strong),
few AS (SELECT signal, transaction_id FROM (SELECT DISTINCT signal, transaction_id FROM sig) QUALIFY row_number() OVER (PARTITION BY signal ORDER BY transaction_id) <= 8)
SELECT signal, (SELECT count(*) FROM sig WHERE sig.signal = few.signal) AS n, string_agg(transaction_id, ',' ORDER BY transaction_id) AS samples FROM few GROUP BY signal""",
    TXN,
)
def _(t):
    return C.case_payload(t.v_txn, t.txn_roles).withColumn("samples", F.array_join("samples", ","))
