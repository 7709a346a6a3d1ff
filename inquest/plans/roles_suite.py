"""Detectors on tables with headers as exports have them: cleaned, renamed and resolved, never named by hand."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest import roles as R
from inquest.operators import bots as B
from inquest.operators import chargeback as C
from inquest.plans import bots_suite, chargeback_suite  # noqa: F401  their SQL is read below
from inquest.plans.registry import ORACLES, query

#: Columns of the session and transaction views as an export spells them.
SESSION_HEADERS = {
    "event_id": "Row Id", "acc_id": "﻿Acc_ID", "name": " Full Name", "created_at": "Signup_Time ", "ip": "IP Address", "canvas_fingerprint": "Canvas Fingerprint", "user_agent": "User-Agent",
    "email": "E-Mail", "latitude": "Geo Latitude", "longitude": "Geo Longitude", "hardware_id": "Hardware ID", "isp": "ISP Name", "amount": "Amount (USD)",
}
TXN_HEADERS = {
    "transaction_id": "Transaction ID", "user_id": "Customer ID", "amount": "Txn Amount", "disputed": "Is Disputed", "status": "Status", "ip": "Ip_Address", "device_id": "Device ID",
    "transaction_date": "Transaction Date", "dispute_date": "Dispute Date", "login_ts": "Last Login", "access_ts": "Content Access",
    "billing_zip": "Billing ZIP", "shipping_zip": "Shipping Zip", "avs": "AVS", "cvv": "CVV Result",
}


def _raw(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    return df.select(*(F.col(c).alias(h) for c, h in headers.items()))


def resolved(raw: DataFrame) -> tuple[DataFrame, R.ColumnRoles]:
    """A table as it came, with clean headers and its core columns renamed, and its roles."""
    named, _ = R.canonicalize_aliases(R.clean_headers(raw))
    named = named.withColumnsRenamed(R.fuzzy_core_columns(named))
    return named, R.resolve_roles(named)


def _sessions(t) -> tuple[DataFrame, R.ColumnRoles]:
    return resolved(_raw(t.v_sessions, SESSION_HEADERS))


def _transactions(t) -> tuple[DataFrame, R.ColumnRoles]:
    return resolved(_raw(t.v_txn, TXN_HEADERS))


def _oracle(key: str) -> str:
    """The result is that of the query on the view with its own names."""
    return ORACLES[key]


#: What each role must come to: the column after renaming, and the one of the view.
SESSION_ROLES = {
    "user": ("user_id", "acc_id"), "timestamp": ("created_at", "created_at"), "ip": ("IP Address", "ip"), "user_agent": ("User-Agent", "user_agent"), "fingerprint": ("Canvas Fingerprint", "canvas_fingerprint"),
    "email": ("E-Mail", "email"), "name": ("Full Name", "name"), "latitude": ("Geo Latitude", "latitude"), "longitude": ("Geo Longitude", "longitude"), "hardware": ("Hardware ID", "hardware_id"), "isp": ("ISP Name", "isp"),
    "amount": ("Amount (USD)", "amount"),
}


@query(
    "roles_resolved",
    " UNION ALL ".join(f"SELECT '{role}' AS role, '{column}' AS \"column\", count({own}) AS filled, count(DISTINCT {own}) AS distinct_values FROM v_sessions" for role, (column, own) in SESSION_ROLES.items()),
    ("v_sessions",),
)
def _(t):
    named, roles = _sessions(t)
    chosen = {role: column for role, column in asdict(roles).items() if role in SESSION_ROLES and column}
    counts = named.select(F.explode(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("v")) for r, c in chosen.items()))).alias("x"))
    return counts.select("x.*").groupBy("role", "column").agg(F.count("v").alias("filled"), F.count_distinct("v").alias("distinct_values"))


@query("raw_bot_clusters", None)
def _(t):
    named, roles = _sessions(t)
    return B.clusters(named, roles, bots_suite.HOURLY)


@query("raw_cb_evidence_score", None)
def _(t):
    named, roles = _transactions(t)
    return C.evidence_scores(C.evidence_counts(named, roles)).drop("win_probability")


@query("raw_cb_ship_bill_mismatch", None)
def _(t):
    named, roles = _transactions(t)
    return C.ship_bill_mismatch(named, roles)


for _key in ("bot_clusters", "cb_evidence_score", "cb_ship_bill_mismatch"):
    ORACLES[f"raw_{_key}"] = _oracle(_key)
