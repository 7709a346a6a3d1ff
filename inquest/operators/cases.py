"""Case register, shares, pins, leads and audit trail as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inquest.functions.scalar import case_status
from inquest.operators.keyed import top_per_key

# Fixed value: cards that a case can have pinned.
MAX_PINS = 24


def order_by_status(cases: DataFrame) -> DataFrame:
    """Flagged cases first, then those under investigation, then cleared ones; newest first in each."""
    rank = F.when(F.col("status") == "FLAGGED", 0).when(F.col("status") == "INVESTIGATING", 1).otherwise(2)
    return cases.withColumn("status", case_status(F.col("status"))).orderBy(rank, F.col("created_at").desc())


def case_memory(leads: DataFrame, audit: DataFrame) -> DataFrame:
    """Per case: leads, audit events, time of the last one, and scripts that were run."""
    a = audit.groupBy("case_id").agg(F.count("*").alias("audit_events"), F.max("logged_at").alias("last_event"), F.count("code").alias("scripts"))
    n = leads.groupBy("case_id").agg(F.count("*").alias("leads"))
    return n.join(a, "case_id", "full").fillna(0, ["leads", "audit_events", "scripts"])


def case_board(leads: DataFrame, audit: DataFrame) -> DataFrame:
    """Leads and audit rows of all cases as one feed: leads newest first, then audit rows by time."""
    l = leads.select("case_id", F.lit("lead").alias("kind"), F.col("lead_id").alias("item_id"), "created_at")
    a = audit.select("case_id", F.lit("audit").alias("kind"), F.col("audit_id").alias("item_id"), F.col("logged_at").alias("created_at"))
    key = F.when(F.col("kind") == "lead", 0).otherwise(1)
    newest = F.when(F.col("kind") == "lead", F.col("created_at"))
    return l.unionByName(a).orderBy("case_id", key, newest.desc(), "created_at", "item_id")


# States of a lead.
LEAD_STATES = ("OPEN", "VERIFIED", "DISMISSED", "ESCALATED")


def latest_state(changes: DataFrame, key: list[str], at: str, tie: str, state: str) -> DataFrame:
    """Last known state per key of an append-only change log."""
    last = F.max_by(state, F.struct(at, tie))
    return changes.groupBy(*key).agg(last.alias(state), F.max(at).alias(at))


def active_case(cases: DataFrame) -> DataFrame:
    """Every case with ``is_active``; the newest one is the active case."""
    newest = cases.agg(F.max_by("case_id", F.struct("created_at", "case_id"))).scalar()
    return cases.withColumn("is_active", F.col("case_id") == newest)


def valid_shares(shares: DataFrame, cases: DataFrame, revoked: DataFrame | None = None) -> DataFrame:
    """One row per (owner, viewer): two different cases of one tenant, not revoked, earliest share kept."""
    tenant = cases.select("case_id", "tenant_id")
    ok = (
        shares.filter(F.col("owner_case_id") != F.col("viewer_case_id"))
        .join(tenant.toDF("owner_case_id", "owner_tenant"), "owner_case_id")
        .join(tenant.toDF("viewer_case_id", "viewer_tenant"), "viewer_case_id")
        .filter("owner_tenant = viewer_tenant")
    )
    if revoked is not None:
        ok = ok.join(revoked.select("owner_case_id", "viewer_case_id"), ["owner_case_id", "viewer_case_id"], "left_anti")
    return ok.groupBy("owner_case_id", "viewer_case_id").agg(F.min("shared_at").alias("shared_at"))


def purge(table: DataFrame, purged: DataFrame, case: str = "case_id") -> DataFrame:
    """Rows of all cases but the purged ones."""
    return table.join(purged.select(F.col("case_id").alias(case)), case, "left_anti").select(*table.columns)


def pinned_cards(cards: DataFrame, at: str, tie: str) -> DataFrame:
    """The pinned cards per case, latest first, as many as a board holds."""
    return top_per_key(cards, ["case_id"], [F.col(at).desc(), F.col(tie).desc()], MAX_PINS, "slot")
