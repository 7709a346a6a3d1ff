"""Chargebacks: evidence signals, scores per user, trust against velocity, manifests."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inquest.functions import scalar as S
from inquest.operators.keyed import top_per_key
from inquest.operators.relational import activity_after_dispute, postal_differs, postal_mismatch, trailing_disputes
from inquest.roles import ColumnRoles


@dataclass(frozen=True)
class EvidenceWeights:
    """Weight and ceiling per kind of signal, and the base chance to win."""

    ip_device: tuple[float, float] = (3.5, 36.0)
    post_dispute: tuple[float, float] = (4.0, 28.0)
    velocity: tuple[float, float] = (6.0, 18.0)
    ship_bill: tuple[float, float] = (2.5, 14.0)
    avs_cvv: tuple[float, float] = (2.0, 14.0)
    base_win: float = 0.28
    max_win: float = 0.92


def prior_matches(df: DataFrame, r: ColumnRoles, strictly_prior: bool = True) -> DataFrame:
    """Disputed rows that share an address or a device with an undisputed row of the same user.

    The undisputed side is one row per (user, kind, value) with its first time, so
    each disputed row is found once. ``strictly_prior=False`` also takes undisputed
    rows that come later, and adds how many there are in ``clean_rows``.
    """
    kinds = {k: c for k, c in (("ip", r.ip), ("device", r.device)) if c}
    cells = F.array(*[F.struct(F.lit(k).alias("kind"), S.text(F.col(c)).alias("value")) for k, c in kinds.items()])
    own = lambda c, kind: F.col(c) if c else F.lit(None).cast(kind)
    long = df.select(
        own(r.transaction, "string").alias("transaction_id"), F.col(r.user).alias("user_id"), own(r.amount, "double").alias("amount"),
        F.col(r.timestamp).alias("ts"), S.is_disputed(F.col(r.disputed)).alias("bad"), F.explode(cells).alias("c"),
    ).select("transaction_id", "user_id", "amount", "ts", "bad", "c.kind", "c.value").filter("value IS NOT NULL")
    clean = long.filter("NOT bad").groupBy("user_id", "kind", "value").agg(F.min("ts").alias("first_clean"), F.count("*").alias("clean_rows"))
    hits = long.filter("bad").join(clean, ["user_id", "kind", "value"])
    if strictly_prior:
        hits = hits.filter("first_clean < ts").drop("clean_rows")
    return hits.withColumn("signal", F.concat("kind", F.lit("_matches_prior_undisputed"))).drop("bad", "first_clean", "ts")


def post_dispute_activity(df: DataFrame, r: ColumnRoles) -> DataFrame:
    activities = {k: c for k, c in (("login", r.login), ("digital_access", r.access)) if c}
    found = activity_after_dispute(df, r.disputed, r.dispute_date, activities)
    return found.select(
        F.col(r.transaction).alias("transaction_id"), F.col(r.user).alias("user_id"), F.col(r.amount).alias("amount"),
        F.concat(F.lit("activity_after_dispute_"), "activity").alias("signal"),
    )


def dispute_velocity(df: DataFrame, r: ColumnRoles, days: int = 180, least: int = 3) -> DataFrame:
    """(user_id, anchor, cb_6mo): dispute dates with ``least`` and more disputes within ``days`` back."""
    bad = df.filter(S.is_disputed(F.col(r.disputed)))
    seen = trailing_disputes(bad, r.user, r.dispute_date, days)
    # An anchor that occurs n times counts its window n times, as a self-join would.
    return seen.select(
        F.col(r.user).alias("user_id"), F.col(r.dispute_date).alias("anchor"), (F.col("n") * F.col("in_window")).alias("cb_6mo")
    ).filter(F.col("cb_6mo") >= least)


def ship_bill_mismatch(df: DataFrame, r: ColumnRoles) -> DataFrame:
    found = postal_mismatch(df, r.billing_zip, r.shipping_zip, r.disputed)
    return found.select(
        F.col(r.transaction).alias("transaction_id"), F.col(r.user).alias("user_id"), F.col(r.amount).alias("amount"),
        F.lit("billing_shipping_mismatch").alias("signal"),
    )


def strong_checks(df: DataFrame, r: ColumnRoles) -> DataFrame:
    tests = F.array(*[F.when(S.check_is_strong(F.col(c)), F.lit(f"strong_{k}")) for k, c in (("avs", r.avs), ("cvv", r.cvv)) if c])
    found = df.filter(S.is_disputed(F.col(r.disputed)))
    return found.select(
        F.col(r.transaction).alias("transaction_id"), F.col(r.user).alias("user_id"), F.col(r.amount).alias("amount"),
        F.explode(F.array_compact(tests)).alias("signal"),
    )


def evidence_counts(df: DataFrame, r: ColumnRoles, strictly_prior: bool = True) -> DataFrame:
    """One row per user: counts of the five kinds of signal, and the disputed rows.

    What a row shows by itself is counted in one aggregate; only prior matches and
    velocity, which compare rows, take a pass of their own. A signal whose columns the
    table does not have is skipped and counts 0; user and disputed flag are needed.
    """
    names = ("ip_device", "post_dispute", "velocity", "ship_bill", "avs_cvv", "disputed_rows")

    def yes(hit: Column) -> Column:
        return F.coalesce(hit, F.lit(False)).cast("long")

    none = F.lit(0).cast("long")
    later = [c for c in (r.login, r.access) if c and r.dispute_date]
    own = {
        "post_dispute": sum((yes(F.col(c) > F.col(r.dispute_date)) for c in later), none),
        "ship_bill": yes(postal_differs(r.billing_zip, r.shipping_zip)) if r.billing_zip and r.shipping_zip else none,
        "avs_cvv": sum((yes(S.check_is_strong(F.col(c))) for c in (r.avs, r.cvv) if c), F.lit(0).cast("long")),
        "disputed_rows": F.lit(1).cast("long"),
    }
    prior_n = F.count("*") if strictly_prior else F.sum("clean_rows")
    parts = [
        df.filter(S.is_disputed(F.col(r.disputed))).groupBy(F.col(r.user).alias("user_id")).agg(*[F.sum(v).alias(n) for n, v in own.items()]),
    ]
    if (r.ip or r.device) and r.timestamp:
        parts.append(prior_matches(df, r, strictly_prior).groupBy("user_id").agg(prior_n.alias("ip_device")))
    if r.dispute_date:
        parts.append(dispute_velocity(df, r).groupBy("user_id").agg(F.count("*").alias("velocity")))
    wide = parts[0]
    for part in parts[1:]:
        wide = wide.unionByName(part, allowMissingColumns=True)
    wide = wide.withColumns({n: F.lit(None).cast("long") for n in names if n not in wide.columns})
    return wide.groupBy("user_id").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])


def evidence_scores(counts: DataFrame, w: EvidenceWeights = EvidenceWeights()) -> DataFrame:
    """Adds ``evidence_score`` (0 to 100) and ``win_probability``."""
    def part(name: str) -> Column:
        weight, ceiling = getattr(w, name)
        return F.least(F.lit(ceiling), F.col(name) * weight)

    score = F.least(F.lit(100.0), sum((part(n) for n in ("post_dispute", "velocity", "ship_bill", "avs_cvv")), part("ip_device")))
    win = (
        F.lit(w.base_win) + F.col("evidence_score") / 125.0 + 0.07 * F.least(F.lit(1.0), F.col("post_dispute") / 4.0)
        + 0.05 * F.least(F.lit(1.0), F.col("ip_device") / 5.0)
    )
    return counts.withColumn("evidence_score", score).withColumn("win_probability", F.least(F.lit(w.max_win), win))


# ---- trust against velocity ------------------------------------------------------

# Limits of the warm-up pattern.
SEASONING_RATIO = 10.0
SEASONING_MIN_COMPLETED = 3
NEAR_FOCAL = 0.99
# Texts of the verdict.
VERDICT_SEASONED = "High risk: potential account seasoning, device or address consistent with warm-up"
VERDICT_ELEVATED = "Elevated friendly-fraud / seasoning risk"
VERDICT_REVIEW = "Review recommended"


def trust_velocity(df: DataFrame, r: ColumnRoles) -> DataFrame:
    """One row per user: the focal payment against the user's completed ones.

    The focal row is the largest disputed payment, else the largest of all. It is
    the maximum of a struct, which combines on the map side for any user.
    """
    amount = F.col(r.amount).try_cast("double")
    status = S.status_class(F.col(r.status)) if r.status else F.lit("other")
    rows = df.select(
        S.clean_key(F.col(r.user)).alias("user_id"), amount.alias("amount"), status.alias("status"), S.text(F.col(r.transaction)).alias("transaction_id"),
        S.clean_key(F.col(r.ip)).alias("ip") if r.ip else F.lit(None).cast("string").alias("ip"),
        S.clean_key(F.col(r.device)).alias("device") if r.device else F.lit(None).cast("string").alias("device"),
    ).filter("user_id IS NOT NULL")
    order = F.struct((F.col("status") == "disputed").alias("d"), "amount", "transaction_id", "ip", "device")
    done = F.col("status") == "completed"
    if r.status:
        per = rows.groupBy("user_id").agg(
            F.max(order).alias("f"), F.count_if(done).alias("completed_n"), F.avg(F.when(done, F.col("amount"))).alias("avg_completed")
        )
        completed = rows.filter(done)
    else:
        focal = rows.groupBy("user_id").agg(F.max(order).alias("f"))
        completed = rows.join(focal.select("user_id", F.col("f.amount").alias("_top")), "user_id").filter(F.col("amount") < F.col("_top") * NEAR_FOCAL)
        stats = completed.groupBy("user_id").agg(F.count("*").alias("completed_n"), F.avg("amount").alias("avg_completed"))
        per = focal.join(stats, "user_id", "left").fillna(0, ["completed_n"])
    base = per.select(
        "user_id", F.col("f.transaction_id").alias("focal_transaction"), F.coalesce("f.amount", F.lit(0.0)).alias("focal_amount"),
        F.col("f.ip").alias("focal_ip"), F.col("f.device").alias("focal_device"), "completed_n", F.coalesce("avg_completed", F.lit(0.0)).alias("avg_completed"),
    )
    for name in ("ip", "device"):
        # Distinct first, so a user with very many payments brings few rows to the join.
        used = completed.select("user_id", F.col(name).alias(f"focal_{name}")).filter(F.col(f"focal_{name}").isNotNull()).distinct()
        base = base.join(used.withColumn(f"same_{name}", F.lit(True)), ["user_id", f"focal_{name}"], "left").withColumn(
            f"same_{name}", F.coalesce(f"same_{name}", F.lit(False))
        )
    ratio = F.col("focal_amount") / F.greatest(F.col("avg_completed"), F.lit(0.01))
    out = base.withColumn("ratio", ratio).withColumn("seasoning", (F.col("ratio") > SEASONING_RATIO) & (F.col("completed_n") >= SEASONING_MIN_COMPLETED))
    return out.withColumn("consistent", F.col("same_ip") | F.col("same_device"))


def seasoning_risk(tv: DataFrame) -> DataFrame:
    """Adds ``risk_score`` 0 to 100 and the verdict."""
    by_ratio = F.least(F.lit(100.0), F.greatest(F.lit(0.0), (F.col("ratio") - 1.0) * 12.0))
    base = F.least(F.lit(95.0), 35.0 + by_ratio)
    warm = F.least(F.lit(100.0), base + F.when(F.col("consistent"), 15.0).otherwise(0.0))
    full = F.least(F.lit(100.0), warm + F.when(F.col("seasoning"), 12.0).otherwise(0.0))
    verdict = (
        F.when(F.col("seasoning") & F.col("consistent"), VERDICT_SEASONED)
        .when(F.col("seasoning"), VERDICT_ELEVATED).otherwise(VERDICT_REVIEW)
    )
    return tv.withColumn("risk_score", F.bround(full).cast("int")).withColumn("verdict", verdict)


# ---- manifests ----------------------------------------------------------------------

# Headers that belong to a section of the evidence manifest.
DELIVERY_HEADERS = r"(?i)track|carrier|ups|fedex|usps|delivery|pod|signed"
SIGNED_HEADERS = r"(?i)signed|pod|delivered"
POLICY_HEADERS = r"(?i)terms|tos|policy|accept|checkbox|consent"
COMMS_HEADERS = r"(?i)support|ticket|email|cs_|contact"


def manifests(df: DataFrame, r: ColumnRoles) -> DataFrame:
    """One row per disputed transaction with the nested evidence sections."""
    def section(columns: list[str]) -> Column:
        known = [c for c in columns if c and c in df.columns]
        entries = [F.struct(F.lit(c).alias("key"), S.text(F.col(c)).alias("value")) for c in known]
        if not entries:
            return F.lit(None).cast("map<string,string>")
        filled = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
        return F.when(F.size(filled) > 0, F.map_from_entries(filled))

    def headed(pattern: str) -> list[str]:
        return [c for c in df.columns if re.search(pattern, c)]

    delivery = headed(DELIVERY_HEADERS)
    signed = next((c for c in delivery if re.search(SIGNED_HEADERS, c)), None)
    comms = [r.comms] if r.comms else headed(COMMS_HEADERS)
    return df.filter(S.is_disputed(F.col(r.disputed))).select(
        S.text(F.col(r.transaction)).alias("transaction_id"),
        F.struct(section([r.ip]).alias("ip_logs"), section([r.login]).alias("logins"), section([r.access]).alias("digital_access")).alias("service"),
        F.struct(
            section(delivery).alias("tracking"), section([r.shipping_zip]).alias("shipping"), section([r.billing_zip]).alias("billing"),
            (S.text(F.col(signed)) if signed else F.lit(None).cast("string")).alias("signed_status"),
        ).alias("delivery"),
        section(headed(POLICY_HEADERS)).alias("policy"),
        section([r.avs, r.cvv]).alias("authentication"),
        section(comms).alias("communication"),
        F.struct("*").alias("source_row"),
    )


def manifest_summary(m: DataFrame, *more: Column) -> DataFrame:
    """(transaction_id, manifest, sections, ...): the JSON text and how many sections are filled; then further columns made of ``m``."""
    filled = [F.col("service.ip_logs"), F.col("service.logins"), F.col("service.digital_access"), F.col("delivery.shipping"), F.col("policy"), F.col("authentication"), F.col("communication")]
    return m.select(
        "transaction_id", F.to_json(F.struct("*")).alias("manifest"), sum((c.isNotNull().cast("int") for c in filled), F.lit(0)).alias("sections"), *more
    )


def case_payload(df: DataFrame, r: ColumnRoles, samples: int = 8) -> DataFrame:
    """(signal, n, samples): each kind of signal with its count and a few transactions."""
    cols = ["transaction_id", "signal"]
    rows = prior_matches(df, r).select(*cols)
    for part in (post_dispute_activity(df, r), ship_bill_mismatch(df, r), strong_checks(df, r)):
        rows = rows.unionByName(part.select(*cols))
    counts = rows.groupBy("signal").agg(F.count("*").alias("n"))
    few = top_per_key(rows.distinct(), ["signal"], [F.col("transaction_id")], samples)
    lists = few.groupBy("signal").agg(F.array_sort(F.collect_list("transaction_id")).alias("samples"))
    return counts.join(lists, "signal")
