"""Which column plays which part: header rules joined with a value profile.

Header names are metadata, so the rules run on ``df.columns``. The values are
profiled by one Spark aggregation over the whole table. Analysts can fix any
role by hand: ``ColumnRoles(user="acc_id")`` or the ``overrides`` argument.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inquest.functions.text import IPV4


@dataclass(frozen=True)
class ColumnRoles:
    """Resolved column per role; ``None`` where the table has no such column."""

    user: str | None = None
    timestamp: str | None = None
    ip: str | None = None
    user_agent: str | None = None
    fingerprint: str | None = None
    email: str | None = None
    name: str | None = None
    latitude: str | None = None
    longitude: str | None = None
    hardware: str | None = None
    isp: str | None = None
    amount: str | None = None
    outcome: str | None = None
    duration: str | None = None
    event_type: str | None = None
    screen_w: str | None = None
    screen_h: str | None = None
    transaction: str | None = None
    status: str | None = None
    disputed: str | None = None
    dispute_date: str | None = None
    dispute_reason: str | None = None
    login: str | None = None
    access: str | None = None
    device: str | None = None
    billing_zip: str | None = None
    shipping_zip: str | None = None
    avs: str | None = None
    cvv: str | None = None
    comms: str | None = None
    payer: str | None = None
    payee: str | None = None
    employee: str | None = None
    address: str | None = None
    phone: str | None = None
    row_id: str | None = None

    def with_roles(self, **named: str) -> ColumnRoles:
        return replace(self, **named)


# Header words per role. Order is preference.
ROLE_HINTS: dict[str, tuple[str, ...]] = {
    "user": ("user_id", "account_id", "acc_id", "userid", "customer_id", "customerid", "member_id", "memberid", "buyer_id", "uid", "user", "account"),
    "timestamp": ("created_at", "signup_at", "signup_time", "registered_at", "event_time", "login_time", "timestamp", "datetime", "transaction_date", "date", "time", "ts"),
    "ip": ("ip_address", "signup_ip", "registration_ip", "client_ip", "remote_ip", "remote_addr", "source_ip", "ip"),
    "user_agent": ("user_agent", "useragent", "http_user_agent", "browser", "ua"),
    "fingerprint": ("canvas_fingerprint", "browser_hash", "fingerprint_id", "canvas_hash", "browser_fingerprint", "fingerprint"),
    "email": ("email", "user_email", "e_mail", "mail", "primary_email"),
    "name": ("full_name", "customer_name", "display_name", "username", "acc_name", "account_name", "name"),
    "latitude": ("latitude", "geo_lat", "location_lat", "lat"),
    "longitude": ("longitude", "geo_lon", "location_lon", "lng", "lon"),
    "hardware": ("hardware_id", "device_id", "deviceid", "dfp"),
    "isp": ("isp", "asn_org", "org", "carrier", "network", "netname"),
    "amount": ("amount", "txn_amount", "payment_amount", "usd_amount", "purchase_total", "withdrawal", "total", "value", "usd"),
    "outcome": ("login_status", "outcome", "auth_result", "event_status", "success", "result", "status"),
    "duration": ("session_duration", "duration_sec", "session_sec", "time_spent", "dwell"),
    "event_type": ("event_type", "event", "action", "activity", "page_name"),
    "screen_w": ("screen_width", "screen_w", "viewport_w", "width"),
    "screen_h": ("screen_height", "screen_h", "viewport_h", "height"),
    "transaction": ("transaction_id", "transaction", "order_id", "txn_id", "tx_id", "txn", "authorization"),
    "status": ("status", "state", "txn_status", "dispute_status", "order_status"),
    "disputed": ("disputed", "is_disputed", "chargeback", "is_chargeback", "cb_flag", "dispute_status", "in_dispute"),
    "dispute_date": ("dispute_date", "chargeback_date", "claim_date", "unauthorized_date", "code_date"),
    "dispute_reason": ("dispute_reason", "chargeback_reason", "issuer_reason", "reason_code", "reason"),
    "login": ("last_login", "user_login", "account_login", "login", "session", "signin", "signon"),
    "access": ("download", "content_access", "digital_access", "license_access", "gameplay", "usage", "stream"),
    "device": ("device_id", "device_fingerprint", "mac_address", "device_hash", "device"),
    "billing_zip": ("billing_zip", "billing_postal", "bill_zip", "bill_to", "billing", "cardholder"),
    "shipping_zip": ("shipping_zip", "ship_zip", "ship_to", "shipping", "delivery", "destination"),
    "avs": ("avs_result", "avs_code", "avs", "address_verification"),
    "cvv": ("cvv", "cvv2", "cvc", "cvc_result", "security_code"),
    "comms": ("support", "ticket", "contact", "cs_note", "communication", "email"),
    "payer": ("payer_id", "sender_id", "payer", "sender", "from_account", "from", "source", "debtor", "remitter"),
    "payee": ("payee_id", "receiver_id", "payee", "receiver", "recipient", "to_account", "to", "beneficiary", "creditor", "merchant"),
    "employee": ("employee_id", "internal_user_id", "agent_id", "staff_id", "rep_id"),
    "address": ("address", "street_address", "shipping_address", "billing_address", "postal_address"),
    "phone": ("phone", "msisdn", "mobile", "phone_number", "tel", "telephone"),
}

# Aliases that become the three core names.
CORE_ALIASES: dict[str, tuple[str, ...]] = {
    "user_id": ("acc_id", "uid", "customer_id", "userid", "account_id", "member_id", "user_id", "id"),
    "created_at": (
        "timestamp",
        "signup_time",
        "created_at",
        "registered_at",
        "registration_time",
        "date",
        "time",
        "ts",
        "datetime",
        "event_time",
        "joined_at",
    ),
    "ip": ("ip", "ip_address", "signup_ip", "remote_addr", "client_ip", "registration_ip", "remote_ip"),
}

# Headers per entity type of the cross-case ledger.
ENTITY_HINTS: dict[str, tuple[str, ...]] = {
    "user_id": ("user_id", "customer_id", "account_id", "member_id", "buyer_id", "payer_id"),
    "ip_address": ("ip", "ip_address", "client_ip", "remote_ip", "signup_ip", "registration_ip", "source_ip"),
    "device_id": ("device_id", "device_fingerprint", "fingerprint", "hardware_id", "dfp", "browser_fingerprint", "canvas_fingerprint", "canvas_fp"),
    "card_hash": ("card_hash", "pan_hash", "payment_token", "instrument_hash", "card_fingerprint", "token_hash"),
}

# Fixed value: least similarity at which a header is taken for a core name.
FUZZY_FLOOR = 0.52

# What the values of a role look like: profile field, or nothing to go by.
VALUE_FIELD = {
    "ip": "ipv4_share", "email": "email_share", "timestamp": "time_share", "dispute_date": "time_share", "login": "time_share",
    "access": "time_share", "amount": "number_share", "latitude": "coordinate_share", "longitude": "coordinate_share",
    "duration": "number_share", "screen_w": "number_share", "screen_h": "number_share",
}


def squash(header: str) -> str:
    return re.sub(r"[^a-z0-9]", "", header.lower())


def header_words(header: str) -> list[str]:
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", header)
    return [w for w in re.split(r"[^a-z0-9]+", spaced.lower()) if w]


def header_score(header: str, hints: tuple[str, ...], strict_compat: bool = False) -> float:
    """How well a header fits a role, 0 to 100.

    Whole words come first, so ``zip`` is no ``ip`` and ``platform`` no ``lat``;
    a part of a word counts only for hints of four letters and more. With
    ``strict_compat`` the score is the plain number of hints inside the header.
    """
    flat = squash(header)
    if not flat:
        return 0.0
    if strict_compat:
        return float(sum(1 for h in set(hints) if h in flat))
    words = header_words(header)
    best = 0.0
    for rank, hint in enumerate(hints):
        own = squash(hint)
        preference = rank / (10.0 * len(hints))
        if flat == own:
            score = 100.0
        elif _has_run(words, header_words(hint)):
            score = 70.0
        elif len(own) >= 4 and own in flat:
            score = 45.0
        else:
            continue
        best = max(best, score - preference)
    return best


def _has_run(words: list[str], run: list[str]) -> bool:
    return any(words[i : i + len(run)] == run for i in range(len(words) - len(run) + 1))


def clean_headers(df: DataFrame) -> DataFrame:
    """Headers without byte-order mark and outer blanks, unless two would collide."""
    names = [c.replace("﻿", "").strip() for c in df.columns]
    return df if len(set(names)) < len(names) else df.toDF(*names)


def canonicalize_aliases(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Rename the first known alias of each core column; returns the frame and the renames."""
    by_lower = {c.lower(): c for c in df.columns}
    bridge: dict[str, str] = {}
    for target, aliases in CORE_ALIASES.items():
        if target not in df.columns:
            hit = next((by_lower[a] for a in aliases if a in by_lower), None)
            if hit:
                bridge[hit] = target
    return df.withColumnsRenamed(bridge), bridge


def resolve_explicit(columns: list[str], wanted: str | None) -> str | None:
    """A column named by hand: exact, then any case, then letters and digits only."""
    if not wanted or not wanted.strip():
        return None
    for key in (lambda s: s, str.lower, squash):
        for c in columns:
            if key(c) == key(wanted.strip()):
                return c
    return None


def fuzzy_core_columns(df: DataFrame) -> dict[str, str]:
    """Nearest header for ``user_id`` and ``created_at`` when no alias fits."""
    out: dict[str, str] = {}
    for target, role in (("user_id", "user"), ("created_at", "timestamp")):
        if target in df.columns:
            continue
        best, best_col = FUZZY_FLOOR, None
        for field in df.schema.fields:
            flat = squash(field.name)
            if len(flat) < 3 or (role == "user" and _is_contact_or_place(flat)):
                continue
            score = max(difflib.SequenceMatcher(None, flat, squash(h)).ratio() for h in ROLE_HINTS[role])
            if any(len(squash(h)) >= 4 and squash(h) in flat for h in ROLE_HINTS[role]):
                score = max(score, 0.9)
            if role == "timestamp" and _is_time(field.dataType):
                score = max(score, 0.85)
            if score > best:
                best, best_col = score, field.name
        if best_col:
            out[best_col] = target
    return out


def _is_contact_or_place(flat: str) -> bool:
    # Parts of headers that never name an account.
    blocked = ("email", "mail", "ipaddress", "phone", "latitude", "longitude", "canvas", "fingerprint", "browser", "useragent")
    return any(b in flat for b in blocked)


def _is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def pick_role(df: DataFrame, role: str, strict_compat: bool = False, skip: tuple[str, ...] = ()) -> str | None:
    """Best column for a role by header, then by type for times."""
    scored = [(header_score(c, ROLE_HINTS[role], strict_compat), c) for c in df.columns if c not in skip]
    best = max(scored, key=lambda sc: sc[0], default=(0.0, None))
    if best[0] > 0:
        return best[1]
    if role == "timestamp":
        return next((f.name for f in df.schema.fields if _is_time(f.dataType)), None)
    return None


def rank_user_candidates(df: DataFrame) -> list[str]:
    """All columns, most account-like first; the order in which a failed run is tried again."""
    def key(c: str) -> float:
        score = header_score(c, ROLE_HINTS["user"])
        return score - (90.0 if _is_contact_or_place(squash(c)) else 0.0)

    return sorted(df.columns, key=lambda c: (-key(c), df.columns.index(c)))


def resolve_payment_columns(df: DataFrame, strict_compat: bool = False) -> tuple[str | None, str | None]:
    payer = pick_role(df, "payer", strict_compat)
    payee = pick_role(df, "payee", strict_compat, skip=(payer,) if payer else ())
    return payer, payee


def resolve_roles(df: DataFrame, overrides: ColumnRoles | None = None, strict_compat: bool = False) -> ColumnRoles:
    """Roles by header alone; names fixed in ``overrides`` win."""
    chosen = {role: pick_role(df, role, strict_compat) for role in ROLE_HINTS}
    chosen["payer"], chosen["payee"] = resolve_payment_columns(df, strict_compat)
    if overrides:
        for f in fields(overrides):
            named = resolve_explicit(df.columns, getattr(overrides, f.name))
            if named:
                chosen[f.name] = named
    return ColumnRoles(**chosen)


def entity_columns(columns: list[str]) -> list[tuple[str, str]]:
    """(entity type, column) of every column that the cross-case ledger indexes."""
    out = []
    for c in columns:
        kind = next((k for k, hints in ENTITY_HINTS.items() if header_score(c, hints) > 0), None)
        if kind:
            out.append((kind, c))
    return out


def profile_values(df: DataFrame) -> DataFrame:
    """One row per column: fill, distinct estimate, and shares of values by shape.

    The table is read once; rows turn into (column, text) pairs that are combined
    on the map side, so the shuffle carries one record per column and task.
    """
    cells = df.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(f"`{c}`").cast("string")).alias("s")) for c in df.columns])).alias("cell")
    ).select("cell.column", "cell.s")
    s = F.col("s")
    filled = s.isNotNull() & (s != "")
    number = s.try_cast("double")

    def share(hit):
        return F.avg(F.when(filled, F.coalesce(hit, F.lit(False)).cast("double")))

    return cells.groupBy("column").agg(
        F.count("*").alias("row_count"),
        F.count_if(filled).alias("filled"),
        F.approx_count_distinct(s).alias("distinct_estimate"),
        share(s.rlike(f"^{IPV4}$")).alias("ipv4_share"),
        share(s.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")).alias("email_share"),
        share(F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp_ntz").isNotNull())).alias("time_share"),
        share(number.isNotNull()).alias("number_share"),
        share(number.between(-180.0, 180.0) & s.contains(".")).alias("coordinate_share"),
        F.avg(F.length(s)).alias("mean_length"),
    )


def profile_column_roles(
    df: DataFrame, overrides: ColumnRoles | None = None, floor: float = 40.0, strict_compat: bool = False
) -> DataFrame:
    """(role, column, header_score, value_score, chosen) for all roles and columns with any score."""
    spark = df.sparkSession
    header_rows = [
        (role, c, header_score(c, hints, strict_compat), VALUE_FIELD.get(role), bool(overrides and getattr(overrides, role) == c))
        for role, hints in ROLE_HINTS.items()
        for c in df.columns
    ]
    # Metadata only: roles times columns of one schema.
    headers = spark.createDataFrame(header_rows, "role string, column string, header_score double, value_field string, fixed boolean")
    shares = profile_values(df)
    by_field = F.create_map(*[x for f in sorted(set(VALUE_FIELD.values())) for x in (F.lit(f), F.col(f))])
    joined = headers.join(shares.select("column", by_field.alias("shares")), "column")
    value = F.round(100 * F.coalesce(F.try_element_at("shares", F.col("value_field")), F.lit(0.0)), 4)
    scored = joined.select("role", "column", "header_score", F.when(F.col("value_field").isNotNull(), value).alias("value_score"), "fixed")
    # The header leads; values confirm it, or contradict it where none fits the role.
    total = F.when(F.col("fixed"), 1000.0).otherwise(
        F.col("header_score") + F.coalesce(F.when(F.col("header_score") > 0, F.col("value_score") / 2 - 25).otherwise(F.col("value_score") / 4), F.lit(0.0))
    )
    first = F.row_number().over(W.partitionBy("role").orderBy(total.desc(), F.col("column")))
    return (
        scored.withColumn("total", total)
        .withColumn("chosen", (first == 1) & (F.col("total") >= floor))
        .filter((F.col("header_score") > 0) | (F.col("value_score") > 0) | F.col("fixed"))
        .drop("fixed", "total")
    )
