"""Scalar column functions used by the detectors.

Each takes and returns ``Column``; nothing here is a Python UDF. Lenient reads
use the ``try_`` family, so ANSI mode does not turn a bad cell into a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Throw-away mail providers.
DISPOSABLE_DOMAINS = (
    "10minutemail.com",
    "10minutemail.net",
    "guerrillamail.com",
    "guerrillamailblock.com",
    "mailinator.com",
    "temp-mail.org",
    "tempmail.com",
    "throwaway.email",
    "yopmail.com",
    "trashmail.com",
    "getnada.com",
    "maildrop.cc",
    "tempail.com",
    "fakeinbox.com",
    "dispostable.com",
    "mohmal.com",
)
# Mail domains whose local part ignores dots.
DOTLESS_DOMAINS = ("gmail.com", "googlemail.com")
# Words that mark a row as disputed.
DISPUTED_WORDS = ("1", "true", "t", "yes", "y", "disputed", "chargeback", "cb", "fraud", "accepted", "lost")
# Payment states that count as completed, and parts of disputed states.
COMPLETED_STATES = ("completed", "settled", "captured", "paid", "success", "closed", "fulfilled")
DISPUTED_STATE_PARTS = ("dispute", "chargeback", "cbk", "fraud", "reversed", "refund", "unrecognized")
# Strong address and card-code results.
STRONG_CHECKS = ("full", "match", "y", "pass", "m", "p", "authenticated", "success")
# Network names of hosting, VPN and proxy operators.
HOSTING_PATTERN = (
    r"(?i)hosting|datacenter|data center|colo|vpn|proxy|tor|cloud\s*provider|amazon|google\s*llc|hetzner|ovh|digitalocean"
)
# Currency marks removed before a number is read.
CURRENCY_PATTERN = r"[\$€£¥₹₽¢\s  ]"
# Fields that hold money in loose form.
AMOUNT_FIELDS = (
    "high_value_amount",
    "transfer_amount",
    "amount",
    "txn_amount",
    "payment_amount",
    "purchase_total",
    "balance",
    "withdrawal_amount",
    "order_total",
    "cart_total",
    "refund_amount",
)
# Other names of the four entity types.
ENTITY_ALIASES = {
    "user": "user_id",
    "userid": "user_id",
    "account": "user_id",
    "ip": "ip_address",
    "device": "device_id",
    "card": "card_hash",
    "hash": "card_hash",
}
ENTITY_TYPES = ("user_id", "ip_address", "device_id", "card_hash")
# Case states with their display labels.
CASE_LABELS = {"FLAGGED": "Fraud Confirmed", "INVESTIGATING": "Under Investigation", "CLEARED": "Cleared"}
DEFAULT_CASE_STATUS = "INVESTIGATING"
# Fixed value: mean earth radius in miles.
EARTH_RADIUS_MILES = 3958.7613
# Words that make a label positive.
POSITIVE_WORDS = ("1", "true", "fraud", "yes")


def text(c: Column) -> Column:
    return c.cast("string")


def clean_key(c: Column) -> Column:
    """Trimmed text, with the empty string as null."""
    return F.nullif(F.trim(text(c)), F.lit(""))


def ipv4_subnet24(ip: Column) -> Column:
    """``a.b.c.0/24`` of a valid dotted quad, else null."""
    parts = F.split(F.trim(text(ip)), r"\.")
    # Ten digits and more cannot be an octet; try_cast turns other junk into null.
    octets = F.transform(parts, lambda p: F.when(p.rlike(r"^\d{1,9}$"), p.try_cast("int")))
    valid = (F.size(parts) == 4) & F.forall(octets, lambda o: F.coalesce(o.between(0, 255), F.lit(False)))
    return F.when(valid, F.concat(F.array_join(F.slice(octets, 1, 3).cast("array<string>"), "."), F.lit(".0/24")))


def email_local(email: Column) -> Column:
    return F.get(F.split(F.lower(F.trim(text(email))), "@"), F.lit(0))


def email_domain(email: Column) -> Column:
    return F.get(F.split(F.lower(F.trim(text(email))), "@"), F.lit(1))


def gmail_normal_local(local: Column, domain: Column) -> Column:
    """Local part without dots where the provider ignores them; plus-tags stay."""
    return F.when(domain.isin(*DOTLESS_DOMAINS), F.replace(local, F.lit("."), F.lit(""))).otherwise(local)


def shannon_entropy(s: Column) -> Column:
    """Bits per character: log2(n) - sum(k * log2 k) / n over character counts k."""

    def bits(x: Column) -> Column:
        n = F.length(x).cast("double")
        chars = F.array_distinct(F.filter(F.split(x, ""), lambda ch: ch != ""))

        def add(acc: Column, ch: Column) -> Column:
            k = (F.length(x) - F.length(F.replace(x, ch, F.lit("")))).cast("double")
            return acc + k * F.log2(k)

        return F.when(n == 0, F.lit(0.0)).otherwise(F.log2(n) - F.aggregate(chars, F.lit(0.0), add) / n)

    # The text is bound to a lambda variable, so an expression behind it runs once per row.
    return F.get(F.transform(F.array(s), bits), F.lit(0))


def chrome_major(ua: Column) -> Column:
    return F.nullif(F.regexp_extract(text(ua), r"(?i)Chrome/(\d+)", 1), F.lit("")).try_cast("int")


def chrome_is_stale(ua: Column, below: int = 115) -> Column:
    return F.coalesce(chrome_major(ua) < below, F.lit(False))


def is_disposable(domain: Column) -> Column:
    return domain.isin(*DISPOSABLE_DOMAINS)


def parse_loose_amount(value: Column) -> Column:
    """Money text as double: currency marks and grouping commas go, brackets negate."""
    s = F.trim(text(value))
    negative = s.startswith("(") & s.endswith(")")
    bare = F.when(negative, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s)
    digits = F.replace(F.regexp_replace(bare, CURRENCY_PATTERN, ""), F.lit(","), F.lit(""))
    # Truth words are no amounts, and only plain decimal or exponent notation is read.
    number = F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), digits.try_cast("double"))
    return F.when(negative, -number).otherwise(number)


def normalize_amount_map(m: Column) -> Column:
    """Loose money text under the known keys becomes plain number text; other keys stay."""
    return F.transform_values(
        m, lambda k, v: F.when(k.isin(*AMOUNT_FIELDS), F.coalesce(text(parse_loose_amount(v)), v)).otherwise(v)
    )


def normalize_amount_columns(df: DataFrame) -> DataFrame:
    """The same for a wide table: parse every column whose name is a money field."""
    hits = {c: parse_loose_amount(F.col(c)) for c in df.columns if c in AMOUNT_FIELDS}
    return df.withColumns(hits) if hits else df


def parse_ts_tolerant(c: Column) -> Column:
    """Timestamp without zone from a cast, else from common layouts, else null."""
    s = F.regexp_replace(F.trim(text(c)), r"(?:Z|\+00:00)$", "")
    return F.coalesce(
        s.try_cast("timestamp_ntz"),
        *[F.try_to_timestamp(s, F.lit(f)).cast("timestamp_ntz") for f in ("dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "yyyyMMdd")],
    )


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.lit(2 * EARTH_RADIUS_MILES) * F.atan2(F.sqrt(half), F.sqrt(F.greatest(F.lit(0.0), 1 - half)))


def is_disputed(c: Column) -> Column:
    """Text that says so, or a number other than 0: a 0/1 flag with gaps is often read as a double."""
    s = F.lower(F.trim(text(c)))
    number = F.typeof(c).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)") & (text(c).try_cast("double") != 0)
    return F.coalesce(s.isin(*DISPUTED_WORDS), F.lit(False)) | F.coalesce(number, F.lit(False))


def status_class(c: Column) -> Column:
    s = F.lower(F.trim(text(c)))
    return (
        F.when(s.isin(*COMPLETED_STATES), F.lit("completed"))
        .when(s.rlike("|".join(DISPUTED_STATE_PARTS)), F.lit("disputed"))
        .otherwise(F.lit("other"))
    )


def is_hosting_isp(c: Column) -> Column:
    return F.coalesce(text(c).rlike(HOSTING_PATTERN), F.lit(False))


def norm_postal(c: Column) -> Column:
    return F.regexp_replace(F.trim(text(c)), r"\s+", "")


def screen_resolution(w: Column, h: Column) -> Column:
    return F.concat(text(w.try_cast("double").try_cast("int")), F.lit("x"), text(h.try_cast("double").try_cast("int")))


def check_is_strong(c: Column) -> Column:
    s = F.lower(F.trim(text(c)))
    return F.coalesce(s.isin(*STRONG_CHECKS) | s.contains("match"), F.lit(False))


def stable_id(prefix: str, value: Column) -> Column:
    digest = F.sha2(F.concat(F.lit(f"{prefix}:"), text(value)), 256)
    return F.concat(F.lit(f"{prefix}:"), F.substring(digest, 1, 14))


def entity_type_alias(c: Column) -> Column:
    s = F.replace(F.lower(F.trim(text(c))), F.lit("-"), F.lit("_"))
    table = F.create_map(*[F.lit(x) for kv in ENTITY_ALIASES.items() for x in kv])
    known = F.coalesce(F.try_element_at(table, s), s)
    return F.when(known.isin(*ENTITY_TYPES), known)


def case_status(c: Column) -> Column:
    s = F.upper(F.trim(text(c)))
    return F.when(s.isin(*CASE_LABELS), s).otherwise(F.lit(DEFAULT_CASE_STATUS))


def case_status_label(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in CASE_LABELS.items() for x in kv])
    return F.try_element_at(table, case_status(c))


def month_label(c: Column) -> Column:
    """``Jan 2024`` of a readable time, else the first ten characters."""
    s = F.regexp_replace(text(c), "Z$", "")
    return F.coalesce(F.date_format(s.try_cast("timestamp_ntz"), "MMM yyyy"), F.substring(text(c), 1, 10))


def binary_label(c: Column) -> Column:
    s = F.lower(F.trim(text(c)))
    return F.when((s.try_cast("double") >= 0.5) | s.isin(*POSITIVE_WORDS), 1).otherwise(0)


def row_json(columns: list[str]) -> Column:
    """The row as JSON text, null fields kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def round_geo(c: Column) -> Column:
    return F.round(c.try_cast("double"), 3)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ or a vector is all zero."""

    def dot(x: Column, y: Column) -> Column:
        pairs = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    usable = (F.size(a) == F.size(b)) & (norm > 0)
    return F.when(usable, dot(a, b) / norm).otherwise(F.lit(0.0))


def l2_normalize(a: Column) -> Column:
    """Unit vector as array<double>; an all-zero vector stays as it is."""
    wide = F.transform(a, lambda v: v.cast("double"))
    size = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when(size > 0, F.transform(wide, lambda v: v / size)).otherwise(wide)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def truncate_ts(ts: Column, unit: str) -> Column:
    """Start of the minute, hour or day, or of an ``n minutes`` slot; keeps the zone-less type."""
    if unit.endswith("minutes"):
        return F.window(ts, unit).start
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def json_or_snippet(c: Column) -> Column:
    """Valid JSON objects stay, other JSON is wrapped as value, bad text as snippet."""
    parsed = F.try_parse_json(c)
    kind = F.schema_of_variant(parsed)
    quoted = F.to_json(F.struct(c.alias("snippet")))
    return (
        F.when(c.isNull(), F.lit("{}"))
        .when(parsed.isNull(), quoted)
        .when(kind.startswith("OBJECT"), F.to_json(parsed))
        .otherwise(F.concat(F.lit('{"value":'), F.to_json(parsed), F.lit("}")))
    )


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c.try_cast("double"), F.lit(float(low))), F.lit(float(high)))


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz"))
