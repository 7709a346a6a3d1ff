"""Small hand-made cases with known answers."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from inquest.operators import ato, bots, chargeback, graph, warehouse
from inquest.operators import cycles as Y
from inquest.operators.relational import payment_edges
from inquest.roles import ColumnRoles

D0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def trap(spark):
    """Twenty small completed payments, then one large dispute from the same machine."""
    rows = [(f"T{i}", "U1", 10.0 + i * 2.537, "completed", "9.9.9.9", "dev1") for i in range(20)]
    rows.append(("TRAP", "U1", 3500.0, "Disputed", "9.9.9.9", "dev1"))
    return spark.createDataFrame(rows, "tx_id string, user_id string, amount double, status string, ip string, device string")


TRAP = ColumnRoles(user="user_id", transaction="tx_id", amount="amount", status="status", ip="ip", device="device")


def test_account_seasoning(trap):
    row = chargeback.seasoning_risk(chargeback.trust_velocity(trap, TRAP)).first()
    assert (row.focal_transaction, row.completed_n, row.seasoning) == ("TRAP", 20, True)
    assert row.ratio == pytest.approx(3500.0 / row.avg_completed)
    assert (row.same_ip, row.same_device, row.risk_score) == (True, True, 100)


@pytest.fixture(scope="module")
def ring(spark):
    """A hundred accounts, addresses and names behind one fingerprint, two a minute at most."""
    rows = [(f"a{i}x", f"n{i}", f"1.1.{i}.{i}", D0 + dt.timedelta(minutes=i // 2), "canvas_1") for i in range(100)]
    return spark.createDataFrame(rows, "acc string, name string, ip string, created timestamp_ntz, fp string")


RING = ColumnRoles(user="acc", name="name", ip="ip", timestamp="created", fingerprint="fp")


def test_humanoid_ring(ring):
    found = bots.clusters(ring, RING).collect()
    assert [(r.cluster_type, r.size, r.distinct_ips, r.distinct_names) for r in found] == [("humanoid_bot_ring", 100, 100, 100)]
    assert bots.members(ring, RING).count() == 100
    card = bots.hardware_forensics(ring, RING).first()
    assert (card.row_count, card.distinct_ips, card.distinct_accounts, card.critical, card.pin_eligible) == (100, 100, 100, True, True)
    assert bots.hardware_spoofing(ring, RING).count() == 1
    assert bots.primary_signal(bots.clusters(ring, RING)).first().primary_signal == "canvas_hardware"


def test_ratio_flags_all_windows(ring):
    windows = bots.ratio_5m(ring, RING, bots.flagged_users(ring, RING)).collect()
    assert len(windows) == 10 and all(w.bot_pct == 100.0 and w.alert for w in windows)


def test_degraded_report_gives_reasons(ring):
    row = bots.degraded_report(ring.drop("created", "acc"), RING.with_roles(timestamp=None, user=None)).first()
    assert row.degraded_reason == "missing_timestamp_column,missing_user_id_column"
    bad = ring.withColumn("created", F.lit("never"))
    assert bots.degraded_report(bad, RING).first().degraded_reason == "no_parseable_timestamps"


def test_plus_tags_are_no_dot_cluster(spark):
    rows = [(f"u{i}", D0, f"name+{i}@gmail.com") for i in range(30)] + [(f"d{i}", D0 + dt.timedelta(days=1), e) for i, e in enumerate(["a.bc@gmail.com", "ab.c@gmail.com", "abc@gmail.com", "a.b.c@gmail.com"])]
    df = spark.createDataFrame(rows, "acc string, ts timestamp_ntz, email string")
    found = bots.clusters(df, ColumnRoles(user="acc", timestamp="ts", email="email"), rules=("gmail_dot_trick",)).collect()
    assert [(r.cluster_key, r.size, r.raw_addresses) for r in found] == [("abc@gmail.com", 4, 4)]


def test_burst_with_counting_handles(spark):
    rows = [(f"bot{i:03d}", D0 + dt.timedelta(seconds=i)) for i in range(12)] + [("alice", D0 + dt.timedelta(hours=3))]
    df = spark.createDataFrame(rows, "acc string, ts timestamp_ntz")
    found = bots.clusters(df, ColumnRoles(user="acc", timestamp="ts")).collect()
    assert [(r.size, r.signals) for r in found] == [(12, "TIME_BURST,SEQUENTIAL_ID_PATTERN")]


def test_payment_star_has_no_cycle_but_a_hub(spark):
    rows = [(f"m{i}", "hub", 100.0) for i in range(10)] + [("hub", "out", 900.0)]
    edges = payment_edges(spark.createDataFrame(rows, "src string, dst string, amt double"), "src", "dst", "amt")
    assert edges.count() == 11 and Y.circular_payments(edges).count() == 0
    empty = spark.createDataFrame([], "kind string, value string, account string, group_size long")
    degrees = graph.account_degrees(empty, edges)
    assert degrees.filter("account = 'hub'").first().degree == 11
    none = degrees.select("account", F.lit(0).alias("communities_near"))
    roles = {r.account: r.role for r in graph.account_roles(degrees, none).collect()}
    assert roles["hub"] == "hub" and roles["m0"] == "peripheral"


def test_laundering_circle_is_found(spark):
    ring = [f"RING_{c}" for c in "ABCDE"]
    rows = [(a, ring[(i + 1) % 5]) for i, a in enumerate(ring)] + [("x", "RING_A"), ("RING_C", "y")]
    edges = payment_edges(spark.createDataFrame(rows, "s string, d string"), "s", "d")
    assert [r.path for r in Y.circular_payments(edges).collect()] == ["RING_A → RING_B → RING_C → RING_D → RING_E → RING_A"]


def test_repeat_offender_needs_more_than_two_other_cases(spark):
    rows = [(f"c{i}", D0, "U_RECID", "x") for i in range(2)] + [(f"c{i}", D0, "U_MANY", "null") for i in range(4)]
    df = spark.createDataFrame(rows, "source_case_id string, upload_timestamp timestamp_ntz, user_id string, zip string")
    occ = warehouse.extract_entities(df, "source_case_id", "upload_timestamp")
    assert {r.source_column for r in occ.collect()} == {"user_id"}  # a zip is no ip
    got = {(r.source_case_id, r.entity_value): (r.other_cases, r.priority) for r in warehouse.entity_overlap(occ).collect()}
    assert got[("c0", "U_RECID")] == (1, "Elevated") and got[("c0", "U_MANY")] == (3, "Recidivist Fraudster")


def test_sensitive_flags_count_beside_events(spark):
    s = spark.createDataFrame(
        [(1, "u", D0 + dt.timedelta(days=9), True, 5000.0), (2, "u", D0 + dt.timedelta(days=9), False, 5000.0)],
        "event_id long, acc string, ts timestamp_ntz, password_changed boolean, transfer double",
    ).withColumns({c: F.lit(None).cast("string") for c in ("ua", "isp", "hw")}).withColumns({"lat": F.lit(1.0), "lon": F.lit(1.0)})
    hist = spark.createDataFrame([(9, "u", D0, 100.0, "a", "b", "c", 1.0, 1.0)], "event_id long, acc string, ts timestamp_ntz, amount double, ua string, isp string, hw string, lat double, lon double")
    roles = ColumnRoles(user="acc", timestamp="ts", row_id="event_id", amount="amount", user_agent="ua", isp="isp", hardware="hw", latitude="lat", longitude="lon")
    found = ato.session_findings(s, hist, roles, transfer="transfer", changed_flags=("password_changed",)).collect()
    assert [(r.session_id, r.code) for r in found] == [(1, "SENSITIVE_CHAIN_HIGH_VALUE")]
    assert ato.risk_scores(ato.session_findings(s, hist, roles, transfer="transfer", changed_flags=("password_changed",))).first().risk == 51.0


def test_prior_match_needs_an_earlier_clean_row(spark):
    rows = [("d1", "u", 5.0, "yes", "i", "v", D0 + dt.timedelta(days=5)), ("c1", "u", 5.0, "no", "i", "v", D0 + dt.timedelta(days=9))]
    df = spark.createDataFrame(rows, "t string, u string, a double, dis string, ip string, dev string, ts timestamp_ntz")
    r = ColumnRoles(user="u", transaction="t", amount="a", disputed="dis", ip="ip", device="dev", timestamp="ts")
    assert chargeback.prior_matches(df, r).count() == 0
    assert {x.kind for x in chargeback.prior_matches(df, r, strictly_prior=False).collect()} == {"ip", "device"}


def test_injected_burst_is_recalled(spark):
    rnd = random.Random(3)
    real = [(f"user{rnd.randrange(10**6)}q{i}", D0 + dt.timedelta(minutes=rnd.randrange(60 * 24 * 30))) for i in range(800)]
    bad = [(f"bot_{i}", D0 + dt.timedelta(days=10, seconds=i % 50)) for i in range(200)]
    df = spark.createDataFrame(real + bad, "acc string, ts timestamp_ntz")
    flagged = {r.account_id for r in bots.flagged_users(df, ColumnRoles(user="acc", timestamp="ts")).collect()}
    assert {b[0] for b in bad} <= flagged and len(flagged) < 210
