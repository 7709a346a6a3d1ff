"""Rows without a key match nobody; numeric flags count."""

import datetime as dt

from pyspark.sql import functions as F

from inquest.functions.scalar import is_disputed
from inquest.operators.keyed import previous_row, trailing_count
from inquest.operators.retrieval import prototype_route, vector_topk

T0 = dt.datetime(2024, 1, 1)


def test_rows_without_a_key_have_no_previous_row(spark):
    rows = [(None, T0, 1, 1.0), (None, T0 + dt.timedelta(minutes=1), 2, 2.0), ("a", T0, 3, 3.0), ("a", T0 + dt.timedelta(days=3), 4, 4.0)]
    got = previous_row(spark.createDataFrame(rows, "u string, ts timestamp_ntz, id int, v double"), ["u"], "ts", ["v"], "id")
    assert {r.id: r.previous and r.previous.id for r in got.collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_rows_without_a_key_are_not_counted(spark):
    rows = [(None, T0), (None, T0), ("a", T0), ("a", None), ("a", T0 + dt.timedelta(seconds=5))]
    got = trailing_count(spark.createDataFrame(rows, "u string, ts timestamp_ntz"), ["u"], "ts", 10_000_000)
    assert sorted((r.u, r.n, r.in_window) for r in got.collect()) == [("a", 1, 1), ("a", 1, 2)]


def test_numeric_flags(spark):
    df = spark.createDataFrame([(1.0, 1, "yes", True), (0.0, 0, "0", False), (None, None, None, None), (2.5, -1, "2.5", True)], "d double, i int, s string, b boolean")
    got = df.select(*(is_disputed(F.col(c)).alias(c) for c in "disb")).collect()
    assert [tuple(r) for r in got] == [(True, True, True, True), (False, False, False, False), (False, False, False, False), (True, True, False, True)]


def test_many_queries_go_in_blocks(spark):
    import random

    r = random.Random(3)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    v = spark.createDataFrame(vectors, "id long, embedding array<double>")
    q = spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(4)]) for i in range(2_000)], "query_id long, embedding array<double>")
    one, many = (sorted(map(tuple, vector_topk(v, q, 3, block).collect())) for block in (5_000, 300))
    assert one == many and len(one) == 6_000
    routes = q.limit(1_500).select(F.col("query_id").cast("string").alias("route"), "embedding")
    assert prototype_route(v, routes, "none", floor=-1.0).count() == 60


def test_signals_without_their_columns_are_skipped(spark):
    from inquest.operators.ato import session_findings
    from inquest.operators.chargeback import evidence_counts
    from inquest.roles import ColumnRoles

    rows = [("u1", "yes", T0, "1.1.1.1"), ("u1", "no", T0 - dt.timedelta(days=2), "1.1.1.1"), ("u2", "no", T0, "2.2.2.2")]
    tx = spark.createDataFrame(rows, "who string, disputed string, at timestamp_ntz, ip string")
    counts = evidence_counts(tx, ColumnRoles(user="who", disputed="disputed", timestamp="at", ip="ip"))
    assert [(r.user_id, r.ip_device, r.velocity, r.ship_bill, r.avs_cvv, r.post_dispute) for r in counts.collect()] == [("u1", 1, 0, 0, 0, 0)]
    assert evidence_counts(tx, ColumnRoles(user="who", disputed="disputed")).first().disputed_rows == 1

    history = spark.createDataFrame([("u1", T0, 1, "agent one"), ("u1", T0, 2, "agent one")], "who string, at timestamp_ntz, n int, ua string")
    now = spark.createDataFrame([("u1", T0 + dt.timedelta(days=1), 3, "agent two")], "who string, at timestamp_ntz, n int, ua string")
    found = session_findings(now, history, ColumnRoles(user="who", timestamp="at", row_id="n", user_agent="ua"))
    assert [r.code for r in found.collect()] == ["USER_AGENT_MISMATCH"]
