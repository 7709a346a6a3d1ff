import math
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inquest.functions import scalar as S
from inquest.functions import text as X
from inquest.functions.sql import register_functions

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "ip, want",
    [("10.1.2.3", "10.1.2.0/24"), (" 1.2.3.4 ", "1.2.3.0/24"), ("256.1.1.1", None), ("1.2.3", None), ("a.b.c.d", None), ("01.2.3.4", "1.2.3.0/24"), (None, None), ("1.2.3.99999999999", None)],
)
def test_subnet(spark, ip, want):
    assert one(spark, ip, S.ipv4_subnet24) == want


@pytest.mark.parametrize(
    "raw, want",
    [("$1,234.50", 1234.5), ("(€ 20)", -20.0), (" £ 7 ", 7.0), ("true", None), ("", None), ("-", None), ("12 or so", None), ("1e3", 1000.0), (".5", 0.5), (None, None)],
)
def test_loose_amount(spark, raw, want):
    assert one(spark, raw, S.parse_loose_amount) == want


@pytest.mark.parametrize("raw, want", [("Yes", True), (" CB ", True), ("true", True), ("no", False), (None, False), ("accepted", True)])
def test_disputed(spark, raw, want):
    assert one(spark, raw, S.is_disputed) is want


@pytest.mark.parametrize("raw, want", [("[1,2]", '{"value":[1,2]}'), ('{"a":1}', '{"a":1}'), ("no json", '{"snippet":"no json"}'), (None, "{}")])
def test_json_or_snippet(spark, raw, want):
    assert one(spark, raw, S.json_or_snippet) == want


def test_gmail_dots_and_tags(spark):
    df = spark.createDataFrame([("a.b.c+x@gmail.com",), ("a.b@corp.example",), ("noat",)], "e string")
    local, domain = S.email_local(F.col("e")), S.email_domain(F.col("e"))
    assert [r.n for r in df.select(S.gmail_normal_local(local, domain).alias("n")).collect()] == ["abc+x", "a.b", "noat"]


@QUIET
@given(words=st.lists(st.text(alphabet="abcdef12", min_size=0, max_size=24), min_size=1, max_size=20))
def test_entropy_matches_definition_and_bounds(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", S.shannon_entropy(F.col("w")).alias("h")).collect():
        n = len(r.w)
        want = -sum(c / n * math.log2(c / n) for c in Counter(r.w).values()) if n else 0.0
        assert r.h == pytest.approx(want, abs=1e-9)
        assert -1e-9 <= r.h <= math.log2(max(1, len(set(r.w)))) + 1e-9


@QUIET
@given(pts=st.lists(st.tuples(*[st.floats(-90, 90), st.floats(-180, 180), st.floats(-90, 90), st.floats(-180, 180)]), min_size=1, max_size=10))
def test_haversine_is_symmetric_and_bounded(spark, pts):
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    there, back = S.haversine_miles(*[F.col(x) for x in "abcd"]), S.haversine_miles(*[F.col(x) for x in "cdab"])
    for r in df.select(there.alias("t"), back.alias("b")).collect():
        assert r.t == pytest.approx(r.b, abs=1e-6)
        assert 0 <= r.t <= math.pi * S.EARTH_RADIUS_MILES + 1e-6


def test_chunks_keep_the_whole_text(spark):
    long = "x" * 2000
    body = f"# Head\nfirst\n\n{long}\n\nlast"
    chunks = spark.createDataFrame([(body,)], "t string").select(X.chunk_array(F.col("t")).alias("c")).first().c
    assert sum(c.count("x") for c in chunks) >= 2000
    assert all(len(c) <= 900 + 150 + 2 for c in chunks)
    assert chunks[0].startswith("# Head") and chunks[-1].endswith("last")


def test_txn_ids_keep_first_spelling(spark):
    df = spark.createDataFrame([(1, "Order id: ABC-12345 then order #abc-12345, cb-XY9999 and txn_AB12CD34")], "id int, t string")
    got = [(r.position, r.txn_id) for r in X.txn_id_candidates(df, "id", "t").orderBy("position").collect()]
    assert got == [(1, "ABC-12345"), (2, "cb-XY9999"), (3, "txn_AB12CD34")]
    assert len({g[1].lower() for g in got}) == len(got)


def test_entity_edges_are_ascii(spark):
    df = spark.createDataFrame([(1, "prüunglich 10.0.0.7 acc_99 u_abcd")], "id int, t string")
    assert {r.token: r.kind for r in X.entities_in_text(df, "id", "t").collect()} == {
        "unglich": "user", "10.0.0.7": "ip", "acc_99": "user", "u_abcd": "user",
    }


def test_sql_functions_equal_column_functions(spark):
    assert "subnet24" in register_functions(spark)
    row = spark.sql("SELECT subnet24('10.0.0.9') s, shannon_entropy('abab') h, is_disposable('x@yopmail.com') d, haversine_miles(0D,0D,0D,1D) m").first()
    assert (row.s, row.h, row.d) == ("10.0.0.0/24", 1.0, True)
    assert row.m == pytest.approx(one(spark, 1.0, lambda c: S.haversine_miles(F.lit(0.0), F.lit(0.0), F.lit(0.0), c), "double"))
