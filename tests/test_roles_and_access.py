import datetime as dt

import pytest

from inquest import roles as R
from inquest.operators import cases, warehouse

D0 = dt.datetime(2024, 1, 1)


def test_whole_words_come_first():
    assert R.header_score("zip_code", R.ROLE_HINTS["ip"]) == 0
    assert R.header_score("platform", R.ROLE_HINTS["latitude"]) == 0
    assert R.header_score("customer", R.ROLE_HINTS["payee"]) == 0
    assert R.header_score("Client IP", R.ROLE_HINTS["ip"]) == 100 - 3 / 80
    assert R.header_score("tx_id", R.ROLE_HINTS["transaction"]) > 90
    # The plain count sees the parts of words and misses hints with an underscore.
    assert R.header_score("zip_code", R.ROLE_HINTS["ip"], strict_compat=True) == 1
    assert R.header_score("tx_id", ("transaction", "tx_id"), strict_compat=True) == 0


def test_resolve(spark):
    df = spark.createDataFrame([], "`Acc Id` string, created_at timestamp, `client-ip` string, canvas_fingerprint string, amount double")
    r = R.resolve_roles(df)
    assert (r.user, r.timestamp, r.ip, r.fingerprint, r.amount) == ("Acc Id", "created_at", "client-ip", "canvas_fingerprint", "amount")
    assert R.resolve_roles(df, R.ColumnRoles(user="AMOUNT")).user == "amount"
    assert R.resolve_explicit(df.columns, "accid") == "Acc Id"


def test_headers_and_aliases(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["﻿uid ", "ts", "zip"])
    cleaned, bridge = R.canonicalize_aliases(R.clean_headers(df))
    assert bridge == {"uid": "user_id", "ts": "created_at"} and cleaned.columns == ["user_id", "created_at", "zip"]
    assert R.clean_headers(spark.createDataFrame([(1, 2)], ["a", "a "])).columns == ["a", "a "]
    typo = spark.createDataFrame([], "usr_id string, createdd_at string, email string")
    assert R.fuzzy_core_columns(typo) == {"usr_id": "user_id", "createdd_at": "created_at"}
    assert R.rank_user_candidates(typo)[-1] == "email"


def test_payment_columns(spark):
    df = spark.createDataFrame([], "`from` string, `to` string, amt double, type string")
    assert R.resolve_payment_columns(df) == ("from", "to")


def test_entity_columns():
    assert R.entity_columns(["user_id", "zip", "shipping", "ip_address", "device_fingerprint", "pan_hash"]) == [
        ("user_id", "user_id"), ("ip_address", "ip_address"), ("device_id", "device_fingerprint"), ("card_hash", "pan_hash"),
    ]


def test_profile_picks_by_values_too(spark):
    df = spark.createDataFrame([(f"10.0.0.{i}", f"a{i}@x.org", float(i)) for i in range(20)], "origin string, contact_mail string, amount double")
    got = {r.role: r.column for r in R.profile_column_roles(df).filter("chosen").collect()}
    assert got["email"] == "contact_mail" and got["amount"] == "amount"


@pytest.mark.parametrize(
    "sql",
    ["", "DELETE FROM t", "SELECT 1; SELECT 2", "SELECT 1 -- x", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "SELECT * FROM main.entity_map", "SELECT 1 /* x */", "SELECT '" + "x" * 12_000 + "'"],
)
def test_only_queries_pass(sql):
    with pytest.raises(ValueError):
        warehouse.readonly_query(sql)


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(
        [("c1", D0, 1, "u1"), ("c1", D0, 2, "u2"), ("c2", D0, 1, "u1"), ("c3", D0, 1, "u1")], "case_id string, at timestamp_ntz, n long, user_id string"
    )


def test_ledger_is_idempotent_and_scoped(spark, small, tmp_path):
    ledger = warehouse.Ledger(spark, str(tmp_path))
    ledger.put(small, "case_id", "at", "n")
    ledger.put(small.filter("case_id = 'c1'"), "case_id", "at", "n")
    assert ledger.events().count() == 4
    seen = ledger.query("SELECT entity_value, distinct_case_count AS n FROM entity_map", ["c1", "c2"]).collect()
    assert {r.entity_value: r.n for r in seen} == {"u1": 2, "u2": 1}  # c3 stays hidden in the count
    with pytest.raises(Exception):
        ledger.query(f"SELECT * FROM parquet.`{tmp_path}/events`").collect()


def test_shares_stay_in_the_tenant(spark):
    c = spark.createDataFrame([("a", "t1"), ("b", "t1"), ("x", "t2")], "case_id string, tenant_id string")
    s = spark.createDataFrame([("a", "b", D0), ("a", "b", D0 + dt.timedelta(1)), ("x", "b", D0), ("b", "b", D0)], "owner_case_id string, viewer_case_id string, shared_at timestamp_ntz")
    assert {(r[0], r[1]) for r in warehouse.allowed_cases(c, s).collect()} == {("a", "a"), ("b", "b"), ("x", "x"), ("b", "a")}
    assert [(r[0], r[1], r[2]) for r in cases.valid_shares(s, c).collect()] == [("a", "b", D0)]
    assert cases.valid_shares(s, c, s.limit(1)).count() == 0


def test_refresh_equals_rebuild(spark, small):
    occ = warehouse.extract_entities(small.drop("n"), "case_id", "at")
    rest, refreshed = warehouse.remove_case(occ, warehouse.entity_map(occ), "c1")
    assert sorted(refreshed.collect()) == sorted(warehouse.entity_map(rest).collect())
