"""Bucketed windows against brute force, with one key that holds most rows."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inquest.operators import keyed as K

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = []
    for i in range(600):
        key = "hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}"
        # Coarse seconds make equal times; a few days make many buckets.
        out.append((i, key, T0 + dt.timedelta(minutes=10 * rnd.randrange(900)), float(rnd.randrange(50))))
    return out


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, key string, ts timestamp_ntz, v double")


def test_trailing_count(frame, rows):
    got = {(r.key, r.ts): (r.n, r.in_window) for r in K.trailing_count(frame, ["key"], "ts", K.HOUR_US).collect()}
    for key, ts in {(r[1], r[2]) for r in rows}:
        same = sum(1 for r in rows if r[1] == key and r[2] == ts)
        within = sum(1 for r in rows if r[1] == key and ts - dt.timedelta(hours=1) <= r[2] <= ts)
        assert got[(key, ts)] == (same, within)


def test_previous_row(frame, rows):
    usable = F.col("v") >= 10
    got = {r.id: r.previous for r in K.previous_row(frame, ["key"], "ts", ["v"], "id", usable=usable).collect()}
    for i, key, ts, _ in rows:
        earlier = [r for r in rows if r[1] == key and r[2] < ts and r[3] >= 10]
        want = max(earlier, key=lambda r: (r[2], r[0]), default=None)
        assert (got[i] is None) == (want is None)
        if want:
            assert (got[i].id, got[i].v) == (want[0], want[3])


def test_previous_row_of_a_key_with_most_rows_in_one_day(spark):
    """19 of 20 rows are one key's on one day: the result is that of a plain window, and no bucket has more than a few hundredths."""
    rnd = random.Random(3)
    data = [(i, "hot" if i % 20 else f"k{i % 3}", T0 + dt.timedelta(seconds=rnd.randrange(86_400)), float(rnd.randrange(50))) for i in range(4000)]
    data += [(4000 + i, "hot", T0 + dt.timedelta(days=i + 1), 20.0) for i in range(5)] + [(5000, "hot", None, 1.0), (5001, None, T0, 1.0)]
    df = spark.createDataFrame(data, "id long, key string, ts timestamp_ntz, v double")
    got = {r.id: r.previous for r in K.previous_row(df, ["key"], "ts", ["v"], "id", usable=F.col("v") >= 10, busy_rows=1000).collect()}
    assert len(got) == len(data) and got[5000] is None and got[5001] is None
    by_key = {}
    for i, key, ts, v in data:
        if key and ts:
            by_key.setdefault(key, []).append((ts, i, v))
    for rows_ in by_key.values():
        last, at, rows_ = None, 0, sorted(rows_)
        for ts, i, v in rows_:
            while at < len(rows_) and rows_[at][0] < ts:
                last, at = rows_[at] if rows_[at][2] >= 10 else last, at + 1
            assert (got[i] is None) == (last is None) and (last is None or (got[i].id, got[i].v) == (last[1], last[2]))
    timed = df.dropna(subset=["key", "ts"]).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    sizes = K.with_time_buckets(timed, ["key"], "_us", busy_rows=1000).groupBy("key", "_slot", "_sub").count()
    assert sizes.agg(F.max("count")).first()[0] < 0.03 * len(data)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.85, 1.0])
def test_quantile_by_key(frame, rows, q):
    got = {r.key: r.quantile for r in K.quantile_by_key(frame, ["key"], "v", q).collect()}
    for key in {r[1] for r in rows}:
        assert got[key] == pytest.approx(np.quantile([r[3] for r in rows if r[1] == key], q))


def test_quantile_of_negative_and_large_values(spark):
    values = [-5e8, -3.0, -3.0, -0.1, 0.0, 2.5, 2.5, 7e12]
    df = spark.createDataFrame([(1, v) for v in values], "key int, v double")
    for q in (0.1, 0.25, 0.5, 0.9):
        assert K.quantile_by_key(df, ["key"], "v", q).first().quantile == pytest.approx(np.quantile(values, q))


def test_packed_members_are_whole(spark):
    df = spark.range(5000).select(F.lit("g").alias("k"), F.concat(F.lit("m"), (F.col("id") % 2500)).alias("m"))
    parts = K.packed_members(df, ["k"], "m", chunk=100).collect()
    assert len(parts) > 20 and max(len(p.members) for p in parts) < 250
    assert sorted(m for p in parts for m in p.members) == sorted({f"m{i}" for i in range(2500)})


def test_running_total(spark):
    df = spark.createDataFrame([(s / 10, s + 1) for s in range(11)], "score double, pos long")
    got = {r.score: r.cum_pos for r in K.running_total(df, "score", ["pos"], F.floor(F.col("score") * 3)).collect()}
    for s in range(11):
        assert got[s / 10] == sum(x + 1 for x in range(s, 11))


@pytest.mark.parametrize("expr", ["id % 13", "CASE WHEN id % 3 > 0 THEN 7 ELSE id % 13 END", "1"])
def test_global_row_number(spark, expr):
    got = K.global_row_number(spark.range(4000).withColumn("o", F.expr(expr)), "o", "id").collect()
    ordered = sorted(got, key=lambda r: (r.o, r.id))
    assert [r.row_number for r in ordered] == list(range(1, 4001))
