"""Streams in several batches give what the batch operators give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from inquest.operators import ato, warehouse
from inquest.roles import ColumnRoles
from inquest.streaming import jobs as J

D0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Three files in the order of time."""
    rnd = random.Random(11)
    rows = sorted((D0 + dt.timedelta(minutes=rnd.randrange(60 * 48)), f"u{rnd.randrange(6)}") for _ in range(240))
    full = [(i, u, ts, float(rnd.randrange(-60, 60)), float(rnd.randrange(-150, 150))) for i, (ts, u) in enumerate(rows)]
    schema = "event_id long, user string, ts timestamp_ntz, lat double, lon double"
    folder = str(tmp_path_factory.mktemp("events"))
    for k in range(3):
        spark.createDataFrame(full[80 * k : 80 * (k + 1)], schema).coalesce(1).write.mode("append").parquet(folder)
    return folder, spark.createDataFrame(full, schema)


def test_impossible_travel_equals_batch(spark, parts, tmp_path):
    folder, all_rows = parts
    roles = ColumnRoles(user="user", timestamp="ts", latitude="lat", longitude="lon", row_id="event_id")
    # Rows after the last watermark still wait for earlier ones.
    end = all_rows.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = {(r.event_id, r.last_login.event_id) for r in ato.impossible_travel(all_rows, roles).collect() if r.ts <= end}
    stream = J.read_table_stream(spark, folder, all_rows.schema, files_per_trigger=1)
    got = J.run_to_table(J.impossible_travel(stream, "user", "ts", "lat", "lon", "event_id"), str(tmp_path))
    pairs = {(r.event_id, r.previous_event_id) for r in got.collect()}
    assert len(pairs) > 50 and pairs == want


def test_late_rows_inside_the_watermark_find_their_place(spark, tmp_path):
    schema = "user string, ts timestamp_ntz, lat double, lon double, event_id long"
    at = lambda m: D0 + dt.timedelta(minutes=m)
    files = [[("u", at(0), 0.0, 0.0, 1), ("u", at(6), 0.0, 0.0, 3)], [("u", at(3), 50.0, 50.0, 2)], [("u", at(400), 0.0, 0.0, 4), ("v", at(500), 0.0, 0.0, 5)]]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = J.read_table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    got = J.run_to_table(J.impossible_travel(stream, "user", "ts", "lat", "lon", "event_id"), str(tmp_path / "out"))
    assert {(r.event_id, r.previous_event_id) for r in got.collect()} == {(2, 1), (3, 2)}


def test_burst_counts_users_once_over_batches(spark, parts, tmp_path):
    folder, all_rows = parts
    stream = J.read_table_stream(spark, folder, all_rows.schema, files_per_trigger=1)
    out = J.run_to_table(J.burst_tumbling(stream, "ts", "user", "6 hours", 1), str(tmp_path))
    got = {r.window_start: r.users for r in out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "users").collect()}
    batch = all_rows.groupBy(F.window("ts", "6 hours").start.alias("w")).agg(F.count_distinct("user").alias("n")).collect()
    want = {r.w: r.n for r in batch}
    assert got and all(want[w] == n for w, n in got.items()) and len(got) >= len(want) - 1


def test_entity_map_is_incremental(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "source_case_id string, upload_timestamp timestamp_ntz, user_id string"
    for k in range(3):
        spark.createDataFrame([(f"c{k}", D0 + dt.timedelta(k), "u"), (f"c{k}", D0, f"v{k}")], schema).coalesce(1).write.mode("append").parquet(folder)
    table = spark.read.parquet(folder)
    stream = J.read_table_stream(spark, folder, table.schema, files_per_trigger=1)
    got = J.entity_ingest(warehouse.extract_entities(stream, "source_case_id", "upload_timestamp"), str(tmp_path / "out"))
    want = warehouse.entity_map(warehouse.extract_entities(table, "source_case_id", "upload_timestamp"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_lead_feed_opens_each_lead_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = "lead_id long, case_id string, pin_kind string, fingerprint string, severity double, status string, created_at timestamp_ntz"
    for k in range(2):
        spark.createDataFrame([(k, "c", "bot", "f", 9.0, "OPEN", D0 + dt.timedelta(days=k)), (10 + k, "c", "bot", f"g{k}", 0.2, "OPEN", D0)], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = J.read_table_stream(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)
    rows = J.lead_feed(stream, str(tmp_path / "out")).collect()
    assert sorted((r.fingerprint, r.severity) for r in rows) == [("f", 1.0), ("g0", 0.2), ("g1", 0.2)]


def _largest_state(stream, folder):
    """Rows of a job over all files, and the most rows that its state had."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    most = max(s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"])
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows").collect(), most


def _native_sliding(timed, keys, width, slide):
    w = F.window("ts", width, slide).alias("w")
    return timed.groupBy(w, *keys).agg(F.count("*").alias("n")).filter("n >= 2").select(F.col("w.start").alias("window_start"), *keys, "n")


@pytest.mark.parametrize("width, slide", [("1 hour", "5 minutes"), ("30 minutes", "30 minutes"), ("50 minutes", "20 minutes")])
def test_sliding_counts_are_those_of_windows_with_state_by_pane(spark, tmp_path, width, slide):
    """Rows that come late, null times and keys, and several keys, in three batches; the state has rows by group, not by window."""
    rnd = random.Random(5)
    minute = lambda k: D0 + dt.timedelta(seconds=60 * (150 * k + rnd.randrange(-8, 160)) + rnd.randrange(60))
    late = [(D0 + dt.timedelta(minutes=m), "u0", 0) for m in (95, 130, 131)]
    schema = "ts timestamp_ntz, user string, kind long"
    for k in range(3):
        rows = [(minute(k), rnd.choice(["u0", "u1", 'q"\\é', None]), rnd.choice([0, None, 2**60 + 1])) for _ in range(200)]
        spark.createDataFrame(rows + late * (k == 1) + [(None, "u0", 0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: J.read_table_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, files_per_trigger=1)
    got, most = _largest_state(J.velocity_sliding(read(), "ts", ["user", "kind"], 2, width, slide, groups=3), str(tmp_path / "a"))
    want, _ = _largest_state(_native_sliding(J.event_time(read(), "ts"), ["user", "kind"], width, slide), str(tmp_path / "b"))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert len(want) > 30 and order(got) == order(want)
    assert most <= 3


def test_travel_state_is_shared_by_users(spark, parts, tmp_path):
    folder, all_rows = parts
    make = lambda groups: J.impossible_travel(J.read_table_stream(spark, folder, all_rows.schema, files_per_trigger=1), "user", "ts", "lat", "lon", "event_id", forget="3 hours", groups=groups)
    got, most = _largest_state(make(2), str(tmp_path / "few"))
    apart, _ = _largest_state(make(4096), str(tmp_path / "many"))
    assert len(got) > 50 and sorted(got) == sorted(apart)
    assert most <= 2
