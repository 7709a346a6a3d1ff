"""Structured Streaming jobs. Each takes a streaming frame and gives one; ``run_to_table`` drives it.

Event times are zone-aware timestamps here, since watermarks refuse the zone-less type.
Windowed results are appended once their window is behind the watermark, so a sink
sees every row once; late rows beyond the watermark are dropped by design.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType

from inquest.functions import scalar as S
from inquest.operators.ato import agent_mismatch, high_value, is_sensitive, isp_mismatch, value_mismatch
from inquest.operators.warehouse import ENTITY, entity_cases
from inquest.sources.sinks import LEAD_KEY, new_leads

DELAY = "10 minutes"


def read_table_stream(spark: SparkSession, folder: str, schema, name_filter: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def event_time(df: DataFrame, ts: str, delay: str = DELAY) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Process all that is there, append to Parquet exactly once, and return the table."""
    q = (
        stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_batches(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process all that is there batch by batch; ``each`` must give the same for a repeated batch id."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def lead_feed(leads: DataFrame, folder: str) -> DataFrame:
    """Leads that open something new, one per key, kept in a table of open leads.

    Repeats inside the watermark go first; the rest is held against the table. A
    batch is a partition of its own, so a batch that runs again replaces itself.
    """
    spark = leads.sparkSession
    unique = event_time(leads, "created_at").dropDuplicatesWithinWatermark(list(LEAD_KEY))
    schema = unique.schema

    columns = schema.names
    table = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())]))
    path = f"{folder}/leads"
    # An empty first part, so that the table can be read before any batch has come.
    spark.createDataFrame([], unique.schema).write.mode("overwrite").parquet(f"{path}/batch=-1")

    def each(batch: DataFrame, batch_id: int) -> None:
        known = table.parquet(path).filter(F.col("batch") < batch_id)
        new_leads(batch, known).select(*columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_batches(unique, folder, each)
    return table.parquet(path).select(*columns)


def burst_tumbling(events: DataFrame, ts: str, user: str, width: str = "1 minute", least: int = 8) -> DataFrame:
    """Windows with ``least`` and more different users, counted exactly: repeats per window go first."""
    timed = event_time(events.select(ts, user), ts).withColumn("w", F.window(ts, width))
    once = timed.select("w", F.col("w.end").alias("_end"), user, ts).dropDuplicates(["w", user])
    counts = once.groupBy("w").agg(F.count("*").alias("users"))
    return counts.filter(F.col("users") >= least).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "users")


#: Groups that keys are dealt to by a hash. A call to Python costs the same for a group of one row and of thousands.
GROUPS = 4096


def velocity_sliding(
    events: DataFrame, ts: str, keys: list[str], least: int = 8, width: str = "1 hour", slide: str = "5 minutes", delay: str = DELAY, groups: int = GROUPS
) -> DataFrame:
    """Busy keys per sliding hour.

    The state has one count per key and pane, the longest step that windows and delay are made of, not a row for each
    window that a row is in; windows are added up when the watermark passes their end. Keys share a state by ``groups``.
    A row is late when its last window has closed; before that it counts in the windows that are open.
    """
    wide, step, wait = (int(pd.Timedelta(x).total_seconds() * 1_000_000) for x in (width, slide, delay))
    pane = math.gcd(wide, step, wait)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    key = F.struct(*keys)
    kind, formats = events.select(key.alias("k")).schema["k"].dataType, {c: "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + z for c, z in (("timestampFormat", "XXX"), ("timestampNTZFormat", ""))}
    rows = events.filter(F.col(ts).isNotNull()).select(F.to_json(key, {"ignoreNullFields": "false", **formats}).alias("key"), (us - F.pmod(us, F.lit(pane))).alias("pane"))
    # All ends of windows are whole panes, so this watermark passes them when one on the time itself does.
    rows = rows.withColumn("until", F.timestamp_micros(F.col("pane") + wide)).withWatermark("until", f"{(wide + wait) // 1000} milliseconds")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(groups)))
    back = np.arange(-(-wide // step)) * step

    def add_up(part: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [] if state.hasTimedOut else [f[["key", "pane"]].assign(n=1) for f in frames]
        done = None
        if state.exists:
            *held, done = state.get
            parts.insert(0, pd.DataFrame(dict(zip(("key", "pane", "n"), held))).astype({"pane": "int64", "n": "int64"}))
        counts = pd.concat(parts, ignore_index=True).groupby(["key", "pane"], as_index=False, sort=False)["n"].sum()
        mark, at = state.getCurrentWatermarkMs() * 1000, counts["pane"].to_numpy()
        latest = at // step * step
        starts = latest[:, None] - back
        ends = starts + wide
        inside = ends > at[:, None]
        closed = inside & (ends <= mark)
        row, which = np.nonzero(closed if done is None else closed & (ends > done))
        found = pd.DataFrame({"key": counts["key"].to_numpy()[row], "start": starts[row, which], "n": counts["n"].to_numpy()[row]})
        found = found.groupby(["key", "start"], as_index=False, sort=False)["n"].sum()
        kept = latest + wide > mark
        state.update((*(counts.loc[kept, c].tolist() for c in ("key", "pane", "n")), mark))
        if kept.any():
            state.setTimeoutTimestamp(max(int(ends[inside & ~closed].min()) // 1000 - 1, mark // 1000))
        yield found[found["n"] >= least]

    summed = rows.groupBy("part").applyInPandasWithState(
        add_up, "key string, start long, n long", "key array<string>, pane array<long>, n array<long>, done long", "append", GroupStateTimeout.EventTimeTimeout
    )
    named = summed.select(F.timestamp_micros("start").alias("window_start"), F.from_json("key", kind, formats).alias("k"), "n")
    return named.select("window_start", *(F.col("k").getField(c).alias(c) for c in keys), "n")


def ratio_5m(events: DataFrame, ts: str, user: str, flagged: DataFrame) -> DataFrame:
    """Users and flagged users per five minutes; the flagged table is a static side, joined as its size allows."""
    marks = flagged.select(F.col(flagged.columns[0]).alias(user)).distinct().withColumn("bot", F.lit(1))
    once = event_time(events.select(ts, user), ts).withColumn("w", F.window(ts, "5 minutes")).dropDuplicates(["w", user])
    joined = once.join(marks, user, "left")
    counts = joined.groupBy("w").agg(F.count("*").alias("total_users"), F.sum(F.coalesce("bot", F.lit(0))).alias("bot_users"))
    return counts.select(F.col("w.start").alias("window_start"), "total_users", "bot_users")


TRAVEL_OUT = "user string, event_id long, previous_event_id long, miles double, hours double"
TRAVEL_STATE = "user array<string>, us array<long>, event_id array<long>, lat array<double>, lon array<double>"


def impossible_travel(
    events: DataFrame, user: str, ts: str, lat: str, lon: str, event_id: str, mph: float = 500.0, forget: str = "30 days", groups: int = GROUPS
) -> DataFrame:
    """Consecutive positions too far apart, in the order of event time, whatever the order of arrival.

    A row waits in the state until the watermark has passed it, so no row before it can still come; then it is paired
    with the latest row of its user that is earlier. Of a user the state holds the last row that was paired and those that
    wait, and drops them when the user is silent for ``forget``. Users share a state by ``groups``, which bounds the calls
    to Python; a state is as large as its share of users and waiting rows. Distances come from the same column function as
    in batch; Python only pairs rows.
    """
    rows = event_time(events, ts).filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & F.col(ts).isNotNull())
    slim = rows.select(F.col(user).cast("string").alias("user"), ts, F.unix_micros(ts).alias("us"), F.col(event_id).alias("event_id"), F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    slim = slim.filter("user IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("user"), F.lit(groups)))
    hold_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    cols = ["user", "us", "event_id", "lat", "lon"]

    def pair(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [] if state.hasTimedOut else [f[cols] for f in frames]
        if state.exists:
            parts.insert(0, pd.DataFrame(dict(zip(cols, state.get))))
        rows = pd.concat(parts, ignore_index=True)
        code = pd.factorize(rows["user"])[0]
        order = np.lexsort((rows["event_id"], rows["us"], code))
        rows, code = rows.iloc[order].reset_index(drop=True), code[order]
        mark, us = state.getCurrentWatermarkMs(), rows["us"].to_numpy()
        passed = us // 1000 <= mark
        last = np.append(code[1:] != code[:-1], True)
        # Of the rows behind the watermark the last of a user stays, for the next one to be paired with.
        kept = ~passed | last | ~np.append(passed[1:], True)
        # When the state has to be looked at again: a waiting row is passed, or a user has been silent for long.
        alarm = np.where(passed, us // 1000 + hold_ms, us // 1000 - 1)
        kept &= ~(passed & last & (alarm < mark))
        if kept.any():
            state.update(tuple(rows.loc[kept, c].tolist() for c in cols))
            state.setTimeoutTimestamp(max(int(alarm[~passed | (last & kept)].min()), mark))
        else:
            state.remove()
        # The latest earlier row is the one before the rows of the same time. A row that was kept from before is the first of its user.
        first = np.append(True, (code[1:] != code[:-1]) | (us[1:] != us[:-1]))
        at = np.maximum.accumulate(np.where(first, np.arange(len(us)), 0)) - 1
        fresh = passed & (at >= 0) & (code[at] == code)
        now, before = rows[fresh].reset_index(drop=True), rows.iloc[at[fresh]].reset_index(drop=True)
        yield pd.DataFrame({
            "user": now["user"], "event_id": now["event_id"].astype("int64"), "previous_event_id": before["event_id"].astype("int64"),
            "us": now["us"].astype("int64"), "us0": before["us"].astype("int64"),
            "lat": now["lat"], "lon": now["lon"], "lat0": before["lat"], "lon0": before["lon"],
        })

    pairs_schema = "user string, event_id long, previous_event_id long, us long, us0 long, lat double, lon double, lat0 double, lon0 double"
    pairs = slim.groupBy("part").applyInPandasWithState(pair, pairs_schema, TRAVEL_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    miles = S.haversine_miles(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    out = pairs.select("user", "event_id", "previous_event_id", miles.alias("miles"), (F.abs(F.col("us") - F.col("us0")) / 3.6e9).alias("hours"))
    return out.filter((F.col("hours") > 1e-6) & (F.col("miles") / F.col("hours") > mph))


def sessionize(events: DataFrame, ts: str, user: str, gap: str = "30 minutes") -> DataFrame:
    """Closed sessions per user with their length."""
    counts = event_time(events.select(ts, user), ts).groupBy(F.session_window(ts, gap).alias("w"), user).agg(
        F.count("*").alias("n"), F.min(F.unix_micros(ts)).alias("a"), F.max(F.unix_micros(ts)).alias("b")
    )
    return counts.select(user, F.col("w.start").alias("session_start"), "n", ((F.col("b") - F.col("a")) / 1e6).alias("seconds"))


def baseline_compare(sessions: DataFrame, lists: DataFrame, user: str, session_id: str, ua: str, screen: str, isp: str, hardware: str) -> DataFrame:
    """(session_id, user, code): sessions held against the static baseline table as they arrive."""
    known = sessions.withColumn("user", F.col(user).cast("string")).join(lists, "user")
    hosting = S.is_hosting_isp(F.col(isp))
    codes = F.array(
        F.when(agent_mismatch(F.col(ua), F.col("top_agents")), "USER_AGENT_MISMATCH"),
        F.when(value_mismatch(F.col(screen), F.col("top_screens")), "SCREEN_ENV_MISMATCH"),
        F.when(hosting, "HOSTING_OR_PROXY_ISP").when(isp_mismatch(F.col(isp), F.col("top_isps")), "ISP_MISMATCH"),
        F.when(value_mismatch(F.col(hardware), F.col("known_hardware")), "NEW_HARDWARE_ID"),
    )
    return known.select(F.col(session_id).alias("session_id"), "user", F.explode(F.array_compact(codes)).alias("code"))


def sensitive_chain(events: DataFrame, user: str, ts: str, kind: str, event_id: str, amount: str, stats: DataFrame, within: str = "1 hour") -> DataFrame:
    """High transfers within an hour after an account change: an interval join of the stream with itself."""
    timed = event_time(events, ts)
    change = timed.filter(is_sensitive(F.col(kind))).select(F.col(user).alias("cu"), F.col(ts).alias("ct"), F.col(event_id).alias("change_event_id"))
    avg = stats.select(F.col("user").alias("_su"), "avg_amount")
    moved = timed.filter(F.col(amount) >= 500.0).join(avg, F.col(user) == F.col("_su"))
    moved = moved.filter(high_value(F.col(amount), F.col("avg_amount"))).select(F.col(user).alias("user"), F.col(ts).alias("tt"), F.col(event_id).alias("event_id"))
    near = (F.col("user") == F.col("cu")) & (F.col("tt") > F.col("ct")) & (F.col("tt") <= F.col("ct") + F.expr(f"INTERVAL {within}"))
    return moved.join(change, near).select("user", "event_id", "change_event_id")


def entity_ingest(occurrences: DataFrame, folder: str) -> DataFrame:
    """Entity map fed by a stream. A batch leaves its entity-case counts in a folder of
    its own; the map is the merge of these small tables, so nothing is counted twice."""
    spark = occurrences.sparkSession
    schema = "entity_type string, entity_value string, source_case_id string, first_seen timestamp_ntz, last_seen timestamp_ntz"

    def each(batch: DataFrame, batch_id: int) -> None:
        entity_cases(batch).write.mode("overwrite").parquet(f"{folder}/parts/b{batch_id}")

    run_batches(occurrences, folder, each)
    parts = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/parts")
    per_case = parts.groupBy(*ENTITY, "source_case_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return per_case.groupBy(*ENTITY).agg(
        F.count("*").alias("distinct_case_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")
    )
