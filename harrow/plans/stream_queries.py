"""Registered queries of the streaming operators.

Each takes the events in four slices of time. The stream runs until a slice is
used up, stops, and goes on from its checkpoint with the next, so state and
watermark are carried across batches and restarts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from harrow import operators as op
from harrow import streaming as st
from harrow.plans import flows, views
from harrow.plans.batch_queries import (
    CONSTRAINTS, FED_LEDGER_SQL, FIXES, GAUGE_SQL, GREEDY_GAP_S, GREEDY_SQL, NOW, POSITION_WITHIN_S, SESSION_GAP_S,
    SESSIONS, STATS, TRAILS, TRANSITIONS, fixes, located_columns, located_signals, session_columns, stats_columns,
    working)
from harrow.plans.registry import (
    COUNTERS, DECODED, EV, GAP_TEXT, POINTS, PROBES, READINGS, REQUESTS, SIGNALS, query, rounded, sql, us)
from harrow.session import shared_folder


def fed(rows: DataFrame, name: str, run: Callable[[DataFrame, str], object], time: str = "time") -> str:
    """Run a stream over slices of the rows; returns the folder it works in.

    The rows are computed and dealt into slices once; a slice then joins the stream's folder from its own.
    """
    spark = rows.sparkSession
    base = shared_folder(spark, name)
    part, n = views.slice_of(rows, time)
    rows.withColumn("_slice", part).write.partitionBy("_slice").parquet(base + "/slices")
    slices = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_slice", T.IntegerType())])).parquet(
        base + "/slices")
    for k in range(n):
        slices.where(F.col("_slice") == k).drop("_slice").write.mode("append").parquet(base + "/in")
        run(spark.readStream.schema(rows.schema).parquet(base + "/in"), base)
    return base


def appended(rows: DataFrame, make: Callable[[DataFrame], DataFrame], name: str,
             time: str = "time") -> DataFrame:
    base = fed(rows, name, lambda stream, at: st.run_append(make(stream), at + "/out", at + "/checkpoint"), time)
    return rows.sparkSession.read.schema(make(rows).schema).parquet(base + "/out")


def updated(rows: DataFrame, make: Callable[[DataFrame], DataFrame], name: str, keys: list[str]) -> DataFrame:
    base = fed(rows, name, lambda stream, at: st.run_updates(make(stream), at + "/out", at + "/checkpoint"))
    return st.read_updates(rows.sparkSession, base + "/out", keys)


def valid_signals(ev: DataFrame) -> DataFrame:
    return op.valid_signal_filter(views.signals(ev))


# Append mode keeps the windows the watermark has not passed: with a one-hour
# delay, those that end less than an hour before the newest event.
@query("stream_signal_stats", sql(SIGNALS, f"""SELECT epoch_us(date_trunc('hour', time)) AS window_us,
  device, name, {STATS} FROM signals WHERE value < max_value GROUP BY 1, 2, 3
  HAVING epoch_us(date_trunc('hour', MIN(time))) + 3600000000 <=
    (SELECT MAX(us) FROM signals WHERE value < max_value) // 1000 * 1000 - 3600000000"""))
def stream_signal_stats(spark, sf):
    out = appended(
        views.events(spark, sf), lambda ev: st.stream_signal_stats(valid_signals(ev), "1 hour", "1 hour"),
        "stream-stats")
    return stats_columns(out, us("window_start", "window_us"), "device", "name")


@query("message_stream_to_stats", sql(DECODED, """SELECT epoch_us(date_trunc('hour', time)) AS window_us,
  device, name, COUNT(*) AS number, printf('%.12e', SUM(value)) AS total FROM decoded WHERE value < max_value
  GROUP BY 1, 2, 3 HAVING epoch_us(date_trunc('hour', MIN(time))) + 3600000000 <=
    (SELECT MAX(us) FROM decoded WHERE value < max_value) // 1000 * 1000 - 3600000000"""))
def message_stream_to_stats(spark, sf):
    seconds = F.get_json_object("body", "$.timestamp").cast("double")
    messages = op.frame_to_message(views.messages(views.events(spark, sf))).select(
        "device", "body", F.timestamp_micros(F.round(seconds * 1000000).cast("bigint")).alias("arrived"))
    dictionary = views.dictionary(spark)
    out = appended(
        messages, lambda m: flows.message_stream_to_stats(m.drop("arrived"), dictionary, "1 hour", "1 hour"),
        "stream-messages", "arrived")
    return out.select(us("window_start", "window_us"), "device", "name", "number",
                      F.format_string("%.12e", "sum_val").alias("total"))


@query("stream_signal_stats_greedy", GREEDY_SQL.replace("MAX(us) AS last_sent_us", """MAX(us) AS last_sent_us,
  CASE name WHEN 'click' THEN 61444 WHEN 'view' THEN 65265 WHEN 'signup' THEN 65262
  WHEN 'purchase' THEN 65267 ELSE 59904 END AS pgn, 'u' AS units,
  CAST(CASE name WHEN 'click' THEN 100 WHEN 'view' THEN 150 ELSE 200 END AS DOUBLE) AS max_value"""))
def stream_signal_stats_greedy(spark, sf):
    out = appended(
        views.events(spark, sf), lambda ev: st.stream_signal_stats_greedy(valid_signals(ev), GREEDY_GAP_S),
        "stream-greedy")
    return stats_columns(out, "device", "name", us("last_sent"), F.col("pgn").cast("bigint").alias("pgn"), "units",
                         "max_value")


@query("stream_rising_edge", sql(READINGS, """SELECT id, device, subject, us AS time_us,
  CAST(reading AS BIGINT) AS reading FROM edges"""))
def stream_rising_edge(spark, sf):
    out = appended(
        views.events(spark, sf), lambda ev: st.stream_rising_edge(views.readings(ev)), "stream-edges")
    return out.select("id", "device", "subject", us("time"), "reading")


@query("stream_online_transitions", sql(TRANSITIONS, f"""SELECT id, device, time_us, event, last_seen_us,
  gap_s, CASE WHEN event = 'online' THEN coalesce({GAP_TEXT}, 'never seen') END AS gap_text
  FROM transitions"""))
def stream_online_transitions(spark, sf):
    out = appended(
        views.events(spark, sf), lambda ev: st.stream_online_transitions(views.probes(ev)), "stream-online")
    return out.select("id", "device", us("time"), "event", us("last_seen"), "gap_s", "gap_text")


# A device's newest sample time is open: more links may still report for it.
@query("stream_idle_detect", sql(COUNTERS, """SELECT device, epoch_us(time) AS time_us, rx_bytes FROM
  (SELECT *, coalesce(lag(rx_bytes) OVER w, 0) AS before, lead(time) OVER w AS after FROM activity
   WINDOW w AS (PARTITION BY device ORDER BY time)) WHERE rx_bytes = before AND after IS NOT NULL"""))
def stream_idle_detect(spark, sf):
    out = appended(views.counters(views.events(spark, sf)), st.stream_idle_detect, "stream-idle")
    return out.select("device", us("time"), "rx_bytes")


@query("stream_gauges", GAUGE_SQL)
def stream_gauges(spark, sf):
    return updated(
        views.events(spark, sf), lambda ev: st.stream_gauges(views.signals(ev)), "stream-gauges",
        ["device", "metric"]).select(
        "device", "metric", "value", "description", us("time"))


@query("stream_subscribers", sql(REQUESTS, """SELECT DISTINCT phone FROM requests WHERE phone LIKE '+%'"""))
def stream_subscribers(spark, sf):
    return appended(
        views.events(spark, sf), lambda ev: st.stream_subscribers(views.subscription_requests(ev)),
        "stream-subscribers").select("phone")


@query("stream_staleness", sql(PROBES, f"""SELECT device,
  round((epoch_us(TIMESTAMP '{NOW}') - MAX(us)) / 1000000.0, 6) AS age_s,
  (epoch_us(TIMESTAMP '{NOW}') - MAX(us)) / 1000000.0 <= 86400 AS healthy
  FROM probes GROUP BY device"""))
def stream_staleness(spark, sf):
    newest = updated(
        views.events(spark, sf), lambda ev: st.stream_staleness(views.probes(ev)), "stream-stale", ["device"])
    fleet = views.probes(views.events(spark, sf)).select("device").distinct()
    return op.staleness(newest, fleet, F.lit(NOW).cast("timestamp"), 86400.0).select(
        "device", rounded("age_s", 6), "healthy")


@query("stream_table_writer", sql(EV, """SELECT CASE event_type WHEN 'signup' THEN 'SKY'
  WHEN 'purchase' THEN 'PPS' ELSE 'TPV' END AS target, id, us AS systime_us FROM ev
  WHERE value >= 2 AND event_type <> 'error'
  UNION ALL SELECT CASE WHEN value < 2 THEN 'not JSON' ELSE 'null mode' END, NULL, us FROM ev
  WHERE value < 2 OR event_type = 'error'"""))
def stream_table_writer(spark, sf):
    classes = ("TPV", "SKY", "PPS")
    base = fed(views.events(spark, sf), "stream-tables", lambda ev, at: st.stream_table_writer(
        views.gpsd_lines(ev), {c: f"{at}/{c}" for c in classes}, at + "/rejects", at + "/checkpoint"))
    stored = [spark.read.parquet(f"{base}/{c}").select(F.lit(c).alias("target"), "id", us("systime"))
              for c in classes]
    rejected = spark.read.parquet(base + "/rejects").select(
        F.col("reason").alias("target"), F.lit(None).cast("bigint").alias("id"), us("systime"))
    return op.class_union(*stored, rejected)


@query("stream_trail_upload", sql(TRAILS, """SELECT device, epoch_us(time) AS time_us, true AS sent
  FROM points GROUP BY device, time"""))
def stream_trail_upload(spark, sf):
    base = fed(views.events(spark, sf), "stream-upload", lambda ev, at: st.stream_trail_upload(
        views.points(ev), at + "/points", at + "/sent", at + "/documents", at + "/staging", at + "/checkpoint"))
    log = spark.read.parquet(base + "/sent")
    return op.ledger_insert(views.points(views.events(spark, sf)), log).select(
        "device", us("time"), "sent")


# --- event time: rows arrive out of order, some too late ----------------------

# Reports come up to twelve hours after their time, one in fifty after more than a week. They are
# taken up in four parts of arrival; what is over a day behind the newest one before is late.
ARRIVAL_CUTS = ("2024-01-09", "2024-01-17", "2024-01-25")
DELAY_S = 86_400
ARRIVED = EV + f""", arrived AS (SELECT *, us + (id * 7919 % 43200) * 1000000
  + CASE WHEN id % 50 = 7 THEN 8 * 86400000000 ELSE 0 END AS arrival FROM ev),
parted AS (SELECT *, {" + ".join(f"CAST(arrival >= epoch_us(TIMESTAMP '{c}') AS INTEGER)" for c in ARRIVAL_CUTS)} AS part
  FROM arrived),
clocks AS (SELECT part, MAX(MAX(us)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS clock
  FROM parted GROUP BY part),
judged AS (SELECT p.*, coalesce(us <= (clock // 1000 - {DELAY_S}000) * 1000, false) AS late
  FROM parted p JOIN clocks USING (part)),
passed AS (SELECT * FROM judged WHERE NOT late
  AND us <= (SELECT MAX(us) // 1000 * 1000 - {DELAY_S}000000 FROM judged))"""


def out_of_order(ev):
    """Events in the parts in which they arrive."""
    late = F.when(F.col("id") % 50 == 7, 8 * 86_400_000_000).otherwise(0)
    arrival = F.unix_micros("time") + F.col("id") * 7919 % 43_200 * 1_000_000 + late
    cuts = [F.unix_micros(F.lit(c).cast("timestamp")) for c in ARRIVAL_CUTS]
    part = sum((F.coalesce(arrival >= c, F.lit(False)).cast("int") for c in cuts), F.lit(0))
    return [ev.where(part == k) for k in range(len(cuts) + 1)]


def in_event_time(ev, name, make):
    """Runs a stream over rows that come out of order; returns what it wrote and the late rows."""
    spark = ev.sparkSession
    base = shared_folder(spark, name)
    for part in out_of_order(ev):
        part.write.mode("append").parquet(base + "/in")
        st.stream_split_late(spark.readStream.schema(ev.schema).parquet(base + "/in"), DELAY_S, base + "/passed",
                             base + "/late", base + "/clocks", base + "/split")
        with st.timer_state(spark):
            st.run_append(make(st.read_batches(spark, base + "/passed", ev.schema)), base + "/out",
                          base + "/checkpoint")
    late = spark.read.schema(ev.schema).parquet(base + "/late/*")
    return spark.read.schema(make(ev).schema).parquet(base + "/out"), late


@query("stream_transitions_event_time", f"""WITH {ARRIVED},
looked AS (SELECT *, event_type <> 'error' AS ok, coalesce(lag(event_type <> 'error') OVER w, false) AS was,
  max(CASE WHEN event_type <> 'error' THEN us END) OVER (PARTITION BY user_id ORDER BY us, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM passed WINDOW w AS (PARTITION BY user_id ORDER BY us, id))
SELECT id, user_id AS device, us AS time_us, CASE WHEN ok THEN 'online' ELSE 'offline' END AS event,
  seen AS last_seen_us FROM looked WHERE ok <> was
UNION ALL SELECT id, user_id, us, 'late', NULL FROM judged WHERE late""")
def stream_transitions_event_time(spark, sf):
    out, late = in_event_time(
        views.events(spark, sf), "stream-transitions",
        lambda ev: st.stream_online_transitions(views.probes(ev), {"delay": f"{DELAY_S} seconds"}))
    return out.select("id", "device", us("time"), "event", us("last_seen")).unionByName(
        views.probes(late).select("id", "device", us("time"), F.lit("late").alias("event"),
                                  F.lit(None).cast("bigint").alias("last_seen_us")))


@query("stream_position_asof", f"""WITH {ARRIVED},
fixes AS (SELECT id, user_id % 50 AS device, us,
  CAST(40.0 AS DOUBLE) + CAST(id % 2000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
  CAST(-87.0 AS DOUBLE) + CAST(user_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon FROM passed WHERE value >= 50),
found AS (SELECT s.id, s.user_id % 50 AS device, event_type AS name, round(value, 4) AS value, p.us AS seen, lat, lon,
  s.us - p.us <= {POSITION_WITHIN_S}000000 AS near
  FROM passed s ASOF LEFT JOIN fixes p ON s.user_id % 50 = p.device AND s.us >= p.us)
SELECT id, device, name, value, CASE WHEN near THEN round(lat, 4) END AS lat, CASE WHEN near THEN round(lon, 4) END AS lon,
  CASE WHEN near THEN seen END AS position_time_us FROM found""")
def stream_position_asof(spark, sf):
    out, _ = in_event_time(
        views.events(spark, sf), "stream-positions",
        lambda ev: st.stream_position_asof(located_signals(ev), fixes(ev), f"{DELAY_S} seconds", POSITION_WITHIN_S))
    return located_columns(out)


# Published are the sessions whose gap the watermark has passed.
@query("stream_work_sessions", sql(SESSIONS, f"""SELECT * FROM sessions WHERE end_time_us + {SESSION_GAP_S}000000 <=
  (SELECT MAX(us) FROM working) // 1000 * 1000 - 3600000000"""))
def stream_work_sessions(spark, sf):
    out = appended(
        views.events(spark, sf), lambda ev: st.stream_work_sessions(
            working(ev), SESSION_GAP_S, "1 hour", measures=("value",)), "stream-sessions")
    return session_columns(out)


# Changes come out of their order, one part of them twice; days are merged after every second batch.
@query("stream_ledger_feed", FED_LEDGER_SQL)
def stream_ledger_feed(spark, sf):
    changes = views.ledger_changes(views.events(spark, sf))
    parts = [views.ledger_changes(p) for p in out_of_order(views.events(spark, sf))]
    base = shared_folder(spark, "stream-ledger")
    for part in [*parts, parts[1]]:
        part.write.mode("append").parquet(base + "/in")
        st.stream_ledger_feed(spark.readStream.schema(changes.schema).parquet(base + "/in"), base + "/ledger",
                              base + "/checkpoint", merge_every=2)
    return st.read_ledger(spark, base + "/ledger").select("device", us("time"), "sent")


# Out come the rows that the watermark has passed, and those that lack a column, of whatever time.
@query("stream_constraint_split", sql(POINTS + f", split AS ({CONSTRAINTS})", """
  SELECT id, reason FROM split JOIN points USING (id) WHERE reason LIKE 'null%' OR epoch_us(time) <=
  (SELECT MAX(epoch_us(time)) FROM points WHERE value >= 3) // 1000 * 1000 - 3600000000"""))
def stream_constraint_split(spark, sf):
    def split(points):
        return st.stream_constraint_split(points, ["lat"], ["device", "time"], "id", "1 hour")

    points = views.points(views.events(spark, sf), "value").withColumn(
        "lat", F.when(F.col("value") >= 3, F.col("lat")))
    return appended(points, split, "stream-split").select("id", "reason")


REPLAY_WITHIN_S = 60


@query("stream_replay_match", f"""WITH {EV}, copies AS (
  SELECT 'j1939.gps.' || event_type AS subject, props AS body, us, 1 AS sent FROM ev
  UNION ALL SELECT 'j1939.gps.' || event_type, props, us + 2000000, 0 FROM ev WHERE value >= 3
  UNION ALL SELECT 'j1939.gps.' || event_type, props, us + 5000000, 0 FROM ev WHERE value > 150),
opened AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {REPLAY_WITHIN_S}000000 THEN 0 ELSE 1 END AS fresh
  FROM copies WINDOW w AS (PARTITION BY subject, body ORDER BY us)),
numbered AS (SELECT *, SUM(fresh) OVER (PARTITION BY subject, body ORDER BY us, fresh DESC ROWS UNBOUNDED PRECEDING)
  AS session FROM opened),
settled AS (SELECT subject, body, MIN(us) AS first_us, MAX(us) AS last_us, CAST(SUM(sent) AS BIGINT) AS sent,
  CAST(SUM(1 - sent) AS BIGINT) AS received FROM numbered GROUP BY subject, body, session)
SELECT subject, body, first_us AS first_time_us, last_us AS last_time_us, least(sent, received) AS matched,
  greatest(sent - received, 0) AS missing, greatest(received - sent, 0) AS unexpected FROM settled
WHERE last_us + {REPLAY_WITHIN_S}000000 <= (SELECT MAX(us) FROM copies) // 1000 * 1000 - 600000000""")
def stream_replay_match(spark, sf):
    out = appended(
        views.events(spark, sf), lambda ev: st.stream_replay_balance(
            views.replay_sent_at(ev), views.replay_received_at(ev), REPLAY_WITHIN_S, "10 minutes"), "stream-replay")
    return out.select("subject", "body", us("first_time"), us("last_time"), "matched", "missing", "unexpected")
