"""Registered queries of the batch operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from harrow import functions as fn
from harrow import operators as op
from harrow import sinks, sources
from harrow.plans import flows, views
from harrow.plans.registry import (
    COUNTERS, DECODED, DFT, EV, FRAMES, GAP_TEXT, GEOHASH, POINTS, POINT_ID, PROBES, READINGS,
    REPLAY, REQUESTS, SIGNALS, TRANSITIONS, WINDOWED, big, query, rounded, sql, us)
from harrow.session import shared_folder


# --- sources ---------------------------------------------------------------

CAN_LOG_SQL = sql(FRAMES, """SELECT us AS time_us, can_interface, printf('%x', can_id) AS can_id,
  data AS can_data FROM frames""")


def can_log_columns(df):
    return df.select(us("time"), "can_interface", "can_id", "can_data")


@query("read_can_csv", CAN_LOG_SQL)
def read_can_csv(spark, sf):
    path = shared_folder(spark, "can-csv")
    views.can_log(views.events(spark, sf)).write.option(
        "timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)
    return can_log_columns(sources.read_can_csv(spark, path))


@query("parse_can_text", sql(FRAMES, """SELECT id, us AS time_us, can_interface,
  printf('%x', can_id) AS can_id, data AS can_data FROM frames WHERE v100 >= 200"""))
def parse_can_text(spark, sf):
    rows, _ = sources.parse_can_text(views.gateway_lines(views.events(spark, sf)))
    return rows.select("id", us("time"), "can_interface", "can_id", "can_data")


@query("parse_can_text_rejects", sql(FRAMES, """SELECT id, can_interface,
  substr('< frame ' || printf('%x', can_id) || printf(' %d.%06d ', us // 1000000, us % 1000000)
  || data || ' >', 1, 20) AS value FROM frames WHERE v100 < 200"""))
def parse_can_text_rejects(spark, sf):
    return sources.parse_can_text(views.gateway_lines(views.events(spark, sf)))[1]


@query("read_raw_frames", sql(FRAMES, """SELECT id, us AS time_us, pgn, source,
  -device - 1 AS source_name, destination,
  CASE WHEN destination IS NOT NULL THEN device * 1000003 END AS destination_name,
  priority, data FROM messages"""))
def read_raw_frames(spark, sf):
    text = op.frame_to_message(views.messages(views.events(spark, sf)))
    rows = sources.read_raw_frames(text.select("id", "body"))
    return rows.select(
        "id", us("time"), big("pgn"), big("source"), "source_name", big("destination"),
        "destination_name", big("priority"), fn.hex_text("data").alias("data"))


@query("read_bus_messages", sql(FRAMES, """SELECT id, us AS time_us, pgn, source, destination,
  priority, data, 'j1939.' || CAST(pgn AS VARCHAR) || '.' || CAST(source AS VARCHAR) || '.'
  || coalesce(CAST(destination AS VARCHAR), 'NONE') AS subject FROM messages"""))
def read_bus_messages(spark, sf):
    text = op.frame_to_bus_message(views.messages(views.events(spark, sf)))
    return sources.read_bus_messages(text.drop("device")).select(
        "id", "subject", us("time"), big("pgn"), big("source"), big("destination"),
        big("priority"), fn.hex_text("data").alias("data"))


@query("read_signals", sql(SIGNALS, """SELECT 'j1939.data.' || name AS subject,
  CAST(pgn AS BIGINT) AS pgn, name, us AS time_us, value, units,
  CAST(min_value AS DOUBLE) AS min_value, CAST(max_value AS DOUBLE) AS max_value FROM signals"""))
def read_signals(spark, sf):
    text = op.signals_to_messages(views.signals(views.events(spark, sf)))
    return sources.read_signals(text).select(
        "subject", big("pgn"), "name", us("time"), "value", "units", "min_value", "max_value")


def _gpsd(spark, sf, cls):
    return sources.read_gpsd(views.gpsd_lines(views.events(spark, sf)), cls)


@query("read_gpsd", sql(EV, """SELECT id, us AS systime_us, CAST(user_id % 50 AS VARCHAR) AS device,
  CAST(CASE WHEN event_type <> 'error' THEN 3 END AS BIGINT) AS mode,
  epoch_us(date_trunc('second', time)) AS time_us, value AS "altHAE",
  CAST(40.0 AS DOUBLE) + CAST(id % 2000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
  CAST(-87.0 AS DOUBLE) + CAST(user_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon,
  CAST(NULL AS DOUBLE) AS track
  FROM ev WHERE event_type IN ('click', 'view', 'error') AND value >= 2"""))
def read_gpsd(spark, sf):
    return _gpsd(spark, sf, "TPV").select(
        "id", us("systime"), "device", big("mode"), us("time"), "altHAE", "lat", "lon", "track")


@query("read_gpsd_sky", sql(EV, """SELECT id, CAST(user_id % 50 AS VARCHAR) AS device,
  value AS gdop, CAST(id % 12 AS DOUBLE) AS "nSat", CAST(1 AS BIGINT) AS n_satellites,
  CAST(id % 360 AS DOUBLE) AS az FROM ev WHERE event_type = 'signup' AND value >= 2"""))
def read_gpsd_sky(spark, sf):
    return _gpsd(spark, sf, "SKY").select(
        "id", "device", "gdop", "nSat", F.size("satellites").cast("bigint").alias("n_satellites"),
        F.get("satellites", F.lit(0))["az"].alias("az"))


@query("read_gpsd_pps", sql(EV, """SELECT id, CAST(user_id % 50 AS VARCHAR) AS device,
  us // 1000000 AS real_sec, CAST(0 AS BIGINT) AS real_nsec, us // 1000000 AS clock_sec,
  (us % 1000000) * 1000 AS clock_nsec, CAST(-10 AS BIGINT) AS precision, id % 100 AS "qErr"
  FROM ev WHERE event_type = 'purchase' AND value >= 2"""))
def read_gpsd_pps(spark, sf):
    return _gpsd(spark, sf, "PPS").select(
        "id", "device", "real_sec", "real_nsec", "clock_sec", "clock_nsec",
        big("precision"), big("qErr"))


@query("json_reject_split", sql(EV, """SELECT id, value >= 2 AS parsed FROM ev"""))
def json_reject_split(spark, sf):
    good, bad = sources.json_reject_split(views.gpsd_lines(views.events(spark, sf)))
    return good.select("id", F.lit(True).alias("parsed")).union(
        bad.select("id", F.lit(False).alias("parsed")))


CELL_SQL = """SELECT us // 1000000 * 1000000 AS time_us, CAST(trunc(coalesce(lte, umts)) AS BIGINT) AS signal,
  CASE WHEN lte IS NOT NULL THEN 'Lte' ELSE 'Umts' END AS cell_tech FROM (SELECT *,
  CASE WHEN event_type <> 'error' THEN -value END AS lte, CASE WHEN value >= 20 THEN -value - 1 END AS umts
  FROM ev) WHERE coalesce(lte, umts) IS NOT NULL"""


@query("read_cell_log", sql(EV, CELL_SQL))
def read_cell_log(spark, sf):
    path = shared_folder(spark, "cell-csv")
    sinks.write_cell_log(op.cell_pick_tech(views.modem(views.events(spark, sf))), path)
    return sources.read_cell_log(spark, path).select(us("time"), big("signal"), "cell_tech")


@query("read_signal_dictionary", """WITH parts AS (SELECT 61440 + p_partkey % 4096 AS pgn,
  CAST(p_partkey AS VARCHAR) AS k, p_name, p_size FROM part),
plain AS (
SELECT CAST(pgn AS BIGINT) AS pgn, 'Size' || k AS name, p_name AS description, 'deg' AS units,
  CAST((p_size % 8) * 8 AS BIGINT) AS start_bit, CAST(8 AS BIGINT) AS bit_len,
  CAST(0.5 AS DOUBLE) AS scale, CAST(-40 AS DOUBLE) AS "offset", CAST(-40 AS DOUBLE) AS min_value,
  CAST(85 AS DOUBLE) AS max_value, false AS signed, false AS big_endian FROM parts
UNION ALL SELECT CAST(pgn AS BIGINT), 'Price' || k, NULL, '', 16, 32, 0.1, 0, 0, 429496729.5, false, false FROM parts
UNION ALL SELECT CAST(pgn AS BIGINT), 'Motor' || k, NULL, '', 48, 8, 1, 0, -128, 127, true, true FROM parts
UNION ALL SELECT CAST(pgn AS BIGINT), 'Trim' || k, NULL, '', 56, 8, 1, 0, -128, 127, true, false FROM parts
UNION ALL SELECT CAST(pgn AS BIGINT), 'Page' || k, NULL, '', 0, 4, 1, 0, 0, 15, false, false FROM parts)
SELECT *, CAST(NULL AS VARCHAR) AS selector, CAST(NULL AS BIGINT) AS selector_start,
  CAST(NULL AS BIGINT) AS selector_len, CAST(NULL AS BOOLEAN) AS selector_big_endian,
  CAST(NULL AS BIGINT) AS selector_value FROM plain
UNION ALL SELECT CAST(pgn AS BIGINT), 'Deep' || k, NULL, '', 15, 12, 1, 0, 0, 4095, false, true,
  'Page' || k, 0, 4, false, CAST(p_size % 16 AS BIGINT) FROM parts""")
def read_signal_dictionary(spark, sf):
    path = shared_folder(spark, "dbc")
    views.dbc_blocks(spark, sf).write.option("maxRecordsPerFile", 500).text(path)
    return sources.read_signal_dictionary(spark, path).select(
        big("pgn"), "name", "description", "units", big("start_bit"), big("bit_len"), "scale",
        "offset", "min_value", "max_value", "signed", "big_endian", "selector", big("selector_start"),
        big("selector_len"), "selector_big_endian", "selector_value")


@query("signal_dictionary_rejects", """SELECT 'SG_ Broken' || CAST(p_partkey AS VARCHAR)
  || ' : 0|65@1+ (1,0) [0|1] "" Vector__XXX' AS line FROM part""")
def signal_dictionary_rejects(spark, sf):
    path = shared_folder(spark, "dbc")
    views.dbc_blocks(spark, sf).write.option("maxRecordsPerFile", 500).text(path)
    return sources.signal_dictionary_rejects(spark, path).select("line")


@query("read_counters", sql(EV, """SELECT id, CAST(round(value * 100) AS BIGINT) AS rx_bytes FROM ev
  WHERE event_type <> 'error'"""))
def read_counters(spark, sf):
    ev = views.events(spark, sf)
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(
        F.round(F.col("value") * 100).cast("bigint").cast("string"))
    return sources.read_counters(ev.select("id", text.alias("rx_bytes")))


@query("read_probes", sql(PROBES, "SELECT id, device, us AS time_us, ok FROM probes"))
def read_probes(spark, sf):
    path = shared_folder(spark, "probes")
    views.probes(views.events(spark, sf)).write.parquet(path)
    return sources.read_probes(spark, path).select("id", "device", us("time"), "ok")


@query("read_spectrum", sql(DFT, """SELECT vec_id AS block_id, CAST(k AS BIGINT) AS bin,
  CAST(floor(sqrt(re * re + im * im) * 1000) AS BIGINT) AS level, CAST(64 AS BIGINT) AS fft_size FROM dft"""))
def read_spectrum(spark, sf):
    rows = sources.read_spectrum(views.spectrum_messages(spark, sf))
    return rows.select("block_id", big("fft_size"), F.posexplode("fft").alias("bin", "level")).select(
        "block_id", big("bin"), big("level"), "fft_size")


@query("read_table_window", sql(POINTS, """SELECT device, epoch_us(time) AS time_us, lat, lon
  FROM points WHERE time BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20 18:30:00'"""))
def read_table_window(spark, sf):
    path = shared_folder(spark, "points")
    sinks.write_hypertable(views.points(views.events(spark, sf)), path)
    return sources.read_table_window(
        spark, path, "2024-01-05 06:00:00", "2024-01-20 18:30:00",
        ["device", "time", "lat", "lon"]).select("device", us("time"), "lat", "lon")


# --- sinks -----------------------------------------------------------------

@query("write_can_csv_rotated", sql(FRAMES, """SELECT can_interface AS bus,
  can_interface || strftime(date_trunc('day', time), '-%Y-%m-%d-%H-%M') AS rotation,
  COUNT(*) AS n, MIN(us) AS first_us, MAX(us) AS last_us FROM frames GROUP BY ALL"""))
def write_can_csv_rotated(spark, sf):
    path = shared_folder(spark, "rotated")
    sinks.write_can_csv_rotated(views.can_log(views.events(spark, sf)), path, 1, "d")
    rows = sources.read_can_csv(spark, path)
    return (
        rows.groupBy(F.regexp_extract(F.input_file_name(), r"bus=([^/]+)/", 1).alias("bus"),
                     F.regexp_extract(F.input_file_name(), r"rotation=([^/]+)/", 1).alias("rotation"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("time")).alias("first_us"),
             F.max(F.unix_micros("time")).alias("last_us")))


@query("write_hypertable", sql(POINTS, """SELECT strftime(time, '%Y-%m-%d') AS day, device,
  epoch_us(time) AS time_us, MIN(id) AS id FROM points GROUP BY ALL"""))
def write_hypertable(spark, sf):
    path = shared_folder(spark, "hypertable")
    points = views.points(views.events(spark, sf))
    # The second write finds every key present.
    sinks.write_hypertable(points, path, unique=["device", "time"], order="id")
    sinks.write_hypertable(points, path, unique=["device", "time"], order="id")
    return spark.read.parquet(path).select(
        F.col("day").cast("string").alias("day"), "device", us("time"), "id")


@query("batch_rows", sql(FRAMES, """SELECT id, can_interface, (row_number() OVER
  (PARTITION BY can_interface ORDER BY time, id) - 1) // 1000 AS batch_id FROM frames"""))
def batch_rows(spark, sf):
    frames = views.frames(views.events(spark, sf))
    return op.batch_rows(frames, ("can_interface",)).select("id", "can_interface", "batch_id")


SEGMENT_BOUNDS = """bounds AS (SELECT date_trunc('hour', MIN(time)) AS a, MAX(time) AS b FROM points)"""
SEGMENTS = POINTS + ", " + SEGMENT_BOUNDS + """, placed AS (SELECT p.*, k.k,
  a + k.k * INTERVAL 1 HOUR AS segment FROM points p, bounds,
  LATERAL (SELECT unnest([epoch_us(time) // 3600000000 - epoch_us(a) // 3600000000]
    || CASE WHEN epoch_us(time) % 3600000000 = 0
       THEN [epoch_us(time) // 3600000000 - epoch_us(a) // 3600000000 - 1] ELSE [] END) AS k) k
  WHERE k.k >= 0 AND a + k.k * INTERVAL 1 HOUR < b)"""


DAY_SEGMENTS = (SEGMENTS.replace("3600000000", "86400000000").replace("'hour'", "'day'")
                .replace("INTERVAL 1 HOUR", "INTERVAL 1 DAY"))


@query("write_gpx", sql(DAY_SEGMENTS, """SELECT CAST(device AS VARCHAR) AS device,
  strftime(segment, '%Y-%m-%dT%H-%M-%SZ') AS segment, COUNT(*) AS points, CAST(1 AS BIGINT) AS headers,
  CAST(1 AS BIGINT) AS footers FROM placed GROUP BY ALL"""))
def write_gpx(spark, sf):
    path = shared_folder(spark, "gpx")
    flows.export_tracks(views.points(views.events(spark, sf)), path, 86400)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumn(
        "_f", F.input_file_name())
    return (
        lines.groupBy(F.regexp_extract("_f", r"device=([^/]+)/", 1).alias("device"),
                      F.regexp_extract("_f", r"segment=([^/]+)/", 1).alias("segment"))
        .agg(F.count_if(F.col("value").contains("<trkpt ")).alias("points"),
             F.count_if(F.col("value").startswith("<gpx ")).alias("headers"),
             F.count_if(F.col("value") == "</gpx>").alias("footers")))


TRAILS = POINTS + f""", ranked AS (SELECT *, {GEOHASH} AS geohash,
  strftime(time, '%Y-%m-%d') AS day, {POINT_ID} AS pid FROM points),
parts AS (SELECT *, (row_number() OVER (PARTITION BY device, day, geohash
  ORDER BY time DESC, id DESC) - 1) // 2 AS batch FROM ranked)"""


@query("write_trail_documents", sql(TRAILS, """SELECT CAST(device AS VARCHAR) || '/' || day || '/' || geohash
  AS path, day, CAST(COUNT(DISTINCT pid) AS BIGINT) AS n, MIN(pid) AS first_id FROM ranked GROUP BY ALL"""))
def write_trail_documents(spark, sf):
    path = shared_folder(spark, "trails")
    docs = op.trail_documents(views.points(views.events(spark, sf)))
    sinks.write_trail_documents(docs, path)
    schema = "path STRING, data MAP<STRING, STRUCT<id: STRING, time: DOUBLE, lat: DOUBLE, lon: DOUBLE>>"
    lines = spark.read.schema(schema + ", day STRING").json(path)
    return (
        lines.groupBy("path", "day")
        .agg(F.sum(F.size("data")).alias("n"),
             F.min(F.array_min(F.map_keys("data"))).alias("first_id")))


@query("route_by_subject", sql(SIGNALS, """SELECT 'j1939.data.' || name AS subject, COUNT(*) AS n
  FROM signals GROUP BY ALL"""))
def route_by_subject(spark, sf):
    path = shared_folder(spark, "subjects")
    sinks.write_by_subject(op.signals_to_messages(views.signals(views.events(spark, sf))), path)
    return spark.read.text(path).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


GAUGE_SQL = sql(SIGNALS, """SELECT device, 'j1939_' || name AS metric, arg_max(value, us) AS value,
  'about ' || name AS description, MAX(us) AS time_us FROM signals GROUP BY device, name""")


@query("gauge_snapshot", GAUGE_SQL)
def gauge_snapshot(spark, sf):
    return op.gauge_snapshot(views.signals(views.events(spark, sf))).select(
        "device", "metric", "value", "description", us("time"))


# --- projections and filters -------------------------------------------------

@query("j1939_decode_id", sql(FRAMES, """SELECT id, can_id, priority,
  CAST(0 AS BIGINT) AS data_page, pgn, source, destination FROM messages"""))
def j1939_decode_id(spark, sf):
    rows = op.j1939_decode_id(views.frames(views.events(spark, sf)))
    return rows.select("id", "can_id", big("priority"), big("data_page"), big("pgn"),
                       big("source"), big("destination"))


@query("j1939_only", sql(FRAMES, "SELECT id, can_id FROM frames WHERE is_extended AND NOT is_rtr"))
def j1939_only(spark, sf):
    return op.j1939_only(views.frames(views.events(spark, sf))).select("id", "can_id")


@query("frame_to_message", sql(FRAMES, """SELECT id, 'j1939.raw.' || CAST(pgn AS VARCHAR) AS subject,
  us AS time_us, printf('%x', pgn) AS pgn, printf('%x', source) AS saddr,
  printf('%016x', -device - 1) AS sname,
  printf('%x', destination) AS daddr, printf('%x', priority) AS priority, data FROM messages"""))
def frame_to_message(spark, sf):
    rows = op.frame_to_message(views.messages(views.events(spark, sf)))
    key = lambda k: F.get_json_object("body", "$." + k)
    return rows.select(
        "id", "subject", F.unix_micros(fn.from_epoch_seconds(key("timestamp").cast("double"))).alias("time_us"),
        *[key(k).alias(k) for k in ("pgn", "saddr", "sname", "daddr", "priority", "data")])


@query("make_subject", sql(FRAMES, """SELECT id, 'j1939.' || CAST(pgn AS VARCHAR) || '.'
  || CAST(source AS VARCHAR) || '.' || coalesce(CAST(destination AS VARCHAR), 'NONE') AS bus,
  'fleet.raw.' || CAST(pgn AS VARCHAR) AS raw FROM messages"""))
def make_subject(spark, sf):
    return views.messages(views.events(spark, sf)).select(
        "id", fn.make_subject("bus", "pgn", "source", "destination").alias("bus"),
        fn.make_subject("raw", "pgn", prefix="fleet").alias("raw"))


@query("subject_match", sql(SIGNALS, """SELECT id, true AS any_data, name = 'click' AS exact,
  false AS too_long, true AS one_token FROM signals"""))
def subject_match(spark, sf):
    subject = fn.make_subject("data", "name")
    return views.signals(views.events(spark, sf)).select("id", subject.alias("s")).select(
        "id", fn.subject_match("s", "j1939.data.>").alias("any_data"),
        fn.subject_match("s", "j1939.data.click").alias("exact"),
        fn.subject_match("s", "j1939.data.click.>").alias("too_long"),
        fn.subject_match("s", "j1939.*.*").alias("one_token"))


@query("gps_class_filter", sql(EV, """SELECT id, CASE event_type WHEN 'signup' THEN 'SKY'
  ELSE 'PPS' END AS class FROM ev WHERE event_type IN ('signup', 'purchase') AND value >= 2"""))
def gps_class_filter(spark, sf):
    good, _ = sources.json_reject_split(views.gpsd_lines(views.events(spark, sf)))
    return op.gps_class_filter(
        good.select("id", F.get_json_object("body", "$.class").alias("class")), "SKY,PPS")


@query("valid_signal_filter", sql(SIGNALS, "SELECT id, name, value FROM signals WHERE value < max_value"))
def valid_signal_filter(spark, sf):
    return op.valid_signal_filter(views.signals(views.events(spark, sf))).select("id", "name", "value")


@query("can_link_filter", sql(COUNTERS, """SELECT device, interface, epoch_us(time) AS time_us, rx_bytes
  FROM counters WHERE link_type = '280'"""))
def can_link_filter(spark, sf):
    return op.can_link_filter(views.counters(views.events(spark, sf))).select(
        "device", "interface", us("time"), "rx_bytes")


@query("time_range_filter", sql(EV, """SELECT id, us AS time_us FROM ev
  WHERE time BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'"""))
def time_range_filter(spark, sf):
    return op.time_range_filter(
        views.events(spark, sf), "time", F.lit("2024-01-10 00:00:00").cast("timestamp"),
        F.lit("2024-01-12 12:00:00").cast("timestamp")).select("id", us("time"))


@query("phone_filter", sql(REQUESTS, "SELECT id, phone FROM requests WHERE phone LIKE '+%'"))
def phone_filter(spark, sf):
    return op.phone_filter(views.subscription_requests(views.events(spark, sf))).select("id", "phone")


@query("add_ingest_time", sql(EV, "SELECT id, us + 1500000 AS systime_us FROM ev"))
def add_ingest_time(spark, sf):
    later = F.timestamp_micros(F.unix_micros("time") + 1500000)
    return op.add_ingest_time(views.events(spark, sf), later).select("id", us("systime"))


@query("cell_pick_tech", sql(EV, CELL_SQL.replace(
    "us // 1000000 * 1000000 AS time_us", "user_id AS device, us AS time_us")))
def cell_pick_tech(spark, sf):
    return op.cell_pick_tech(views.modem(views.events(spark, sf))).select(
        "device", us("time"), big("signal"), "cell_tech")


# --- joins -------------------------------------------------------------------

@query("signal_decode", sql(DECODED, """SELECT id, name, CAST(value AS DOUBLE) AS value, units,
  us AS time_us FROM decoded"""))
def signal_decode(spark, sf):
    rows = op.signal_decode(views.messages(views.events(spark, sf)), views.dictionary(spark))
    return rows.select("id", "name", "value", "units", us("time"))


# Bytes 5 to 7 hold v100 with the high byte first; byte 4 chooses by its low two bits.
@query("signal_decode_layouts", sql(FRAMES, """SELECT id, name, CAST(value AS DOUBLE) AS value FROM (
  SELECT id, 'Kind' AS name, b4 % 4 AS value FROM messages WHERE pgn = 61444
  UNION ALL SELECT id, 'Whole', v100 * 0.25 FROM messages WHERE pgn = 61444 AND b4 % 4 = 0
  UNION ALL SELECT id, 'Short', (v100 + 32768) % 65536 - 32768 FROM messages WHERE pgn = 61444 AND b4 % 4 = 1
  UNION ALL SELECT id, 'Nibble', v100 % 16 * 2 - 1 FROM messages WHERE pgn = 61444 AND b4 % 4 = 2
  UNION ALL SELECT id, 'Byte', v100 % 256 FROM messages WHERE pgn = 61444 AND b4 % 4 = 2
  UNION ALL SELECT id, 'Level', v100 FROM messages WHERE pgn = 65265
  UNION ALL SELECT id, 'Mixed', (b4 % 32 * 256 + v100 // 65536 + 4096) % 8192 - 4096 FROM messages WHERE pgn = 65265
  )"""))
def signal_decode_layouts(spark, sf):
    dictionary = views.layout_dictionary(spark, shared_folder(spark, "layouts"))
    rows = op.signal_decode(views.messages(views.events(spark, sf)), dictionary)
    return rows.select("id", "name", "value")


@query("unsent_points", sql(POINTS, """SELECT id, device, epoch_us(time) AS time_us, lat, lon
  FROM points p WHERE NOT EXISTS (SELECT 1 FROM sent_log s WHERE s.device = p.device
  AND s.time = p.time) ORDER BY p.time DESC, id DESC LIMIT 1000"""))
def unsent_points(spark, sf):
    ev = views.events(spark, sf)
    return op.unsent_points(views.points(ev), views.sent_log(ev), 1000).select(
        "id", "device", us("time"), "lat", "lon")


@query("ledger_backfill", sql(POINTS, """SELECT DISTINCT device, epoch_us(time) AS time_us FROM points
  EXCEPT SELECT device, epoch_us(time) FROM sent_log"""))
def ledger_backfill(spark, sf):
    ev = views.events(spark, sf)
    return op.ledger_backfill(views.points(ev), views.sent_log(ev)).select("device", us("time"))


@query("ledger_prune", sql(POINTS, """SELECT device, epoch_us(time) AS time_us FROM sent_log
  INTERSECT SELECT device, epoch_us(time) FROM points WHERE value >= 10"""))
def ledger_prune(spark, sf):
    ev = views.events(spark, sf)
    kept = views.points(ev.where("value >= 10"))
    return op.ledger_prune(views.sent_log(ev), kept).select("device", us("time"))


@query("interface_resolve", sql(FRAMES, """SELECT r.interface, r.interface IN
  (SELECT can_interface FROM frames) AS available FROM (VALUES ('can0'), ('can1'), ('can9')) r(interface)"""))
def interface_resolve(spark, sf):
    valid, missing = op.interface_resolve(*views.interfaces(spark, views.events(spark, sf)))
    return valid.select("interface", F.lit(True).alias("available")).union(
        missing.select("interface", F.lit(False).alias("available")))


@query("device_label", sql(PROBES, """SELECT id, device, n_name AS label FROM probes
  LEFT JOIN nation ON n_nationkey = device % 25"""))
def device_label(spark, sf):
    ev = views.events(spark, sf)
    return op.device_label(views.probes(ev), views.labels(spark, sf, ev)).select(
        "id", "device", "label")


@query("segment_assign", sql(SEGMENTS, """SELECT id, device, epoch_us(time) AS time_us,
  epoch_us(segment) AS segment_us FROM placed"""))
def segment_assign(spark, sf):
    points = views.points(views.events(spark, sf))
    first, last = op.export_bounds(points, 3600)
    return op.segment_assign(points, F.lit(first), F.lit(last), 3600).select(
        "id", "device", us("time"), us("segment"))


@query("segment_assign_half_open", sql(SEGMENTS, """SELECT id, epoch_us(segment) AS segment_us
  FROM placed WHERE time < segment + INTERVAL 1 HOUR"""))
def segment_assign_half_open(spark, sf):
    points = views.points(views.events(spark, sf))
    first, last = op.export_bounds(points, 3600)
    return op.segment_assign(points, F.lit(first), F.lit(last), 3600, inclusive=False).select(
        "id", us("segment"))


@query("replay_match", sql(REPLAY, """SELECT CASE WHEN s > 0 THEN 'missing' ELSE 'unexpected' END AS side,
  subject, body, abs(s) AS n FROM balance WHERE s <> 0"""))
def replay_match(spark, sf):
    ev = views.events(spark, sf)
    return op.replay_match(views.replay_expected(ev), views.replay_received(ev))


@query("replay_missing", sql(REPLAY, "SELECT subject, body, s AS n FROM balance WHERE s > 0"))
def replay_missing(spark, sf):
    ev = views.events(spark, sf)
    return op.replay_missing(views.replay_expected(ev), views.replay_received(ev))


@query("replay_unexpected", sql(REPLAY, "SELECT subject, body, -s AS n FROM balance WHERE s < 0"))
def replay_unexpected(spark, sf):
    ev = views.events(spark, sf)
    return op.replay_unexpected(views.replay_expected(ev), views.replay_received(ev))


# --- aggregations ------------------------------------------------------------

STATS = """COUNT(*) AS number, round(SUM(value), 4) AS sum_val,
  round(SUM(value * value), 4) AS sum_of_squares, round(AVG(value), 4) AS average,
  MIN(us) AS from_us, MAX(us) AS to_us"""


def stats_columns(df, *first):
    return df.select(
        *first, "number", rounded("sum_val"), rounded("sum_of_squares"), rounded("average"),
        us("from_time", "from_us"), us("to_time", "to_us"))


STATS_SQL = sql(SIGNALS, f"""SELECT epoch_us(date_trunc('hour', time)) AS window_us, device, name,
  {STATS}, MAX(units) AS units, CAST(MAX(pgn) AS BIGINT) AS pgn, CAST(MAX(min_value) AS DOUBLE) AS min_value,
  CAST(MAX(max_value) AS DOUBLE) AS max_value
  FROM signals WHERE value < max_value GROUP BY 1, 2, 3""")


@query("signal_stats", STATS_SQL)
def signal_stats(spark, sf):
    valid = op.valid_signal_filter(views.signals(views.events(spark, sf)))
    return stats_columns(
        op.signal_stats(valid, "1 hour"), us("window_start", "window_us"), "device", "name",
        "units", big("pgn"), "min_value", "max_value")


@query("signal_stats_second", sql(SIGNALS, f"""SELECT epoch_us(date_trunc('second', time)) AS window_us,
  device, name, {STATS} FROM signals WHERE value < max_value GROUP BY 1, 2, 3"""))
def signal_stats_second(spark, sf):
    valid = op.valid_signal_filter(views.signals(views.events(spark, sf)))
    return stats_columns(op.signal_stats(valid), us("window_start", "window_us"), "device", "name")


@query("frames_to_stats", sql(DECODED, f"""SELECT epoch_us(date_trunc('hour', time)) AS window_us,
  device, name, COUNT(*) AS number, printf('%.12e', AVG(value)) AS average,
  printf('%.12e', SUM(value)) AS total FROM decoded WHERE value < max_value AND is_extended AND NOT is_rtr GROUP BY 1, 2, 3"""))
def frames_to_stats(spark, sf):
    stats = flows.frames_to_stats(views.frames(views.events(spark, sf)), views.dictionary(spark), "1 hour")
    # Relative rounding: values go up to 64 bits.
    return stats.select(us("window_start", "window_us"), "device", "name", "number",
                        F.format_string("%.12e", "average").alias("average"),
                        F.format_string("%.12e", "sum_val").alias("total"))


# The log keeps no flags: the size of the id tells the frames of the protocol.
@query("logs_to_stats", sql(DECODED, """SELECT epoch_us(date_trunc('hour', d.time)) AS window_us,
  f.can_interface, name, COUNT(*) AS number, printf('%.12e', AVG(d.value)) AS average,
  printf('%.12e', SUM(d.value)) AS total FROM decoded d JOIN frames f USING (id)
  WHERE d.value < max_value AND f.can_id > 2047 GROUP BY 1, 2, 3"""))
def logs_to_stats(spark, sf):
    stats = flows.logs_to_stats(views.can_log(views.events(spark, sf)), views.dictionary(spark), "1 hour")
    return stats.select(us("window_start", "window_us"), "can_interface", "name", "number",
                        F.format_string("%.12e", "average").alias("average"),
                        F.format_string("%.12e", "sum_val").alias("total"))


@query("stats_to_messages", sql(SIGNALS, """SELECT device, 'j1939.filter.' || name AS subject,
  COUNT(*) AS number, round(SUM(value), 4) AS total, MAX(units) AS units,
  CAST(MAX(pgn) AS BIGINT) AS pgn, CAST(MAX(max_value) AS DOUBLE) AS max_value,
  MIN(us) AS from_us, MAX(us) AS to_us, MAX(us) AS sent_us
  FROM signals WHERE value < max_value GROUP BY device, name, date_trunc('hour', time)"""))
def stats_to_messages(spark, sf):
    valid = op.valid_signal_filter(views.signals(views.events(spark, sf)))
    told = op.stats_to_messages(op.signal_stats(valid, "1 hour")).withColumn("_m", F.from_json(
        "body", "sumVal DOUBLE, number BIGINT, max_value DOUBLE, pgn BIGINT, units STRING, "
        "`from` DOUBLE, `to` DOUBLE, lastSent DOUBLE"))
    at = lambda name: F.unix_micros(fn.from_epoch_seconds(F.col(f"_m.{name}")))
    return told.select(
        "device", "subject", "_m.number", F.round("_m.sumVal", 4).alias("total"), "_m.units", "_m.pgn",
        "_m.max_value", at("from").alias("from_us"), at("to").alias("to_us"), at("lastSent").alias("sent_us"))


# Six hours: the data has a few events per machine and day.
GREEDY_GAP_S = 21600.0
GREEDY = "RECURSIVE " + SIGNALS + f""", walk_in AS (SELECT *, row_number() OVER
  (PARTITION BY device, name ORDER BY time, id) AS rn FROM signals WHERE value < max_value),
walk AS (SELECT device, name, rn, us, value, us AS last, 0 AS part, false AS closes
  FROM walk_in WHERE rn = 1
  UNION ALL SELECT n.device, n.name, n.rn, n.us, n.value,
    CASE WHEN n.us - w.last >= {int(GREEDY_GAP_S * 1e6)} THEN n.us ELSE w.last END,
    CASE WHEN w.closes THEN w.part + 1 ELSE w.part END,
    n.us - w.last >= {int(GREEDY_GAP_S * 1e6)}
  FROM walk w JOIN walk_in n ON n.device = w.device AND n.name = w.name AND n.rn = w.rn + 1)"""
GREEDY_SQL = sql(GREEDY, f"""SELECT device, name, {STATS}, MAX(us) AS last_sent_us FROM walk
  GROUP BY device, name, part HAVING bool_or(closes)""")


@query("signal_stats_greedy", GREEDY_SQL)
def signal_stats_greedy(spark, sf):
    valid = op.valid_signal_filter(views.signals(views.events(spark, sf)))
    return stats_columns(
        op.signal_stats_greedy(valid, GREEDY_GAP_S), "device", "name", us("last_sent"))


@query("signal_keys", sql(SIGNALS, "SELECT DISTINCT 'j1939.filter.' || name AS subject FROM signals"))
def signal_keys(spark, sf):
    return op.signal_keys(views.signals(views.events(spark, sf)).select(
        fn.make_subject("filter", "name").alias("subject")))


@query("bus_activity", sql(COUNTERS, "SELECT device, epoch_us(time) AS time_us, rx_bytes FROM activity"))
def bus_activity(spark, sf):
    return op.bus_activity(views.counters(views.events(spark, sf))).select(
        "device", us("time"), "rx_bytes")


@query("interface_traffic", sql(COUNTERS, """SELECT device, interface,
  epoch_us(date_trunc('day', time)) AS bucket_us, CAST(SUM(grown) AS BIGINT) AS delta,
  SUM(grown) <= 0 AS silent FROM (SELECT *, rx_bytes - lag(rx_bytes) OVER
    (PARTITION BY device, interface ORDER BY time) AS grown FROM counters) GROUP BY 1, 2, 3"""))
def interface_traffic(spark, sf):
    return op.interface_traffic(views.counters(views.events(spark, sf)), "1 day").select(
        "device", "interface", us("bucket"), "delta", "silent")


@query("latest_row", sql(FRAMES, """SELECT can_interface, id, us AS time_us, data FROM frames
  QUALIFY row_number() OVER (PARTITION BY can_interface ORDER BY time DESC, id DESC) = 1"""))
def latest_row(spark, sf):
    return op.latest_row(views.frames(views.events(spark, sf)), ["can_interface"]).select(
        "can_interface", "id", us("time"), "data")


NOW = "2024-01-30 12:00:00"


@query("staleness", sql(PROBES, f"""SELECT c_custkey AS device,
  round((epoch_us(TIMESTAMP '{NOW}') - MAX(us)) / 1000000.0, 6) AS age_s,
  coalesce((epoch_us(TIMESTAMP '{NOW}') - MAX(us)) / 1000000.0 <= 86400, false) AS healthy
  FROM customer LEFT JOIN probes ON device = c_custkey GROUP BY c_custkey"""))
def staleness(spark, sf):
    latest = op.newest_time(views.probes(views.events(spark, sf)), ["device"])
    fleet = views.table(spark, sf, "customer").select(F.col("c_custkey").alias("device"))
    return op.staleness(latest, fleet, F.lit(NOW).cast("timestamp"), 86400.0).select(
        "device", rounded("age_s", 6), "healthy")


@query("export_range", sql(POINTS, """SELECT epoch_us(MIN(time)) AS first_us, epoch_us(MAX(time)) AS last_us
  FROM points"""))
def export_range(spark, sf):
    return op.export_range(views.points(views.events(spark, sf))).select(us("first"), us("last"))


@query("high_water_mark", sql(SEGMENTS, """SELECT greatest(
  (SELECT epoch_us(a) FROM bounds), MAX(epoch_us(segment))) AS start_us FROM placed"""))
def high_water_mark(spark, sf):
    points = views.points(views.events(spark, sf))
    first, last = op.export_bounds(points, 3600)
    segments = op.segment_assign(points, F.lit(first), F.lit(last), 3600)
    return op.high_water_mark(segments, F.lit(first)).select(us("start"))


@query("high_water_mark_per_device", sql(SEGMENTS, """SELECT device, epoch_us(max(segment)) AS start_us
  FROM placed GROUP BY device"""))
def high_water_mark_per_device(spark, sf):
    points = views.points(views.events(spark, sf))
    first, last = op.export_bounds(points, 3600)
    segments = op.segment_assign(points, F.lit(first), F.lit(last), 3600)
    return op.high_water_marks(segments).select("device", us("start"))


@query("read_raw_frames_rejects", sql(EV, "SELECT id, id % 4 <> 3 AS refused FROM ev"))
def read_raw_frames_rejects(spark, sf):
    """Three of four messages are broken: cut off, an address or a group out of range."""
    text = op.frame_to_message(views.messages(views.events(spark, sf))).select("id", "body")
    kind = F.col("id") % 4
    broken = text.withColumn("body", F.when(kind == 0, F.substring("body", 1, 20))
                             .when(kind == 1, F.regexp_replace("body", '"saddr":"', '"saddr":"1ffff'))
                             .when(kind == 2, F.regexp_replace("body", '"pgn":"', '"pgn":"1234567890abcdef'))
                             .otherwise(F.col("body")))
    rows, rejects = sources.split_rejects(broken, sources.read_raw_frames, ("pgn", "source"))
    return rows.select("id", F.lit(False).alias("refused")).union(
        rejects.select("id", F.lit(True).alias("refused")))


def document_columns(docs):
    return docs.select("device", "day", "geohash", "batch", "n",
                       F.array_join(F.array_sort(F.map_keys("data")), ",").alias("ids"))


@query("trail_documents", sql(TRAILS, """SELECT device, day, geohash, CAST(0 AS BIGINT) AS batch,
  COUNT(DISTINCT pid) AS n, array_to_string(list(DISTINCT pid ORDER BY pid), ',') AS ids FROM ranked GROUP BY ALL"""))
def trail_documents(spark, sf):
    return document_columns(op.trail_documents(views.points(views.events(spark, sf))))


@query("trail_documents_parts", sql(TRAILS, """SELECT device, day, geohash, batch, COUNT(DISTINCT pid) AS n,
  array_to_string(list(DISTINCT pid ORDER BY pid), ',') AS ids FROM parts GROUP BY ALL"""))
def trail_documents_parts(spark, sf):
    return document_columns(op.trail_documents(views.points(views.events(spark, sf)), batch_size=2))


@query("progress_count", sql(FRAMES, """SELECT COUNT(*) AS n, COUNT(*) // 1000 AS reports FROM frames
  WHERE is_extended AND NOT is_rtr"""))
def progress_count(spark, sf):
    return op.progress_count(op.j1939_only(views.frames(views.events(spark, sf))))


@query("spectrum_average", sql(WINDOWED, """SELECT CAST(label AS BIGINT) AS device, vec_id // 256 AS block,
  CAST(bin AS BIGINT) AS bin, round(AVG(re), 6) AS re, round(AVG(im), 6) AS im FROM fft GROUP BY ALL"""))
def spectrum_average(spark, sf):
    spectra = op.spectrum_fft(views.blocks(spark, sf))
    return op.spectrum_average(spectra).select(
        big("device"), "block", big("bin"), rounded("re", 6), rounded("im", 6))


# --- previous values ----------------------------------------------------------

@query("rising_edge_alerts", sql(READINGS, """SELECT id, device, subject, us AS time_us,
  CAST(reading AS BIGINT) AS reading FROM edges"""))
def rising_edge_alerts(spark, sf):
    return op.rising_edge_alerts(views.readings(views.events(spark, sf))).select(
        "id", "device", "subject", us("time"), big("reading"))


@query("alert_fanout", sql(READINGS, """SELECT e.device, e.id AS alert_id,
  '+1765' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS phone, 'The number is ' || reading AS body
  FROM edges e JOIN customer ON c_custkey % 150 = e.device"""))
def alert_fanout(spark, sf):
    alerts = op.rising_edge_alerts(views.readings(views.events(spark, sf)))
    return op.alert_fanout(alerts, views.subscribers(spark, sf))


@query("online_transitions", sql(TRANSITIONS, f"""SELECT id, device, time_us, event, last_seen_us, gap_s,
  CASE WHEN event = 'online' THEN coalesce({GAP_TEXT}, 'never seen') END AS gap_text FROM transitions"""))
def online_transitions(spark, sf):
    return op.online_transitions(views.probes(views.events(spark, sf))).select(
        "id", "device", us("time"), "event", us("last_seen"), "gap_s", "gap_text")


@query("fleet_state", sql(PROBES, """SELECT device, MAX(CASE WHEN ok THEN us END) AS last_seen_us,
  arg_max(ok, us) AS online, MAX(us) AS checked_us FROM probes GROUP BY device"""))
def fleet_state(spark, sf):
    return op.fleet_state(views.probes(views.events(spark, sf))).select(
        "device", us("last_seen"), "online", us("checked"))


@query("idle_detect", sql(COUNTERS, """SELECT device, epoch_us(time) AS time_us, rx_bytes FROM
  (SELECT *, coalesce(lag(rx_bytes) OVER (PARTITION BY device ORDER BY time), 0) AS before FROM activity)
  WHERE rx_bytes = before"""))
def idle_detect(spark, sf):
    activity = op.bus_activity(views.counters(views.events(spark, sf)))
    return op.idle_detect(activity).select("device", us("time"), "rx_bytes")


@query("keep_one_in_n", "SELECT vec_id AS block_id FROM embeddings WHERE vec_id % 256 = 255")
def keep_one_in_n(spark, sf):
    return op.keep_one_in_n(views.blocks(spark, sf), 256).select("block_id")


@query("rotation_bucket", sql(FRAMES, """SELECT id, epoch_us(time_bucket(INTERVAL 15 MINUTE, time)) AS bucket_us
  FROM frames"""))
def rotation_bucket(spark, sf):
    return views.frames(views.events(spark, sf)).select(
        "id", F.unix_micros(fn.rotation_bucket("time", 15, "m")).alias("bucket_us"))


# --- order ---------------------------------------------------------------------

@query("newest_n", sql(POINTS, """SELECT id, device, epoch_us(time) AS time_us FROM points
  ORDER BY time DESC, id DESC LIMIT 1000"""))
def newest_n(spark, sf):
    return op.newest_n(views.points(views.events(spark, sf))).select("id", "device", us("time"))


@query("newest_one", sql(POINTS, """SELECT id, device, epoch_us(time) AS time_us FROM points
  ORDER BY time DESC, id DESC LIMIT 1"""))
def newest_one(spark, sf):
    return op.newest_one(views.points(views.events(spark, sf))).select("id", "device", us("time"))


@query("segment_order", sql(SEGMENTS, """SELECT id, device, epoch_us(segment) AS segment_us, row_number() OVER
  (PARTITION BY device, segment ORDER BY time, id) AS ordinal FROM placed"""))
def segment_order(spark, sf):
    points = views.points(views.events(spark, sf))
    first, last = op.export_bounds(points, 3600)
    placed = op.segment_assign(points, F.lit(first), F.lit(last), 3600)
    return op.segment_order(placed).select("id", "device", us("segment"), "ordinal")


# --- scalar functions -------------------------------------------------------------

@query("spn_value", sql(FRAMES, """SELECT id, CAST(v100 % 256 AS DOUBLE) * 0.5 AS top_byte,
  CAST((b4 // 16 + 16 * ((v100 // 65536) % 256)) % 256 AS DOUBLE) AS straddling,
  CAST(NULL AS DOUBLE) AS past_end FROM frames"""))
def spn_value(spark, sf):
    return views.frames(views.events(spark, sf)).select(
        "id", fn.spn_value("data", 56, 8, 0.5).alias("top_byte"),
        fn.spn_value("data", 36, 8).alias("straddling"), fn.spn_value("data", 60, 16).alias("past_end"))


@query("hex_text", sql(FRAMES, """SELECT id, printf('%x', can_id) AS number, data AS bytes,
  can_id AS back FROM frames"""))
def hex_text(spark, sf):
    return views.frames(views.events(spark, sf)).select(
        "id", fn.hex_text("can_id").alias("number"), fn.hex_text(F.unhex("data")).alias("bytes"),
        fn.hex_number(fn.hex_text("can_id")).alias("back"))


@query("epoch_seconds", sql(EV, "SELECT id, us / 1000000.0 AS seconds, us AS back_us FROM ev"))
def epoch_seconds(spark, sf):
    return views.events(spark, sf).select(
        "id", fn.epoch_seconds("time").alias("seconds"),
        F.unix_micros(fn.from_epoch_seconds(fn.epoch_seconds("time"))).alias("back_us"))


@query("iso_time", sql(EV, "SELECT id, strftime(time, '%Y-%m-%dT%H:%M:%S.%fZ') AS text FROM ev"))
def iso_time(spark, sf):
    return views.events(spark, sf).select("id", fn.iso_time("time").alias("text"))


@query("parse_time", sql(EV, """SELECT id, CASE WHEN event_type <> 'error'
  THEN epoch_us(date_trunc('second', time)) END AS time_us FROM ev"""))
def parse_time(spark, sf):
    text = F.when(F.col("event_type") == "error", F.date_format("time", "dd/MM/yyyy")).otherwise(
        F.date_format("time", "yyyy-MM-dd HH:mm:ss"))
    return views.events(spark, sf).select("id", F.unix_micros(fn.parse_time(text)).alias("time_us"))


@query("truncate_time", sql(EV, """SELECT id, epoch_us(date_trunc('hour', time)) AS hour_us,
  epoch_us(date_trunc('day', time)) AS day_us FROM ev"""))
def truncate_time(spark, sf):
    return views.events(spark, sf).select(
        "id", F.unix_micros(fn.truncate_time("time", 3600)).alias("hour_us"),
        F.unix_micros(fn.truncate_time("time", 86400)).alias("day_us"))


@query("day_of", sql(EV, "SELECT id, strftime(time, '%Y-%m-%d') AS day FROM ev"))
def day_of(spark, sf):
    return views.events(spark, sf).select("id", fn.day_of("time").alias("day"))


@query("geohash", sql(POINTS, f"SELECT id, {GEOHASH} AS geohash FROM points"))
def geohash(spark, sf):
    return views.points(views.events(spark, sf)).select("id", fn.geohash("lat", "lon").alias("geohash"))


@query("point_id", sql(POINTS, f"SELECT id, {POINT_ID} AS point_id FROM points"))
def point_id(spark, sf):
    return views.points(views.events(spark, sf)).select(
        "id", fn.point_id("device", "time", "lat", "lon").alias("point_id"))


@query("gap_text", sql(EV, f"""SELECT id, {GAP_TEXT} AS gap_text FROM
  (SELECT id, CAST(round(value * 100) AS BIGINT) * 37 AS gap_s FROM ev)"""))
def gap_text(spark, sf):
    return views.events(spark, sf).select(
        "id", fn.gap_text(F.round(F.col("value") * 100).cast("bigint") * 37).alias("gap_text"))


@query("gnss_document", sql(POINTS, """SELECT id, CAST(id AS VARCHAR) AS doc_id,
  epoch_us(time) / 1000000.0 AS doc_time, lat AS doc_lat, lon AS doc_lon FROM points"""))
def gnss_document(spark, sf):
    return views.points(views.events(spark, sf)).select(
        "id", fn.gnss_document(F.col("id").cast("string"), "time", "lat", "lon").alias("d")).select(
        "id", F.col("d.id").alias("doc_id"), F.col("d.time").alias("doc_time"),
        F.col("d.lat").alias("doc_lat"), F.col("d.lon").alias("doc_lon"))


@query("magnitude", sql(WINDOWED, """SELECT vec_id AS block_id, CAST(bin AS BIGINT) AS bin,
  round(sqrt(re * re + im * im), 6) AS magnitude FROM fft"""))
def magnitude(spark, sf):
    return op.spectrum_fft(views.blocks(spark, sf)).select(
        "block_id", big("bin"), F.round(fn.magnitude("re", "im"), 6).alias("magnitude"))


@query("quantise_u16", sql(EV, "SELECT id, CAST(trunc(value * 1000) AS BIGINT) & 65535 AS level FROM ev"))
def quantise_u16(spark, sf):
    return views.events(spark, sf).select(
        "id", fn.quantise_u16("value", 1000.0).cast("bigint").alias("level"))


@query("spectrum_decode", """SELECT vec_id AS block_id, array_to_string(list_transform(embedding,
  lambda v: CAST(abs(CAST(v AS DOUBLE) * 10000) AS BIGINT)), ',') AS levels FROM embeddings""")
def spectrum_decode(spark, sf):
    level = F.transform("samples", lambda v: F.round(F.abs(v.cast("double") * 10000)).cast("int"))
    back = fn.spectrum_decode(fn.spectrum_encode(level))
    return views.blocks(spark, sf).select(
        "block_id", F.array_join(back.cast("array<string>"), ",").alias("levels"))


@query("spectrum_encode", """SELECT vec_id AS block_id, to_base64(unhex(array_to_string(list_transform(embedding,
  lambda v: printf('%02x%02x', CAST(abs(CAST(v AS DOUBLE) * 10000) AS BIGINT) & 255,
  CAST(abs(CAST(v AS DOUBLE) * 10000) AS BIGINT) >> 8)), ''))) AS fft FROM embeddings""")
def spectrum_encode(spark, sf):
    level = F.transform("samples", lambda v: F.round(F.abs(v.cast("double") * 10000)).cast("int"))
    return views.blocks(spark, sf).select("block_id", fn.spectrum_encode(level).alias("fft"))


@query("spectrum_fft", sql(WINDOWED, """SELECT vec_id AS block_id, CAST(bin AS BIGINT) AS bin,
  round(re, 6) AS re, round(im, 6) AS im FROM fft"""))
def spectrum_fft(spark, sf):
    return op.spectrum_fft(views.blocks(spark, sf)).select(
        "block_id", big("bin"), rounded("re", 6), rounded("im", 6))


@query("display_spectrum", sql(WINDOWED, """SELECT CAST(device AS BIGINT) AS device, block,
  array_to_string(list(CAST(trunc(sqrt(re * re + im * im) * 10000) AS BIGINT) ORDER BY bin), ',') AS levels
  FROM (SELECT label AS device, vec_id // 256 AS block, bin, AVG(re) AS re, AVG(im) AS im
  FROM fft GROUP BY ALL) GROUP BY device, block"""))
def display_spectrum(spark, sf):
    averaged = op.spectrum_average(op.spectrum_fft(views.blocks(spark, sf)))
    return op.display_spectrum(averaged).select(
        big("device"), "block", F.array_join(F.col("levels").cast("array<string>"), ",").alias("levels"))


# --- sets, ledger, constraints ------------------------------------------------------

@query("subscriber_set", sql(REQUESTS, """SELECT phone, MIN(us) AS time_us FROM requests
  WHERE phone LIKE '+%' GROUP BY phone"""))
def subscriber_set(spark, sf):
    return op.subscriber_set(views.subscription_requests(views.events(spark, sf))).select(
        "phone", us("time"))


@query("class_union", sql(EV, """SELECT id, CAST(user_id % 50 AS VARCHAR) AS device,
  CASE event_type WHEN 'signup' THEN 'SKY' WHEN 'purchase' THEN 'PPS' ELSE 'TPV' END AS class
  FROM ev WHERE value >= 2"""))
def class_union(spark, sf):
    return op.class_union(*[
        _gpsd(spark, sf, c).select("id", "device", F.lit(c).alias("class")) for c in ("TPV", "SKY", "PPS")])


@query("ledger_insert", sql(POINTS, """SELECT DISTINCT p.device, epoch_us(p.time) AS time_us,
  s.device IS NOT NULL AS sent FROM points p LEFT JOIN sent_log s ON s.device = p.device AND s.time = p.time"""))
def ledger_insert(spark, sf):
    ev = views.events(spark, sf)
    return op.ledger_insert(views.points(ev), views.sent_log(ev)).select("device", us("time"), "sent")


@query("ledger_mark_sent", sql(POINTS, "SELECT DISTINCT device, epoch_us(time) AS time_us FROM points"))
def ledger_mark_sent(spark, sf):
    ev = views.events(spark, sf)
    points, log = views.points(ev), views.sent_log(ev)
    # Everything unsent goes out; the log then knows every point.
    after = log.union(op.ledger_mark_sent(op.unsent(points, log)))
    return op.ledger_insert(points, after).where("sent").select("device", us("time"))


CHANGES = f"""WITH {EV}, changes AS (SELECT id AS seq, CASE WHEN event_type = 'signup' AND id % 10 = 0 THEN 'update'
    WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'purchase' THEN 'sent' ELSE 'insert' END AS op,
  CASE WHEN value < 2 THEN NULL ELSE user_id % 5 END AS device, epoch_us(date_trunc('hour', time)) AS time_us
  FROM ev)"""
FED_LEDGER_SQL = CHANGES + """ SELECT device, time_us,
  coalesce(arg_max(op, seq) FILTER (WHERE op IN ('insert', 'sent')) = 'sent', false) AS sent
  FROM changes WHERE device IS NOT NULL AND op <> 'update' GROUP BY device, time_us
  HAVING arg_max(op, seq) FILTER (WHERE op IN ('insert', 'delete')) = 'insert'"""


@query("ledger_from_feed", FED_LEDGER_SQL)
def ledger_from_feed(spark, sf):
    return op.ledger_from_feed(views.ledger_changes(views.events(spark, sf))).select("device", us("time"), "sent")


@query("ledger_feed_rejects", CHANGES + """ SELECT seq, op, device, time_us,
  CASE WHEN device IS NULL THEN 'null device' ELSE 'unknown op update' END AS reason
  FROM changes WHERE device IS NULL OR op = 'update'""")
def ledger_feed_rejects(spark, sf):
    return op.feed_split(views.ledger_changes(views.events(spark, sf)))[1].select(
        "seq", "op", "device", us("time"), "reason")


@query("upload_retry", sql(TRAILS, """SELECT device, epoch_us(time) AS time_us FROM sent_log
  UNION SELECT device, epoch_us(time) FROM ranked r WHERE NOT EXISTS (SELECT 1 FROM sent_log s
    WHERE s.device = r.device AND s.time = r.time)
  AND NOT EXISTS (SELECT 1 FROM ranked f WHERE f.value > 200 AND f.device = r.device AND f.day = r.day
    AND f.geohash = r.geohash)"""))
def upload_retry(spark, sf):
    ev = views.events(spark, sf)
    located = lambda e: views.points(e).withColumns({
        "day": fn.day_of("time"), "geohash": fn.geohash("lat", "lon")})
    return op.upload_retry(
        located(ev), views.sent_log(ev), located(ev.where("value > 200"))).select("device", us("time"))


CONSTRAINTS = sql(POINTS, """SELECT id, CASE WHEN lat2 IS NULL THEN 'null lat'
  WHEN row_number() OVER (PARTITION BY device, time, lat2 IS NULL ORDER BY id) > 1
  THEN 'duplicate device,time' END AS reason
  FROM (SELECT *, CASE WHEN value >= 3 THEN lat END AS lat2 FROM points)""")


@query("constraint_split", CONSTRAINTS)
def constraint_split(spark, sf):
    points = views.points(views.events(spark, sf), "value").withColumn(
        "lat", F.when(F.col("value") >= 3, F.col("lat")))
    accepted, rejected = op.constraint_split(points, ["lat"], ["device", "time"], "id")
    return accepted.select("id", F.lit(None).cast("string").alias("reason")).union(
        rejected.select("id", "reason"))


# --- whole flows ---------------------------------------------------------------

@query("reports_to_table", CONSTRAINTS)
def reports_to_table(spark, sf):
    path = shared_folder(spark, "reports")
    points = views.points(views.events(spark, sf), "value").withColumn(
        "lat", F.when(F.col("value") >= 3, F.col("lat")))
    rejected = flows.reports_to_table(points, path, ["lat"], ["device", "time"], "id")
    return spark.read.parquet(path).select("id", F.lit(None).cast("string").alias("reason")).union(
        rejected.select("id", "reason"))


@query("gateway_text_to_logs", sql(FRAMES, """SELECT id, can_interface, CASE WHEN v100 >= 200 THEN us END AS time_us,
  CASE WHEN v100 >= 200 THEN printf('%x', can_id) END AS can_id, CASE WHEN v100 >= 200 THEN data END AS can_data
  FROM frames"""))
def gateway_text_to_logs(spark, sf):
    path = shared_folder(spark, "gateway")
    rejects = flows.gateway_text_to_logs(views.gateway_lines(views.events(spark, sf)), table=path)
    return op.class_union(
        spark.read.parquet(path).select("id", "can_interface", us("time"), "can_id", "can_data"),
        rejects.select("id", "can_interface"))


@query("fleet_state_continued", sql(PROBES, """SELECT device, MAX(CASE WHEN ok THEN us END) AS last_seen_us,
  arg_max(ok, us) AS online, MAX(us) AS checked_us FROM probes GROUP BY device"""))
def fleet_state_continued(spark, sf):
    """The state half a month in, carried on with the probes since."""
    probes, half = views.probes(views.events(spark, sf)), F.lit("2024-01-16").cast("timestamp")
    before = op.fleet_state(probes.where(F.col("time") < half))
    return op.fleet_state(probes.where(F.col("time") >= half), before).select(
        "device", us("last_seen"), "online", us("checked"))


@query("bus_health", sql(COUNTERS, f"""SELECT device, interface,
  round((epoch_us(TIMESTAMP '{NOW}') - logged) / 1000000.0, 6) AS age_s, silent,
  coalesce((epoch_us(TIMESTAMP '{NOW}') - logged) / 1000000.0 <= 21600, false) OR coalesce(silent, false) AS healthy
  FROM (SELECT device, interface, rx_bytes - lag(rx_bytes) OVER w <= 0 AS silent FROM counters
    WINDOW w AS (PARTITION BY device, interface ORDER BY time)
    QUALIFY row_number() OVER (PARTITION BY device, interface ORDER BY time DESC) = 1)
  LEFT JOIN (SELECT user_id % 10 AS device, 'can' || CAST(user_id % 2 AS VARCHAR) AS interface, MAX(us) AS logged
    FROM ev WHERE value >= 30 GROUP BY ALL) USING (device, interface)"""))
def bus_health(spark, sf):
    ev = views.events(spark, sf)
    logs = ev.where("value >= 30").select(
        (F.col("user_id") % 10).alias("device"), F.concat(F.lit("can"), F.col("user_id") % 2).alias("interface"), "time")
    return flows.bus_health(views.counters(ev), logs, F.lit(NOW).cast("timestamp"), 21600.0, "1 hour").select(
        "device", "interface", rounded("age_s", 6), "silent", "healthy")


@query("export_tracks_append", sql(DAY_SEGMENTS.replace("date_trunc('minute', time) AS time", "time"),
       """SELECT CAST(device AS VARCHAR) AS device, strftime(segment, '%Y-%m-%dT%H-%M-%SZ') AS segment,
  COUNT(*) AS points FROM placed GROUP BY ALL"""))
def export_tracks_append(spark, sf):
    """Every second device comes late with most of its points, after the others were exported."""
    path = shared_folder(spark, "gpx-append")
    points = views.points(views.events(spark, sf), time=F.col("time"))
    flows.export_tracks(points.where("device % 2 = 0 OR time < TIMESTAMP '2024-01-10'"), path, 86400, append=True)
    flows.export_tracks(points, path, 86400, append=True)
    lines = spark.read.option("recursiveFileLookup", "true").text(path).withColumn("_f", F.input_file_name())
    return (
        lines.groupBy(F.regexp_extract("_f", r"device=([^/]+)/", 1).alias("device"),
                      F.regexp_extract("_f", r"segment=([^/]+)/", 1).alias("segment"))
        .agg(F.count_if(F.col("value").contains("<trkpt ")).alias("points")))


# --- signals and positions, work sessions ------------------------------------

# A machine reports some of its positions only; tolerance in seconds.
POSITION_WITHIN_S = 7200
FIXES = SIGNALS + """, located AS (SELECT id, device % 50 AS device, name, time, us, value FROM signals),
fixes AS (SELECT id, user_id % 50 AS device, time, us,
  CAST(40.0 AS DOUBLE) + CAST(id % 2000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat,
  CAST(-87.0 AS DOUBLE) + CAST(user_id % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS lon
  FROM ev WHERE value >= 50)"""


def located_signals(ev):
    return views.signals(ev).withColumn("device", F.col("device") % 50)


def fixes(ev):
    return views.points(ev.where("value >= 50"), time=F.col("time"))


def located_columns(df):
    return df.select("id", "device", "name", rounded("value"), rounded("lat"), rounded("lon"), us("position_time"))


POSITION_SQL = sql(FIXES, f"""SELECT id, device, name, round(value, 4) AS value,
  CASE WHEN us - seen <= {POSITION_WITHIN_S}000000 THEN round(lat, 4) END AS lat,
  CASE WHEN us - seen <= {POSITION_WITHIN_S}000000 THEN round(lon, 4) END AS lon,
  CASE WHEN us - seen <= {POSITION_WITHIN_S}000000 THEN seen END AS position_time_us
  FROM (SELECT s.*, p.us AS seen, p.lat, p.lon FROM located s ASOF LEFT JOIN fixes p
    ON s.device = p.device AND s.us >= p.us)""")


@query("signal_position_asof", POSITION_SQL)
def signal_position_asof(spark, sf):
    ev = views.events(spark, sf)
    return located_columns(op.signal_position_asof(located_signals(ev), fixes(ev), POSITION_WITHIN_S))


@query("signal_position_nearest", sql(FIXES, """SELECT id, device, name, round(value, 4) AS value,
  round(CASE WHEN ahead THEN lat2 ELSE lat1 END, 4) AS lat, round(CASE WHEN ahead THEN lon2 ELSE lon1 END, 4) AS lon,
  CASE WHEN ahead THEN at2 ELSE at1 END AS position_time_us
  FROM (SELECT *, at1 IS NULL OR coalesce(at2 - us < us - at1, false) AS ahead FROM
    (SELECT s.*, p.us AS at1, p.lat AS lat1, p.lon AS lon1, q.us AS at2, q.lat AS lat2, q.lon AS lon2
     FROM located s ASOF LEFT JOIN fixes p ON s.device = p.device AND s.us >= p.us
     ASOF LEFT JOIN fixes q ON s.device = q.device AND s.us <= q.us))"""))
def signal_position_nearest(spark, sf):
    ev = views.events(spark, sf)
    return located_columns(op.signal_position_asof(located_signals(ev), fixes(ev), None, "nearest"))


SESSION_GAP_S = 21_600
SESSIONS = EV + f""", working AS (SELECT id, user_id % 50 AS device, us, value FROM ev WHERE value >= 20),
opened AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {SESSION_GAP_S}000000 THEN 0 ELSE 1 END AS fresh
  FROM working WINDOW w AS (PARTITION BY device ORDER BY us, id)),
numbered AS (SELECT *, SUM(fresh) OVER (PARTITION BY device ORDER BY us, id) AS session FROM opened),
sessions AS (SELECT device, MIN(us) AS start_time_us, MAX(us) AS end_time_us,
  round((MAX(us) - MIN(us)) / 1000000.0, 6) AS duration_s, COUNT(*) AS rows, round(MIN(value), 4) AS min_value,
  round(MAX(value), 4) AS max_value, round(SUM(value), 4) AS sum_value FROM numbered GROUP BY device, session)"""


def working(ev):
    return ev.where("value >= 20").select("id", (F.col("user_id") % 50).alias("device"), "time", "value")


def session_columns(df):
    return df.select(
        "device", us("start_time"), us("end_time"), rounded("duration_s", 6), big("rows"),
        *[rounded(f"{k}_value") for k in ("min", "max", "sum")])


@query("work_sessions", sql(SESSIONS, "SELECT * FROM sessions"))
def work_sessions(spark, sf):
    return session_columns(op.work_sessions(
        working(views.events(spark, sf)), SESSION_GAP_S, measures=("value",)))
