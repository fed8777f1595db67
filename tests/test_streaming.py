"""Streams over several batches give what the batch operators give."""

import random

import pytest
from pyspark.sql import functions as F

from harrow import operators as op
from harrow import sources
from harrow import streaming as st
from tests.conftest import rows
from tests.test_gps import PPS, SKY, TPV


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    """Rows in four files by time, each a batch of its own."""
    rng = random.Random(9)
    folder = str(tmp_path_factory.mktemp("feed"))
    data, s = [], 0
    for i in range(1200):
        s += rng.choice([0, 0, 1, 2, 30])
        data.append((i, rng.randrange(4), s, rng.random() < 0.6, rng.randrange(3), float(rng.randrange(50))))
    df = spark.createDataFrame(data, "id bigint, device int, s bigint, ok boolean, reading int, value double").select(
        "id", "device", F.timestamp_seconds("s").alias("time"), "ok", "reading", "value",
        F.lit("sms").alias("subject"), F.concat(F.lit("s"), F.col("device") % 2).alias("name"))
    for a in range(0, 1200, 300):
        df.where(F.col("id").between(a, a + 299)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def open_stream(spark, feed):
    batch = spark.read.parquet(feed)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(feed)
    return batch, stream


def append(spark, df, tmp_path):
    query = st.run_append(df, str(tmp_path / "out"), str(tmp_path / "check"))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 4
    return spark.read.schema(df.schema).parquet(str(tmp_path / "out"))


def test_rising_edges(spark, feed, tmp_path):
    batch, stream = open_stream(spark, feed)
    got = append(spark, st.stream_rising_edge(stream, 2), tmp_path)
    assert rows(got) == rows(op.rising_edge_alerts(batch, 2).select(got.columns))


def test_online_transitions(spark, feed, tmp_path):
    batch, stream = open_stream(spark, feed)
    got = append(spark, st.stream_online_transitions(stream), tmp_path)
    assert rows(got) == rows(op.online_transitions(batch).select(got.columns))


def test_greedy_statistics(spark, feed, tmp_path):
    batch, stream = open_stream(spark, feed)
    about = {"pgn": F.lit(61444), "units": F.lit("rpm"), "min_value": F.lit(0.0),
             "max_value": F.when(F.col("name") == "s0", 50.0).otherwise(60.0)}
    got = append(spark, st.stream_signal_stats_greedy(stream.withColumns(about), 5.0), tmp_path)
    want = op.signal_stats_greedy(batch.withColumns(about), 5.0)
    assert rows(got) == rows(want.select(got.columns))
    assert set(got.columns) == set(want.columns)


def test_idle(spark, feed, tmp_path):
    counters = lambda df: df.select(
        "device", "time", F.lit("280").alias("link_type"), F.col("reading").cast("bigint").alias("rx_bytes"))
    batch, stream = open_stream(spark, feed)
    got = append(spark, st.stream_idle_detect(counters(stream)), tmp_path)
    # Samples of one second are summed; a device's newest second is open.
    activity = op.bus_activity(counters(batch))
    newest = activity.groupBy("device").agg(F.max("time").alias("time"))
    assert rows(got) == rows(op.idle_detect(activity).join(newest, ["device", "time"], "left_anti").select(
        *got.columns))
    assert got.count() > 10


def test_idle_across_batches_and_links(spark, tmp_path):
    schema = "device int, s bigint, interface string, link_type string, rx_bytes bigint"
    batches = [[(1, 10, "can0", "280", 3)], [(1, 10, "can1", "280", 4), (1, 20, "can0", "280", 3)],
               [(1, 20, "can1", "280", 4), (1, 20, "eth0", "1", 99), (1, 10, "can0", "280", 50)],
               [(1, 30, "can0", "280", None), (1, 40, "can0", "280", 9)]]
    for data in batches:
        spark.createDataFrame(data, schema).select("*", F.timestamp_seconds("s").alias("time")).coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
        st.run_append(st.stream_idle_detect(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("device", F.unix_seconds("time"), "rx_bytes")) == [(1, 20, 7)]


def test_windows_close_with_the_watermark(spark, feed, tmp_path):
    batch, stream = open_stream(spark, feed)
    out = append(spark, st.stream_signal_stats(stream, "1 minute", "2 minutes"), tmp_path)
    want = op.signal_stats(batch, "1 minute")
    newest = batch.agg(F.max(F.unix_seconds("time"))).first()[0]
    closed = want.where(F.unix_seconds("window_start") + 60 <= newest - 120)
    assert rows(out) == rows(closed.select(out.columns))


def test_gauges_and_staleness(spark, feed, tmp_path):
    batch, stream = open_stream(spark, feed)
    st.run_updates(st.stream_gauges(stream), str(tmp_path / "g"), str(tmp_path / "gc"))
    got = st.read_updates(spark, str(tmp_path / "g"), ["device", "metric"])
    assert rows(got) == rows(op.gauge_snapshot(batch).select(got.columns))
    st.run_updates(st.stream_staleness(stream), str(tmp_path / "s"), str(tmp_path / "sc"))
    got = st.read_updates(spark, str(tmp_path / "s"), ["device"])
    assert rows(got) == rows(op.newest_time(batch, ["device"]))


def test_subscribers(spark, feed, tmp_path):
    phone = F.concat(F.when(F.col("device") == 0, "0").otherwise("+1"), F.col("device") + 20)
    batch, stream = open_stream(spark, feed)
    got = append(spark, st.stream_subscribers(stream.withColumn("phone", phone)), tmp_path)
    assert rows(got.select("phone")) == [("+121",), ("+122",), ("+123",)]


def test_restart_continues_from_the_checkpoint(spark, feed, tmp_path):
    batch, _ = open_stream(spark, feed)
    folder, half = str(tmp_path / "in"), F.col("id") < 600
    batch.where(half).coalesce(1).write.parquet(folder)
    def run():
        stream = spark.readStream.schema(batch.schema).parquet(folder)
        st.run_append(st.stream_online_transitions(stream), str(tmp_path / "o"), str(tmp_path / "c"))
    run()
    batch.where(~half).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = spark.read.parquet(str(tmp_path / "o"))
    assert rows(got) == rows(op.online_transitions(batch).select(got.columns))


def test_repeated_batch_writes_nothing_twice(spark, tmp_path):
    lines = spark.createDataFrame(
        [(TPV,), (SKY,), (PPS,), (TPV.replace('"mode":2,', ""),), ("{",)], "body string"
    ).withColumn("systime", F.timestamp_seconds(F.monotonically_increasing_id()))
    tables = {c: str(tmp_path / c) for c in ("TPV", "SKY", "PPS")}
    for turn in range(2):
        st.write_gpsd_batch(lines, tables, str(tmp_path / f"bad{turn}"))
    assert [spark.read.parquet(p).count() for p in tables.values()] == [1, 1, 1]
    reasons = spark.read.parquet(str(tmp_path / "bad0")).select("reason")
    assert rows(reasons) == [("not JSON",), ("null mode",)]


def test_json_readers_take_streams(spark, feed, tmp_path):
    batch, stream = open_stream(spark, feed)
    body = F.to_json(F.struct(
        F.lit(61444).alias("pgn"), "name", F.unix_seconds("time").cast("double").alias("time"), "value",
        F.lit("u").alias("units"), F.lit(0.0).alias("min_value"), F.lit(40.0).alias("max_value")))
    signals = lambda df: op.valid_signal_filter(
        sources.read_signals(df.select("id", "device", body.alias("body"))))
    got = append(spark, signals(stream), tmp_path)
    assert got.count() == batch.where("value < 40").count()


def test_frames_to_statistics_as_a_stream(spark, tmp_path):
    from harrow.plans import flows, views

    ev = views.events(spark, "/root/testdata/sf0.001")
    text = op.frame_to_message(views.messages(ev)).select("device", "body")
    text.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(text.schema).parquet(str(tmp_path / "in"))
    stats = flows.message_stream_to_stats(stream, views.dictionary(spark), "1 hour", "1 hour")
    st.run_append(stats, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.schema(stats.schema).parquet(str(tmp_path / "out"))
    decoded = op.valid_signal_filter(op.signal_decode(views.messages(ev), views.dictionary(spark)))
    want = op.signal_stats(decoded, "1 hour").select(got.columns)
    newest = decoded.agg(F.max(F.unix_seconds("time"))).first()[0]
    closed = want.where(F.unix_seconds("window_start") + 3600 <= newest - 3600)
    numbers = lambda df: rows(df.select("window_start", "device", "name", "number"))
    assert numbers(got) == numbers(closed) and got.count() > 0
