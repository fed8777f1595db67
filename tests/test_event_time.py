"""Streams in the order of event time: shuffled arrival, late rows, silent devices, sessions."""

import random

import pytest
from pyspark.sql import functions as F

from harrow import operators as op
from harrow import streaming as st
from tests.conftest import rows

SCHEMA = "id bigint, device int, us bigint, ok boolean"


def probes(spark, data):
    return spark.createDataFrame(data, SCHEMA).select("id", "device", F.timestamp_micros("us").alias("time"), "ok")


def transitions(df):
    return rows(df.select("id", "device", F.unix_micros("time"), "event", F.unix_micros("last_seen")))


def run(spark, base, batches, delay_s, make):
    """One run per batch of rows, each going on from the checkpoints."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{base}/in")
        st.stream_split_late(spark.readStream.schema(batch.schema).parquet(f"{base}/in"), delay_s,
                             f"{base}/passed", f"{base}/late", f"{base}/clocks", f"{base}/split")
        with st.timer_state(spark):
            st.run_append(make(st.read_batches(spark, f"{base}/passed", batch.schema)), f"{base}/out",
                          f"{base}/checkpoint")
    schema = batches[0].schema
    return (spark.read.schema(make(batches[0]).schema).parquet(f"{base}/out"),
            spark.read.schema(schema).parquet(f"{base}/late/*"))


def test_shuffled_arrival_is_batch_and_late_table(spark, tmp_path):
    r = random.Random(9)
    data = [(i, r.randrange(4), i * 1_000_000 + r.randrange(1000), r.random() < 0.6) for i in range(400)]
    arrival = sorted(data, key=lambda row: row[2] + r.randrange(40_000_000) + 200_000_000 * (row[0] % 17 == 3))
    parts = [arrival[k:k + 100] for k in range(0, 400, 100)] + [[(999, 9, 10 ** 12, True)]]
    out, late = run(spark, str(tmp_path), [probes(spark, p) for p in parts], 50,
                    lambda df: st.stream_online_transitions(df, {"delay": "50 seconds"}))
    clock, behind, passed = None, [], []
    for part in parts:
        for row in part:
            (behind if clock is not None and row[2] <= (clock // 1000 - 50_000) * 1000 else passed).append(row)
        clock = max([clock or 0, *[row[2] for row in part]])
    assert 5 < len(behind) < 40
    assert rows(late.select("id")) == sorted((row[0],) for row in behind)
    want = op.online_transitions(probes(spark, passed)).where("device <> 9")
    assert transitions(out) == transitions(want)


def test_a_batch_delivered_again_replaces_its_own(spark, tmp_path):
    base, data = str(tmp_path), [(1, 1, 100_000_000, True), (2, 1, 1_000_000, True)]
    first = probes(spark, data[:1])
    make = lambda df: st.stream_online_transitions(df, {"delay": "5 seconds"})
    run(spark, base, [first, probes(spark, data[1:])], 5, make)
    # The second batch once more: its commit is taken back.
    commits = sorted((tmp_path / "split" / "commits").glob("[0-9]*"))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    st.stream_split_late(spark.readStream.schema(first.schema).parquet(f"{base}/in"), 5, f"{base}/passed",
                         f"{base}/late", f"{base}/clocks", f"{base}/split")
    assert rows(spark.read.parquet(f"{base}/late/*").select("id")) == [(2,)]
    assert rows(spark.read.parquet(f"{base}/passed/*").select("id")) == [(1,)]


def test_a_row_without_a_time_is_late(spark, tmp_path):
    data = probes(spark, [(0, 1, -5, True), (1, 1, None, True), (2, 1, 5_000_000, True)])
    out, late = run(spark, str(tmp_path), [data], 1, lambda df: st.stream_online_transitions(
        df, {"delay": "1 second"}))
    assert rows(late.select("id")) == [(0,), (1,)] and out.count() == 0


def test_a_silent_device_is_forgotten(spark, tmp_path):
    """After its expiry a device starts anew; before, it is still known."""
    second = 1_000_000
    batches = [[(1, 1, second, True), (2, 2, second, True)], [(3, 3, 50 * second, True)],
               [(4, 2, 58 * second, False), (5, 3, 70 * second, True)],
               [(6, 3, 300 * second, True)], [(7, 1, 310 * second, True), (8, 3, 400 * second, True)],
               [(9, 3, 500 * second, True)]]
    out, late = run(spark, str(tmp_path), [probes(spark, b) for b in batches], 5,
                    lambda df: st.stream_online_transitions(df, {"delay": "5 seconds", "expiry_s": 100}))
    # Device 1 was silent for 309 s: its row is a first one again. Device 2 was known at 58 s.
    assert transitions(out) == [
        (1, 1, second, "online", None), (2, 2, second, "online", None), (3, 3, 50 * second, "online", None),
        (4, 2, 58 * second, "offline", second), (6, 3, 300 * second, "online", None),
        (7, 1, 310 * second, "online", None)]
    assert late.count() == 0


@pytest.mark.parametrize("tolerance", [None, 3.0])
def test_positions_as_a_stream(spark, tmp_path, tolerance):
    r = random.Random(4)
    data = [(i, r.randrange(3), r.randrange(1, 200) * 500_000, r.choice([True, False])) for i in range(300)]
    df = probes(spark, data)

    def sides(rows_):
        signals = rows_.where("ok").select("id", "device", "time", F.lit("speed").alias("name"),
                                           F.col("id").cast("double").alias("value"))
        points = rows_.where("NOT ok").select("id", "device", "time", (F.col("id") / 10).alias("lat"),
                                              (-F.col("id") / 10).alias("lon"))
        return signals, points

    end = probes(spark, [(999, 9, 10 ** 10, True)])
    out, late = run(spark, str(tmp_path), [df, end], 5, lambda s: st.stream_position_asof(
        *sides(s), "5 seconds", tolerance))
    want = op.signal_position_asof(*sides(df), tolerance)
    columns = ["id", "device", "name", "value", "lat", "lon", "position_time"]
    assert rows(out.select(*columns)) == rows(want.select(*columns))
    assert late.count() == 0


def test_sessions_as_a_stream_and_exact_gaps(spark, tmp_path):
    second = 1_000_000
    at = [10, 20, 30, 41, 51, 110, 120, 131, 5000]
    data = probes(spark, [(i, 1, t * second, True) for i, t in enumerate(at)])
    want = op.work_sessions(data, 10).where(F.unix_micros("end_time") < 4000 * second)
    for k in range(3):
        data.where((F.col("id") / 3).cast("int") == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        st.run_append(st.stream_work_sessions(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), 10,
                                              "5 seconds"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    columns = ["device", "start_time", "end_time", "duration_s", "rows"]
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got.select(*columns)) == rows(want.select(*columns))
    assert [r.rows for r in want.orderBy("start_time").collect()] == [3, 2, 2, 1]


def test_live_replay_equals_the_batch_comparison(spark, tmp_path):
    """Over four parts with restarts; copies settle apart when they are far from each other."""
    r = random.Random(12)
    second, sent, got = 1_000_000, [], []
    for i in range(200):
        us = i * 10 * second
        body = f"m{r.randrange(3)}" if i % 4 else "beat"
        sent += [(us, "s", body)] * r.choice([1, 1, 2])
        got += [(us + r.randrange(3 * second), "s", body)] * r.choice([0, 1, 1, 3])
    cut = [0, 500 * second, 1000 * second, 1500 * second, 10 ** 12]
    schema = "us bigint, subject string, body string, ours boolean"
    for low, high in zip(cut, cut[1:]):
        part = [(*m, ours) for rows_, ours in ((sent, True), (got, False)) for m in rows_ if low <= m[0] < high]
        spark.createDataFrame(part, schema).withColumn("time", F.timestamp_micros("us")).coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema + ", time timestamp").parquet(f"{tmp_path}/in")
        st.run_append(st.stream_replay_balance(stream.where("ours"), stream.where("NOT ours"), 5, "20 seconds"),
                      f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    out = spark.read.parquet(f"{tmp_path}/out")
    last = out.agg(F.max(F.unix_micros("last_time"))).first()[0]
    assert last >= 1900 * second
    columns = ["subject", "body"]
    a = spark.createDataFrame([m[1:] for m in sent if m[0] <= last], "subject string, body string")
    b = spark.createDataFrame([m[1:] for m in got if m[0] <= last], "subject string, body string")
    totals = out.groupBy(*columns).agg(F.sum("sent").alias("n"), F.sum("received").alias("m"))
    want = a.groupBy(*columns).count().join(b.groupBy(*columns).agg(F.count("*").alias("m")), columns, "full")
    assert rows(totals) == rows(want.na.fill(0))
    # No message has another of its kind within 5 s except its own copies, so each settles by itself.
    assert out.where("matched + missing <> sent OR matched + unexpected <> received").isEmpty()
    assert out.where("unix_micros(last_time) - unix_micros(first_time) >= 3000000").isEmpty()
