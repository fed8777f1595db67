import random

from pyspark.sql import functions as F

from harrow import operators as op
from harrow import sources
from tests.conftest import rows


def timed(spark, data, schema):
    return spark.createDataFrame(data, schema).withColumn("time", F.timestamp_seconds("s")).drop("s")


def test_alert_sequence(spark):
    cycle = [0, 1, 1, 0, 0, 1]
    data = [(i, 1, "sms", 5 * i, cycle[i % 6]) for i in range(18)]
    df = timed(spark, data, "id int, device int, subject string, s int, reading int")
    alerts = op.rising_edge_alerts(df, max_rows=5)
    assert [r[0] for r in rows(alerts.select("id"))] == [1, 5, 7, 11, 13, 17]
    numbers = spark.createDataFrame([(1, "+17655550001"), (2, "+17655550002")], "device int, phone string")
    assert rows(op.alert_fanout(alerts.where("id < 6"), numbers)) == [
        (1, 1, "+17655550001", "The number is 1"), (1, 5, "+17655550001", "The number is 1")]


def test_phone_numbers(spark):
    good = ["+17655551234", "+12"]
    bad = ["17655551234", "+0123", "+1", "+1234567890123456", "+12a", "+12 ", None]
    df = spark.createDataFrame([(p,) for p in good + bad], "phone string")
    assert {r[0] for r in op.phone_filter(df).collect()} == set(good)


def test_subscribers_keep_the_first(spark):
    df = timed(spark, [(1, 9, "+12"), (2, 3, "+12"), (3, 3, "+12"), (4, 1, "x")], "id int, s int, phone string")
    assert rows(op.subscriber_set(df).select("phone", F.unix_seconds("time"))) == [("+12", 3)]


def walk(probes):
    """Probe rule per device, one probe after the other."""
    out, online, seen = [], False, None
    for s, i, ok in sorted(probes):
        if ok and not online:
            out.append((i, "online", seen, None if seen is None else s - seen))
        if not ok and online:
            out.append((i, "offline", seen, None))
        online, seen = ok, s if ok else seen
    return out


def test_transitions_with_cut_devices(spark):
    rng = random.Random(5)
    data = [(i, 1 if i % 3 else rng.randrange(2, 6), rng.randrange(0, 400_000), rng.random() < 0.6)
            for i in range(1500)]
    df = timed(spark, data, "id int, device int, s int, ok boolean")
    for limit in (None, 30):
        got = op.online_transitions(df, max_rows=limit).select(
            "device", "id", "event", F.unix_seconds("last_seen"), "gap_s")
        want = []
        for d in {r[1] for r in data}:
            want += [(d, *e) for e in walk([(s, i, ok) for i, dd, s, ok in data if dd == d])]
        assert {tuple(r) for r in got.collect()} == set(want)


def test_first_sight_has_no_gap(spark):
    df = timed(spark, [(1, 1, 10, True), (2, 1, 20, False), (3, 1, 90_081, True)], "id int, device int, s int, ok boolean")
    got = {r["id"]: r for r in op.online_transitions(df).collect()}
    assert got[1]["gap_text"] == "never seen" and got[1]["gap_s"] is None
    assert got[2]["event"] == "offline" and got[2]["gap_text"] is None
    assert got[3]["gap_text"] == "1 days 01 hours 01 minutes 11 seconds"


def test_state_continues_between_runs(spark):
    early = timed(spark, [(1, 1, 10, True), (2, 2, 11, True), (3, 2, 12, False)], "id int, device int, s int, ok boolean")
    late = timed(spark, [(4, 1, 20, False), (5, 3, 21, True)], "id int, device int, s int, ok boolean")
    whole = op.fleet_state(early.union(late))
    assert rows(op.fleet_state(late, op.fleet_state(early))) == rows(whole)


def test_staleness_is_strict_and_counts_the_missing(spark):
    latest = timed(spark, [(1, 95), (2, 94), (3, 0)], "device int, s int")
    expected = spark.createDataFrame(
        [(1, False), (2, False), (3, True), (4, False)], "device int, silent boolean")
    now = F.timestamp_seconds(F.lit(100))
    got = op.staleness(latest, expected, now, silent="silent").select("device", "age_s", "healthy")
    assert rows(got) == [(1, 5.0, True), (2, 6.0, False), (3, 100.0, True), (4, None, False)]


def test_idle_samples(spark):
    data = [(1, t, "can0", "280", b) for t, b in [(0, 0), (5, 8), (10, 8), (15, 8), (20, 16)]]
    data += [(1, t, "eth0", "1", 100 + t) for t in (0, 5, 10)] + [(1, 5, "can1", " 280\n", 0)]
    df = timed(spark, data, "device int, s int, interface string, link_type string, rx_bytes bigint")
    activity = op.bus_activity(df)
    assert rows(op.idle_detect(activity, max_rows=2).select(F.unix_seconds("time"))) == [(0,), (10,), (15,)]
    traffic = op.interface_traffic(df.where("interface = 'can0'"), "10 seconds")
    assert rows(traffic.select(F.unix_seconds("bucket"), "delta", "silent")) == [
        (0, 8, False), (10, 0, True), (20, 8, False)]


def test_counter_text(spark):
    df = spark.createDataFrame([("12 ",), ("x",), ("-3",), ("1.5",), ("9" * 30,)], "rx_bytes string")
    assert rows(sources.read_counters(df)) == [(12,)]


def test_interfaces(spark):
    asked = spark.createDataFrame([("can0",), ("can9",)], "interface string")
    there = spark.createDataFrame([("can0",), ("can0",), ("can1",)], "interface string")
    valid, missing = op.interface_resolve(asked, there)
    assert rows(valid) == [("can0",)] and rows(missing) == [("can9",)]


def test_modem_technology(spark):
    df = timed(spark, [(1, 0, -61.9, -70.0), (1, 1, None, -70.2), (1, 2, None, None)],
               "device int, s int, lte_rssi double, umts_rssi double")
    assert rows(op.cell_pick_tech(df).select("signal", "cell_tech")) == [(-70, "Umts"), (-61, "Lte")]


def test_constraints(spark):
    data = [(i, 7, 1.0) for i in range(50)] + [(50, None, 1.0), (51, 8, None), (52, 9, 2.0)]
    df = spark.createDataFrame(data, "id int, k int, v double")
    accepted, rejected = op.constraint_split(df, ["v"], ["k"], "id")
    assert [r[0] for r in rows(accepted.select("id"))] == [0, 52]
    reasons = {r["id"]: r["reason"] for r in rejected.collect()}
    assert reasons[50] == "null k" and reasons[51] == "null v" and reasons[49] == "duplicate k"
    assert len(reasons) == 51


def test_replay(spark):
    sent = spark.createDataFrame([("a", "1")] * 500 + [("a", "2")], "subject string, body string")
    came = spark.createDataFrame([("a", "1")] * 499 + [("b", "2")], "subject string, body string")
    assert rows(op.replay_match(sent, sent)) == []
    assert rows(op.replay_match(sent, came)) == [
        ("missing", "a", "1", 1), ("missing", "a", "2", 1), ("unexpected", "b", "2", 1)]
    assert rows(op.replay_missing(sent, came)) == [("a", "1", 1), ("a", "2", 1)]


def test_latest_rows_without_a_sort_of_the_table(spark):
    df = timed(spark, [(1, "a", 5, "x"), (2, "a", 5, "y"), (2, "a", 5, "y"), (3, None, 1, "z"), (4, "b", None, "w")],
               "id bigint, bus string, s bigint, text string")
    got = op.latest_row(df, ["bus"])
    assert rows(got.select("id", "bus", "text")) == [(2, "a", "y"), (3, None, "z")]
    assert rows(op.newest_one(df).select("id")) == [(2,)]
    assert "SortAggregate" not in got._jdf.queryExecution().toString()


def test_a_silent_bus_is_healthy(spark):
    from harrow.plans import flows

    schema = "device int, interface string, s bigint, rx_bytes bigint"
    counters = timed(spark, [(1, "can0", 0, 5), (1, "can0", 60, 5), (1, "can1", 0, 5), (1, "can1", 60, 9),
                             (2, "can0", 0, 1), (2, "can0", 60, 7), (3, "can0", 60, 7)], schema)
    logs = timed(spark, [(1, "can0", 1), (1, "can1", 1), (2, "can0", 98)], "device int, interface string, s bigint")
    got = flows.bus_health(counters, logs, F.timestamp_seconds(F.lit(100)))
    assert rows(got.select("device", "interface", "age_s", "silent", "healthy")) == [
        (1, "can0", 99.0, True, True), (1, "can1", 99.0, False, False), (2, "can0", 2.0, False, True),
        (3, "can0", None, None, False)]
