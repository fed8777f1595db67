"""As-of joins and work sessions against brute force, however the keys are cut."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from harrow import operators as op
from harrow.operators.pieces import PIECE, cut_into_pieces
from tests.conftest import rows

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def table(spark, data, value):
    df = spark.createDataFrame(data, f"id bigint, device int, us bigint, {value} double")
    return df.select("id", "device", F.timestamp_micros("us").alias("time"), value)


@pytest.fixture(scope="module")
def data():
    """Device 1 has most rows, many at one instant on both sides; device 9 has no positions."""
    r = random.Random(8)

    def made(n, devices):
        out = []
        for i in range(n):
            device = 1 if i % 3 else r.choice(devices)
            us = 777 if r.random() < 0.1 else r.randrange(4000) if r.random() < 0.9 else r.randrange(10 ** 6)
            out.append((i - 50, device, us, float(i)))
        return out

    return made(900, [2, 3, 9]), made(500, [2, 3, 4])


def nearest(signal, points, direction, tolerance):
    i, device, us, _ = signal
    own = [p for p in points if p[1] == device]
    back = max((p for p in own if p[2] <= us), key=lambda p: (p[2], p[0]), default=None)
    ahead = min((p for p in own if p[2] >= us), key=lambda p: (p[2], p[0]), default=None)
    found = {"backward": back, "forward": ahead}.get(direction)
    if direction == "nearest":
        found = back if ahead is None or (back and us - back[2] <= ahead[2] - us) else ahead
    return found if found and (tolerance is None or abs(found[2] - us) <= tolerance) else None


@pytest.mark.parametrize("limit", [None, 60])
@pytest.mark.parametrize("tolerance", [None, 20])
@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof(spark, data, direction, tolerance, limit):
    signals, points = data
    got = op.asof_join(
        table(spark, signals, "value"), table(spark, points, "lat"), ["device"], ["lat"], matched="at",
        direction=direction, tolerance_s=None if tolerance is None else tolerance / 1e6, max_rows=limit)
    want = []
    for s in signals:
        p = nearest(s, points, direction, tolerance)
        want.append((s[0], s[3], p and p[2], p and p[3]))
    found = got.select("id", "value", F.unix_micros("at"), "lat")
    assert rows(found) == sorted(want, key=lambda r: tuple((v is not None, v) for v in r))


def test_a_crowded_device_is_cut_and_nothing_is_paired(spark, data):
    left, right = table(spark, data[0], "value"), table(spark, data[1], "lat")
    both = left.select("id", "device", "time").union(right.select("id", "device", "time"))
    pieces = cut_into_pieces(both, ["device"], "time", "id", 60)
    assert pieces.where("device = 1").select(PIECE).distinct().count() >= 8
    joined = op.asof_join(left, right, ["device"], ["lat"], max_rows=60)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_nulls_names_and_no_rows(spark):
    left = spark.createDataFrame([(1, 1, T0, "a"), (2, None, T0, "b"), (3, 1, None, "c")],
                                 "id bigint, device int, time timestamp, _here string")
    right = spark.createDataFrame([(1, 1, T0, 5.0), (2, 1, None, 6.0), (3, None, T0, 7.0)],
                                  "id bigint, device int, time timestamp, lat double")
    got = op.asof_join(left, right, ["device"], ["lat"])
    assert rows(got.select("id", "_here", "lat")) == [(1, "a", 5.0), (2, "b", None), (3, "c", None)]
    assert rows(op.asof_join(left, right.limit(0), ["device"], ["lat"]).select("id", "lat")) == [
        (1, None), (2, None), (3, None)]
    assert op.asof_join(left.limit(0), right, ["device"], ["lat"]).count() == 0
    with pytest.raises(ValueError):
        op.asof_join(left.withColumn("lat", F.lit(1)), right, ["device"], ["lat"])
    with pytest.raises(ValueError):
        op.asof_join(left, right, ["device"], ["lat"], direction="sideways")


def sessions_of(data, gap):
    out = []
    for device in {d for _, d, _, _ in data}:
        own = sorted((us, i, v) for i, d, us, v in data if d == device)
        part = [own[0]]
        for row in own[1:] + [None]:
            if row is None or row[0] - part[-1][0] > gap:
                values = [v for _, _, v in part]
                out.append((device, part[0][0], part[-1][0], len(part), min(values), max(values), sum(values)))
                part = []
            part.append(row)
    return sorted(out)


@pytest.mark.parametrize("limit", [None, 60, 400])
@pytest.mark.parametrize("gap", [0, 1, 3, 10, 100, 5000, 10 ** 7])
def test_sessions_go_on_over_pieces(spark, data, gap, limit):
    signals = [(i, d, us, float(v)) for i, d, us, v in data[0]]
    got = op.work_sessions(table(spark, signals, "value"), gap / 1e6, measures=("value",), max_rows=limit)
    found = got.select("device", F.unix_micros("start_time"), F.unix_micros("end_time"), "rows",
                       "min_value", "max_value", "sum_value")
    assert rows(found) == sessions_of(signals, gap)


def test_one_device_in_eight_pieces(spark):
    """One long session, single rows far apart, and a session over the last pieces."""
    r = random.Random(1)
    at = [*range(0, 4000, 10), *range(100_000, 500_000, 1000), *range(900_000, 904_000, 10)]
    data = [(i, 1, us, 1.0) for i, us in enumerate(r.sample(at, len(at)))]
    frames = table(spark, data, "value")
    limit = len(at) // 8
    assert cut_into_pieces(frames, ["device"], "time", "id", limit).select(PIECE).distinct().count() >= 8
    got = op.work_sessions(frames, 20e-6, max_rows=limit)
    assert rows(got.select("device", F.unix_micros("start_time"), F.unix_micros("end_time"), "rows")) == [
        r[:4] for r in sessions_of(data, 20)]


def test_sessions_without_times(spark):
    frames = spark.createDataFrame([(1, 1, None), (2, 1, T0), (3, 1, T0 + timedelta(seconds=5))],
                                   "id bigint, device int, time timestamp")
    assert rows(op.work_sessions(frames, 5).select("device", "duration_s", "rows")) == [(1, 5.0, 2)]
    assert op.work_sessions(frames.limit(0), 5).count() == 0
