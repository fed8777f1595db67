import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harrow import operators as op, schemas
from tests.conftest import rows


def publish(messages, gap):
    """The arrival rule, one message after the other."""
    last, held, out = None, [], []
    for us, value in messages:
        last = us if last is None else last
        held.append((us, value))
        if us - last >= gap:
            values = [v for _, v in held]
            out.append((len(held), round(sum(values), 6), round(sum(v * v for v in values), 6),
                        held[0][0], held[-1][0]))
            last, held = us, []
    return out


@pytest.fixture(params=[10_000, 7])
def arrow_rows(spark, request):
    """Arrow batches that hold whole signals, and some that split them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.set(name, before)


@pytest.mark.parametrize("limit", [None, 25, 400])
@pytest.mark.parametrize("gap", [1.0, 0.25])
def test_greedy_statistics_against_the_rule(spark, limit, gap, arrow_rows):
    rng = random.Random(4)
    data, us = [], {}
    for i in range(3000):
        key = (1, "hot") if i % 3 else (rng.randrange(3), "cold")
        # Bursts, equal times, regular spacing and pauses over midnight.
        step = rng.choice([0, 100_000, 100_000, 250_000, 333_333, 1_000_000, 9_000_000])
        us[key] = us.get(key, 86_390_000_000) + step
        data.append((i, *key, us[key], float(rng.randrange(100))))
    df = spark.createDataFrame(data, "id bigint, device int, name string, us bigint, value double").select(
        "id", "device", "name", F.timestamp_micros("us").alias("time"), "value")
    got = op.signal_stats_greedy(df, gap, max_rows=limit).select(
        "device", "name", "number", F.round("sum_val", 6), F.round("sum_of_squares", 6),
        F.unix_micros("from_time"), F.unix_micros("to_time"))
    want = []
    for key in us:
        mine = sorted((t, i, v) for i, d, n, t, v in data if (d, n) == key)
        want += [(*key, *p) for p in publish([(t, v) for t, _, v in mine], int(gap * 1e6))]
    assert rows(got) == sorted(want)


def test_greedy_tables_stay_small_when_the_gap_outlasts_a_piece(spark):
    """100 Hz, pieces of ten seconds, a gap of thirty."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql import types as T
    from harrow.operators.pieces import PIECE, cut_into_pieces
    from harrow.operators.signals import GAPS_PER_PIECE, _tables

    n, gap = 200_000, 30_000_000
    df = spark.range(n).select(
        "id", F.lit(1).alias("device"), F.lit("s").alias("name"), (F.col("id") % 10).cast("double").alias("value"),
        F.timestamp_micros(F.col("id") * 10_000).alias("time"))
    keys = ["device", "name"]
    cut = cut_into_pieces(df, keys, "time", "id", 1000, GAPS_PER_PIECE * gap).withColumn("_us", F.unix_micros("time"))
    assert cut.select(PIECE).distinct().count() >= 3
    kind = T.StructType([cut.schema[k] for k in [*keys, PIECE]] + [
        T.StructField(c, T.LongType()) for c in ("first", "entered", "left")])
    tables = (cut.select(*keys, PIECE, "_us").repartition(4, *keys, PIECE).sortWithinPartitions(*keys, PIECE, "_us")
              .mapInArrow(_tables([*keys, PIECE], gap, to_arrow_schema(kind)), kind))
    assert tables.groupBy(PIECE).count().agg(F.max("count")).first()[0] <= gap // 10_000 + 1
    got = op.signal_stats_greedy(df, gap / 1e6, max_rows=1000).select(
        "number", F.round("sum_val", 6), F.round("sum_of_squares", 6), F.unix_micros("from_time"),
        F.unix_micros("to_time"))
    assert rows(got) == sorted(publish([(i * 10_000, float(i % 10)) for i in range(n)], gap))


def test_identifier_hand_cases(spark):
    df = spark.createDataFrame([(0x18FEF100,), (0x18EAFF21,), (0x1DEF1234,)], "can_id bigint")
    got = op.j1939_decode_id(df).collect()
    assert tuple(got[0])[1:] == (6, 0, 65265, 0, None)
    assert tuple(got[1])[1:] == (6, 0, 59904, 33, 255)
    # The page bit is lost from the group number and kept beside it.
    assert (got[2]["data_page"], got[2]["pgn"], got[2]["destination"]) == (1, 0xEF00, 0x12)


def test_activity_frames_are_not_j1939(spark):
    df = spark.range(120).select(
        F.lit(0x42A).alias("can_id"), F.lit(False).alias("is_extended"), F.lit(False).alias("is_rtr"))
    assert op.j1939_only(df).count() == 0


def test_decode_drops_fields_past_the_payload(spark):
    frames = spark.createDataFrame(
        [(1, 5, "0102"), (2, 5, "01020304050607080910"), (3, 6, "ff")], "id int, pgn int, data string")
    spec = spark.createDataFrame(
        [(5, "a", "", "", 0, 16, 1.0, 0.0, 0.0, 1e9), (5, "b", "", "", 60, 12, 1.0, 0.0, 0.0, 1e9)],
        "pgn int, name string, description string, units string, start_bit int, bit_len int, "
        "scale double, offset double, min_value double, max_value double")
    got = rows(op.signal_decode(frames, spec).select("id", "name", "value"))
    whole = int.from_bytes(bytes.fromhex("01020304050607080910"), "little")
    assert got == [(1, "a", 513.0), (2, "a", 513.0), (2, "b", float((whole >> 60) & 0xFFF))]


def test_decode_of_random_layouts(spark):
    rng = random.Random(6)
    frames, spec, want = [], [], set()
    for pgn in range(60):
        payload = bytes(rng.randrange(256) for _ in range(rng.randint(1, 30)))
        frames.append((pgn, payload.hex()))
        for k in range(8):
            start, width = rng.randrange(0, 220), rng.randint(1, 64)
            spec.append((pgn, f"s{k}", "", "", start, width, 2.0, -1.0, 0.0, 1.0))
            if start + width <= 8 * len(payload):
                raw = (int.from_bytes(payload, "little") >> start) & ((1 << width) - 1)
                want.add((pgn, f"s{k}", float(raw) * 2.0 - 1.0))
    f = spark.createDataFrame(frames, "pgn int, data string")
    d = spark.createDataFrame(
        spec, "pgn int, name string, description string, units string, start_bit int, bit_len int, "
        "scale double, offset double, min_value double, max_value double")
    got = op.signal_decode(f, d).select("pgn", "name", "value").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def bits_of(payload, start, width, big):
    """A field read bit by bit, as the file format numbers bits; None past the payload."""
    raw, at = 0, start
    for k in range(width):
        if not 0 <= at < 8 * len(payload):
            return None
        bit = payload[at // 8] >> at % 8 & 1
        if big:
            raw = raw << 1 | bit
            at = at - 1 if at % 8 else at + 15
        else:
            raw |= bit << k
            at += 1
    return raw


@pytest.mark.parametrize("longest", [8, 30])
def test_decode_bit_by_bit(spark, longest):
    """Both byte orders, signs and selectors, inside eight bytes and past them."""
    rng = random.Random(longest)
    frames, spec, want = [], [], set()
    for pgn in range(80):
        payload = bytes(rng.randrange(256) for _ in range(rng.randint(1, longest)))
        frames.append((pgn, payload.hex()))
        at, size, order = rng.randrange(8 * len(payload)), rng.randint(1, 3), rng.random() < 0.5
        selected = bits_of(payload, at, size, order)
        for k in range(12):
            start, width = rng.randrange(0, 8 * longest), rng.randint(1, 64)
            big, signed, chosen = rng.random() < 0.6, rng.random() < 0.3, rng.random() < 0.4
            value = rng.randrange(2 ** size) if chosen else None
            spec.append((pgn, f"s{k}", "", "", start, width, 2.0, -1.0, 0.0, 1.0, signed, big, *(
                ("sel", at, size, order, value) if chosen else (None,) * 5)))
            raw = bits_of(payload, start, width, big)
            if raw is not None and (not chosen or selected == value):
                number = raw - (1 << width) if signed and raw >> (width - 1) else raw
                want.add((pgn, f"s{k}", float(number) * 2.0 - 1.0))
    f = spark.createDataFrame(frames, "pgn int, data string")
    d = spark.createDataFrame(spec, StructType([*schemas.DICTIONARY.fields, *schemas.LAYOUT.fields]))
    got = op.signal_decode(f, d)
    assert {tuple(r) for r in got.select("pgn", "name", "value").collect()} == want and got.count() == len(want)
    assert got.columns == ["pgn", "data", "name", "description", "units", "min_value", "max_value", "value"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Python" not in plan


def test_valid_filter_is_strict(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 2.0)], "value double, max_value double")
    assert rows(op.valid_signal_filter(df)) == [(1.0, 2.0)]


def test_windows_add_up(spark):
    df = spark.range(1000).select(
        (F.col("id") % 3).alias("device"), F.lit("s").alias("name"), "id",
        F.timestamp_micros(F.col("id") * 137_000).alias("time"), F.col("id").cast("double").alias("value"))
    stats = op.signal_stats(df)
    assert stats.agg(F.sum("number"), F.sum("sum_val")).first() == (1000, 499500.0)


def test_gauges_take_the_higher_id_on_a_tie(spark):
    df = spark.createDataFrame(
        [(1, 9, "a", 1.0), (1, 10, "a", 2.0), (1, 3, "a", 7.0)], "device int, id int, name string, value double"
    ).withColumn("time", F.timestamp_seconds(F.when(F.col("id") == 3, 1).otherwise(5)))
    assert op.gauge_snapshot(df).first()["value"] == 2.0


def test_fft_of_a_tone(spark):
    import math
    tone = [math.cos(2 * math.pi * 4 * i / 64) for i in range(64)]
    df = spark.createDataFrame([(0, tone)], "block_id int, samples array<double>")
    spectrum = op.spectrum_fft(df, window=None).withColumn("m", F.sqrt(F.col("re") ** 2 + F.col("im") ** 2))
    peaks = rows(spectrum.where("m > 1").select("bin", F.round("m", 6)))
    assert peaks == [(28, 32.0), (36, 32.0)]
    vector = spark.createDataFrame([(0, tone, [-math.sin(2 * math.pi * 4 * i / 64) for i in range(64)])],
                                   "block_id int, samples array<double>, q array<double>")
    one = op.spectrum_fft(vector, window=None, imaginary="q").where("abs(re) > 1")
    assert [r["bin"] for r in one.collect()] == [28]


def test_average_is_complex(spark):
    df = spark.createDataFrame(
        [(0, f, 0, 1.0 if f % 2 else -1.0, 0.5) for f in range(512)],
        "device int, frame bigint, bin int, re double, im double")
    assert rows(op.spectrum_average(df)) == [(0, 0, 0, 0.0, 0.5), (0, 1, 0, 0.0, 0.5)]
    assert [r["frame"] for r in op.keep_one_in_n(df, 256).collect()] == [255, 511]
