import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from harrow import functions as fn
from harrow.operators import j1939_only, logs_to_frames, signal_decode


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_geohash_hand_case_and_edges(spark):
    assert one(spark, fn.geohash(F.lit(42.6), F.lit(-5.6))) == ("ezs42e4",)
    assert one(spark, fn.geohash(F.lit(57.64911), F.lit(10.40744), 11)) == ("u4pruydqqvj",)
    assert one(spark, fn.geohash(F.lit(90.0), F.lit(180.0), 3)) == ("zzz",)
    assert one(spark, fn.geohash(F.lit(-90.0), F.lit(-180.0), 3)) == ("000",)


def test_geohash_agrees_with_bisection(spark):
    alphabet = "0123456789bcdefghjkmnpqrstuvwxyz"

    def bisect(lat, lon, precision):
        box, text, value = [[-180.0, 180.0], [-90.0, 90.0]], "", 0
        for bit in range(5 * precision):
            side, at = box[bit % 2], (lon, lat)[bit % 2]
            middle = (side[0] + side[1]) / 2
            high = at >= middle
            side[0 if high else 1] = middle
            value = value * 2 + high
            if bit % 5 == 4:
                text, value = text + alphabet[value], 0
        return text

    rng = random.Random(1)
    cells = [360 / 2**18 * k - 180 for k in range(0, 2**18, 9973)]
    data = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(500)]
    data += [(c / 2, c) for c in cells]
    df = spark.createDataFrame(data, "lat double, lon double")
    for precision in (5, 6, 7, 12):
        got = df.select("lat", "lon", fn.geohash("lat", "lon", precision).alias("g")).collect()
        assert all(r["g"] == bisect(r["lat"], r["lon"], precision) for r in got)


def test_bit_fields_of_any_payload(spark):
    rng = random.Random(2)
    data = []
    for _ in range(1500):
        payload = bytes(rng.randrange(256) for _ in range(rng.randint(1, 24)))
        start, width = rng.randrange(0, 150), rng.randint(1, 64)
        value = (int.from_bytes(payload, "little") >> start) & ((1 << width) - 1)
        fits = start + width <= 8 * len(payload)
        data.append((payload.hex(), start, width, float(value) if fits else None))
    df = spark.createDataFrame(data, "data string, s int, w int, want double")
    assert df.where(~fn.spn_value("data", "s", "w").eqNullSafe(F.col("want"))).count() == 0


def test_signed_bit_fields_of_any_payload(spark):
    rng = random.Random(3)
    data = []
    for k in range(1500):
        payload = bytes(rng.randrange(256) for _ in range(rng.randint(1, 24)))
        start, width = rng.randrange(0, 150), k % 64 + 1
        value = (int.from_bytes(payload, "little") >> start) & ((1 << width) - 1)
        value -= (value >> (width - 1)) << width
        fits = start + width <= 8 * len(payload)
        data.append((k, payload.hex(), start, width, float(value) if fits else None))
    df = spark.createDataFrame(data, "pgn int, data string, s int, w int, want double")
    assert df.where(~fn.spn_value("data", "s", "w", signed=True).eqNullSafe(F.col("want"))).count() == 0
    dictionary = df.selectExpr(
        "pgn", "'x' AS name", "NULL AS description", "'' AS units", "s AS start_bit", "w AS bit_len", "1D AS scale",
        "0D AS offset", "0D AS min_value", "0D AS max_value", "true AS signed")
    decoded = signal_decode(df, dictionary)
    assert decoded.where("NOT value <=> want").count() == 0
    assert decoded.count() == df.where("want IS NOT NULL").count()


def test_log_rows_as_frames(spark):
    logs = spark.createDataFrame(
        [("7FF", "01"), ("800", "ab"), ("18FEF100", "0A"), ("no", "00"), (None, None)], "can_id string, can_data string")
    got = logs_to_frames(logs)
    assert sorted((r["can_id"], r["data"]) for r in j1939_only(got).collect()) == [(0x800, "ab"), (0x18FEF100, "0a")]
    assert got.count() == 5


def test_hex(spark):
    assert one(spark, fn.hex_text(F.lit(-1).cast("bigint")), fn.hex_text(F.lit(65265)),
               fn.hex_number(F.lit("f" * 16)), fn.hex_number(F.lit("fef1"))) == (
        "f" * 16, "fef1", -1, 65265)


def test_times(spark):
    at = F.timestamp_micros(F.lit(1619124803000001))
    assert one(spark, fn.iso_time(at), fn.day_of(at), fn.epoch_seconds(at)) == (
        "2021-04-22T20:53:23.000001Z", "2021-04-22", 1619124803.000001)
    assert one(spark, fn.parse_time(F.lit("2021-04-22 20:53")),
               fn.parse_time(F.lit("2021-13-01 00:00:00"))) == (None, None)
    assert one(spark, F.unix_seconds(fn.parse_time(F.lit("1970-01-02 00:00:00")))) == (86400,)
    assert one(spark, F.unix_seconds(fn.truncate_time(F.timestamp_seconds(F.lit(-1)), 3600))) == (-3600,)


def test_gap_text(spark):
    assert one(spark, fn.gap_text(F.lit(90061)), fn.gap_text(F.lit(None).cast("bigint"))) == (
        "1 days 01 hours 01 minutes 01 seconds", None)


def test_rotation(spark):
    at = F.timestamp_seconds(F.lit(4000))
    assert one(spark, F.unix_seconds(fn.rotation_bucket(at, "2", "M"))) == (3960,)
    for period, interval in (("x", "h"), (1, "w"), (None, "h"), (0, "h")):
        assert one(spark, fn.rotation_bucket(at, period, interval)) == (None,)


def test_subjects(spark):
    def matches(subject, pattern):
        return one(spark, fn.subject_match(F.lit(subject), pattern))[0]
    assert matches("j1939.data.speed", "j1939.data.>")
    assert not matches("j1939.data", "j1939.data.>")
    assert not matches("j1939.data.", "j1939.data.>")
    assert not matches("j1939xdata.a", "j1939.data.>")
    assert matches("a.b.c", "a.*.c") and not matches("a.b.x.c", "a.*.c")
    assert matches("a.b.c.d", "a.*.>") and matches("gps.TPV", "gps.TPV")
    assert one(spark, fn.make_subject("bus", F.lit(65265), F.lit(3), F.lit(None))) == ("j1939.65265.3.NONE",)


def test_spectrum_text(spark):
    assert one(spark, fn.spectrum_decode(F.lit("AQACAP//"))) == ([1, 2, 65535],)
    long = list(range(0, 65536, 37))
    df = spark.createDataFrame([(long,), ([],), (None,)], T.StructType(
        [T.StructField("v", T.ArrayType(T.IntegerType()))]))
    got = df.select("v", fn.spectrum_encode("v").alias("t")).select(
        "v", "t", fn.spectrum_decode("t").alias("w")).collect()
    assert all(r["v"] == r["w"] for r in got)
    assert "\n" not in got[0]["t"]


def test_quantise_wraps(spark):
    assert one(spark, *[fn.quantise_u16(F.lit(v), 10000.0) for v in (0.00019, 7.0, -0.00019)]) == (
        1, 70000 & 65535, 65535)


def test_point_id_is_stable_and_sorts_by_time(spark):
    ids = [one(spark, fn.point_id(F.lit(1), F.timestamp_seconds(F.lit(t)), F.lit(1.0), F.lit(2.0)))[0]
           for t in (10, 10, 11, 2**31)]
    assert ids[0] == ids[1] and ids == sorted(ids) and len(ids[0]) == 40
