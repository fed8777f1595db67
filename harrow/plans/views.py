"""The driver's tables seen as telemetry.

Every view is a projection of whole tables; the check queries run on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from harrow import schemas
from harrow.functions.bits import hex_text
from harrow.functions.spectra import magnitude, quantise_u16, spectrum_encode
from harrow.functions.subjects import make_subject
from harrow.functions.times import truncate_time
from harrow.operators.j1939 import j1939_decode_id
from harrow.operators.spectrum import spectrum_vectors
from harrow.session import use_utc
from harrow.sources.logs import read_signal_dictionary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-less times read as UTC."""
    df = use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.simpleString() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def as_events(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"),
        F.col("user_id"), "event_type", "value", "props")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(table(spark, sf_dir, "events"))


# Rows of a slice of a stream, at most about, once there are more than four. Every slice starts the
# stream anew, with all its state, so their number must grow much slower than the rows.
SLICE_ROWS = 8_000_000


def slice_of(df: DataFrame, time: str) -> tuple[Column, int]:
    """Number of a row's slice of time, and how many slices there are: four of about equal size, or as many as the
    rows call for. Rows without a time are in the first."""
    n = max(4, df.count() // SLICE_ROWS + 1)
    us = F.unix_micros(time)
    cuts = df.agg(F.percentile_approx(
        us, F.array(*[F.lit(k / n) for k in range(1, n)]), F.lit(10_000))).first()[0] or []
    bounds = sorted(set(cuts))
    return sum((F.coalesce(us > b, F.lit(False)).cast("int") for b in bounds), F.lit(0)), len(bounds) + 1


_PGN = {"click": 61444, "view": 65265, "signup": 65262, "purchase": 65267}


def _by_type(values: dict[str, object], otherwise) -> Column:
    column = F.lit(None)
    for name, value in values.items():
        column = F.when(F.col("event_type") == name, F.lit(value)).otherwise(column)
    return F.coalesce(column, otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def frames(ev: DataFrame) -> DataFrame:
    pgn = _by_type(_PGN, F.lit(59904) + F.col("user_id") * 7 % 256).cast("bigint")
    payload = (F.round(F.col("value") * 100).cast("bigint")
               + F.col("id") % 256 * F.lit(16777216))
    return ev.select(
        "id", "time", F.col("user_id").alias("device"),
        F.concat(F.lit("can"), F.col("user_id") % 2).alias("can_interface"),
        (F.col("id") % 8 * 67108864 + pgn * 256 + F.col("user_id") % 254).alias("can_id"),
        (F.col("value") >= 4).alias("is_extended"), (F.col("value") > 220).alias("is_rtr"),
        F.lpad(hex_text(payload), 16, "0").alias("data"))


def can_log(ev: DataFrame) -> DataFrame:
    return frames(ev).select(
        "time", "can_interface", hex_text("can_id").alias("can_id"), F.col("data").alias("can_data"))


# Check dictionary: top codes of a field lie at or above its maximum; the last
# field does not fit eight bytes. Fixed values.
_SIGNALS = [
    (61444, "speed", "Engine speed", "rpm", 56, 8, 0.5, 0.0, 0.0, 125.0, False),
    (61444, "torque", "Engine torque", "%", 32, 8, 1.0, -125.0, -125.0, 125.0, False),
    (61444, "slip", "Wheel slip, signed", "1", 32, 8, 1.0, 0.0, -128.0, 128.0, True),
    (65265, "vehicle", "Vehicle speed", "km/h", 48, 16, 0.00390625, 0.0, 0.0, 250.0, False),
    (65262, "coolant", "Coolant temperature", "C", 56, 8, 1.0, -40.0, -40.0, 210.0, False),
    (65267, "wide", "Whole payload", "1", 0, 64, 1.0, 0.0, 0.0, 2.0e19, False),
    (65267, "overflow", "Past the payload", "1", 60, 16, 1.0, 0.0, 0.0, 60000.0, False),
]


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_SIGNALS, schemas.DICTIONARY)


def messages(ev: DataFrame) -> DataFrame:
    """Frames with their decoded identifier and 64-bit names."""
    return j1939_decode_id(frames(ev)).withColumns({
        "source_name": -F.col("device") - 1,
        "destination_name": F.when(F.col("destination").isNotNull(), F.col("device") * 1000003)})


def signals(ev: DataFrame) -> DataFrame:
    return ev.select(
        "id", F.col("user_id").alias("device"), F.col("event_type").alias("name"), "time", "value",
        _by_type({"click": 100.0, "view": 150.0}, 200.0).alias("max_value"),
        F.lit(0.0).alias("min_value"), F.lit("u").alias("units"),
        _by_type(_PGN, 59904).cast("int").alias("pgn"),
        F.concat(F.lit("about "), F.col("event_type")).alias("description"))


def counters(ev: DataFrame) -> DataFrame:
    """Cumulative bytes per interface and hour.

    Hours are summed before they are accumulated, so the window sees one row
    per hour.
    """
    hourly = (
        ev.groupBy((F.col("user_id") % 10).alias("device"),
                   F.concat(F.lit("can"), F.col("user_id") % 2).alias("interface"),
                   truncate_time("time", 3600).alias("time"))
        .agg(F.sum(F.when(F.col("value") >= 30, 8).otherwise(0)).alias("_b")))
    running = Window.partitionBy("device", "interface").orderBy("time").rowsBetween(
        Window.unboundedPreceding, 0)
    return hourly.select(
        "time", "device", "interface",
        F.when(F.col("device") == 9, "x").when(F.col("device") == 8, "1").otherwise("280")
        .alias("link_type"), F.sum("_b").over(running).alias("rx_bytes"))


def points(ev: DataFrame, *more: str, time: Column | None = None) -> DataFrame:
    """Positions at whole minutes, or at the time given; ``more`` names columns of the events to keep."""
    at = F.date_trunc("minute", "time") if time is None else time
    return ev.select(
        "id", (F.col("user_id") % 50).alias("device"), at.alias("time"), *more,
        (F.lit(40.0) + (F.col("id") % 2000).cast("double") / F.lit(1000.0)).alias("lat"),
        (F.lit(-87.0) + (F.col("user_id") % 100).cast("double") / F.lit(100.0)).alias("lon"))


def sent_log(ev: DataFrame) -> DataFrame:
    return points(ev.where("value < 30")).select("device", "time").distinct()


def ledger_changes(ev: DataFrame) -> DataFrame:
    """Inserts, deletes and marks of points at whole hours, some without a device or of no known kind."""
    op = _by_type({"error": "delete", "purchase": "sent"}, F.lit("insert"))
    unknown = (F.col("event_type") == "signup") & (F.col("id") % 10 == 0)
    return ev.select(
        F.col("id").alias("seq"), F.when(unknown, F.lit("update")).otherwise(op).alias("op"),
        F.when(F.col("value") < 2, F.lit(None)).otherwise(F.col("user_id") % 5).alias("device"),
        F.date_trunc("hour", "time").alias("time"))


def probes(ev: DataFrame) -> DataFrame:
    return ev.select(
        "id", F.col("user_id").alias("device"), "time", (F.col("event_type") != "error").alias("ok"))


def labels(spark: SparkSession, sf_dir: str, ev: DataFrame) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("_n"), F.col("n_name").alias("label"))
    return (ev.select(F.col("user_id").alias("device")).distinct()
            .join(nations, F.col("device") % 25 == F.col("_n")).select("device", "label"))


def readings(ev: DataFrame) -> DataFrame:
    return ev.select(
        "id", F.col("user_id").alias("device"), F.lit("sms").alias("subject"), "time",
        F.when(F.col("value") >= 50, 1).otherwise(0).alias("reading"))


def subscription_requests(ev: DataFrame) -> DataFrame:
    start = F.when(F.col("user_id") % 7 == 0, "0").otherwise("+1765555")
    return ev.select(
        "id", "time", F.concat(start, F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("phone"))


def subscribers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subscribers of a machine."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") % 150).alias("device"),
        F.concat(F.lit("+1765"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")).alias("phone"))


def modem(ev: DataFrame) -> DataFrame:
    return ev.select(
        F.col("user_id").alias("device"), "time",
        F.when(F.col("event_type") != "error", -F.col("value")).alias("lte_rssi"),
        F.when(F.col("value") >= 20, -F.col("value") - 1).alias("umts_rssi"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("block_id"), F.col("vec_id").alias("frame"),
        F.col("label").alias("device"), F.col("embedding").alias("samples"))


def spectrum_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = spectrum_vectors(blocks(spark, sf_dir), window=None, shift=False)
    fft = F.transform(F.arrays_zip("re", "im"),
                      lambda c: quantise_u16(magnitude(c["re"], c["im"]), 1000.0))
    return level.select("block_id", F.to_json(F.struct(
        spectrum_encode(fft).alias("fft"), F.lit(98.7e6).alias("fc"), F.lit(0.0).alias("gain"),
        F.lit(2.0e6).alias("span"), F.size(fft).alias("fft_size"),
        F.lit(False).alias("stream"))).alias("body"))


def replay_expected(ev: DataFrame) -> DataFrame:
    return ev.select(make_subject("gps", "event_type").alias("subject"), F.col("props").alias("body"))


def replay_received(ev: DataFrame) -> DataFrame:
    arrived = ev.where("value >= 3")
    return replay_expected(arrived).unionByName(replay_expected(ev.where("value > 150")))


def replay_sent_at(ev: DataFrame) -> DataFrame:
    return ev.select(make_subject("gps", "event_type").alias("subject"), F.col("props").alias("body"), "time")


def replay_received_at(ev: DataFrame) -> DataFrame:
    """What arrives two seconds later, without the lost, and some of it once more."""
    later = ev.withColumn("time", F.col("time") + F.expr("INTERVAL 2 SECONDS"))
    again = ev.withColumn("time", F.col("time") + F.expr("INTERVAL 5 SECONDS"))
    return replay_sent_at(later.where("value >= 3")).union(replay_sent_at(again.where("value > 150")))


def gpsd_lines(ev: DataFrame) -> DataFrame:
    """Reports as JSON lines; those of value under 2 are cut short."""
    device = (F.col("user_id") % 50).cast("string")
    lat = F.lit(40.0) + (F.col("id") % 2000).cast("double") / F.lit(1000.0)
    lon = F.lit(-87.0) + (F.col("user_id") % 100).cast("double") / F.lit(100.0)
    stamp = F.date_format(F.date_trunc("second", "time"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    seconds = F.unix_seconds("time")
    tpv = F.to_json(F.struct(
        F.lit("TPV").alias("class"), device.alias("device"),
        F.when(F.col("event_type") != "error", 3).alias("mode"), stamp.alias("time"),
        lat.alias("lat"), lon.alias("lon"), F.col("value").alias("altHAE"),
        F.lit("unused").alias("extra")))
    sky = F.to_json(F.struct(
        F.lit("SKY").alias("class"), device.alias("device"), F.col("value").alias("gdop"),
        (F.col("id") % 12).alias("nSat"),
        F.array(F.struct(
            F.lit(1).alias("PRN"), F.lit(26).alias("el"), (F.col("id") % 360).alias("az"),
            F.lit(17).alias("ss"), F.lit(True).alias("used"), F.lit(0).alias("gnssid"),
            F.lit(1).alias("svid"))).alias("satellites")))
    pps = F.to_json(F.struct(
        F.lit("PPS").alias("class"), device.alias("device"), seconds.alias("real_sec"),
        F.lit(0).alias("real_nsec"), seconds.alias("clock_sec"),
        (F.unix_micros("time") % 1000000 * 1000).alias("clock_nsec"),
        F.lit(-10).alias("precision"), (F.col("id") % 100).alias("qErr")))
    text = F.when(F.col("event_type") == "signup", sky).when(
        F.col("event_type") == "purchase", pps).otherwise(tpv)
    cut = F.when(F.col("value") < 2, F.substring(text, F.lit(1), F.length(text) - 5)).otherwise(text)
    return ev.select("id", F.col("time").alias("systime"), cut.alias("body"))


def gateway_lines(ev: DataFrame) -> DataFrame:
    """Gateway text; frames of value under 2 are cut short."""
    us = F.unix_micros("time")
    line = F.concat(
        F.lit("< frame "), hex_text("can_id"),
        F.format_string(" %d.%06d ", F.floor(us / F.lit(1000000)).cast("bigint"), us % 1000000),
        F.col("data"), F.lit(" >"))
    short = F.conv(F.substring("data", 11, 6), 16, 10).cast("bigint") < 200
    return frames(ev).select("id", "can_interface", F.when(
        short, F.substring(line, 1, 20)).otherwise(line).alias("value"))


def interfaces(spark: SparkSession, ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    requested = spark.createDataFrame([("can0",), ("can1",), ("can9",)], "interface string")
    return requested, frames(ev).select(F.col("can_interface").alias("interface"))


# The same payloads read high byte first, and fields that the low bits of byte 4 choose. Fixed values.
LAYOUT_DBC = """BO_ 2364540158 Clicks: 8 ECU
 SG_ Kind M : 32|2@1+ (1,0) [0|3] "" ECU
 SG_ Whole m0 : 47|24@0+ (0.25,0) [0|4194303.75] "" ECU
 SG_ Short m1 : 55|16@0- (1,0) [-32768|32767] "" ECU
 SG_ Nibble m2 : 59|4@0+ (2,-1) [-1|29] "" ECU
 SG_ Byte m2 : 56|8@1+ (1,0) [0|255] "" ECU

BO_ 2566844926 Views: 8 ECU
 SG_ Level : 47|24@0+ (1,0) [0|16777215] "" ECU
 SG_ Mixed : 36|13@0- (1,0) [-4096|4095] "" ECU
"""


def layout_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary of big-endian and selected signals, written as DBC text and read back."""
    spark.createDataFrame([(LAYOUT_DBC,)], "value string").coalesce(1).write.text(path)
    return read_signal_dictionary(spark, path)


def dbc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as message blocks of DBC text, each with a comment on one signal."""
    # PDU format 240 and up: a broadcast group; the top bit marks an extended id.
    number = F.lit(2147483648) + F.lit(6 * 67108864) + (F.lit(61440) + F.col("p_partkey") % 4096) * 256
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.format_string(
        'BO_ %d M%d: 8 Vector__XXX\n'
        ' SG_ Size%d : %d|8@1+ (0.5,-40) [-40|85] "deg" Vector__XXX\n'
        ' SG_ Price%d : 16|32@1+ (0.1,0) [0|429496729.5] "" Vector__XXX\n'
        ' SG_ Motor%d : 48|8@0- (1,0) [-128|127] "" Vector__XXX\n'
        ' SG_ Trim%d : 56|8@1- (1,0) [-128|127] "" Vector__XXX\n'
        ' SG_ Page%d M : 0|4@1+ (1,0) [0|15] "" Vector__XXX\n'
        ' SG_ Deep%d m%d : 15|12@0+ (1,0) [0|4095] "" Vector__XXX\n'
        ' SG_ Broken%d : 0|65@1+ (1,0) [0|1] "" Vector__XXX\n\n'
        'CM_ SG_ %d Size%d "%s";\n',
        number, key, key, F.pmod(F.col("p_size"), F.lit(8)) * 8, key, key, key, key, key,
        F.pmod(F.col("p_size"), F.lit(16)), key, number, key,
        F.col("p_name")).alias("value"))
