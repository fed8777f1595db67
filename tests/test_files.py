from pathlib import Path

import pytest
from pyspark.sql import functions as F

from harrow import operators as op
from harrow import schemas, sinks, sources
from harrow.plans import flows
from tests.conftest import rows
from tests.test_gps import points


def bus_rows(spark, n=40):
    return spark.range(n).select(
        F.timestamp_micros(F.col("id") * 600_000_001).alias("time"),
        F.concat(F.lit("can"), F.col("id") % 2).alias("can_interface"),
        F.lower(F.hex("id")).alias("can_id"), F.lit("0102").alias("can_data"))


def test_rotated_csv(spark, tmp_path):
    df = bus_rows(spark)
    for period, interval, folders in ((1, "h", 14), ("2", "H", 8), (1, "x", 2)):
        path = str(tmp_path / f"log{folders}")
        sinks.write_can_csv_rotated(df, path, period, interval)
        names = {p.parent.name for p in Path(path).rglob("*.csv")}
        assert len(names) == folders
        assert rows(sources.read_can_csv(spark, path)) == rows(df)
    assert "rotation=can1" in names
    hourly = {p.parent.name for p in Path(tmp_path / "log14").rglob("*.csv")}
    assert "rotation=can0-1970-01-01-01-00" in hourly


def test_gateway_text(spark, tmp_path):
    lines = [("can0", "< frame 18FEF100 1619124803.000001 0102030405060708 >"),
             ("can0", "< frame 123 23.424242 11 >"), ("can0", "< ok >"), ("can0", None),
             ("can0", "< frame 18FEF100 1619124803.0"), ("can0", "")]
    df = spark.createDataFrame(lines, "can_interface string, value string")
    good, bad = sources.parse_can_text(df)
    assert rows(good.select(F.unix_micros("time"), "can_id", "can_data")) == [
        (23424242, "123", "11"), (1619124803000001, "18FEF100", "0102030405060708")]
    assert bad.count() == 4
    rejects = flows.gateway_text_to_logs(df, str(tmp_path / "csv"), str(tmp_path / "table"))
    assert rejects.count() == 4
    assert sources.read_can_csv(spark, str(tmp_path / "csv")).count() == 2
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "a.dbc").write_text("""VERSION ""

BU_: ECU

BO_ 2364540158 EEC1: 8 ECU
 SG_ EngineSpeed m0 : 24|16@1+ (0.125,0) [0|8031.875] "rpm" ECU
 SG_ Speed : 24|16@1+ (0.125,0) [0|8031.875] "rpm" ECU
 SG_ Torque : 16|8@1- (1,-125) [-125|125] "%" Vector__XXX

BO_ 2565865249 ERC: 8 ECU
 SG_ State : 0|4@1+ (1,0) [0|15] "" ECU

CM_ BO_ 2364540158 "a message";
CM_ SG_ 2364540158 Speed "Actual engine speed";
""")
    (tmp_path / "b.dbc").write_text('BO_ 2566844926 CCVS: 8 X\n SG_ Wheel : 8|16@1+ (3.90625E-3,0) [0|250.996] "km/h" X')
    read = sources.read_signal_dictionary(spark, str(tmp_path / "*.dbc"))
    assert read.where("big_endian OR selector IS NOT NULL").isEmpty()
    got = rows(read.select(*schemas.DICTIONARY.fieldNames()))
    assert got == [
        (0xEF00, "State", None, "", 0, 4, 1.0, 0.0, 0.0, 15.0, False),
        (61444, "Speed", "Actual engine speed", "rpm", 24, 16, 0.125, 0.0, 0.0, 8031.875, False),
        (61444, "Torque", None, "%", 16, 8, 1.0, -125.0, -125.0, 125.0, True),
        (65265, "Wheel", None, "km/h", 8, 16, 0.00390625, 0.0, 0.0, 250.996, False)]


def test_dictionary_rejects(spark, tmp_path):
    (tmp_path / "a.dbc").write_text("""BO_ 2364540158 EEC1: 8 ECU
 SG_ Gear m0 : 24|16@1+ (0.125,0) [0|8031.875] "rpm" ECU
 SG_ Mode M : 0|2@1+ (1,0) [0|3] "" ECU
 SG_ Motor : 7|16@0+ (1,0) [0|65535] "" ECU
 SG_ Wide : 0|65@1+ (1,0) [0|1] "" ECU
 SG_ None : 0|0@1+ (1,0) [0|1] "" ECU
 SG_ Far : 99999999999|8@1+ (1,0) [0|1] "" ECU
 SG_ Odd : 0|8@1+ (1e,0) [0|1] "" ECU
 SG_ Good : 0|8@1- (1,0) [-128|127] "" ECU

CM_ SG_ 2364540158 Good "SG_ in a comment";
""")
    path = str(tmp_path / "*.dbc")
    columns = ["name", "signed", "big_endian", "selector", "selector_start", "selector_value"]
    assert rows(sources.read_signal_dictionary(spark, path).select(*columns)) == [
        ("Gear", False, False, "Mode", 0, 0), ("Good", True, False, None, None, None),
        ("Mode", False, False, None, None, None), ("Motor", False, True, None, None, None)]
    lines = sources.signal_dictionary_rejects(spark, path).select(F.split("line", " ")[1].alias("name"))
    assert rows(lines) == [("Far",), ("None",), ("Odd",), ("Wide",)]


@pytest.mark.parametrize("selectors", ["", " SG_ A M : 0|2@1+ (1,0) [0|3] \"\" X\n SG_ B M : 2|2@1+ (1,0) [0|3] \"\" X\n",
                                       " SG_ A m0M : 0|2@1+ (1,0) [0|3] \"\" X\n"])
def test_signals_without_one_selector_are_rejected(spark, tmp_path, selectors):
    (tmp_path / "a.dbc").write_text(f"BO_ 2364540158 E: 8 X\n{selectors} SG_ Gear m0 : 24|16@1+ (1,0) [0|9] \"\" X\n")
    lines = sources.signal_dictionary_rejects(spark, str(tmp_path / "*.dbc")).select(F.split("line", " ")[1])
    assert ("Gear",) in rows(lines)
    assert "Gear" not in [r.name for r in sources.read_signal_dictionary(spark, str(tmp_path / "*.dbc")).collect()]


def test_dictionaries_of_two_buses(spark, tmp_path):
    line = 'BO_ 2566844926 CCVS: 8 X\n SG_ Wheel : {}|8@1{} (1,0) [-128|300] "" X'
    (tmp_path / "can0.dbc").write_text(line.format(0, "+"))
    (tmp_path / "can1.dbc").write_text(line.format(8, "-"))
    (tmp_path / "can1-copy.dbc").write_text(line.format(8, "-"))
    path = str(tmp_path / "*.dbc")
    frames = spark.createDataFrame(
        [("can0", 65265, "f1f2"), ("can1", 65265, "f1f2"), ("can2", 65265, "f1f2")],
        "can_interface string, pgn int, data string")
    bus = F.regexp_extract("_file", r"(can\d+)[^/]*$", 1)
    apart = sources.read_signal_dictionary(spark, path, bus)
    assert apart.count() == 2
    assert rows(op.signal_decode(frames, apart).select("can_interface", "value")) == [
        ("can0", 241.0), ("can1", -14.0)]
    with pytest.raises(ValueError, match="more than once"):
        op.signal_decode(frames, sources.read_signal_dictionary(spark, path))
    alike = sources.read_signal_dictionary(spark, str(tmp_path / "can1*.dbc"))
    assert rows(op.signal_decode(frames, alike).select("can_interface", "value")) == [
        ("can0", -14.0), ("can1", -14.0), ("can2", -14.0)]


def test_table_is_unique_and_pruned(spark, tmp_path):
    path = str(tmp_path / "t")
    p = points(spark, [10, 10, 90_000, 180_000])
    for _ in range(2):
        sinks.write_hypertable(p, path, unique=["device", "time"], order="id")
    sinks.write_hypertable(points(spark, [10, 95_000]), path, unique=["device", "time"], order="id")
    assert rows(spark.read.parquet(path).select("id", F.unix_seconds("time"))) == [
        (0, 10), (1, 95_000), (2, 90_000), (3, 180_000)]
    window = sources.read_table_window(spark, path, "1970-01-02 00:00:00", "1970-01-02 02:00:00", ["time", "lat"])
    assert rows(window.select(F.unix_seconds("time"))) == [(90_000,)]
    plan = window._jdf.queryExecution().executedPlan().toString()
    # Only the day's folder is listed at all.
    assert all("day=1970-01-02" in f for f in window.inputFiles())
    assert "PushedFilters: [IsNotNull(time)" in plan
    assert "lon" not in plan


def test_constrained_reports(spark, tmp_path):
    p = points(spark, [10, 10, 20]).withColumn("lat", F.when(F.col("id") != 2, F.col("lat")))
    refused = flows.reports_to_table(p, str(tmp_path / "r"), ["lat"], ["device", "time"], "id")
    assert rows(refused.select("id", "reason")) == [(1, "duplicate device,time"), (2, "null lat")]
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_routes(spark, tmp_path):
    df = spark.createDataFrame([("a.b", "1"), ("a.b", "2"), ("a.c", "3")], "subject string, body string")
    sinks.write_by_subject(df, str(tmp_path / "m"))
    got = spark.read.text(str(tmp_path / "m")).select("subject", "value")
    assert rows(got) == [("a.b", "1"), ("a.b", "2"), ("a.c", "3")]
    assert rows(op.signal_keys(df)) == [("a.b",), ("a.c",)]


def test_batches_keep_the_short_one(spark):
    df = spark.range(2345).select("id", F.lit("can0").alias("can_interface"), F.timestamp_seconds("id").alias("time"))
    for limit in (None, 400):
        got = op.batch_rows(df, ("can_interface",), max_rows=limit).groupBy("batch_id").count()
        assert rows(got) == [(0, 1000), (1, 1000), (2, 345)]


def test_messages_keep_absent_options(spark):
    frame = spark.createDataFrame(
        [(65265, 3, -2, None, None, 6, "01ff")],
        "pgn int, source int, source_name bigint, destination int, destination_name bigint, priority int, data string"
    ).withColumn("time", F.timestamp_micros(F.lit(1619124803000001)))
    message = op.frame_to_message(frame)
    row = message.first()
    assert row["subject"] == "j1939.raw.65265"
    assert '"pgn":"fef1"' in row["body"] and '"daddr":null' in row["body"] and '"sname":"fffffffffffffffe"' in row["body"]
    back = sources.read_raw_frames(message).first()
    assert (back["source_name"], back["destination"], bytes(back["data"])) == (-2, None, b"\x01\xff")
    tuner = spark.createDataFrame([('{"ft":1,"fc":2,"gain":3,"stream":true}',)], "body string")
    assert tuple(sources.read_tuner(tuner).first()) == (1, 2, 3, True)


def test_missing_message_source(spark):
    with pytest.raises(Exception):
        sources.message_stream(spark, "kafka", subscribe="gps").schema
