"""Readers, tables and scratch folders where the input is not as it should be."""

import pytest
from pyspark.sql import functions as F

from harrow import sinks, sources
from harrow.session import refuse_local
from tests.conftest import rows


def test_outsized_numbers_end_no_job(spark):
    good = '{"timestamp":1.5,"pgn":"f004","saddr":"21","sname":"1","priority":"6","data":"00ff"}'
    bad = [good.replace('"21"', '"1ffff"'), good.replace('"f004"', '"12345678901234567890"'), good[:30],
           good.replace("1.5", "1e300").replace('"21"', '"zz"'), None]
    df = spark.createDataFrame(list(enumerate([good, *bad])), "id int, body string")
    good_rows, rejects = sources.split_rejects(df, sources.read_raw_frames, ("pgn", "source"))
    assert rows(good_rows.select("id", "pgn", "source")) == [(0, 0xF004, 0x21)]
    assert rows(rejects) == [(i + 1, b) for i, b in enumerate(bad)]


def test_gateway_lines(spark):
    lines = ["< frame 123 1600000000.5  >", "< frame 123 1600000000.5 abc >",
             "< frame 123 12345678901234567890 ab >", "< frame 1F 1.25 ab >"]
    df = spark.createDataFrame([(t,) for t in lines], "value string").withColumn("can_interface", F.lit("can0"))
    good, bad = sources.parse_can_text(df)
    assert rows(good.select("can_id", "can_data")) == [("123", ""), ("1F", "ab")]
    assert sorted(r[0] for r in bad.select("value").collect()) == sorted(lines[1:3])


def test_a_repeated_batch_with_nulls_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS device, TIMESTAMP'2024-01-05 10:00:00' AS time")
    for _ in range(3):
        sinks.write_hypertable(df, path, unique=["device", "time"], order="id")
    assert spark.read.parquet(path).count() == 1


def test_a_window_lists_its_days_only(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(60).select("id", F.expr("TIMESTAMP'2024-01-01 10:00:00' + make_interval(0, 0, 0, id)").alias("time"))
    sinks.write_hypertable(df, path)
    one = sources.read_table_window(spark, path, "2024-01-31", "2024-01-31T23:00:00", ["id"])
    assert rows(one) == [(30,)] and len(one.inputFiles()) == 1
    assert sources.read_table_window(spark, path, "2025-01-31", "2025-02-01", ["id"]).count() == 0


def test_no_folder_of_the_driver_on_a_cluster():
    refuse_local("local[4]", "file:/tmp/warehouse")
    refuse_local("yarn", "s3a://bucket/warehouse")
    for base in ("file:/tmp/warehouse", "/tmp/warehouse", "spark-warehouse"):
        with pytest.raises(ValueError):
            refuse_local("spark://host:7077", base)
