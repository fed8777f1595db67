"""Streams over many keys: buckets walk them together, slices are computed once."""

import pytest
from pyspark.sql import functions as F

from harrow import operators as op
from harrow import streaming as st
from harrow.plans import stream_queries
from harrow.streaming.keyed import BUCKETS
from tests.conftest import rows
from tests.test_event_time import run


def test_state_is_kept_by_bucket(spark, tmp_path):
    """More devices than buckets, one without a number, and one number beyond what a float holds."""
    n = BUCKETS + 200
    data = spark.range(3 * n).select(
        "id", F.when(F.col("id") % n == 7, 2 ** 53 + 1).when(F.col("id") % n != 5, F.col("id") % n).alias("device"),
        F.timestamp_seconds(F.col("id") * 7 % 1000 + (F.col("id") / n).cast("int") * 1000).alias("time"),
        (F.col("id") * 31 % 5 > 1).alias("ok"))
    for k in range(3):
        data.where((F.col("id") / n).cast("int") == k).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
        query = st.run_append(st.stream_online_transitions(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert rows(got) == rows(op.online_transitions(data).select(got.columns))
    # The one without a number is in a bucket of its own.
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= BUCKETS + 1


def test_greedy_statistics_of_two_keys_in_a_bucket(spark, tmp_path):
    """The open interval of each key goes on from its own state."""
    data = spark.createDataFrame(
        [(i, i % 3, f"s{i % 2}", i * 400 + i % 7, float(i)) for i in range(3 * BUCKETS)],
        "id bigint, device int, name string, ms bigint, value double").select(
        "id", (F.col("device") + F.col("id") / 1000 * 3).cast("int").alias("device"), "name",
        F.timestamp_millis("ms").alias("time"), "value")
    for k in range(2):
        data.where((F.col("id") > BUCKETS) == bool(k)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in")
        st.run_append(st.stream_signal_stats_greedy(stream, 5.0), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out")
    want = op.signal_stats_greedy(data, 5.0)
    assert rows(got) == rows(want.select(got.columns)) and got.count() > 100


@pytest.mark.parametrize("n", [0, 400])
def test_slices_are_dealt_in_one_pass(spark, n):
    """Rows are computed to count them, to cut them and to deal them, not once a slice."""
    seen = spark.sparkContext.accumulator(0)

    def counted(chunks):
        for chunk in chunks:
            seen.add(len(chunk))
            yield chunk

    data = spark.range(n).select("id", F.timestamp_seconds("id").alias("time"))
    data = data.mapInPandas(counted, data.schema)
    sizes = []
    base = stream_queries.fed(data, "slices", lambda stream, at: sizes.append(spark.read.schema(
        data.schema).parquet(at + "/in").agg(F.count("*"), F.max("id")).first()))
    assert seen.value <= 3 * n
    assert [tuple(s) for s in sizes] == ([(k, k - 1) for k in (100, 200, 300, 400)] if n else [(0, None)])
    assert rows(spark.read.parquet(base + "/in")) == rows(data)


def test_devices_beside_a_null_keep_their_numbers_and_state_in_event_order(spark, tmp_path):
    second = 1_000_000
    data = [(i, None if i % 5 == 0 else 2 ** 53 + 1 + i % 5, (i + 1) * second, i % 3 > 0) for i in range(60)]
    schema = "id bigint, device bigint, us bigint, ok boolean"
    parts = [spark.createDataFrame(p, schema).select("id", "device", F.timestamp_micros("us").alias("time"), "ok")
             for p in (data[:30], data[30:], [(99, 1, 10 ** 10, True)])]
    out, _ = run(spark, str(tmp_path), parts, 5, lambda df: st.stream_online_transitions(df, {"delay": "5 seconds"}))
    want = op.online_transitions(parts[0].union(parts[1]))
    assert rows(out) == rows(want.select(out.columns))
