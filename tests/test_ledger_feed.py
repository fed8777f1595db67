import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from harrow import operators as op
from harrow import streaming as st
from harrow.streaming import ledger_feed
from tests.conftest import rows

FEED = "seq bigint, op string, device bigint, time timestamp"
START = datetime(2024, 1, 1)


def feed(n, seed, devices=3, hours=60):
    r = random.Random(seed)
    return [(i, r.choice(["insert", "insert", "delete", "sent"]), r.randrange(devices),
             START + timedelta(hours=r.randrange(hours))) for i in range(n)]


def in_order(changes):
    """The ledger by one pass over the changes in order."""
    held = {}
    for _, kind, *key in sorted(changes):
        key = tuple(key)
        if kind == "insert":
            held[key] = False
        elif kind == "delete":
            held.pop(key, None)
        elif key in held:
            held[key] = True
    return sorted((*k, s) for k, s in held.items())


def test_ledger_is_that_of_one_pass_in_order(spark):
    changes = feed(3000, 1)
    assert rows(op.ledger_from_feed(spark.createDataFrame(changes, FEED))) == in_order(changes)
    assert rows(op.ledger_from_feed(spark.createDataFrame([], FEED))) == []


def test_changes_that_say_nothing_are_told_apart(spark):
    t = START
    data = [(1, "insert", 1, t), (None, "insert", 1, t), (2, None, 1, t), (3, "insert", None, t),
            (4, "sent", 1, None), (5, "update", 1, t)]
    good, bad = op.feed_split(spark.createDataFrame(data, FEED))
    assert good.count() == 1
    assert sorted(r.reason for r in bad.collect()) == [
        "null device", "null op", "null seq", "null time", "unknown op update"]


@pytest.mark.parametrize("seed", [1, 2])
def test_any_batches_in_any_order_give_one_ledger(spark, tmp_path, seed):
    changes, r, path = feed(900, seed), random.Random(seed), str(tmp_path)
    batches = [[] for _ in range(5)]
    for c in changes:
        for k in r.sample(range(5), r.choice([1, 1, 2])):   # some come in two batches
            batches[k].append(c)
    for k, batch in enumerate(batches):
        r.shuffle(batch)
        for _ in range(r.choice([1, 2])):                    # some batches are written twice
            st.write_feed_batch(spark.createDataFrame(batch, FEED), path, k)
        if r.random() < 0.6:
            st.merge_days(spark, path)
    assert rows(st.read_ledger(spark, path)) == in_order(changes)
    assert st.merge_days(spark, path) == 4
    assert rows(st.read_ledger(spark, path)) == in_order(changes)
    since = date(2024, 1, 2)
    assert rows(st.read_ledger(spark, path, since=since)) == [
        x for x in in_order(changes) if x[1].date() >= since]


def test_a_merge_cut_short_changes_nothing_and_is_done_again(spark, tmp_path, monkeypatch):
    changes, path = feed(400, 5), str(tmp_path)
    first, second = changes[:200], changes[200:]
    st.write_feed_batch(spark.createDataFrame(first, FEED), path, 0)
    assert st.merge_days(spark, path) == 0
    st.write_feed_batch(spark.createDataFrame(second, FEED), path, 1)
    written = ledger_feed._by_day

    def dies(folds, to):
        written(folds.where("device = 0"), to)      # some of the days are there, no pointer is
        raise RuntimeError("lost")

    monkeypatch.setattr(ledger_feed, "_by_day", dies)
    with pytest.raises(RuntimeError):
        st.merge_days(spark, path)
    monkeypatch.undo()
    assert ledger_feed.merged_up_to(spark, path) == 0
    assert rows(st.read_ledger(spark, path)) == in_order(changes)
    assert st.merge_days(spark, path) == 1
    assert rows(st.read_ledger(spark, path)) == in_order(changes)


def test_merges_and_reads_touch_the_newest_days_and_the_tail_alone(spark, tmp_path):
    path = str(tmp_path)
    assert st.read_ledger(spark, path).count() == 0 and st.merge_days(spark, path) == -1
    at = [START + timedelta(days=k) for k in range(3)]
    for k, days in enumerate([at, at[:1], at[2:]]):
        changes = [(10 * k + i, "insert", 1, t) for i, t in enumerate(days)]
        st.write_feed_batch(spark.createDataFrame(changes, FEED), path, k)
        if k < 2:
            st.merge_days(spark, path)
    written = spark.read.parquet(path + "/days").groupBy("upto").agg(F.count_distinct("day")).collect()
    assert {tuple(r) for r in written} == {(0, 3), (1, 1)}
    # What reads take: of the merged days the newest form each, of the folds the one after them.
    upto = ledger_feed.merged_up_to(spark, path)
    merged = ledger_feed._merged(spark, path, "bigint", upto).select("day", "upto").distinct()
    assert rows(merged) == [(at[0].date(), 1), (at[1].date(), 0), (at[2].date(), 0)]
    tail = ledger_feed._tail(spark, path, "bigint", upto)
    assert {f.split("/deltas/")[1].split("/")[0] for f in tail.inputFiles()} >= {"batch=2"}
    assert "PartitionFilters: [isnotnull(batch" in tail._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert rows(st.read_ledger(spark, path).select(F.to_date("time"))) == [(t.date(),) for t in at]


def test_stream_with_empty_batches_and_rejects(spark, tmp_path):
    changes, base = feed(300, 9), str(tmp_path)
    parts = [changes[200:], [], changes[:100], changes[100:200], changes[:100], [(None, "insert", 1, START)]]
    for part in parts:
        spark.createDataFrame(part, FEED).coalesce(1).write.mode("append").parquet(base + "/in")
        st.stream_ledger_feed(spark.readStream.schema(FEED).parquet(base + "/in"), base + "/ledger",
                              base + "/checkpoint", merge_every=2)
    assert rows(st.read_ledger(spark, base + "/ledger")) == in_order(changes)
    assert spark.read.parquet(base + "/ledger/rejects").count() == 1


POINTS = "id bigint, device bigint, time timestamp, lat double"


def test_stream_constraints_take_the_lowest_id_whatever_comes_first(spark, tmp_path):
    base, late = str(tmp_path), START + timedelta(days=9)
    data = [(i, i % 2, START + timedelta(hours=i % 7), None if i % 5 == 4 else 1.0) for i in range(60)]
    data += [(100, None, START, 1.0), (101, 1, None, 1.0)]
    df = spark.createDataFrame(data, POINTS)
    accepted, rejected = op.constraint_split(df, ["lat"], ["device", "time"], "id")
    want = sorted([(r.id, None) for r in accepted.collect()] + [(r.id, r.reason) for r in rejected.collect()])

    random.Random(4).shuffle(data)
    for part in (data[:20], data[20:41], data[41:], [(999, 0, late, 1.0)]):
        spark.createDataFrame(part, POINTS).coalesce(1).write.mode("append").parquet(base + "/in")
        st.run_append(st.stream_constraint_split(
            spark.readStream.schema(POINTS).parquet(base + "/in"), ["lat"], ["device", "time"], "id", "2 days"),
            base + "/out", base + "/checkpoint")
    got = spark.read.parquet(base + "/out").where("id < 999").select("id", "reason").collect()
    assert sorted((r.id, r.reason) for r in got) == want
    with pytest.raises(ValueError):
        st.stream_constraint_split(df, [], ["device"], "id", "1 day")
