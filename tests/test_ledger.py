from datetime import date

from pyspark.sql import functions as F

from harrow import functions as fn
from harrow import operators as op
from harrow import streaming as st
from tests.conftest import rows
from tests.test_gps import points


def log_of(spark, *seconds):
    return spark.createDataFrame([(1, s) for s in seconds], "device bigint, s int").select(
        "device", F.timestamp_seconds("s").alias("time"))


def seconds(df):
    return [r[0] for r in rows(df.select(F.unix_seconds("time")))]


def test_ledger_views(spark):
    p, log = points(spark, [1, 2, 2, 3]), log_of(spark, 2, 9)
    assert rows(op.ledger_insert(p, log).select(F.unix_seconds("time"), "sent")) == [
        (1, False), (2, True), (3, False)]
    assert seconds(op.ledger_backfill(p, log)) == [1, 3]
    assert seconds(op.ledger_prune(log, p)) == [2]
    assert seconds(op.unsent_points(p, log, 1)) == [3]


def test_failed_paths_stay_unsent(spark):
    p = points(spark, [1, 2, 90_000]).withColumns(
        {"day": fn.day_of("time"), "geohash": fn.geohash("lat", "lon")})
    failed = p.where("day = '1970-01-02'").select("device", "day", "geohash")
    log = op.upload_retry(p, log_of(spark), failed)
    assert seconds(log) == [1, 2]
    assert seconds(op.upload_retry(p, log, failed.limit(0))) == [1, 2, 90_000]


def test_uploads_take_the_newest_and_lose_nothing(spark, tmp_path):
    p = points(spark, range(25))
    place = {k: str(tmp_path / k) for k in ("sent", "docs")}
    turn, taken = 0, []
    failed = p.where("id < 3").select("device", fn.day_of("time").alias("day"), fn.geohash("lat", "lon").alias("geohash"))
    # Every path fails at first: nothing is logged.
    assert st.upload_once(p, place["sent"], place["docs"], str(tmp_path / "s"), 10, failed) == 10
    assert spark.read.schema("device bigint, time timestamp, day date").parquet(place["sent"]).count() == 0
    while n := st.upload_once(p, place["sent"], place["docs"], str(tmp_path / f"s{turn}"), 10):
        taken.append((n, min(seconds(spark.read.parquet(str(tmp_path / f"s{turn}"))))))
        turn += 1
    assert taken == [(10, 15), (10, 5), (5, 0)]
    assert seconds(spark.read.parquet(place["sent"])) == list(range(25))
    ids = spark.read.schema("data map<string, struct<id: string>>, day string").json(place["docs"])
    assert ids.select(F.explode("data")).select("key").distinct().count() == 25


def test_stream_uploads_every_batch(spark, tmp_path):
    feed = str(tmp_path / "feed")
    for part in ([1, 2], [90_000, 3], [180_000, 90_001]):
        points(spark, part).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(spark.read.parquet(feed).schema).option(
        "maxFilesPerTrigger", 1).parquet(feed)
    place = {k: str(tmp_path / k) for k in ("table", "sent", "docs", "staging", "check")}
    st.stream_trail_upload(stream, *place.values())
    assert seconds(spark.read.parquet(place["sent"])) == [1, 2, 3, 90_000, 90_001, 180_000]
    ids = spark.read.schema("data map<string, struct<id: string>>, day string").json(place["docs"])
    assert ids.select(F.explode("data")).count() == 6
    # A later sweep finds nothing more; one bounded by day reads only those days.
    stored = spark.read.parquet(place["table"]).drop("day")
    for since in (None, date(1970, 1, 3)):
        assert st.upload_once(stored, place["sent"], place["docs"], str(tmp_path / "again"), since=since) == 0


def test_stream_upload_of_failed_and_repeated_batches(spark, tmp_path):
    feed = str(tmp_path / "feed")
    for part in ([1, 2], [90_000], [180_000], [270_000]):
        points(spark, part).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(spark.read.parquet(feed).schema).option(
        "maxFilesPerTrigger", 1).parquet(feed)
    place = {k: str(tmp_path / k) for k in ("table", "sent", "docs", "staging", "check")}
    paths = points(spark, [1, 2]).select(
        "device", fn.day_of("time").alias("day"), fn.geohash("lat", "lon", 7).alias("geohash")).distinct()

    def failing(session, batch):
        return paths if batch < 2 else paths.limit(0)

    def documents():
        docs = spark.read.schema("data map<string, struct<id: string>>, day string").json(place["docs"])
        return docs.select(F.explode("data")).select("key").count()

    st.stream_trail_upload(stream, *place.values(), failing=failing)
    # The first day fails twice, is far from the days that follow and goes with the third batch.
    assert seconds(spark.read.parquet(place["sent"])) == [1, 2, 90_000, 180_000, 270_000]
    assert documents() == 5
    for name in ("3", ".3.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    st.stream_trail_upload(stream, *place.values(), failing=failing)
    assert seconds(spark.read.parquet(place["sent"])) == [1, 2, 90_000, 180_000, 270_000]
    assert documents() == 5
    assert spark.read.parquet(place["table"]).count() == 5
