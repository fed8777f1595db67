import json
import random
import xml.etree.ElementTree as ET
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from harrow import operators as op
from harrow import sinks, sources
from harrow.plans import flows
from tests.conftest import rows

TPV = ('{"class":"TPV","device":"/dev/serial7","mode":2,"time":"2022-06-01T05:06:07.500Z","lat":-33.25,'
       '"lon":151.5,"altHAE":12.75,"speed":3.5}')
SKY = ('{"class":"SKY","device":"/dev/serial7","gdop":1.25,"satellites":[{"PRN":5,"el":41,"az":12,"ss":33,'
       '"used":true,"gnssid":2,"svid":5},{"PRN":21,"el":8,"az":200,"ss":11,"used":false,"gnssid":2,"svid":21}]}')
PPS = ('{"class":"PPS","device":"/dev/serial7","real_sec":1700000001,"real_nsec":5,"clock_sec":1700000001,'
       '"clock_nsec":77,"precision":-4}')


def test_sample_reports(spark):
    lines = spark.createDataFrame([(t,) for t in (TPV, SKY, PPS, TPV[:-9], '{"class":"DEVICE"}', "")], "body string")
    good, bad = sources.json_reject_split(lines)
    # An empty line is no message either.
    assert good.count() == 4 and bad.count() == 2
    tpv = sources.read_gpsd(good, "TPV")
    assert len(tpv.columns) == 45
    row = tpv.first()
    assert (row["mode"], row["lat"], row["altHAE"], row["relN"]) == (2, -33.25, 12.75, None)
    assert row["time"] == datetime(2022, 6, 1, 5, 6, 7, 500000)
    sky = sources.read_gpsd(good, "SKY").first()
    assert [s["PRN"] for s in sky["satellites"]] == [5, 21] and sky["satellites"][0]["used"]
    pps = sources.read_gpsd(good, "PPS").first()
    assert (pps["clock_nsec"], pps["precision"], pps["qErr"]) == (77, -4, None)
    assert op.gps_class_filter(
        good.select(F.get_json_object("body", "$.class").alias("class")), "TPV, PPS").count() == 2


def points(spark, seconds, device=1):
    return spark.createDataFrame(
        [(i, device, float(s), 40.0 + i / 1e7, -87.0) for i, s in enumerate(seconds)],
        "id bigint, device bigint, s double, lat double, lon double").withColumn(
        "time", F.timestamp_micros((F.col("s") * 1e6).cast("bigint"))).drop("s")


def segments(df):
    return rows(df.select("id", F.unix_seconds("segment")))


def test_segment_boundaries(spark):
    p = points(spark, [0, 3599.5, 3600, 7200, 7200.25, 9000])
    bounds = F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(7300))
    assert segments(op.segment_assign(p, *bounds, 3600)) == [
        (0, 0), (1, 0), (2, 0), (2, 3600), (3, 3600), (3, 7200), (4, 7200), (5, 7200)]
    assert segments(op.segment_assign(p, *bounds, 3600, inclusive=False)) == [
        (0, 0), (1, 0), (2, 3600), (3, 7200), (4, 7200), (5, 7200)]
    # An end exactly on a boundary opens no further segment.
    end = F.timestamp_seconds(F.lit(7200))
    assert segments(op.segment_assign(p, bounds[0], end, 3600))[-1] == (3, 3600)


def test_segments_against_the_query_per_segment(spark):
    rng = random.Random(7)
    seconds = [rng.choice([rng.randrange(0, 4000), rng.randrange(0, 40) * 100, rng.uniform(0, 4000)])
               for _ in range(400)]
    p = points(spark, seconds)
    start, end, length = 130, 3333, 100
    want = {(i, t) for t in range(start, end, length) for i, s in enumerate(seconds)
            if t <= int(s * 1e6) / 1e6 <= t + length}
    got = op.segment_assign(p, F.timestamp_seconds(F.lit(start)), F.timestamp_seconds(F.lit(end)), length)
    assert set(segments(got)) == want


def gpx_files(path):
    return {tuple(p.split("=")[1] for p in f.parts[-4:-1]): f.read_text()
            for f in Path(path).rglob("part-*.txt")}


NS = {"g": "http://www.topografix.com/GPX/1/1"}


@pytest.mark.parametrize("max_points,limit", [(1_000_000, None), (7, None), (7, 50)])
def test_gpx_files(spark, tmp_path, max_points, limit):
    rng = random.Random(8)
    seconds = [rng.randrange(0, 86400) for _ in range(300)] + [5] * 40
    p = points(spark, seconds)
    placed = op.segment_assign(p, F.timestamp_seconds(F.lit(0)), F.timestamp_seconds(F.lit(86400)), 21600)
    sinks.write_gpx(placed, str(tmp_path / "gpx"), max_points=max_points, max_rows=limit)
    files = gpx_files(tmp_path / "gpx")
    tracks = {}
    for (device, segment, part), text in sorted(files.items(), key=lambda f: (f[0][0], f[0][1], int(f[0][2]))):
        gpx = ET.fromstring(text)
        found = gpx.findall("g:trk/g:trkseg/g:trkpt", NS)
        assert gpx.get("version") == "1.1" and 0 < len(found) <= max_points
        tracks.setdefault(segment, []).extend(
            (t.find("g:time", NS).text, float(t.get("lat"))) for t in found)
    assert {s: len(t) for s, t in tracks.items()} == {
        r["s"]: r["n"] for r in placed.groupBy(F.date_format("segment", "yyyy-MM-dd'T'HH-mm-ss'Z'").alias("s"))
        .agg(F.count(F.lit(1)).alias("n")).collect()}
    for track in tracks.values():
        assert [t for t, _ in track] == sorted(t for t, _ in track)


def test_export_appends_from_the_last_segment(spark, tmp_path):
    path = str(tmp_path / "tracks")
    early, late = [10, 4000, 7300], [10, 4000, 7300, 7400, 11000]
    flows.export_tracks(points(spark, early), path)
    first = set(gpx_files(path))
    assert {f[1] for f in first} == {"1970-01-01T00-00-00Z", "1970-01-01T01-00-00Z", "1970-01-01T02-00-00Z"}
    flows.export_tracks(points(spark, late), path, append=True)
    files = gpx_files(path)
    assert len(files) == 4
    again = files[("1", "1970-01-01T02-00-00Z", "0")]
    assert again.count("<trkpt") == 2
    done = op.high_water_mark(flows.exported_segments(spark, path), F.timestamp_seconds(F.lit(0)))
    assert done.select(F.unix_seconds("start")).first()[0] == 10800
    with pytest.raises(ValueError):
        op.export_bounds(points(spark, early), 3600, start="yesterday")


def test_documents_of_a_path(spark):
    # One machine stands still all day: one cell. Parts count inside the path, copies are one entry.
    p = points(spark, [i * 30 for i in range(2500)] + [90_000]).withColumn("lat", F.lit(40.0))
    whole = op.trail_documents(p.union(p.where("id < 10"))).orderBy("day").collect()
    assert [(d["batch"], d["n"], len(d["data"])) for d in whole] == [(0, 2500, 2500), (0, 1, 1)]
    for limit in (None, 300):
        docs = op.trail_documents(p, batch_size=1000, max_rows=limit).orderBy("day", "batch").collect()
        assert [d["n"] for d in docs] == [1000, 1000, 500, 1]
        assert max(docs[1]["epochs"]) < min(docs[0]["epochs"])
        assert len({k for d in docs for k in d["data"]}) == 2501


def test_documents_on_disk(spark, tmp_path):
    p = points(spark, [5, 6, 90_000])
    docs = op.trail_documents(p)
    sinks.write_trail_documents(docs, str(tmp_path / "d"))
    lines = [json.loads(x) for f in (tmp_path / "d").rglob("part-*.json") for x in f.read_text().splitlines()]
    assert sum(len(d["data"]) for d in lines) == 3
    entry = next(iter(lines[0]["data"].values()))
    assert set(entry) == {"id", "time", "lat", "lon"} and entry["id"] in lines[0]["data"]
    assert lines[0]["path"].split("/")[1] in ("1970-01-01", "1970-01-02")


def test_segments_with_a_fractional_end(spark):
    p = points(spark, [0, 3600.5])
    first, last = op.export_bounds(p, 3600)
    assert segments(op.segment_assign(p, F.lit(first), F.lit(last), 3600)) == [(0, 0), (1, 3600)]


def test_a_late_device_loses_no_segment(spark, tmp_path):
    path = str(tmp_path / "tracks")
    flows.export_tracks(points(spark, [0, 7200], 1), path, append=True)
    both = points(spark, [0, 7200, 7300], 1).union(points(spark, [0.25, 3600, 7200], 2))
    flows.export_tracks(both, path, append=True)
    done = flows.exported_segments(spark, path).select("device", F.unix_seconds("segment")).distinct()
    assert rows(done) == [("1", 0), ("1", 3600), ("1", 7200), ("2", 0), ("2", 3600), ("2", 7200)]
