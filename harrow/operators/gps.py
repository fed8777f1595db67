"""GPS reports, points and track segments."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from harrow.functions.geo import geohash, gnss_document, point_id
from harrow.functions.times import day_of, parse_time, truncate_time
from harrow.operators.pieces import with_row_number


def gps_class_filter(df: DataFrame, classes: list[str] | str, col: str = "class") -> DataFrame:
    """Reports of the listed classes; a comma list is taken too."""
    names = classes.split(",") if isinstance(classes, str) else list(classes)
    return df.where(F.col(col).isin([n.strip() for n in names]))


def class_union(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def add_ingest_time(df: DataFrame, at: Column | None = None) -> DataFrame:
    return df.withColumn("systime", F.current_timestamp() if at is None else at)


def time_range_filter(df: DataFrame, time: str, start, end) -> DataFrame:
    """Rows with a time from start to end, both included; reaches the file scan."""
    return df.where(F.col(time).between(start, end))


def segment_assign(points: DataFrame, start: Column, end: Column, length_s: int,
                   inclusive: bool = True, time: str = "time") -> DataFrame:
    """Place points in the segments [start + k*length, start + (k+1)*length].

    Segments begin at ``start`` (whole seconds) while before ``end``. With
    ``inclusive`` both ends belong to a segment, so a point exactly on an inner
    boundary appears in two; otherwise the upper end is open. The range join is
    arithmetic: a point computes its own segment, nothing is compared pairwise.
    ``start`` and ``end`` may be literals or columns of ``points``.
    """
    step = length_s * 1_000_000
    first = F.unix_seconds(start)
    # In microseconds: a last point just past a boundary has a segment too.
    count = F.ceil((F.unix_micros(end) - first * 1_000_000) / F.lit(step)).cast("bigint")
    into = F.unix_micros(F.col(time)) - first * 1_000_000
    index = F.floor(into / F.lit(step)).cast("bigint")
    candidates = F.array(index)
    if inclusive:
        candidates = F.when(into % step == 0, F.array(index - 1, index)).otherwise(candidates)
    valid = F.filter(candidates, lambda k: (k >= 0) & (k < count))
    return (
        points.withColumn("_k", F.explode(valid))
        .withColumn("segment", F.timestamp_seconds(first + F.col("_k") * length_s))
        .drop("_k"))


def export_bounds(points: DataFrame, length_s: int, start: str | None = None,
                  end: str | None = None, truncate: bool = True) -> tuple[datetime, datetime]:
    """Start and end of an export as two values.

    Given texts are ``YYYY-MM-DD HH:MM:SS``; missing ones are the first and
    last time of the table, one aggregate that files answer from statistics.
    """
    first = parse_time(F.lit(start)) if start else F.min("time")
    last = parse_time(F.lit(end)) if end else F.max("time")
    row = points.agg(
        (truncate_time(first, length_s) if truncate else first).alias("first"),
        last.alias("last")).first()
    for given, value, name in ((start, row["first"], "start"), (end, row["last"], "end")):
        if given and value is None:
            raise ValueError(f"{name}: use YYYY-MM-DD HH:MM:SS")
    return row["first"], row["last"]


def high_water_mark(segments: DataFrame, start: Column, col: str = "segment") -> DataFrame:
    """The later of ``start`` and the newest exported segment, as one row.

    Names that are not times are ignored.
    """
    newest = F.max(F.col(col).cast("string").try_cast("timestamp"))
    return segments.agg(F.greatest(start, newest).alias("start"))


def high_water_marks(segments: DataFrame, key: str = "device", col: str = "segment") -> DataFrame:
    """Newest exported segment of each device (``device, start``); a late device has its own."""
    newest = F.max(F.col(col).cast("string").try_cast("timestamp"))
    return segments.groupBy(key).agg(newest.alias("start")).where("start IS NOT NULL")


def segment_order(df: DataFrame, keys: tuple[str, ...] = ("device", "segment"),
                  time: str = "time", tie: str = "id", max_points: int | None = None,
                  **options) -> DataFrame:
    """Rank points inside their segment.

    ``ordinal`` counts from 1 within (device, segment) to ``points``. A segment is one
    part (0); with ``max_points`` it is cut into parts of so many points.
    """
    ranked = with_row_number(df, list(keys), time, tie, "ordinal", total="points", **options)
    part = F.lit(0) if max_points is None else F.floor((F.col("ordinal") - 1) / F.lit(max_points))
    return ranked.withColumn("part", part.cast("bigint"))


def upload_batches(points: DataFrame, batch_size: int = 1000, **options) -> DataFrame:
    """Number points newest first per device in batches of ``batch_size``."""
    ranked = with_row_number(
        points, ["device"], "time", "id", "_rank", newest_first=True, **options)
    return ranked.withColumn(
        "batch", F.floor((F.col("_rank") - 1) / F.lit(batch_size)).cast("bigint")).drop("_rank")


def trail_documents(points: DataFrame, precision: int = 7, batch_size: int | None = None,
                    **options) -> DataFrame:
    """Documents of the points of one device, day and geohash cell.

    A path is one document (``batch`` 0) unless ``batch_size`` cuts it: its points are then taken
    newest first, so many to a document, numbered inside the path. ``data`` maps the
    point id to its entry and ``n`` is the number of entries.
    """
    entry = F.struct(
        point_id("device", "time", "lat", "lon").alias("key"),
        gnss_document(point_id("device", "time", "lat", "lon"), "time", "lat", "lon").alias("value"))
    place = ["device", "day", "geohash"]
    located = points.withColumns({"day": day_of("time"), "geohash": geohash("lat", "lon", precision)})
    if batch_size is None:
        located = located.withColumn("batch", F.lit(0).cast("bigint"))
    else:
        located = with_row_number(located, place, "time", "id", "_rank", newest_first=True, **options).withColumn(
            "batch", F.floor((F.col("_rank") - 1) / F.lit(batch_size)).cast("bigint"))
    path = [*place, "batch"]
    # A point stored twice has one id and is one entry.
    once = F.filter("_sorted", lambda e, i: (i == 0) | (
        F.get("_sorted", i - 1)["key"] != e["key"]))
    return (
        located.select(*path, entry.alias("_entry")).groupBy(*path)
        .agg(F.array_sort(F.collect_list("_entry")).alias("_sorted"))
        .withColumn("_entries", once)
        .select(*path, F.size("_entries").cast("bigint").alias("n"),
                F.transform("_entries", lambda e: e["value"]["time"]).alias("epochs"),
                F.map_from_entries("_entries").alias("data")))
