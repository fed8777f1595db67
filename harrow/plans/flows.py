"""The data paths of a logger fleet, end to end.

Each is a composition of operators; Catalyst sees one plan per flow.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harrow.operators.constraints import constraint_split
from harrow.operators.counters import interface_traffic
from harrow.operators.fleet import newest_time, staleness
from harrow.operators.gps import export_bounds, high_water_marks, segment_assign
from harrow.operators.j1939 import (
    j1939_decode_id, j1939_only, logs_to_frames, signal_decode, valid_signal_filter)
from harrow.operators.signals import signal_stats
from harrow.sinks.files import write_can_csv_rotated, write_gpx
from harrow.sinks.tables import write_hypertable
from harrow.sources.logs import parse_can_text
from harrow.sources.messages import read_raw_frames
from harrow.streaming.aggregates import stream_signal_stats


def frames_to_signals(frames: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Bus frames to valid decoded signals."""
    messages = j1939_decode_id(j1939_only(frames))
    return valid_signal_filter(signal_decode(messages, dictionary))


def frames_to_stats(frames: DataFrame, dictionary: DataFrame, width: str = "1 second") -> DataFrame:
    return signal_stats(frames_to_signals(frames, dictionary), width)


def logs_to_stats(logs: DataFrame, dictionary: DataFrame, width: str = "1 second",
                  keys: tuple[str, ...] = ("can_interface", "name")) -> DataFrame:
    """Stored bus logs to statistics of each bus and signal."""
    return signal_stats(frames_to_signals(logs_to_frames(logs), dictionary), width, keys)


def message_stream_to_stats(messages: DataFrame, dictionary: DataFrame, width: str = "1 second",
                            watermark: str = "10 seconds") -> DataFrame:
    """Raw frame messages (device, body) as a stream to windowed statistics."""
    frames = read_raw_frames(messages).withColumn("data", F.lower(F.hex("data")))
    signals = valid_signal_filter(signal_decode(frames, dictionary))
    return stream_signal_stats(signals, width, watermark)


def gateway_text_to_logs(lines: DataFrame, csv: str | None = None, table: str | None = None,
                         period=1, interval="h") -> DataFrame:
    """Gateway lines (can_interface, value) to log files and table; returns the rejects."""
    rows, rejects = parse_can_text(lines)
    if csv:
        write_can_csv_rotated(rows, csv, period, interval)
    if table:
        write_hypertable(rows, table)
    return rejects


def reports_to_table(reports: DataFrame, table: str, not_null: list[str],
                     unique: list[str], id_col: str, time: str = "time") -> DataFrame:
    """Typed reports to their table; returns what its constraints refuse."""
    accepted, rejected = constraint_split(reports, not_null, unique, id_col)
    write_hypertable(accepted, table, time, unique, id_col)
    return rejected


def bus_health(counters: DataFrame, logs: DataFrame, now: Column, threshold_s: float = 5.0,
               bucket: str = "1 minute") -> DataFrame:
    """Age of the newest logged row of each bus, and whether its logger is healthy.

    A bus (device, interface) that received nothing in its newest bucket of counter
    samples has nothing to log and is healthy too.
    """
    keys = ("device", "interface")
    buses = interface_traffic(counters, bucket).groupBy(*keys).agg(F.max_by("silent", "bucket").alias("silent"))
    return staleness(newest_time(logs, list(keys)), buses, now, threshold_s, keys, silent="silent")


def export_tracks(points: DataFrame, path: str, length_s: int = 3600, start: str | None = None,
                  end: str | None = None, truncate: bool = True, append: bool = False) -> None:
    """Points to one GPX file per device and time segment, in one job.

    With ``append`` each device starts at its own newest segment already written, which
    is written again whole; a device whose points come late loses none. Files of
    a segment replace older ones.
    """
    spark = points.sparkSession
    first, last = export_bounds(points, length_s, start, end, truncate)
    if first is None or last is None:
        return
    begin = F.lit(first)
    done = exported_segments(spark, path)
    if append and done is not None:
        marks = high_water_marks(done).select(
            F.col("device").alias("_device"), F.col("start").alias("_mark"))
        points = points.join(marks, F.col("device").cast("string") == F.col("_device"), "left")
        begin = F.greatest(begin, F.coalesce("_mark", begin))
    segments = segment_assign(points, begin, F.lit(last), length_s).drop("_device", "_mark")
    write_gpx(segments, path, replace=done is not None)


def exported_segments(spark: SparkSession, path: str) -> DataFrame | None:
    """``device, segment`` of what is already under ``path``, from folder names alone."""
    try:
        files = spark.read.format("binaryFile").option(
            "recursiveFileLookup", "true").load(path).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    name = F.regexp_extract("path", r"segment=([^/]+)/", 1)
    return files.select(
        F.regexp_extract("path", r"device=([^/]+)/", 1).alias("device"),
        F.try_to_timestamp(name, F.lit("yyyy-MM-dd'T'HH-mm-ss'Z'")).alias("segment"))
