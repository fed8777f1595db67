"""File sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harrow import schemas
from harrow.functions.times import iso_time, rotation_bucket
from harrow.operators.gps import segment_order
from harrow.operators.pieces import shuffle_tasks


def write_can_csv_rotated(df: DataFrame, path: str, period=1, interval="h") -> None:
    """Append bus rows to CSV, one folder per bus and rotation period.

    Folder ``rotation=BUS-YYYY-MM-DD-HH-MM`` carries the name a rotated log
    file has; with rotation off it is the bus name alone. Rotation follows the
    time of the row. Rows are in time order within a file.
    """
    name = F.concat_ws("-", F.col("can_interface"), F.date_format(
        rotation_bucket("time", period, interval), "yyyy-MM-dd-HH-mm"))
    (df.select(*schemas.CAN_LOG_KEYS, F.col("can_interface").alias("bus"), name.alias("rotation"))
     .hint("rebalance", "bus", "rotation")
     .sortWithinPartitions("bus", "rotation", "time")
     .write.partitionBy("bus", "rotation").mode("append")
     .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path))


def write_cell_log(df: DataFrame, path: str) -> None:
    df.select(F.unix_seconds("time").alias("timestamp"), "signal", "cell_tech").write.mode(
        "append").csv(path)


_GPX_OPEN = (
    '<?xml version="1.0" encoding="utf-8"?>\n'
    '<gpx version="1.1" creator="harrow" xmlns="http://www.topografix.com/GPX/1/1">\n'
    "<trk><trkseg>")
_GPX_CLOSE = "</trkseg></trk>\n</gpx>"


def gpx_lines(segments: DataFrame, max_points: int | None = None, **options) -> DataFrame:
    """Text lines of GPX files: (device, segment, part, ordinal, line).

    A file is one (device, segment, part) with one track of one track segment;
    ordinal orders its lines. A segment is one part unless ``max_points`` cuts it.
    """
    ranked = segment_order(segments, max_points=max_points, **options)
    named = ranked.withColumn(
        "segment", F.date_format("segment", "yyyy-MM-dd'T'HH-mm-ss'Z'"))
    def degrees(name: str):
        # Never in exponent form, which a double near zero would take as text.
        return F.col(name).cast("decimal(12,9)").cast("string")

    point = F.format_string(
        '<trkpt lat="%s" lon="%s"><time>%s</time></trkpt>',
        degrees("lat"), degrees("lon"), iso_time("time"))
    # The first and last point of a file bring its frame along.
    opens, closes = F.col("ordinal") == 1, F.col("ordinal") == F.col("points")
    if max_points is not None:
        opens = F.pmod(F.col("ordinal"), F.lit(max_points)) == 1 % max_points
        closes = closes | (F.pmod(F.col("ordinal"), F.lit(max_points)) == 0)
    line = F.concat_ws(
        "\n", F.when(opens, F.lit(_GPX_OPEN)), point, F.when(closes, F.lit(_GPX_CLOSE)))
    return named.select("device", "segment", "part", "ordinal", line.alias("line"))


def write_gpx(segments: DataFrame, path: str, max_points: int | None = None,
              replace: bool = True, **options) -> None:
    """One GPX 1.1 file per non-empty segment, points in time order.

    Files lie under ``device=/segment=/part=`` and replace those of an earlier
    export of the same part; others stay. Into an empty place ``replace=False``
    saves the bookkeeping. The sort columns start with the
    partition columns, which is the order the writer needs; it keeps ours.
    """
    file = ["device", "segment", "part"]
    # A fixed number of tasks: opening files, not bytes, is the cost here, and
    # AQE would merge small partitions by bytes.
    (gpx_lines(segments, max_points, **options)
     .repartition(shuffle_tasks(segments), *file).sortWithinPartitions(*file, "ordinal")
     .drop("ordinal")
     .write.partitionBy(*file).mode("overwrite" if replace else "append")
     .option("partitionOverwriteMode", "dynamic").text(path))


def write_trail_documents(docs: DataFrame, path: str, folders: tuple[str, ...] = ("day",),
                          upload: str | None = None) -> None:
    """Documents as JSON lines under the folders named, by default one per day.

    A line holds the document's path and its data. ``folders`` may be the whole
    path ("device", "day", "geohash"), which makes a folder per document and
    suits small exports only. A named upload has a folder of its own, ``upload=``, which a
    repeat replaces; without a name lines are added.
    """
    place = F.concat_ws("/", F.col("device").cast("string"), F.col("day"), F.col("geohash"))
    (docs.select("device", "day", "geohash", "batch", "data", place.alias("path"))
     .hint("rebalance", *folders)
     .sortWithinPartitions(*folders, "path", "batch")
     .write.partitionBy(*folders).mode("append" if upload is None else "overwrite")
     .json(path if upload is None else f"{path}/upload={upload}"))


def write_by_subject(df: DataFrame, path: str | None = None, kafka: dict | None = None) -> None:
    """Route messages (subject, body) to the place their subject names.

    Files go under ``subject=``; with Kafka options the subject is the topic.
    """
    if kafka is not None:
        (df.select(F.col("subject").alias("topic"), F.col("body").alias("value"))
         .write.format("kafka").options(**kafka).save())
        return
    (df.select("subject", "body").hint("rebalance", "subject")
     .write.partitionBy("subject").mode("append").text(path))
