"""JSON messages to typed rows.

Each reader takes a DataFrame with the message text in ``body`` (or the column
named) and works the same on a stream. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from harrow import schemas
from harrow.functions.bits import hex_number
from harrow.functions.spectra import spectrum_decode
from harrow.functions.times import from_epoch_seconds


def json_reject_split(df: DataFrame, col: str = "body") -> tuple[DataFrame, DataFrame]:
    """Messages that parse, and those that do not."""
    parsed = F.try_parse_json(F.col(col)).isNotNull()
    return df.where(parsed), df.where(~parsed)


def _parsed(df: DataFrame, schema: T.StructType, col: str) -> tuple[DataFrame, list[str]]:
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.from_json(F.col(col), schema).alias("_m")), keep


def _bytes(name: str) -> Column:
    return F.when(F.col(name).rlike("^(?:[0-9A-Fa-f]{2})*$"), F.unhex(F.col(name)))


def split_rejects(df: DataFrame, reader: Callable[[DataFrame], DataFrame], required: tuple[str, ...],
                  col: str = "body") -> tuple[DataFrame, DataFrame]:
    """Rows of a reader, and the messages in which a required field is missing or out of range.

    Readers give NULL for what they cannot take, so one bad message ends no job; here
    such messages come back as they were.
    """
    rows = reader(df.withColumn("_text", F.col(col)))
    whole = F.lit(True)
    for name in required:
        whole = whole & F.col(name).isNotNull()
    keep = [c for c in df.columns if c != col]
    return rows.where(whole).drop("_text"), rows.where(~whole).select(*keep, F.col("_text").alias(col))


def read_raw_frames(df: DataFrame, col: str = "body") -> DataFrame:
    """Raw frame messages: hex numbers to integers, absent options to NULL."""
    parsed, keep = _parsed(df, schemas.RAW_FRAME_JSON, col)

    def number(name: str, kind: str) -> Column:
        return hex_number(F.col(f"_m.{name}")).try_cast(kind)

    return parsed.select(
        *keep, from_epoch_seconds("_m.timestamp").alias("time"),
        number("pgn", "int").alias("pgn"), number("saddr", "smallint").alias("source"),
        number("sname", "bigint").alias("source_name"),
        number("daddr", "smallint").alias("destination"),
        number("dname", "bigint").alias("destination_name"),
        number("priority", "smallint").alias("priority"),
        _bytes("_m.data").alias("data"))


def read_bus_messages(df: DataFrame, col: str = "body") -> DataFrame:
    """Messages of the plainer form, with decimal numbers."""
    parsed, keep = _parsed(df, schemas.BUS_MESSAGE_JSON, col)
    return parsed.select(
        *keep, from_epoch_seconds("_m.ts").alias("time"), "_m.pgn",
        F.col("_m.source").try_cast("smallint").alias("source"),
        F.col("_m.dest").try_cast("smallint").alias("destination"),
        F.col("_m.priority").try_cast("smallint").alias("priority"),
        _bytes("_m.data").alias("data"))


def read_signals(df: DataFrame, col: str = "body") -> DataFrame:
    parsed, keep = _parsed(df, schemas.SIGNAL_JSON, col)
    return parsed.select(
        *keep, "_m.pgn", "_m.name", from_epoch_seconds("_m.time").alias("time"),
        "_m.value", "_m.units", "_m.min_value", "_m.max_value")


def read_gpsd(df: DataFrame, cls: str, col: str = "body") -> DataFrame:
    """Reports of one class as rows of its table.

    Keys without a column are ignored, columns without a key are NULL. A
    report has its own ``device``; a pass-on column of the same name wins.
    """
    schema = schemas.GPSD_CLASSES[cls]
    parsed, keep = _parsed(
        df.where(F.get_json_object(col, "$.class") == cls), schema, col)
    return parsed.select(
        *keep, *[F.col(f"_m.`{n}`") for n in schema.fieldNames() if n not in keep])


def read_spectrum(df: DataFrame, col: str = "body") -> DataFrame:
    """Spectrum messages with the packed vector as an array of integers."""
    parsed, keep = _parsed(df, schemas.SPECTRUM_JSON, col)
    return parsed.select(*keep, "_m.*").withColumn("fft", spectrum_decode("fft"))


def read_tuner(df: DataFrame, col: str = "body") -> DataFrame:
    parsed, keep = _parsed(df, schemas.TUNER_JSON, col)
    return parsed.select(*keep, "_m.*")


def message_stream(spark: SparkSession, fmt: str, schema: T.StructType | None = None,
                   path: str | None = None, **options: str) -> DataFrame:
    """Subscribe to messages: files with an explicit schema, or Kafka.

    For Kafka (its connector must be on the class path) give
    ``subscribe`` or ``subscribePattern``; topic and value come back as
    ``subject`` and ``body``.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        return reader.load().select(
            F.col("topic").alias("subject"), F.col("value").cast("string").alias("body"),
            F.col("timestamp").alias("arrived"))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)
