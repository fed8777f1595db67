"""Log files and gateway text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harrow import schemas
from harrow.functions.times import from_epoch_seconds

# Gateway line: "< frame ID SECONDS.MICROSECONDS DATA >"; fixed format.
_FRAME_LINE = r"^\s*<\s*frame\s+([0-9A-Fa-f]+)\s+([0-9]+(?:\.[0-9]+)?)\s+((?:[0-9A-Fa-f]{2})*)\s*>\s*$"


def read_can_csv(spark: SparkSession, path: str) -> DataFrame:
    """Bus log files without header, rotated or not; the bus is read from the row."""
    return (
        spark.read.schema(schemas.CAN_LOG).option("recursiveFileLookup", "true").csv(path))


def parse_can_text(lines: DataFrame, can_interface: Column | None = None,
                   col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Gateway lines to bus log rows, and the lines that are no frames.

    The bus is ``can_interface``, by default the column of that name. Columns
    other than the line are passed on.
    """
    bus = F.col("can_interface") if can_interface is None else can_interface
    keep = [c for c in lines.columns if c not in (col, "can_interface")]

    # The pattern runs once a line: what it matches becomes three fields, all else stays as it is.
    fields = F.regexp_replace(col, _FRAME_LINE, "$1 $2 $3")
    tried = lines.withColumn("_fields", F.when(fields != F.col(col), F.split(fields, " "))).withColumn(
        # A frame may have no data, but it has a time that can be told.
        "_time", from_epoch_seconds(F.col("_fields")[1].try_cast("double")))
    rows = tried.where(F.col("_time").isNotNull()).select(
        *keep, F.col("_time").alias("time"), bus.alias("can_interface"),
        F.col("_fields")[0].alias("can_id"), F.col("_fields")[2].alias("can_data"))
    return rows, tried.where(F.col("_time").isNull()).select(*lines.columns)


def read_cell_log(spark: SparkSession, path: str) -> DataFrame:
    """Modem log files: epoch seconds, signal, technology."""
    rows = spark.read.schema(schemas.CELL_CSV).csv(path)
    return rows.select(
        F.timestamp_seconds("timestamp").alias("time"), "signal", "cell_tech")


def read_counters(df: DataFrame) -> DataFrame:
    """Counter samples whose byte text is a whole number; others are skipped."""
    text = F.trim(F.col("rx_bytes").cast("string"))
    return (
        df.where(text.rlike("^[0-9]+$"))
        .withColumn("rx_bytes", text.try_cast("bigint")).where(F.col("rx_bytes").isNotNull()))


def read_probes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Reachability probe results."""
    return spark.read.schema(schemas.PROBES).format(fmt).load(path)


_NUMBER = r"[-+0-9.eE]+"
# A signal as its file writes it, the selector of a message (M) or one that it selects (m0, m1, ...); fixed format.
_SIGNAL_LINE = (
    r"^\s*SG_\s+(\w+)(?:\s+(M|m\d+))?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*"
    rf"\(({_NUMBER}),({_NUMBER})\)\s*\[({_NUMBER})\|({_NUMBER})\]\s*\"([^\"]*)\"")
_NAME, _MUX, _START, _LEN, _ORDER, _SIGN, _SCALE, _OFFSET, _MIN, _MAX, _UNITS = range(1, 12)


def _signal_lines(files: DataFrame) -> DataFrame:
    """Every signal line of every message block with its fields; ``_fits`` if all can be taken."""
    # Text before the first block is the file header.
    block = files.select(
        "_file", F.posexplode(F.split("value", r"(?:^|\n)BO_\s+")).alias("_at", "_block")
    ).where("_at > 0")
    all_lines = F.regexp_extract_all("_block", F.lit(r"(?m)^[ \t]*SG_[ \t][^\r\n]*"), F.lit(0))
    lines = (
        block.select("_file", F.regexp_extract("_block", r"^(\d+)", 1).try_cast("bigint").alias("_id"),
                     all_lines.alias("_lines"))
        # The selector is a line of the same block, so it needs no join.
        .withColumn("_selectors", F.filter("_lines", lambda line: F.regexp_extract(line, _SIGNAL_LINE, _MUX) == "M"))
        .select("_file", "_id", F.when(F.size("_selectors") == 1, F.col("_selectors")[0]).alias("_selector"),
                F.explode("_lines").alias("_line")))

    def field(i: int, kind: str, line: str = "_line") -> Column:
        return F.regexp_extract(line, _SIGNAL_LINE, i).try_cast(kind)

    def fits(start: str, width: str) -> Column:
        return F.coalesce(F.col(start).isNotNull() & F.col(width).between(1, 64), F.lit(False))

    chosen = F.regexp_extract("_line", _SIGNAL_LINE, _MUX).startswith("m")

    def of_selector(i: int, kind: str) -> Column:
        return F.when(chosen, field(i, kind, "_selector"))

    fields = lines.select(
        "_file", "_id", "_line", field(_NAME, "string").alias("name"), field(_UNITS, "string").alias("units"),
        field(_START, "int").alias("start_bit"), field(_LEN, "int").alias("bit_len"),
        field(_SCALE, "double").alias("scale"), field(_OFFSET, "double").alias("offset"),
        field(_MIN, "double").alias("min_value"), field(_MAX, "double").alias("max_value"),
        (field(_SIGN, "string") == "-").alias("signed"), (field(_ORDER, "string") == "0").alias("big_endian"),
        of_selector(_NAME, "string").alias("selector"), of_selector(_START, "int").alias("selector_start"),
        of_selector(_LEN, "int").alias("selector_len"),
        (of_selector(_ORDER, "string") == "0").alias("selector_big_endian"),
        F.when(chosen, F.substring(field(_MUX, "string"), 2, 20).try_cast("bigint")).alias("selector_value"),
        chosen.alias("_chosen"))
    known = [F.col(c).isNotNull() for c in ("_id", "scale", "offset", "min_value", "max_value")]
    selected = ~F.col("_chosen") | (fits("selector_start", "selector_len") & F.col("selector_value").isNotNull())
    return fields.withColumn("_fits", reduce(
        lambda a, b: a & b, known, fits("start_bit", "bit_len") & selected)).drop("_chosen")


def _dictionary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("_file", F.input_file_name())


def signal_dictionary_rejects(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of the signals that :func:`read_signal_dictionary` cannot take:
    of no or over 64 bits, with a number that is none, or chosen by a selector that the message
    does not have, has twice, or that is itself chosen by another."""
    return _signal_lines(_dictionary_files(spark, path)).where("NOT _fits").select(
        F.col("_file").alias("file"), F.trim("_line").alias("line"))


def read_signal_dictionary(spark: SparkSession, path: str,
                           can_interface: Column | None = None) -> DataFrame:
    """Signal dictionary of DBC files.

    One text row per file; message blocks and their signal lines are exploded,
    comments are joined on as descriptions. Signals may be big endian, and chosen by the value of a
    selector of their message (``schemas.LAYOUT``). A signal that several files, or several ids of a
    group, define alike is one row. Files that define it differently belong to different
    buses: ``can_interface`` tells the bus from the path in ``_file``, and
    :func:`signal_decode` then keeps to it.
    """
    files = _dictionary_files(spark, path)
    pdu = F.shiftright(F.col("_id"), 8).bitwiseAND(F.lit(0x3FFFF))
    pf = F.shiftright(pdu, 8).bitwiseAND(F.lit(0xFF))
    comment_line = r'CM_\s+SG_\s+(\d+)\s+(\w+)\s+"([^"]*)"'
    comments = files.select("_file", F.explode(F.regexp_extract_all(
        "value", F.lit(comment_line), F.lit(0))).alias("_c")).select(
        "_file", F.regexp_extract("_c", comment_line, 1).try_cast("bigint").alias("_id"),
        F.regexp_extract("_c", comment_line, 2).alias("name"),
        F.regexp_extract("_c", comment_line, 3).alias("description"))
    bus = [] if can_interface is None else ["can_interface"]
    columns = [*bus, *schemas.DICTIONARY.fieldNames(), *schemas.LAYOUT.fieldNames()]
    return (
        _signal_lines(files).where("_fits").join(comments, ["_file", "_id", "name"], "left")
        .withColumn("pgn", F.when(pf >= 240, pdu).otherwise(F.shiftleft(pf, 8)).cast("int"))
        .withColumns({b: can_interface for b in bus})
        .groupBy(*[c for c in columns if c != "description"])
        .agg(F.min("description").alias("description")).select(*columns))
