"""Vehicle-bus frames: identifier fields, messages and signal decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from harrow import schemas
from harrow.functions.bits import (
    big_endian_word_of, hex_number, hex_text, signed_double, unsigned_double, word_of)
from harrow.functions.subjects import make_subject
from harrow.functions.times import epoch_seconds

# Groups below this PDU format carry a destination in their low byte.
_FIRST_BROADCAST_FORMAT = 240
# Standard ids have eleven bits; fixed value.
LAST_STANDARD_ID = 0x7FF
# Beyond this many dictionary rows the join is left to Spark.
DICTIONARY_LIMIT = 200_000


def id_fields(can_id: Column) -> dict[str, Column]:
    pdu = F.shiftright(can_id, 8).bitwiseAND(F.lit(0x3FFFF))
    pf = F.shiftright(pdu, 8).bitwiseAND(F.lit(0xFF))
    low = pdu.bitwiseAND(F.lit(0xFF))
    broadcast = pf >= _FIRST_BROADCAST_FORMAT
    return {
        "priority": F.shiftright(can_id, 26).bitwiseAND(F.lit(7)).cast("smallint"),
        "data_page": F.shiftright(pdu, 16).cast("smallint"),
        "pgn": F.when(broadcast, pdu).otherwise(F.shiftleft(pf, 8)).cast("int"),
        "source": can_id.bitwiseAND(F.lit(0xFF)).cast("smallint"),
        "destination": F.when(~broadcast, low).cast("smallint"),
    }


def j1939_decode_id(df: DataFrame, id_col: str = "can_id") -> DataFrame:
    """Add priority, data_page, pgn, source and destination of a 29-bit id.

    For a group with a destination the pgn has neither page bits nor low byte;
    ``data_page`` keeps the page bits. A broadcast has a NULL destination.
    """
    return df.withColumns(id_fields(F.col(id_col).cast("bigint")))


def logs_to_frames(logs: DataFrame) -> DataFrame:
    """Bus log rows (hex ``can_id``, ``can_data``) as frames.

    A log keeps no flags: an id past eleven bits is extended, and remote frames are not
    logged. Rows whose id is no hex number have NULL flags, which no filter lets pass.
    """
    return (
        logs.withColumn("can_id", hex_number("can_id")).withColumns({
            "is_extended": F.col("can_id") > LAST_STANDARD_ID,
            "is_rtr": F.when(F.col("can_id").isNotNull(), F.lit(False)),
            "data": F.lower("can_data")}).drop("can_data"))


def j1939_only(df: DataFrame) -> DataFrame:
    """Extended data frames; standard and remote frames are not this protocol."""
    return df.where(F.col("is_extended") & ~F.col("is_rtr"))


def frame_to_message(df: DataFrame, prefix: str = "j1939") -> DataFrame:
    """Serialise messages: subject and JSON body, absent options as null.

    Takes time, pgn, source, source_name, destination, destination_name,
    priority and a hex ``data`` column.
    """
    def text(name: str) -> Column:
        return hex_text(F.col(name).cast("bigint"))

    body = F.to_json(F.struct(
        epoch_seconds("time").alias("timestamp"), text("pgn").alias("pgn"),
        text("source").alias("saddr"), text("source_name").alias("sname"),
        text("destination").alias("daddr"), text("destination_name").alias("dname"),
        text("priority").alias("priority"), F.col("data")), {"ignoreNullFields": "false"})
    return df.select(
        *[c for c in ("id", "device") if c in df.columns],
        make_subject("raw", "pgn", prefix=prefix).alias("subject"), body.alias("body"))


def frame_to_bus_message(df: DataFrame, prefix: str = "j1939") -> DataFrame:
    """The plainer message form: decimal numbers and a routed subject."""
    body = F.to_json(F.struct(
        epoch_seconds("time").alias("ts"), F.col("pgn"), F.col("source"),
        F.col("destination").alias("dest"), F.col("priority"), F.col("data")),
        {"ignoreNullFields": "false"})
    return df.select(
        *[c for c in ("id", "device") if c in df.columns],
        make_subject("bus", "pgn", "source", "destination", prefix=prefix).alias("subject"),
        body.alias("body"))


def _move(way: str, word: Column, by: Column) -> Column:
    return F.call_function(way, word, by.cast("int"))


def _first_bit(start: Column, big: Column) -> Column:
    """Bits of the payload before a field, in the order of its kind.

    A big-endian field starts at its top bit, whose number still counts up inside its byte.
    """
    return F.when(big, start - start % 8 * 2 + 7).otherwise(start)


def _raw(rows: DataFrame, at: str, width: str, big: str | None, far: bool, out: str) -> DataFrame:
    """Adds the bits of a field: ``width`` ones after the first ``at`` of a payload.

    Inside the first eight bytes that is a shift of the frame's word. With ``far``, a field that
    goes on beyond takes the nine bytes from its first byte on; the others stay with the word.
    """
    end = F.col(at) + F.col(width)
    mask = _move("shiftrightunsigned", F.lit(-1).cast("bigint"), F.lit(64) - F.col(width))
    near = _move("shiftrightunsigned", F.col("_word"), F.col(at))
    if big:
        near = F.when(F.col(big), _move("shiftrightunsigned", F.col("_big_word"), F.lit(64) - end)).otherwise(near)
    if not far:
        return rows.withColumn(out, near.bitwiseAND(mask))
    shift = F.col(at) % 8
    over = shift + F.col(width) - 64        # bits in the ninth byte
    rows = rows.withColumn("_nine", F.when(end > 64, F.substring(
        "data", F.floor(F.col(at) / 8).cast("int") * 2 + 1, F.lit(18)))).withColumn(
        "_ninth", F.coalesce(hex_number(F.substring("_nine", 17, 2)), F.lit(0).cast("bigint")))
    beyond = _move("shiftrightunsigned", word_of(F.col("_nine")), shift).bitwiseOR(
        F.when(shift > 0, _move("shiftleft", F.col("_ninth"), F.lit(64) - shift)).otherwise(0))
    if big:
        eight = big_endian_word_of(F.col("_nine"))
        beyond = F.when(~F.col(big), beyond).when(
            over <= 0, _move("shiftrightunsigned", eight, -over)).otherwise(
            _move("shiftleft", eight, over).bitwiseOR(_move("shiftrightunsigned", F.col("_ninth"), F.lit(8) - over)))
    return rows.withColumn(out, F.when(end > 64, beyond).otherwise(near).bitwiseAND(mask)).drop("_nine", "_ninth")


def signal_decode(frames: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row per signal of each frame; a field past the payload is dropped.

    The payload becomes a 64-bit word once per frame, before the join; each
    signal is then a shift and a mask, with what they need prepared in the dictionary.
    The dictionary is looked at first: it is broadcast if its size allows, so a
    parameter group that makes up most of the traffic is never shuffled to one
    task, and fields past the eighth byte, of a full 64 bits, with a sign, big endian or under a selector
    cost something only if there are any. A dictionary without ``signed`` has unsigned fields,
    one without the columns of ``schemas.LAYOUT`` little-endian ones that every frame holds. A signal
    that a selector chooses has a row only where the selector has its value.

    If frames and dictionary both have ``can_interface``, a definition holds for its bus
    only. Two definitions of one signal name in a group would give every row twice; they
    are refused.
    """
    both = {*frames.columns} & {*dictionary.columns}
    keys = [k for k in ("can_interface", "pgn") if k in both or k == "pgn"]

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in dictionary.columns else F.lit(False)

    def layout(name: str) -> Column:
        return F.col(name) if name in dictionary.columns else F.lit(None).cast(schemas.LAYOUT[name].dataType)

    spec = dictionary.select(
        *keys, "name", "description", "units", "min_value", "max_value", "bit_len", "scale", "offset",
        flag("signed").alias("_signed"), flag("big_endian").alias("_big"),
        _first_bit(F.col("start_bit"), flag("big_endian")).alias("_at"),
        layout("selector_value").alias("_value"), layout("selector_len").alias("_selector_len"),
        flag("selector_big_endian").alias("_selector_big"),
        _first_bit(layout("selector_start"), flag("selector_big_endian")).alias("_selector_at"))
    size, names, last_bit, last_selector, widest, any_signed, any_big, any_selector = spec.agg(
        F.count(F.lit(1)), F.count_distinct(F.struct(*keys, "name")), F.max(F.col("_at") + F.col("bit_len")),
        F.max(F.col("_selector_at") + F.col("_selector_len")), F.max("bit_len"), F.max("_signed"),
        F.max(F.col("_big") | F.col("_selector_big")), F.max(F.col("_value").isNotNull())).first()
    if names < size:
        raise ValueError(f"{size - names} signals of the dictionary are defined more than once")
    words = {"_word": word_of(F.col("data")), "_bits": F.length("data") * 4}
    if any_big:
        words["_big_word"] = big_endian_word_of(F.col("data"))
    joined = (
        frames.withColumns(words)
        .join(F.broadcast(spec) if size <= DICTIONARY_LIMIT else spec, keys)
        .where(F.col("_at") + F.col("bit_len") <= F.col("_bits")))
    # Each step is a projection of its own: nothing is computed twice for a row,
    # and the generated code stays small enough to be compiled.
    if any_selector:
        chosen = _raw(joined, "_selector_at", "_selector_len", "_selector_big" if any_big else None,
                      (last_selector or 0) > 64, "_selected")
        joined = chosen.where(F.col("_value").isNull() | (
            (F.col("_selector_at") + F.col("_selector_len") <= F.col("_bits"))
            & (F.col("_selected") == F.col("_value")))).drop("_selected")
    decoded = _raw(joined, "_at", "bit_len", "_big" if any_big else None, (last_bit or 0) > 64, "_raw")
    number = F.col("_raw").cast("double") if (widest or 0) < 64 else unsigned_double(F.col("_raw"))
    if any_signed:
        number = F.when(F.col("_signed"), signed_double(F.col("_raw"), F.col("bit_len"))).otherwise(number)
    value = number * F.col("scale") + F.col("offset")
    return decoded.withColumn("value", value).drop(
        *words, *[c for c in spec.columns if c.startswith("_")], "_raw", "bit_len", "scale", "offset")


def valid_signal_filter(df: DataFrame) -> DataFrame:
    """Drop null values and values at or above the maximum.

    The codes for "error" and "not available" decode above the maximum.
    """
    return df.where(F.col("value").isNotNull() & (F.col("value") < F.col("max_value")))


def signals_to_messages(signals: DataFrame, prefix: str = "j1939") -> DataFrame:
    """Decoded signals as subject and JSON body."""
    body = F.to_json(F.struct(
        F.col("pgn"), F.col("name"), epoch_seconds("time").alias("time"), F.col("value"),
        F.col("units"), F.col("min_value"), F.col("max_value")), {"ignoreNullFields": "false"})
    return signals.select(
        make_subject("data", "name", prefix=prefix).alias("subject"), body.alias("body"))


def stats_to_messages(stats: DataFrame, prefix: str = "j1939") -> DataFrame:
    """Statistics of signals as subject and JSON body.

    ``lastSent`` is ``last_sent`` where the statistics have it, else the time of the last
    value. Names of the JSON members are fixed by the format.
    """
    sent = "last_sent" if "last_sent" in stats.columns else "to_time"
    body = F.to_json(F.struct(
        F.col("sum_val").alias("sumVal"), F.col("number"), F.col("average"),
        F.col("sum_of_squares").alias("sumOfSquares"), F.col("max_value"), F.col("min_value"),
        F.col("name"), F.col("pgn"), F.col("units"), epoch_seconds("from_time").alias("from"),
        epoch_seconds("to_time").alias("to"), epoch_seconds(sent).alias("lastSent")),
        {"ignoreNullFields": "false"})
    return stats.select(
        *[c for c in ("device", "can_interface") if c in stats.columns],
        make_subject("filter", "name", prefix=prefix).alias("subject"), body.alias("body"))
