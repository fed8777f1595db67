"""Work sessions: stretches of a machine's rows without a long gap between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harrow.operators.pieces import IS_CUT, PIECE, cut_into_pieces


def session_measures(measures: tuple[str, ...]) -> dict[str, Column]:
    """Aggregates of a session by name; they can be added up again under the same name."""
    return {f"{kind}_{m}": getattr(F, kind)(m) for m in measures for kind in ("min", "max", "sum")}


def work_sessions(rows: DataFrame, gap_s: float, keys: tuple[str, ...] = ("device",), time: str = "time",
                  tie: str = "id", measures: tuple[str, ...] = (), max_rows: int | None = None) -> DataFrame:
    """Sessions of each key: a row belongs to the session of the one before if it comes at most ``gap_s`` later.

    Returns keys, ``start_time, end_time, duration_s, rows`` and, for each of ``measures``, its
    minimum, maximum and sum. Rows without a time are in no session.

    Sessions are found in the pieces of a crowded key and summed up there. The session that is open at
    the end of a piece is carried on: over any number of pieces, as long as each has one
    session alone. Its parts are then added up under the start it was opened at.
    """
    keys, gap = list(keys), round(gap_s * 1_000_000)
    timed = rows.where(F.col(time).isNotNull())
    cut = cut_into_pieces(timed, keys, time, tie, max_rows)
    piece = keys if cut is None else [*keys, PIECE]
    marks = [] if cut is None else [IS_CUT]
    along = Window.partitionBy(*piece).orderBy(time, tie)
    before = F.lag("_us").over(along)
    opened = F.when(before.isNull() | (F.col("_us") - before > gap), F.col("_us"))
    parts = (
        (timed if cut is None else cut).withColumn("_us", F.unix_micros(time)).withColumn("_opened", opened)
        .withColumn("_start", F.last("_opened", ignorenulls=True).over(along))
        .groupBy(*piece, *marks, "_start").agg(
            F.max("_us").alias("_end"), F.count(F.lit(1)).alias("rows"),
            *[c.alias(n) for n, c in session_measures(measures).items()]))
    if cut is not None:
        parts = parts.join(_open_sessions(parts, keys, gap), [*keys, PIECE], "left").withColumn(
            "_start", F.when(F.col("_start") == F.col("_first"), F.coalesce("_carried", "_start"))
            .otherwise(F.col("_start")))
        parts = parts.groupBy(*keys, "_start").agg(
            F.max("_end").alias("_end"), F.sum("rows").alias("rows"),
            *[getattr(F, n.split("_")[0])(n).alias(n) for n in session_measures(measures)])
    return parts.select(
        *keys, F.timestamp_micros("_start").alias("start_time"), F.timestamp_micros("_end").alias("end_time"),
        ((F.col("_end") - F.col("_start")) / 1_000_000).alias("duration_s"), "rows", *session_measures(measures))


def _open_sessions(parts: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """For each piece of a cut key: its first session's start, and the start of the earlier one it goes on with."""
    along = Window.partitionBy(*keys).orderBy(PIECE)
    pieces = parts.where(IS_CUT).groupBy(*keys, PIECE).agg(
        F.min("_start").alias("_first"), F.max("_start").alias("_last"), F.max("_end").alias("_ends"),
        F.count(F.lit(1)).alias("_n"))
    goes_on = F.coalesce(F.col("_first") - F.lag("_ends").over(along) <= gap, F.lit(False))
    return (
        pieces.withColumn("_goes_on", goes_on)
        # What is open at the end of a piece began there, or is what was open before.
        .withColumn("_begun", F.when(~F.col("_goes_on") | (F.col("_n") > 1), F.col("_last")))
        .withColumn("_open", F.last("_begun", ignorenulls=True).over(along))
        .withColumn("_carried", F.when(F.col("_goes_on"), F.lag("_open").over(along)))
        .select(*keys, PIECE, "_first", "_carried"))
