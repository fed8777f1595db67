"""As-of joins: each row with the row of another table that is nearest in time.

Both tables are united and scanned once along time; the last row of the other side is carried to
those that follow. Nothing is compared pairwise, and a crowded key is cut into pieces
like in any ordered scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from harrow.operators.pieces import ordered_scan, order_key

_HERE, _THERE = "_here", "_there"


def _usable(df: DataFrame, needed: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])


def _carried(rows: DataFrame, keys: list[str], name: str, forward: bool, max_rows: int | None) -> DataFrame:
    """Adds the last row of the other side at or before each row; at or after it, if ``forward``."""
    # At one instant the rows of the other side come first, whichever way the scan goes.
    side = F.col(_THERE).isNotNull() if forward else F.col(_THERE).isNull()
    tied = rows.withColumn("_tie", F.struct(side.alias("side"), F.col("_id").alias("id")))
    key = F.when(F.col(_THERE).isNotNull(), order_key("_at", "_id"))
    nearest = F.min_by if forward else F.max_by
    scanned = ordered_scan(
        tied, keys, "_at", "_tie",
        local=lambda w: {"_near": F.last(_THERE, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))},
        summary={"_last": nearest(_THERE, key)},
        carried=lambda w: {"_far": F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))},
        newest_first=forward, max_rows=max_rows)
    return scanned.withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far", "_tie")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], *, time: str = "time",
              tie: str = "id", matched: str = "matched_time", direction: str = "backward",
              tolerance_s: float | None = None, max_rows: int | None = None) -> DataFrame:
    """``left`` with ``columns`` of the row of ``right`` that is nearest in time, and its time as ``matched``.

    ``direction`` is backward (at or before), forward (at or after) or nearest (backward if both are
    as far). Of rows of one instant the one of the greatest ``tie`` counts, forward the least. A
    match farther off than ``tolerance_s`` is none. Rows without a match stay, with NULLs; so
    do those with a NULL key or time. Rows of ``right`` with a NULL key or time match nothing.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"no direction {direction}")
    clash = sorted({*columns, matched} & {*left.columns})
    if clash:
        raise ValueError(f"both sides have {', '.join(clash)}; rename one")
    kinds = {f.name: f.dataType for f in right.schema.fields}
    there = F.struct(F.col(time).alias("time"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    placed = [*keys, F.col(time).alias("_at"), F.col(tie).cast("bigint").alias("_id")]
    ours = left.where(_usable(left, [*keys, time])).select(
        *placed, F.struct(*left.columns).alias(_HERE))
    theirs = right.where(_usable(right, [*keys, time])).select(*placed, there.alias(_THERE))
    rows = ours.unionByName(theirs, allowMissingColumns=True)

    if direction != "forward":
        rows = _carried(rows, keys, "_back", False, max_rows)
    if direction != "backward":
        rows = _carried(rows, keys, "_next", True, max_rows)
    at = F.unix_micros("_at")
    if direction == "nearest":
        back, ahead = at - F.unix_micros("_back.time"), F.unix_micros("_next.time") - at
        found = F.when(F.col("_back").isNull() | (ahead < back), F.col("_next")).otherwise(F.col("_back"))
    else:
        found = F.col("_back" if direction == "backward" else "_next")
    if tolerance_s is not None:
        found = F.when(F.abs(at - F.unix_micros(found["time"])) <= round(tolerance_s * 1_000_000), found)
    joined = rows.where(F.col(_THERE).isNull()).withColumn("_found", found).select(
        f"{_HERE}.*", F.col("_found.time").alias(matched),
        *[F.col(f"_found.c{i}").alias(c) for i, c in enumerate(columns)])
    apart = left.where(~_usable(left, [*keys, time])).select(
        "*", F.lit(None).cast(kinds[time]).alias(matched), *[F.lit(None).cast(kinds[c]).alias(c) for c in columns])
    return joined.unionByName(apart)


def signal_position_asof(signals: DataFrame, points: DataFrame, tolerance_s: float | None = 60.0,
                         direction: str = "backward", keys: tuple[str, ...] = ("device",),
                         max_rows: int | None = None) -> DataFrame:
    """Each decoded signal with the machine's position at its time: ``lat, lon, position_time``."""
    return asof_join(signals, points, list(keys), ["lat", "lon"], matched="position_time",
                     direction=direction, tolerance_s=tolerance_s, max_rows=max_rows)
