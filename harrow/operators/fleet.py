"""Fleet health: newest rows, staleness, reachability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from harrow.functions.times import gap_text
from harrow.operators.pieces import order_key, ordered_scan


def latest_row(df: DataFrame, keys: list[str], time: str = "time", tie: str = "id") -> DataFrame:
    """Newest row of the table, or of each key; equal times go to the higher id.

    The newest position of each key is a hash aggregate; rows at such a position are then
    picked by a join, so the table is neither sorted nor shuffled while keys are few. A row
    that is stored twice comes once.
    """
    placed = df.withColumn("_position", order_key(time, tie))
    newest = placed.groupBy(*keys).agg(F.max("_position").alias("_newest")).where(
        F.col("_newest").isNotNull()).select(*[F.col(k).alias(f"_key_{k}") for k in keys], "_newest")
    same = F.col("_position") == F.col("_newest")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    found = placed.join(newest, same, "left_semi")
    if not keys:
        return found.select(*df.columns).limit(1)
    first = Window.partitionBy(*keys).orderBy("_position")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*df.columns)


def newest_time(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """Newest time alone; enough for ``staleness`` and cheaper than the row."""
    return df.groupBy(*keys).agg(F.max(time).alias(time))


def newest_one(df: DataFrame, time: str = "time", tie: str = "id") -> DataFrame:
    return latest_row(df, [], time, tie)


def newest_n(df: DataFrame, time: str = "time", tie: str = "id", n: int = 1000) -> DataFrame:
    """The n newest rows: each task keeps n, the tops are merged."""
    return df.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(n)


def export_range(df: DataFrame, time: str = "time") -> DataFrame:
    return df.agg(F.min(time).alias("first"), F.max(time).alias("last"))


def staleness(latest: DataFrame, expected: DataFrame, now: Column, threshold_s: float = 5.0,
              keys: tuple[str, ...] = ("device",), time: str = "time",
              silent: str | None = None) -> DataFrame:
    """Age of the newest row per expected key.

    Healthy is an age of at most the threshold; a key without rows is not
    healthy. ``silent`` names a flag of ``expected`` that exempts a key whose
    bus carried nothing.
    """
    age = (F.unix_micros(now) - F.unix_micros(F.col(time))) / F.lit(1000000.0)
    healthy = F.coalesce(age <= F.lit(float(threshold_s)), F.lit(False))
    if silent:
        healthy = healthy | F.coalesce(F.col(silent), F.lit(False))
    return (
        expected.join(latest.select(*keys, time), list(keys), "left")
        .withColumn("age_s", age).withColumn("healthy", healthy))


def device_label(df: DataFrame, labels: DataFrame, key: str = "device") -> DataFrame:
    """Attach names; unknown devices keep a NULL label.

    Spark broadcasts the labels while they are under its size threshold and
    otherwise joins by shuffle, splitting skewed devices.
    """
    return df.join(labels.select(key, "label"), key, "left")


def transition_columns(previous_ok: Column, last_seen: Column) -> dict[str, Column]:
    was_online = F.coalesce(previous_ok, F.lit(False))
    event = F.when(F.col("ok") & ~was_online, F.lit("online")).when(
        ~F.col("ok") & was_online, F.lit("offline"))
    gap = F.floor(
        (F.unix_micros("time") - F.unix_micros(last_seen)) / F.lit(1000000)).cast("bigint")
    return {"event": event, "last_seen": last_seen,
            "gap_s": F.when(event == "online", gap)}


def online_transitions(probes: DataFrame, **options) -> DataFrame:
    """Came-online and went-offline events.

    A device starts offline and never seen. ``last_seen`` is the last good
    probe before the event; the gap is given for devices that came online and
    were seen before.
    """
    seen = F.when(F.col("ok"), F.col("time"))
    before = (Window.unboundedPreceding, -1)
    scanned = ordered_scan(
        probes, ["device"], "time", "id",
        local=lambda w: {"_near_ok": F.lag("ok").over(w),
                         "_near_seen": F.max(seen).over(w.rowsBetween(*before))},
        summary={"_last_ok": F.max_by("ok", order_key("time", "id")), "_seen": F.max(seen)},
        carried=lambda w: {"_far_ok": F.lag("_last_ok").over(w),
                           "_far_seen": F.max("_seen").over(w.rowsBetween(*before))}, **options)
    events = scanned.withColumns(transition_columns(
        F.coalesce("_near_ok", "_far_ok"), F.coalesce("_near_seen", "_far_seen")))
    return events.where(F.col("event").isNotNull()).select(
        "id", "device", "time", "event", "last_seen", "gap_s",
        F.when(F.col("event") == "online",
               F.coalesce(gap_text("gap_s"), F.lit("never seen"))).alias("gap_text"))


def fleet_state(probes: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """Last seen and online flag per device.

    ``previous`` is an earlier state (device, last_seen, online, checked): a
    run over new probes only continues from it.
    """
    state = probes.groupBy("device").agg(
        F.max(F.when(F.col("ok"), F.col("time"))).alias("last_seen"),
        F.max_by("ok", order_key("time", "id")).alias("online"), F.max("time").alias("checked"))
    if previous is None:
        return state
    both = state.unionByName(previous.select(state.columns))
    return both.groupBy("device").agg(
        F.max("last_seen").alias("last_seen"), F.max_by("online", "checked").alias("online"),
        F.max("checked").alias("checked"))
