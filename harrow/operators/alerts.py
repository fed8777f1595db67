"""Threshold alerts and their subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harrow.operators.pieces import with_previous

# International phone number: plus sign, up to fifteen digits; fixed pattern.
PHONE = r"^\+[1-9][0-9]{1,14}$"


def rising_edge_alerts(readings: DataFrame, threshold: int = 1,
                       keys: tuple[str, ...] = ("device", "subject"), **options) -> DataFrame:
    """Readings that reach the threshold when the one before did not.

    Before a key's first reading the level counts as 0.
    """
    return (
        with_previous(readings, list(keys), "time", "id", ["reading"], "_before", **options)
        .where((F.col("reading") >= threshold)
               & (F.coalesce("_before.reading", F.lit(0)) < threshold))
        .select("id", *keys, "time", "reading"))


def phone_filter(df: DataFrame, col: str = "phone") -> DataFrame:
    return df.where(F.col(col).rlike(PHONE))


def subscriber_set(requests: DataFrame, keys: tuple[str, ...] = ("phone",)) -> DataFrame:
    """Each valid number once, with the time it was first seen."""
    return (
        phone_filter(requests).groupBy(*keys)
        .agg(F.min("time").alias("time")))


def alert_fanout(alerts: DataFrame, subscribers: DataFrame, on: tuple[str, ...] = ("device",),
                 body: str = "The number is ") -> DataFrame:
    """One text per alert and subscriber of the machine that raised it.

    Each machine has its own list of numbers, so this is an equi-join on the
    machine; the rows out are the texts to send, no more.
    """
    return (
        alerts.join(subscribers.select(*on, "phone"), list(on))
        .select(*on, F.col("id").alias("alert_id"), "phone",
                F.concat(F.lit(body), F.col("reading").cast("string")).alias("body")))
