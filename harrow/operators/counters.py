"""Interface counters: bus activity, traffic and idleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harrow.operators.pieces import with_previous

# Link type number of a CAN interface; fixed value.
CAN_LINK = 280


def can_link_filter(df: DataFrame, link_type: int = CAN_LINK) -> DataFrame:
    """Links whose type text is digits and equals the CAN link type."""
    text = F.trim(F.col("link_type").cast("string"))
    return df.where(text.rlike("^[0-9]+$") & (text.try_cast("int") == link_type))


def bus_activity(counters: DataFrame, link_type: int = CAN_LINK) -> DataFrame:
    """Received bytes over all CAN links of a device per sample time."""
    return (
        can_link_filter(counters, link_type).groupBy("device", "time")
        .agg(F.sum("rx_bytes").alias("rx_bytes")))


def interface_traffic(counters: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Bytes received per interface and time bucket; none or fewer is silence.

    A sample compares with the one before it, also across buckets, so no traffic is
    lost between them. Of a bucket whose only sample is an interface's first nothing
    can be said: ``delta`` and ``silent`` are NULL.
    """
    grown = with_previous(counters, ["device", "interface"], "time", "rx_bytes", ["rx_bytes"], "_before")
    return (
        grown.groupBy("device", "interface", F.window("time", bucket).alias("_w"))
        .agg(F.sum(F.col("rx_bytes") - F.col("_before.rx_bytes")).alias("delta"))
        .select("device", "interface", F.col("_w.start").alias("bucket"), "delta",
                (F.col("delta") <= 0).alias("silent")))


def idle_detect(activity: DataFrame, **options) -> DataFrame:
    """Samples whose total equals the one before; a device's first compares with 0."""
    return (
        with_previous(activity, ["device"], "time", "rx_bytes", ["rx_bytes"], "_before", **options)
        .where(F.col("rx_bytes") == F.coalesce("_before.rx_bytes", F.lit(0)))
        .select("device", "time", "rx_bytes"))


def interface_resolve(requested: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requested interfaces that exist, and those that do not."""
    return (requested.join(available.select("interface").distinct(), "interface", "left_semi"),
            requested.join(available.select("interface").distinct(), "interface", "left_anti"))
