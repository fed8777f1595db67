"""Modem signal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def cell_pick_tech(df: DataFrame) -> DataFrame:
    """Signal of the LTE entry where present, else of the UMTS entry.

    A sample with neither is dropped. The fraction is cut toward zero.
    """
    signal = F.coalesce("lte_rssi", "umts_rssi")
    return df.where(signal.isNotNull()).select(
        "device", "time",
        F.when(signal < 0, F.ceil(signal)).otherwise(F.floor(signal)).cast("smallint").alias("signal"),
        F.when(F.col("lte_rssi").isNotNull(), "Lte").otherwise("Umts").alias("cell_tech"))
