"""Fixed-size batches in arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harrow.operators.pieces import with_row_number


def batch_rows(df: DataFrame, keys: tuple[str, ...] = ("device", "can_interface"),
               n: int = 1000, time: str = "time", tie: str = "id", **options) -> DataFrame:
    """Add ``batch_id``: rows of a bus in arrival order, ``n`` to a batch.

    The last batch of a bus may be short; it is kept.
    """
    ranked = with_row_number(df, list(keys), time, tie, "_rank", **options)
    return ranked.withColumn(
        "batch_id", F.floor((F.col("_rank") - 1) / F.lit(n)).cast("bigint")).drop("_rank")
