"""Streaming aggregates on built-in state."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harrow.operators.alerts import phone_filter
from harrow.operators.signals import gauge_snapshot, signal_stats


def stream_signal_stats(df: DataFrame, width: str = "1 second", watermark: str = "10 seconds",
                        keys: tuple[str, ...] = ("device", "name")) -> DataFrame:
    """Windowed statistics in append mode.

    A window is published when the watermark passes its end; the windows still
    open at the end of the input stay in state. Rows older than the watermark
    are dropped.
    """
    return signal_stats(df.withWatermark("time", watermark), width, keys)


def stream_gauges(df: DataFrame, **options) -> DataFrame:
    """Last value per metric; run in update mode. State is one row per metric."""
    return gauge_snapshot(df, **options)


def stream_subscribers(df: DataFrame, keys: tuple[str, ...] = ("phone",)) -> DataFrame:
    """First request of each valid number. State is one row per number."""
    return phone_filter(df).dropDuplicates(list(keys))


def stream_staleness(df: DataFrame, keys: tuple[str, ...] = ("device",)) -> DataFrame:
    """Newest time per key, for update mode; age it with ``staleness`` when read."""
    return df.groupBy(*keys).agg(F.max("time").alias("time"))


def stream_constraint_split(df: DataFrame, not_null: list[str], unique: list[str], id_col: str, delay: str,
                            time: str = "time") -> DataFrame:
    """Rows with the ``reason`` why a table with these constraints refuses them, NULL for accepted ones; append mode.

    ``unique`` holds the time column. A row comes out when the watermark, ``delay`` behind the newest time, has
    passed it: by then all rows of its key are here, and the one of the lowest id is accepted whatever
    order they came in. So the result is that of ``constraint_split``. The first id of each key is an
    aggregate combined before the shuffle; copies wait as rows of a join, until the watermark passes them. A row
    that misses a column comes out at once. Part late rows off with ``stream_split_late``.
    """
    if time not in unique:
        raise ValueError(f"the unique key needs {time}")
    needed = list(dict.fromkeys(not_null + unique))
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in needed])
    marked = df.withColumn("reason", missing)
    whole = marked.where(F.col("reason").isNull()).drop("reason").withWatermark(time, delay)
    first = whole.groupBy(*unique).agg(F.min(id_col).alias("_first"))
    refused = F.when(F.col(id_col) != F.col("_first"), F.lit("duplicate " + ",".join(unique)))
    judged = whole.join(first, unique).withColumn("reason", refused).select(*df.columns, "reason")
    return judged.unionByName(marked.where(F.col("reason").isNotNull()))
