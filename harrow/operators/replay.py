"""Replay check: messages sent and received compared one for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _balance(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Sent minus received copies per message; copies combine before the shuffle."""
    signed = expected.withColumn("_s", F.lit(1)).unionByName(received.withColumn("_s", F.lit(-1)))
    return signed.groupBy(*expected.columns).agg(F.sum("_s").alias("_s"))


def replay_missing(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Messages sent more often than received, with the number of copies left."""
    return _balance(expected, received).where("_s > 0").withColumnRenamed("_s", "n")


def replay_unexpected(expected: DataFrame, received: DataFrame) -> DataFrame:
    return replay_missing(received, expected)


def replay_match(expected: DataFrame, received: DataFrame) -> DataFrame:
    """Both differences in one pass; empty when every message arrived once."""
    return (
        _balance(expected, received).where("_s <> 0")
        .select(F.when(F.col("_s") > 0, "missing").otherwise("unexpected").alias("side"),
                *expected.columns, F.abs("_s").alias("n")))
