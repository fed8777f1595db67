"""Day-partitioned tables, unique on a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from harrow.operators.constraints import first_per_key
from harrow.sources.tables import read_days


def accept_new(df: DataFrame, path: str, unique: list[str], time: str = "time",
               order: str | None = None) -> DataFrame:
    """First row of each key that the table at ``path`` does not hold.

    ``df`` carries ``day``. The first and last day of ``df`` are found before, so
    that only those days of the table are listed and read.
    """
    key = ["day", *unique]
    fresh = first_per_key(df, key, order or time)
    first, last = df.agg(F.min("day"), F.max("day")).first()
    held = None if first is None else read_days(df.sparkSession, path, first, last)
    if held is None:
        return fresh
    held = held.select(*[F.col(c).alias(f"_held_{c}") for c in key])
    # A NULL in a key equals a NULL, so a repeated batch adds no such rows either.
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in key])
    return fresh.join(held, same, "left_anti")


def write_hypertable(df: DataFrame, path: str, time: str = "time",
                     unique: list[str] | None = None, order: str | None = None) -> None:
    """Append rows to a table partitioned by day; keys already there are skipped.

    Writing the same rows twice leaves the table as it was, which makes a
    repeated streaming batch or a rerun harmless.
    """
    dated = df.withColumn("day", F.to_date(time))
    if unique:
        dated = accept_new(dated, path, unique, time, order)
    (dated.hint("rebalance", "day").write.partitionBy("day").mode("append").parquet(path))


def write_jdbc(df: DataFrame, url: str, table: str, batch_rows: int = 1000, **options: str) -> None:
    """Append to a relational table in multi-row inserts."""
    (df.write.format("jdbc").mode("append").options(**{
        "url": url, "dbtable": table, "batchsize": str(batch_rows),
        "reWriteBatchedInserts": "true", **options}).save())
