"""Time-partitioned tables."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F


def _utc(value: datetime | str) -> datetime:
    at = datetime.fromisoformat(value) if isinstance(value, str) else value
    return at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)


def read_days(spark: SparkSession, path: str, first: date, last: date) -> DataFrame | None:
    """Rows of the day folders from first to last, which alone are listed; None if there are none."""
    days = ",".join((first + timedelta(days=k)).isoformat() for k in range((last - first).days + 1))
    try:
        return spark.read.option("basePath", path).parquet(f"{path}/day={{{days}}}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_table_window(spark: SparkSession, path: str, start: datetime | str,
                      end: datetime | str, columns: list[str], time: str = "time") -> DataFrame:
    """Columns of a table between two times, both included.

    The day bounds follow from the time bounds, so only the partitions of
    those days are listed and read. Times without a zone are UTC.
    """
    first, last = _utc(start), _utc(end)
    days = read_days(spark, path, first.date(), last.date()) if first <= last else None
    if days is None:
        days = spark.read.parquet(path).limit(0)
    return (
        days.where(F.col(time).between(F.lit(first), F.lit(last)))
        .select(*columns))


def read_jdbc_window(spark: SparkSession, url: str, table: str, start: datetime | str,
                     end: datetime | str, columns: list[str], time: str = "time",
                     partitions: int = 16, **options: str) -> DataFrame:
    """The same scan of a relational table, split along time into parallel reads.

    Filter and projection are pushed to the database; its driver must be on
    the class path.
    """
    first, last = _utc(start), _utc(end)
    text = "%Y-%m-%d %H:%M:%S.%f"
    return (
        spark.read.format("jdbc").options(**{
            "url": url, "dbtable": table, "partitionColumn": time,
            "lowerBound": first.strftime(text), "upperBound": last.strftime(text),
            "numPartitions": str(partitions), "fetchsize": "10000", **options})
        .load().where(F.col(time).between(F.lit(first), F.lit(last))).select(*columns))
