"""The sent-ledger kept from a stream of inserts, deletes and marks, in folds by day.

Each batch leaves one small fold (``fold_feed``). From time to time the folds since the last time are merged
into those days that they touch; a row of pointers, written last, makes the merged days valid:

    deltas/batch=B/day=D     the fold of a batch
    days/upto=B/day=D        the days that batches up to B touched, merged
    pointers/upto=B          those days

A fold says nothing wrong when it is read twice, so a crash at any step is repaired by doing the step again,
and folders that no pointer names any more can be deleted at leisure.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from harrow.operators.ledger import FEED, KEY, feed_split, fold_feed, ledger_of, merge_folds
from harrow.streaming.writers import found, start_batches

COLUMNS = [*KEY, *FEED.values()]


def _folds(device: str) -> str:
    return f"device {device}, time timestamp, " + ", ".join(f"{c} bigint" for c in FEED.values()) + ", day date"


def _by_day(folds: DataFrame, path: str) -> None:
    (folds.hint("rebalance", "day").write.partitionBy("day").mode("overwrite").parquet(path))


def write_feed_batch(changes: DataFrame, path: str, batch: int) -> None:
    """The fold of a batch of changes in place of what the batch left before."""
    good, bad = feed_split(changes)
    _by_day(fold_feed(good).withColumn("day", F.to_date("time")), f"{path}/deltas/batch={batch}")
    bad.write.mode("overwrite").parquet(f"{path}/rejects/batch={batch}")


def merged_up_to(spark: SparkSession, path: str) -> int:
    """The last batch that merged days hold; -1 for none."""
    pointers = found(spark, f"{path}/pointers", "day date, upto bigint")
    newest = None if pointers is None else pointers.agg(F.max("upto")).first()[0]
    return -1 if newest is None else newest


def _tail(spark: SparkSession, path: str, device: str, after: int) -> DataFrame | None:
    deltas = found(spark, f"{path}/deltas", _folds(device) + ", batch bigint")
    return None if deltas is None else deltas.where(F.col("batch") > after)


def _merged(spark: SparkSession, path: str, device: str, upto: int) -> DataFrame | None:
    """Merged days, each in its newest form up to a batch; older forms are not read."""
    days = found(spark, f"{path}/days", _folds(device) + ", upto bigint")
    if days is None or upto < 0:
        return None
    newest = (found(spark, f"{path}/pointers", "day date, upto bigint").where(F.col("upto") <= upto)
              .groupBy("day").agg(F.max("upto").alias("upto")))
    return days.where(F.col("upto") <= upto).join(newest, ["day", "upto"])


def read_folds(spark: SparkSession, path: str, device: str = "bigint", since: date | None = None) -> DataFrame:
    """The fold of all batches: merged days and the folds written after them; ``since`` leaves out older days."""
    upto = merged_up_to(spark, path)
    parts = [p if since is None else p.where(F.col("day") >= F.lit(since))
             for p in (_merged(spark, path, device, upto), _tail(spark, path, device, upto)) if p is not None]
    if not parts:
        return spark.createDataFrame([], _folds(device))
    rows = parts[0].select(*COLUMNS, "day")
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*COLUMNS, "day"))
    return merge_folds(rows).withColumn("day", F.to_date("time"))


def read_ledger(spark: SparkSession, path: str, device: str = "bigint", since: date | None = None) -> DataFrame:
    """``device, time, sent`` of the points that are there, now."""
    return ledger_of(read_folds(spark, path, device, since))


def merge_days(spark: SparkSession, path: str, device: str = "bigint") -> int:
    """Merge the folds since the last time into the days that they touch; returns the last batch merged.

    Other days are neither read nor written. Cut short before the pointers are there, the days written are
    invisible and the next call replaces them.
    """
    upto = merged_up_to(spark, path)
    tail = _tail(spark, path, device, upto)
    last = None if tail is None else tail.agg(F.max("batch")).first()[0]
    if last is None:
        return upto
    tail = tail.where(F.col("batch") <= last)
    touched = tail.select("day").distinct()
    before = _merged(spark, path, device, upto)
    rows = tail.select(*COLUMNS)
    if before is not None:
        rows = rows.unionByName(before.join(touched, "day", "left_semi").select(*COLUMNS))
    _by_day(merge_folds(rows).withColumn("day", F.to_date("time")), f"{path}/days/upto={last}")
    touched.coalesce(1).write.mode("overwrite").parquet(f"{path}/pointers/upto={last}")
    return last


def stream_ledger_feed(changes: DataFrame, path: str, checkpoint: str, merge_every: int = 16,
                       available_now: bool = True) -> StreamingQuery:
    """Keep the ledger under ``path`` from a stream of changes (``seq, op, device, time``).

    Changes may come in any order and more than once, the ledger is that of one pass in the order of
    ``seq``; no state is held, so none can be late. Rows without a key, number or known kind go to ``rejects``.
    Days are merged every so many batches.
    """
    device = changes.schema["device"].dataType.simpleString()

    def save(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            write_feed_batch(held, path, batch_id)
        finally:
            held.unpersist()
        if (batch_id + 1) % merge_every == 0:
            merge_days(batch.sparkSession, path, device)

    return start_batches(changes, save, checkpoint, available_now)
