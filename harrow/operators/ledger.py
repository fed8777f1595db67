"""The sent-ledger: which points were uploaded.

The ledger is not a table that is updated in place. The log of sent keys only
grows; the ledger is the points joined with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from harrow.operators.fleet import newest_n

KEY = ["device", "time"]


def ledger_insert(points: DataFrame, sent_log: DataFrame) -> DataFrame:
    """Ledger row of every point key, unsent unless the log has it."""
    sent = sent_log.select(*KEY).distinct().withColumn("_sent", F.lit(True))
    return (
        points.select(*KEY).distinct().join(sent, KEY, "left")
        .select(*KEY, F.coalesce("_sent", F.lit(False)).alias("sent")))


def unsent(points: DataFrame, sent_log: DataFrame) -> DataFrame:
    return points.join(sent_log.select(*KEY).distinct(), KEY, "left_anti")


def unsent_points(points: DataFrame, sent_log: DataFrame, n: int = 1000) -> DataFrame:
    """The n newest points that were not sent."""
    return newest_n(unsent(points, sent_log), "time", "id", n)


def ledger_backfill(points: DataFrame, ledger: DataFrame) -> DataFrame:
    """Keys of points the ledger does not know."""
    return points.select(*KEY).distinct().join(ledger.select(*KEY).distinct(), KEY, "left_anti")


def ledger_prune(ledger: DataFrame, points: DataFrame) -> DataFrame:
    """Ledger without the keys whose point is gone."""
    return ledger.join(points.select(*KEY).distinct(), KEY, "left_semi")


def ledger_mark_sent(written: DataFrame) -> DataFrame:
    """Log rows of points whose document was written."""
    return written.select(*KEY).distinct()


def upload_retry(points: DataFrame, sent_log: DataFrame, failed_paths: DataFrame,
                 path: tuple[str, ...] = ("device", "day", "geohash")) -> DataFrame:
    """Log after a round: everything unsent was tried, failed paths stay unsent.

    ``points`` carry the path columns.
    """
    tried = unsent(points, sent_log)
    worked = tried.join(failed_paths.select(*path).distinct(), list(path), "left_anti")
    return sent_log.select(*KEY).union(ledger_mark_sent(worked)).distinct()


# --- the ledger from a feed of changes -----------------------------------------------

FEED = {"insert": "inserted", "delete": "deleted", "sent": "marked"}


def feed_split(changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Changes (``seq, op, device, time``) that say something, and the others with a ``reason``."""
    reason = F.coalesce(
        *[F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in ("seq", "op", *KEY)],
        F.when(~F.col("op").isin(*FEED), F.concat(F.lit("unknown op "), F.col("op"))))
    checked = changes.withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def fold_feed(changes: DataFrame) -> DataFrame:
    """What is known of each point: the greatest sequence number of its inserts, deletes and marks.

    That is all that a pass in order would need, and greatest numbers can be taken in any order and
    as often as one likes: batches may come out of order, overlap or be repeated. They combine before
    the shuffle, so a point that changes all the time is one row per task.
    """
    return changes.groupBy(*KEY).agg(*[
        F.max(F.when(F.col("op") == kind, F.col("seq"))).alias(name) for kind, name in FEED.items()])


def merge_folds(folds: DataFrame) -> DataFrame:
    """One row per point of the rows that several folds have of it."""
    return folds.groupBy(*KEY).agg(*[F.max(c).alias(c) for c in FEED.values()])


def ledger_of(folds: DataFrame) -> DataFrame:
    """``device, time, sent`` of the points that are there.

    A point is there if its last insert follows its last delete, and sent if a mark follows
    that insert: a point that was deleted and came again is to be sent again.
    """
    there = folds.where(F.col("inserted") > F.coalesce("deleted", F.lit(-1)))
    return there.select(*KEY, (F.coalesce("marked", F.lit(-1)) > F.col("inserted")).alias("sent"))


def ledger_from_feed(changes: DataFrame) -> DataFrame:
    """Ledger after a feed of inserts, deletes and marks of points, ordered by ``seq``.

    Numbers are not negative, and no two changes of a point have the same one.
    """
    return ledger_of(fold_feed(feed_split(changes)[0]))
