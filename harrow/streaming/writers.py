"""Streams that write tables and documents batch by batch.

A batch may be delivered again after a failure. Everything written here is
keyed: keys already stored are skipped, documents of a batch replace its own.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from harrow import schemas
from harrow.functions.geo import geohash
from harrow.functions.times import day_of
from harrow.operators.gps import class_union, trail_documents
from harrow.operators.ledger import KEY, ledger_mark_sent, unsent, unsent_points
from harrow.sinks.files import write_trail_documents
from harrow.sinks.tables import write_hypertable
from harrow.sources.messages import json_reject_split, read_gpsd

# Place of a document.
PATH = ["device", "day", "geohash"]


def start_batches(df: DataFrame, save, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        query.awaitTermination()
    return query


def write_gpsd_batch(lines: DataFrame, tables: dict[str, str], rejects: str,
                     unique: tuple[str, ...] = ("device", "systime")) -> None:
    """Reports of a batch to the table of their class.

    ``lines`` carries ``body``, ``systime`` and any pass-on columns. Text that
    is no JSON, and reports without a required field, go to ``rejects``, a
    folder of this batch alone.
    """
    good, bad = json_reject_split(lines)
    refused = [bad.select("systime", "body", F.lit("not JSON").alias("reason"))]
    for cls, path in tables.items():
        rows = read_gpsd(good.withColumn("_body", F.col("body")), cls)
        missing = F.coalesce(*[
            F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in schemas.GPSD_NOT_NULL[cls]])
        refused.append(rows.where(missing.isNotNull()).select(
            "systime", F.col("_body").alias("body"), missing.alias("reason")))
        write_hypertable(
            rows.where(missing.isNull()).drop("_body"), path, "systime", list(unique))
    class_union(*refused).write.mode("overwrite").parquet(rejects)


def stream_table_writer(lines: DataFrame, tables: dict[str, str], rejects: str, checkpoint: str,
                        available_now: bool = True) -> StreamingQuery:
    """Each report to a typed row in its class's table."""
    def save(batch: DataFrame, batch_id: int) -> None:
        # Three classes read the batch; keep it instead of the source.
        held = batch.persist()
        try:
            write_gpsd_batch(held, tables, f"{rejects}/batch={batch_id}")
        finally:
            held.unpersist()

    return start_batches(lines, save, checkpoint, available_now)


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.createDataFrame([], schema) if (df := found(spark, path, schema)) is None else df


def found(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _located(points: DataFrame, precision: int) -> DataFrame:
    return points.withColumn("day", day_of("time")).withColumn("geohash", geohash("lat", "lon", precision))


def _log(spark: SparkSession, sent_log: str, points: DataFrame, since: date | None) -> DataFrame:
    log = _read(spark, sent_log, points.select(*KEY).schema.add("day", "date"))
    return log if since is None else log.where(F.col("day") >= F.lit(since))


def _send(taken: DataFrame, failed_paths: DataFrame | None, log: DataFrame, sent_log: str, documents: str,
          precision: int, batch_size: int | None, upload: str | None) -> None:
    """Documents of what is taken, then the log; a point that is logged is not logged again."""
    worked = taken
    if failed_paths is not None:
        worked = _located(taken, precision).join(failed_paths, PATH, "left_anti").select(taken.columns)
    write_trail_documents(trail_documents(worked, precision, batch_size), documents, upload=upload)
    (ledger_mark_sent(unsent(worked, log)).withColumn("day", F.to_date("time"))
     .hint("rebalance", "day").write.partitionBy("day").mode("append").parquet(sent_log))


def upload_once(points: DataFrame, sent_log: str, documents: str, staging: str,
                n: int | None = None, failed_paths: DataFrame | None = None,
                precision: int = 7, batch_size: int | None = None, since: date | None = None) -> int:
    """Upload unsent points; returns how many were taken.

    By default that is all of them in one job, a document per path; ``batch_size``
    cuts those with more points. With ``n`` only the n newest of the fleet go.

    The batch is staged as a table first: documents and log rows then come
    from the same rows even if an executor is lost between them. Documents are
    written before the log; a crash in between sends the batch again with the
    same ids. Points of ``failed_paths`` (device, day, geohash) stay unsent.
    ``since`` leaves out older days, of which neither points nor log are read.
    """
    spark = points.sparkSession
    log = _log(spark, sent_log, points, since)
    if since is not None:
        points = points.where(F.to_date("time") >= F.lit(since))
    chosen = unsent(points, log) if n is None else unsent_points(points, log, n)
    chosen.write.mode("overwrite").parquet(staging)
    taken = spark.read.parquet(staging)
    count = taken.count()
    if count:
        _send(taken, failed_paths, log, sent_log, documents, precision, batch_size, None)
    return count


def stream_trail_upload(points: DataFrame, table: str, sent_log: str, documents: str,
                        staging: str, checkpoint: str, batch_size: int | None = None, precision: int = 7,
                        failing: Callable[[SparkSession, int], DataFrame] | None = None,
                        available_now: bool = True) -> StreamingQuery:
    """Store arriving points, then upload what is unsent.

    ``failing`` gives the paths (device, day, geohash) that cannot be written in a batch. Their
    points stay unsent and are taken again by the next batch, which looks at the days from
    its own oldest point and from the oldest failed path on; the first batch looks at all days.

    What a batch takes and what failed is staged once. A batch that is delivered again goes
    on from there and replaces its own documents, so nothing is lost or doubled.
    """
    failed_type = f"device {points.schema['device'].dataType.simpleString()}, day string, geohash string"

    def stored(batch: DataFrame, batch_id: int) -> date | None:
        """Stores the batch; the first day to look at, or None."""
        held = batch.persist()
        try:
            write_hypertable(held, table, "time", KEY, "id")
            oldest = held.agg(F.min(F.to_date("time"))).first()[0]
        finally:
            held.unpersist()
        earlier = found(batch.sparkSession, f"{staging}/failed/batch={batch_id - 1}", failed_type)
        failed = None if earlier is None else earlier.agg(F.min(F.to_date("day"))).first()[0]
        return min((d for d in (oldest, failed) if d is not None), default=None)

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        taken_path, failed_path, ready = (f"{staging}/{k}/batch={batch_id}" for k in ("taken", "failed", "ready"))
        since = stored(batch, batch_id)
        if since is None and batch_id:
            return
        if not batch_id:
            since = None
        log = _log(spark, sent_log, points, since)
        if found(spark, ready, "id bigint") is None:
            known = _read(spark, table, points.schema.add("day", "date"))
            if since is not None:
                known = known.where(F.col("day") >= F.lit(since))
            unsent(known.drop("day"), log).write.mode("overwrite").parquet(taken_path)
            paths = spark.createDataFrame([], failed_type) if failing is None else failing(spark, batch_id)
            (_located(spark.read.parquet(taken_path), precision).select(*PATH)
             .join(paths, PATH, "left_semi").distinct().write.mode("overwrite").parquet(failed_path))
            spark.range(1).coalesce(1).write.mode("overwrite").parquet(ready)
        taken = spark.read.parquet(taken_path)
        if not taken.isEmpty():
            _send(taken, spark.read.schema(failed_type).parquet(failed_path), log, sent_log, documents, precision,
                  batch_size, f"batch-{batch_id}")

    return start_batches(points, save, checkpoint, available_now)
