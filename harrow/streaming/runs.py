"""Running a stream over what is available, restartable by its checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def run_append(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
               available_now: bool = True) -> StreamingQuery:
    """Write an append-mode stream to files, exactly once."""
    writer = (df.writeStream.format(fmt).outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        query.awaitTermination()
    return query


def run_updates(df: DataFrame, path: str, checkpoint: str,
                available_now: bool = True) -> StreamingQuery:
    """Write an update-mode stream, one folder per batch.

    A repeated batch overwrites its own folder.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = (df.writeStream.outputMode("update").foreachBatch(save)
              .option("checkpointLocation", checkpoint))
    query = (writer.trigger(availableNow=True) if available_now else writer).start()
    if available_now:
        query.awaitTermination()
    return query


def read_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Current row of each key of an update-mode stream."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_row"))
            .select(*keys, "_row.*"))
