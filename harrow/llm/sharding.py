"""Sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from harrow.llm.common import HASH_BITS, hash60, numbered_copies, read, stage, text_of
from harrow.llm.registry import query

SHARD_BYTES = 64 << 20
SHARD_COLUMNS = ("shard_depth", "shard_prefix", "shard_bytes", "shard_rows")
SPARE_BITS = 6  # directory bits beyond those an even spread needs


def _prefix(depth: int | Column) -> Column:
    left = F.lit(HASH_BITS) - depth
    return F.when(left >= HASH_BITS, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftright", F.col("_hash"), left.cast("int")))


def shard_directory(rows: DataFrame, size: str, limit: int) -> tuple[DataFrame, int]:
    """Directory of the hash space: ``cell, shard_depth, shard_prefix, shard_bytes, shard_rows``.

    ``rows`` has ``_hash`` (60 bits) and a size. The directory is indexed by the first
    ``depth`` bits (returned too). A bucket is the shortest prefix whose rows fit the
    limit: a bucket that fits is never split, one that does not is split on the next
    bit. A single row above the limit has a bucket of its own. The directory is
    deepened until that holds everywhere.
    """
    total = rows.agg(F.sum(size)).first()[0] or 0
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    while True:
        cells = rows.groupBy(_prefix(depth).alias("cell")).agg(
            F.sum(size).alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
        paths = cells.withColumn(
            "shard_depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))
        ).withColumn("shard_prefix", F.expr(f"shiftright(cell, {depth} - shard_depth)"))
        buckets = paths.groupBy("shard_depth", "shard_prefix").agg(
            F.sum("_bytes").alias("shard_bytes"), F.sum("_rows").alias("shard_rows"))
        fitting = buckets.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
        shortest = (paths.join(fitting, ["shard_depth", "shard_prefix"], "left")
                    .groupBy("cell").agg(F.min(F.when(
                        F.col("shard_rows").isNotNull(),
                        F.struct("shard_depth", "shard_prefix", "shard_bytes", "shard_rows"))
                    ).alias("_bucket")))
        directory = stage(shortest.select("cell", "_bucket.*"), "directory")
        if depth == HASH_BITS or directory.where("shard_depth IS NULL").isEmpty():
            return directory.where("shard_depth IS NOT NULL"), depth
        depth = min(HASH_BITS, depth + SPARE_BITS)


def assign_shards(rows: DataFrame, size: str, limit: int = SHARD_BYTES) -> DataFrame:
    """Rows with ``shard_depth, shard_prefix, shard_bytes, shard_rows``.

    The hash covers all columns, so pass those that tell rows apart and no wide
    text (a digest of it does). Equal rows are numbered and spread like others, so
    one row repeated any number of times is no hot bucket. NULL sizes count 0, NULL
    columns hash as empty texts; no row is lost and an empty table gives no shards.
    Columns that have the names of the results are replaced.
    """
    packed = rows.select(F.struct(*rows.columns).alias("_row"), F.coalesce(
        F.col(size).cast("bigint"), F.lit(0)).alias("_size"))
    hashed = stage(numbered_copies(packed).withColumn("_hash", hash60(
        *[text_of(f"_row.`{c}`") for c in rows.columns], F.col("_copy").cast("string"))), "hashed")
    directory, depth = shard_directory(hashed, "_size", limit)
    placed = hashed.withColumn("cell", _prefix(depth)).join(directory, "cell")
    kept = [F.col(f"_row.`{c}`") for c in rows.columns if c not in SHARD_COLUMNS]
    return placed.select(*kept, *SHARD_COLUMNS)


def write_shards(docs: DataFrame, path: str, text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Documents to one folder per shard under ``path``, replacing what is there.

    Folder names are ``shard=<bits>``. A shard fits one task, for it fits the limit.
    """
    packed = docs.select(F.struct(*docs.columns).alias("doc"),
                         F.octet_length(text).alias("n_bytes"))
    placed = assign_shards(packed, "n_bytes", limit)
    bits = F.when(F.col("shard_depth") > 0, F.lpad(
        F.bin("shard_prefix"), F.col("shard_depth"), F.lit("0"))).otherwise(F.lit(""))
    columns = [F.col(f"doc.`{c}`") for c in docs.columns if c != "shard"]
    (placed.select(*columns, F.concat(F.lit("b"), bits).alias("shard")).repartition("shard")
     .write.mode("overwrite").partitionBy("shard").parquet(path))


def document_shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, n_bytes`` and the shard of each document."""
    narrow = docs.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.md5(text_of("text")).alias("digest"))
    return assign_shards(narrow, "n_bytes", limit).drop("digest")


# One statement for any table of documents; d + 20 bits are ample for the check tables.
SHARDS_SQL = f"""base AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
  md5(coalesce(text, '')) AS digest FROM docs),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n_bytes, digest) - 1 AS copy FROM base),
hashed AS (SELECT doc_id, n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '/'
  || CAST(n_bytes AS VARCHAR) || '/' || digest || '/' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS h
  FROM numbered),
paths AS (SELECT doc_id, n_bytes, h, d, h >> ({HASH_BITS} - d) AS p
  FROM hashed, (SELECT unnest(range(0, 25)) AS d)),
buckets AS (SELECT d, p, CAST(sum(n_bytes) AS BIGINT) AS b, count(*) AS n FROM paths GROUP BY ALL
  HAVING sum(n_bytes) <= {SHARD_BYTES} OR count(*) = 1),
shards AS (SELECT doc_id, n_bytes, CAST(d AS INTEGER) AS shard_depth, p AS shard_prefix,
  b AS shard_bytes, n AS shard_rows
  FROM paths JOIN buckets USING (d, p)
  QUALIFY row_number() OVER (PARTITION BY h, doc_id ORDER BY d) = 1)"""


@query("op8_sharding", f"WITH docs AS (SELECT * FROM documents), {SHARDS_SQL} SELECT * FROM shards")
def op8_sharding(spark, sf):
    return document_shards(read(spark, sf, "documents"))
