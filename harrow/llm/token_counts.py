"""Token counts by source, language and tokenizer version, maintained by signed deltas."""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harrow.llm.common import read, stage
from harrow.llm.registry import query
from harrow.session import shared_folder

KEYS = ("source", "lang", "version")
WORDS = r"[^\x20\x09-\x0D]+"
PIECES = r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x20\x09-\x0D]+"
PLAIN_PIECES = r"\p{L}+|\p{N}+"


def inserted(counts: DataFrame) -> DataFrame:
    """Documents (``source, lang, version, tokens``) that come in."""
    return counts.select(*KEYS, "tokens", F.lit(1).alias("sign"))


def deleted(counts: DataFrame) -> DataFrame:
    """Documents that go, with the counts they came in with."""
    return counts.select(*KEYS, "tokens", F.lit(-1).alias("sign"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """Documents whose count, source, language or version changes: old rows out, new rows in."""
    return deleted(before).union(inserted(after))


COMMITS = "batch string, folder string"
DELTAS = "source string, lang string, version string, docs bigint, tokens bigint"


def _commits(spark: SparkSession, path: str) -> DataFrame:
    """Committed batches and the folders of their deltas; a batch that went into another has none."""
    try:
        return spark.read.schema(COMMITS).parquet(f"{path}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], COMMITS)


def is_committed(spark: SparkSession, path: str, batch: str) -> bool:
    return not _commits(spark, path).where(F.col("batch") == batch).isEmpty()


def _folder(batch: str) -> str:
    """A folder name for any batch name."""
    return hashlib.md5(batch.encode("utf-8", "surrogatepass")).hexdigest()


def commit(changes: DataFrame, path: str, batch: str) -> bool:
    """Adds one batch of signed changes to the rollup under ``path``, once.

    A batch that is committed is left alone (returns False). One that was cut short has no
    commit row; its deltas are written anew over what is there. Deltas are sums per
    key, combined before the shuffle, so one hot source costs one row per task.
    NULL keys are keys like others; NULL tokens count 0.
    """
    spark = changes.sparkSession
    if is_committed(spark, path, batch):
        return False
    sign = F.col("sign").cast("bigint")
    deltas = changes.groupBy(*KEYS).agg(
        F.sum(sign).alias("docs"), F.sum(sign * F.coalesce(F.col("tokens").cast("bigint"), F.lit(0))).alias("tokens"))
    deltas.write.mode("overwrite").parquet(f"{path}/deltas/{_folder(batch)}")
    spark.createDataFrame([(batch, _folder(batch))], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return True


def totals(spark: SparkSession, path: str) -> DataFrame:
    """``source, lang, version, docs, tokens`` of all committed batches; keys at zero are left out."""
    folders = [r[0] for r in _commits(spark, path).where("folder IS NOT NULL").select("folder").distinct()
               .toLocalIterator()]
    if not folders:
        return spark.createDataFrame([], DELTAS)
    deltas = spark.read.schema(DELTAS).parquet(*[f"{path}/deltas/{f}" for f in folders])
    return deltas.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where(
        "docs <> 0 OR tokens <> 0")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """All committed batches as one rollup at a new path; batch names stay committed.

    Two jobs however many batches there are; a rollup without commits gives an empty one.
    """
    totals(spark, path).write.mode("overwrite").parquet(f"{to}/deltas/{_folder('compacted')}")
    merged = _commits(spark, path).select("batch", F.lit(None).cast("string").alias("folder")).distinct()
    merged.union(spark.createDataFrame([("compacted", _folder("compacted"))], COMMITS)).write.mode(
        "overwrite").parquet(f"{to}/commits")


def counted(docs: DataFrame, pattern: str, version: str, text: str = "text") -> DataFrame:
    """Documents with ``tokens`` by a pattern and ``version``; a NULL text has none."""
    return docs.withColumn("tokens", _count(pattern, text)).withColumn("version", F.lit(version))


def _count(pattern: str, text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("bigint")


def tokenized(docs: DataFrame, file: str, version: str, text: str = "text") -> DataFrame:
    """``doc_id, source, lang, tokens, version`` by a tokenizer file that all executors can read."""
    def run(frames):
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(file)
        tokenizer.encode_special_tokens = True
        for frame in frames:
            texts = [t or "" for t in frame.pop("_text")]
            frame["tokens"] = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return docs.select("doc_id", "source", "lang", F.col(text).alias("_text")).mapInPandas(
        run, "doc_id long, source string, lang string, tokens long").withColumn("version", F.lit(version))


# Words of all documents and pieces of all, pieces then counted without marks, and the
# documents of fewer than 20 words withdrawn: what is left, computed at once.
TOTALS_SQL = r"""WITH counted AS (SELECT source, lang,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS w,
  coalesce(len(regexp_extract_all(text, '\p{L}+|\p{N}+')), 0) AS p FROM documents)
SELECT source, lang, version, count(*) AS docs, CAST(sum(CASE version WHEN 'words' THEN w ELSE p END) AS BIGINT) AS tokens
FROM counted, (SELECT unnest(['words', 'pieces']) AS version) WHERE w >= 20 GROUP BY ALL"""


@query("op9_token_counts", TOTALS_SQL)
def op9_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "token-counts")
    counts = stage(read(spark, sf, "documents").select(
        "source", "lang", _count(WORDS).alias("words"), _count(PIECES).alias("pieces"),
        _count(PLAIN_PIECES).alias("plain")), "counts")

    def version(rows: DataFrame, name: str, column: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(name).alias("version"), F.col(column).alias("tokens"))

    words, pieces, plain = (version(counts, *v) for v in (
        ("words", "words"), ("pieces", "pieces"), ("pieces", "plain")))
    short = counts.where("words < 20")
    batches = {
        "load": inserted(words).union(inserted(pieces)),
        "revise": revised(pieces, plain),
        "withdraw": deleted(version(short, "words", "words")).union(deleted(version(short, "pieces", "plain")))}
    for name in ("load", "revise", "load", "withdraw", "revise"):   # some are delivered twice
        commit(batches[name], path, name)
    return totals(spark, path)
