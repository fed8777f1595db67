"""Mixing of sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from harrow.llm.common import HASH_BITS, hash60, numbered_copies, read, stage, text_of
from harrow.llm.registry import query

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)       # of the sources by code point, repeating
SHARE = 1.5               # of all words that the mix takes
MOST = 2                  # passes over a source
PASSES_PER_BUCKET = 2_000
# Weight of a source over training time 0..1, as (time, factor) knots for each of WEIGHTS:
# the heaviest sources come late, the lightest early.
SCHEDULES = (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, docs, rank, weight_class, target`` of each source.

    Takes one row per source. Targets share ``share`` of all words by weight; none
    exceeds ``most`` times its source. Handing the excess round again by weight until
    none is above ends where every target is min(most * size, level * weight): the
    sources are put in the order in which they fill up and the level is the first
    at which the rest can take what is left. Works on the summed table only.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn(
        "weight_class", (F.pmod(F.col("rank") - 1, F.lit(n))).cast("int"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.col("weight_class") + 1)
    limit = F.col("source_size") * most
    filled = ranked.withColumn("_w", weight.cast("bigint")).withColumn(
        "_fill", limit.cast("double") / F.col("_w"))
    before = Window.orderBy("_fill", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("_fill", "rank").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("source_size").over(everything).cast("double") * share
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0)).cast("double")) / F.sum(
        "_w").over(onward).cast("double")
    levels = filled.withColumn("_level", level)
    first = F.min(F.when(F.col("_level") <= F.col("_fill"), F.struct("_fill", "rank", "_level"))
                  ).over(everything)
    return (levels.withColumn("_first", first)
            .withColumn("target", F.when(
                F.col("_first").isNull()
                | (F.struct("_fill", "rank") < F.struct("_first._fill", "_first.rank")),
                limit.cast("double")).otherwise(F.col("_first._level") * F.col("_w")))
            .select("source", "source_size", "docs", "rank", "weight_class", "target"))


def training_time(demand: Column, knots) -> Column:
    """Time at which a source has been asked for the given part (0..1) of its words.

    Inverts the integral of a piecewise linear weight: the segment in which the
    demand falls, then the root of its quadratic.
    """
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
    whole, done, time = sum(areas), 0.0, None
    for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
        rest = demand * whole - done
        slope = (w1 - w0) / (t1 - t0)
        inside = F.lit(t0) + (rest / w0 if slope == 0 else
                              (F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + rest * (2 * slope))) - w0)
                              / slope)
        part = (demand * whole < done + area, inside)
        time = F.when(*part) if time is None else time.when(*part)
        done += area
    return time.otherwise(F.lit(float(knots[-1][0])))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """:func:`mix` range-sorted by position, documents that are not taken last."""
    return (mix(docs, **settings).drop("copy")
            .repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id"))
            .sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST,
          schedules=SCHEDULES, bucket_rows: int = PASSES_PER_BUCKET) -> DataFrame:
    """One row per document of ``docs`` (``doc_id, source, size``): what the mix takes and when.

    Adds ``source_size, target, taken, position, last_position``. A source's
    documents stand in the order of a hash of their id. Whole passes over the source come
    first; the rest of the target is the head of one more pass, whose last document is
    cut at the target. The words a source has been asked for before a document, put
    through the inverse of its schedule, are the document's position in training
    (NULL if nothing of it is taken).

    The running sum of a source goes over hash buckets: sums of buckets first, then
    inside each. Copies of one row are counted and dealt out at the end, so no
    source and no repeated row has to fit a task. NULL sizes count 0; a NULL
    source is one source, the last. The same rows give the same result in any order.
    """
    narrow = docs.select("doc_id", "source", F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size"))
    counted = stage(numbered_copies(narrow), "sizes")
    sizes = counted.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    targets = stage(source_targets(sizes, weights, share, most), "targets")
    largest = targets.agg(F.max("docs")).first()[0] or 1
    bits = max(0, math.ceil(math.log2(max(1, largest / bucket_rows))))

    order = hash60(text_of("doc_id"), F.col("_copy").cast("string"))
    placed = (counted.join(targets.withColumnRenamed("source", "_source"),
                           F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "docs")
              .withColumn("_order", order)
              .withColumn("_bucket", F.shiftright("_order", HASH_BITS - bits) if bits else F.lit(0)))
    sums = placed.groupBy("rank", "_bucket").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("rank", "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy("rank", "_bucket").orderBy("_order", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    located = placed.join(starts, ["rank", "_bucket"]).withColumn(
        "_before", F.col("_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))

    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - F.col("_passes") * F.col("source_size")).cast("bigint")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before")))
    asked = lambda c: c.cast("double") / F.col("target")
    curve = F.when(F.col("weight_class") == 0, training_time(F.col("_part"), schedules[0]))
    for k in range(1, len(schedules)):
        curve = curve.when(F.col("weight_class") == k, training_time(F.col("_part"), schedules[k]))

    def at(df: DataFrame, name: str, words: Column, when: Column) -> DataFrame:
        part = F.when(when, asked(words))
        return df.withColumn("_part", part).withColumn(
            name, F.when(F.col("_part").isNotNull(), curve)).drop("_part")

    taken = (located.withColumn("_passes", passes.cast("bigint")).withColumn("_extra", extra)
             .withColumn("taken", F.col("_passes") * F.col("size") + F.col("_extra")))
    some = F.col("taken") > 0
    taken = at(taken, "position", F.col("_before"), some)
    last_pass = F.when(F.col("_extra") > 0, F.col("_passes")).otherwise(F.col("_passes") - 1)
    taken = at(taken, "last_position", last_pass * F.col("source_size") + F.col("_before"), some)
    return taken.select("doc_id", "source", "size", F.col("_copy").alias("copy"), "source_size",
                        "target", "taken", "position", "last_position")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def document_mix(docs: DataFrame, **settings) -> DataFrame:
    """The mix of a table of documents; size is the number of words of the whole text."""
    return mixed(docs.select("doc_id", "source", word_count().alias("size")), **settings)


def training_stream(docs: DataFrame, **settings) -> DataFrame:
    """The documents in the order in which training reads them, once for each time.

    A document comes once per pass that takes words of it, whole; one that the mix does
    not take does not come. All columns are as they were. Rows are told apart by
    a digest of their content, equal rows by a number, so repeated and NULL ids do no harm.
    """
    columns = docs.columns
    key = F.md5(F.concat_ws("/", text_of("doc_id"), text_of("source"), text_of("text")))
    sizes = stage(docs.select(key.alias("doc_id"), "source", word_count().alias("size")), "sizes")
    plan = mix(sizes, **settings).where("taken > 0").select(
        F.col("doc_id").alias("_key"), F.col("copy").cast("int").alias("_copy"),
        F.array_compact(F.array(
            F.col("position"), F.when(F.col("taken") > F.col("size"), F.col("last_position"))
        )).alias("_times"))
    rows = docs.select(F.struct(*columns).alias("_doc"), key.alias("_key"))
    if sizes.groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.withColumn("_copy", F.lit(0))
    else:
        rows = numbered_copies(rows)
    timed = rows.join(plan, ["_key", "_copy"]).select("_doc", F.explode("_times").alias("_time"), "_key")
    return timed.repartitionByRange("_time", "_key").sortWithinPartitions("_time", "_key").select("_doc.*")


def _curve_sql(x: str) -> str:
    """The default schedules, solved by hand: w = 1/2 + t, w = 3/2 - t, w = 1."""
    return f"""CASE (rank - 1) % 3 WHEN 0 THEN (sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + {x} * 2.0::DOUBLE))
      - 0.5::DOUBLE) / 1.0::DOUBLE
    WHEN 1 THEN (sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE + {x} * (-2.0)::DOUBLE)) - 1.5::DOUBLE) / (-1.0)::DOUBLE
    ELSE {x} END"""


# Hands the excess round step by step, as the task states it; twenty steps settle twenty sources.
MIX_SQL = """WITH RECURSIVE sized AS (SELECT doc_id, source,
  CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank,
  [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
rounds AS (SELECT 0 AS step, rank, w, source_size, false AS capped, CAST(0 AS DOUBLE) AS target FROM sources
  UNION ALL SELECT step + 1, rank, w, source_size, capped OR t > 2 * source_size,
    least(t, CAST(2 * source_size AS DOUBLE)) FROM (SELECT *, CASE WHEN capped THEN 2.0::DOUBLE * source_size ELSE w *
      (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
       - CAST(coalesce(sum(2 * source_size) FILTER (WHERE capped) OVER (), 0) AS DOUBLE))
      / CAST(sum(w) FILTER (WHERE NOT capped) OVER () AS DOUBLE) END AS t FROM rounds WHERE step < 20)),
targets AS (SELECT rank, target FROM rounds WHERE step = 20),
placed AS (SELECT doc_id, sized.source, size, source_size, rank, target,
  coalesce(sum(size) OVER (PARTITION BY rank ORDER BY CAST('0x' || substr(md5(
    CAST(doc_id AS VARCHAR) || '/0'), 1, 15) AS BIGINT), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source JOIN targets USING (rank)),
taken AS (SELECT *, floor(target / source_size) AS passes, greatest(0, least(size,
  round(target - floor(target / source_size) * source_size) - before)) AS extra FROM placed),
parts AS (SELECT *, CAST(passes * size + extra AS BIGINT) AS taken, CAST(before AS DOUBLE) / target AS x FROM taken)
SELECT doc_id, source, size, source_size, round(target, 6) AS target, taken,
  round(CASE WHEN taken > 0 THEN """ + _curve_sql("x") + """ END, 9) AS position FROM parts"""


@query("op6_mixing", MIX_SQL)
def op6_mixing(spark, sf):
    return document_mix(read(spark, sf, "documents")).select(
        "doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), "taken",
        F.round("position", 9).alias("position"))
