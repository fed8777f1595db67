"""Ordered scans over keys of any size.

A window over ``partitionBy(device)`` puts every row of a device in one task.
That is the right plan while a device fits a task, so the keys are counted
first. A crowded key is cut along its order at measured split points; rows are
then ranked, lagged or accumulated inside their piece, each piece is summed up
to one small row, and what a piece needs from those before it is carried in by
a join on (key, piece). Rows are shuffled once; window and join share that
shuffle.

Key columns are NOT NULL, and (key, time, tie) names one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from harrow.session import set_checkpoint_dir

PIECE, IS_CUT = "_piece", "_is_cut"
# Piece of a key that is not cut.
WHOLE = -1
# Rows below which a key is never worth cutting.
SMALL_KEY = 1_000_000
# Samples taken for each split point; evens out the pieces.
_SAMPLES_PER_SPLIT = 16


def shuffle_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_into_pieces(df: DataFrame, keys: list[str], time: str, tie: str,
                    max_rows: int | None = None, least_us: int = 0) -> DataFrame | None:
    """Add ``_piece`` and ``_is_cut``, or return None when no key is crowded.

    The count per key is one pre-aggregated pass over the key columns. A key is
    crowded when it holds more rows than a quarter of an even task share (and
    more than a million), so there are fewer than four crowded keys per shuffle
    partition. They get split points from a hash sample of their own rows, also
    a few per partition; only crowded keys and split points are broadcast, and
    the split points are checkpointed, so that every use sees the same ones. A
    position is (time, tie), so even rows of one instant are cut. Every row
    stays in the result; pieces follow each other in order. Pieces that would span less
    than ``least_us`` microseconds are joined to the one before.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    limit = max_rows or max(SMALL_KEY, (total or 0) // (4 * shuffle_tasks(df)))
    if not largest or largest <= limit:
        return None

    position = F.struct(F.col(time).alias("t"), F.col(tie).alias("i"))
    crowded = counts.where(F.col("_n") > limit).withColumn(
        "_cuts", F.ceil(F.col("_n") / F.lit(limit)).cast("int"))
    rate = F.greatest(
        F.lit(1), F.floor(F.col("_n") / (F.col("_cuts") * _SAMPLES_PER_SPLIT))).cast("bigint")
    sample = (
        df.select(*keys, time, tie)
        .join(F.broadcast(crowded), keys)
        .where(F.pmod(F.xxhash64(F.col(time), F.col(tie)), rate) == 0)
        .groupBy(*keys, "_cuts")
        .agg(F.array_sort(F.collect_list(position)).alias("_seen")))
    pick = F.transform(
        F.sequence(F.lit(1), F.col("_cuts") - 1),
        lambda i: F.get("_seen", F.floor(i * F.size("_seen") / F.col("_cuts")).cast("int")))
    picked = F.array_distinct(pick)
    if least_us:
        picked = _apart(picked, F.get("_seen", F.lit(0)), least_us)
    set_checkpoint_dir(df.sparkSession)
    splits = sample.select(*keys, picked.alias("_splits")).where(F.size("_splits") > 0).checkpoint()

    # Binary search for the number of split points at or before the row.
    steps = [1 << b for b in reversed(range((-(-largest // limit)).bit_length()))]
    here = F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(
            F.coalesce(F.get("_splits", at + step - 1) <= position, F.lit(False)),
            at + step).otherwise(at))
    return (
        df.join(F.broadcast(splits), keys, "left")
        .withColumn(IS_CUT, F.col("_splits").isNotNull())
        .withColumn(PIECE, F.when(F.col("_splits").isNull(), WHOLE).otherwise(here))
        .drop("_splits"))


def _apart(splits: Column, first: Column, least_us: int) -> Column:
    """Split points that are at least so far from the one kept before, or from the first row seen."""
    kept = F.aggregate(
        splits, F.array(first),
        lambda before, split: F.when(
            F.unix_micros(split["t"]) - F.unix_micros(F.element_at(before, -1)["t"]) >= least_us,
            F.array_append(before, split)).otherwise(before))
    return F.slice(kept, 2, F.greatest(F.lit(1), F.size(splits)))


Columns = dict[str, Column]


def ordered_scan(df: DataFrame, keys: list[str], time: str, tie: str, *,
                 local: Callable[[WindowSpec], Columns],
                 summary: Columns,
                 carried: Callable[[WindowSpec], Columns],
                 newest_first: bool = False, max_rows: int | None = None) -> DataFrame:
    """Window functions along time within ``keys``, for keys of any size.

    ``local(w)`` are window columns inside a piece, ``summary`` the aggregates
    that describe a piece, ``carried(w)`` window columns over a key's piece
    summaries; these are NULL for a key that is not cut. Returns ``df`` with
    the local and carried columns; the caller combines them.
    """
    down = (lambda c: F.col(c).desc()) if newest_first else F.col
    pieces = Window.partitionBy(*keys).orderBy(down(PIECE))
    cut = cut_into_pieces(df, keys, time, tie, max_rows)
    if cut is None:
        rows = Window.partitionBy(*keys).orderBy(down(time), down(tie))
        nothing = {n: F.lit(None) for n in carried(pieces)}
        return df.select("*", *[c.alias(n) for n, c in {**local(rows), **nothing}.items()])

    piece = [*keys, PIECE]
    rows = Window.partitionBy(*piece).orderBy(down(time), down(tie))
    # A few rows per key: one for each piece of those that were cut.
    summed = (
        cut.where(IS_CUT).groupBy(*piece)
        .agg(*[c.alias(n) for n, c in summary.items()])
        .select(*piece, *[c.alias(n) for n, c in carried(pieces).items()]))
    return (
        cut.select("*", *[c.alias(n) for n, c in local(rows).items()])
        .join(summed, piece, "left").drop(PIECE, IS_CUT))


def with_previous(df: DataFrame, keys: list[str], time: str, tie: str,
                  columns: list[str], name: str = "previous", **options) -> DataFrame:
    """Add a struct of the previous row's ``columns``, NULL for a key's first row."""
    if options.get("newest_first"):
        raise ValueError("the previous row is that before in time")
    key = order_key(time, tie)
    last = F.struct(*[F.col(f"_last_{c}").alias(c) for c in columns])
    out = ordered_scan(
        df, keys, time, tie,
        local=lambda w: {"_near": F.lag(F.struct(*columns)).over(w)},
        summary={f"_last_{c}": F.max_by(c, key) for c in columns},
        carried=lambda w: {"_far": F.lag(last).over(w)}, **options)
    return out.withColumn(name, F.coalesce("_near", "_far")).drop("_near", "_far")


def with_row_number(df: DataFrame, keys: list[str], time: str, tie: str,
                    name: str = "row_number", total: str | None = None, **options) -> DataFrame:
    """Rank rows of a key along time, from 1; ``total`` also adds their number."""
    before, whole = (Window.unboundedPreceding, -1), (
        Window.unboundedPreceding, Window.unboundedFollowing)
    counted = F.count(F.lit(1))
    out = ordered_scan(
        df, keys, time, tie,
        local=lambda w: {"_near": F.row_number().over(w), **(
            {"_all_near": counted.over(w.rowsBetween(*whole))} if total else {})},
        summary={"_n": counted},
        carried=lambda w: {"_far": F.sum("_n").over(w.rowsBetween(*before)),
                           "_all": F.sum("_n").over(w.rowsBetween(*whole))}, **options)
    rank = (F.col("_near") + F.coalesce("_far", F.lit(0))).cast("bigint")
    size = {total: F.coalesce("_all", "_all_near").cast("bigint")} if total else {}
    return out.withColumns({name: rank, **size}).drop("_near", "_far", "_all", "_all_near")


def order_key(time: str, tie: str) -> Column:
    """(time, tie) as one number, for ``max_by`` and ``min_by``.

    A struct would order the same, but its buffer is not of fixed width, and
    Spark then sorts all rows before it aggregates instead of hashing them.
    """
    step = F.lit(str(1 << 65)).cast("decimal(20,0)")
    return (F.unix_micros(F.col(time)).cast("decimal(17,0)") * step
            + F.col(tie).cast("decimal(20,0)"))
