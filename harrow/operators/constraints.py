"""NOT NULL and UNIQUE as a split into accepted and rejected rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def with_reason(df: DataFrame, not_null: list[str], unique: list[str], id_col: str) -> DataFrame:
    """Add ``reason``: NULL for an accepted row, else the constraint it breaks.

    Of rows that share the unique key the one with the lowest id is accepted.
    The first id of each key is found by an aggregate that combines before the
    shuffle, and joined back on (key, id), so a key with any number of copies
    spreads over all tasks.
    """
    missing = F.coalesce(*[
        F.when(F.col(c).isNull(), F.lit(f"null {c}")) for c in dict.fromkeys(not_null + unique)],
        F.lit(None).cast("string"))
    marked = df.withColumn("reason", missing)
    if not unique:
        return marked
    first = (
        df.where(reduce(lambda a, b: a & b, [
            F.col(c).isNotNull() for c in dict.fromkeys(not_null + unique)]))
        .groupBy(*unique).agg(F.min(id_col).alias(id_col))
        .withColumn("_first", F.lit(True)))
    return (
        marked.join(first, [*unique, id_col], "left")
        .withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(
            F.col("_first").isNull(), F.lit("duplicate " + ",".join(unique))))
        .select(*df.columns, "reason"))


def constraint_split(df: DataFrame, not_null: list[str], unique: list[str],
                     id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows a table with these constraints would accept, and the others with a reason."""
    checked = with_reason(df, not_null, unique, id_col)
    return (checked.where(F.col("reason").isNull()).drop("reason"),
            checked.where(F.col("reason").isNotNull()))


def first_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first by ``order``; combines before the shuffle.

    Equal rows in that order are told apart by a hash, so a repeated task keeps
    the same one.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest)))
    return (
        df.groupBy(*keys).agg(first.alias("_row"))
        .select(*keys, "_row.*").select(*df.columns))
