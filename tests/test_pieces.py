"""Ordered scans agree with plain windows however the keys are cut."""

import random

import pytest
from pyspark.sql import Window, functions as F

from harrow.operators.pieces import (
    PIECE, WHOLE, cut_into_pieces, with_previous, with_row_number)


@pytest.fixture(scope="module")
def skewed(spark):
    """One device has most rows, many of them at one instant; some days are empty."""
    rng = random.Random(3)
    data = []
    for i in range(6000):
        hot = i % 3 != 0
        device = 1 if hot else rng.randrange(2, 40)
        if hot and i % 2 == 0:
            us = 5_000_000
        else:
            us = rng.randrange(0, 6 * 86400) * 1_000_000 if rng.random() < 0.8 else 40 * 86400 * 1_000_000
        data.append((i, device, us, rng.randrange(5)))
    return spark.createDataFrame(data, "id bigint, device int, us bigint, v int").select(
        "id", "device", F.timestamp_micros("us").alias("time"), "v").cache()


@pytest.mark.parametrize("limit", [None, 40, 500])
def test_row_number_and_previous(skewed, limit):
    w = Window.partitionBy("device").orderBy("time", "id")
    got = with_previous(
        with_row_number(skewed, ["device"], "time", "id", "rn", total="n", max_rows=limit),
        ["device"], "time", "id", ["v", "id"], "before", max_rows=limit)
    want = skewed.select(
        "*", F.row_number().over(w).cast("bigint").alias("rn"),
        F.count(F.lit(1)).over(Window.partitionBy("device")).alias("n"),
        F.lag(F.struct("v", "id")).over(w).alias("before"))
    assert got.count() == 6000
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_previous_means_before_in_time(skewed):
    with pytest.raises(ValueError):
        with_previous(skewed, ["device"], "time", "id", ["v"], newest_first=True)


def test_newest_first(skewed):
    w = Window.partitionBy("device").orderBy(F.desc("time"), F.desc("id"))
    got = with_row_number(
        skewed, ["device"], "time", "id", "rn", newest_first=True, max_rows=100)
    want = skewed.withColumn("rn", F.row_number().over(w).cast("bigint"))
    assert got.select(want.columns).exceptAll(want).count() == 0


def test_nothing_is_cut_needlessly(skewed):
    assert cut_into_pieces(skewed, ["device"], "time", "id") is None


def test_pieces_are_bounded_even_at_one_instant(skewed):
    sizes = (cut_into_pieces(skewed, ["device"], "time", "id", max_rows=100)
             .groupBy("device", PIECE).count())
    assert sizes.agg(F.sum("count")).first()[0] == 6000
    largest = sizes.where(F.col(PIECE) != WHOLE).agg(F.max("count")).first()[0]
    # 2000 rows of one device share one microsecond; sampling keeps a piece
    # within a small factor of the limit.
    assert largest <= 300
