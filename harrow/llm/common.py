"""Shared helpers of the corpus operators: words, staging, grouped streams, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harrow.session import shared_folder

# A word is a run of ASCII letters and digits and of anything past ASCII.
# Over UTF-8 bytes that is one table: capitals become small, the rest of ASCII a blank.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256))


HASH_BITS = 60


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of a whole text, as UTF-8; none for a null."""
    if text is None:
        return []
    return text.encode("utf-8", "surrogatepass").translate(WORD_TABLE).split()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS_OF_A_TASK = 20_000


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """As many tasks as that many narrow rows call for, where the shuffle made more of them."""
    return df.coalesce(rows // ROWS_OF_A_TASK + 1)


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hash60(*parts: Column) -> Column:
    """First 60 bits of an MD5, as a number that other engines can compute too."""
    joined = parts[0] if len(parts) == 1 else F.concat_ws("/", *parts)
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def dealt_out(counted: DataFrame, count: str, copy: str, step: int = 1024) -> DataFrame:
    """Each row as often as its count says, numbered from 0; no list is longer than a step."""
    steps = counted.withColumn(
        "_step", F.explode(F.sequence(F.lit(0), F.expr(f"({count} - 1) div {step}"))))
    return steps.withColumn(copy, F.explode(F.sequence(
        F.col("_step") * step, F.least(F.col(count), (F.col("_step") + 1) * step) - 1))
    ).drop(count, "_step")


def numbered_copies(df: DataFrame, copy: str = "_copy") -> DataFrame:
    """Rows with a number that tells equal rows apart.

    Equal rows are counted (combined before the shuffle) and dealt out again, so
    the number depends on the data alone and no list grows with a group.
    """
    columns = [F.col(c) for c in df.columns]
    return dealt_out(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")), "_n", copy)


def groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by an integer key, one at a time.

    Holds one batch and one group; groups may run across batches.
    """
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        keys = frame[key].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(frame)]
        for start, end in zip(bounds, bounds[1:]):
            part = frame.iloc[start:end]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def summed(rows: DataFrame, partial: Callable[[pa.RecordBatch], np.ndarray], shape: tuple[int, ...],
           tasks: int, direct: int = 64) -> np.ndarray:
    """Sum of ``partial(batch)``, an array of a fixed shape, over all rows.

    Each task adds up its own and sends one array if it had rows. Where there are more than ``direct``
    tasks, as many as their square root add those up first, so few arrays reach the driver, one by one.
    """
    def part(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                own = partial(batch)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [np.ascontiguousarray(total).tobytes()]})

    def add(batches):
        total = np.zeros(shape)
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total += np.frombuffer(v).reshape(shape)
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    sums = rows.mapInArrow(part, "v binary")
    if tasks > direct:
        sums = sums.repartition(math.isqrt(tasks)).mapInArrow(add, "v binary")
    return sum((np.frombuffer(row[0]).reshape(shape) for row in sums.toLocalIterator()), np.zeros(shape))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``id, component`` of each vertex of an edge table: the smallest id it reaches.

    Smallest labels spread along edges and then jump to the label of their label,
    so chains halve in each round. Rounds are staged in the shared folder.
    """
    pairs = edges.select(F.col(a).alias("id"), F.col(b).alias("other")).where("id <> other")
    pairs = stage(pairs.union(pairs.select("other", "id")).distinct(), "edges")
    n = pairs.count()
    first = pairs.groupBy("id").agg(F.min("other").alias("near"))
    labels = stage(in_tasks(first.select("id", F.least("id", "near").alias("component")), n), "labels")
    for _ in range(max_rounds):
        near = (pairs.join(labels.withColumnRenamed("id", "other"), "other")
                .groupBy("id").agg(F.min("component").alias("near")))
        spread = labels.join(near, "id").select(
            "id", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        roots = spread.select(F.col("id").alias("label"), F.col("label").alias("component"))
        after = stage(in_tasks(spread.join(roots, "label").select("id", "was", "component"), n), "labels")
        labels = after.select("id", "component")
        if after.where("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


class Forest:
    """Union-find over the positions of one block; roots are the smallest ids."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.up = ids, list(range(len(ids)))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            if self.ids[i] < self.ids[j]:
                self.up[j] = i
            else:
                self.up[i] = j

    def link(self, linked: np.ndarray) -> None:
        """Joins all positions that a symmetric matrix of booleans links."""
        for i in range(len(linked)):
            for j in np.flatnonzero(linked[i, i + 1:]) + i + 1:
                if self.up[j] != self.up[i] or self.up[i] != self.root(i):
                    self.join(i, int(j))

    def roots(self) -> np.ndarray:
        return np.array([self.ids[self.root(i)] for i in range(len(self.up))], dtype=np.int64)


def seated(members: DataFrame, cluster: str, member: str, block: int) -> DataFrame:
    """Members of clusters with ``seat`` of ``seats``: the blocks their cluster is cut into."""
    sizes = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("_g"))
    return (members.join(sizes, cluster)
            .withColumn("seats", F.expr(f"(_g + {block} - 1) div {block}"))
            .withColumn("seat", F.pmod(F.xxhash64(member), F.col("seats"))).drop("_g"))


def in_pairs(members: DataFrame, cluster: str) -> DataFrame:
    """Seated members, dealt to pairs of blocks so that every two of a cluster meet once.

    Adds ``pair_key`` (rows with one value meet in one task) and ``side`` (0 rows, 1
    columns, 2 both). A cluster of g members makes g * g / block rows, one of a single
    block just g.
    """
    dealt = members.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("seats") - 1)))
    low, high = F.least("seat", "_other"), F.greatest("seat", "_other")
    return (dealt.withColumn("pair_key", F.xxhash64(F.col(cluster), low, high))
            .withColumn("side", F.when(F.col("seat") == F.col("_other"), 2)
                        .when(F.col("seat") < F.col("_other"), 0).otherwise(1))
            .drop("_other", "seat"))
