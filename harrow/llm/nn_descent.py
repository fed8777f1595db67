"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from harrow.llm.common import Forest, components, groups, in_pairs, read, seated, stage
from harrow.llm.registry import query

THRESHOLD = 0.95
NEIGHBOURS = 8
TABLES = 12         # hash tables of the first graph, at least
CHANCE = 0.999      # of a pair at the threshold to meet in one of them, at any number of vectors
CHUNK = 192         # vectors of a hash bucket compared at once for it
ROUNDS = 4          # of neighbours-of-neighbours joins
SETTLED = 0.005     # share of lists' places still changing at which rounds end
BLOCK = 1024        # vectors on a side of an exact comparison
AUDIT = 400         # vectors compared with all, and as many outside of large clusters
RECALL = 0.99       # share of the vectors with links that have all of them
ATTEMPTS = 3
FLOAT_SLACK = 1e-4  # single precision chooses candidates; what is near enough is settled in double


def unit_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id, dim, unit``: vectors of length 1 as bytes of doubles; ``unit`` NULL where there is none."""
    def run(frames):
        for frame in frames:
            units, dims = [], []
            for values in frame["embedding"]:
                v = np.array([] if values is None else values, dtype=np.float64)
                length = math.sqrt(float(v @ v)) if v.ndim == 1 and len(v) and np.isfinite(v).all() else 0.0
                scaled = v
                if not math.isfinite(length) or (length == 0.0 and np.isfinite(v).all() and v.any()):
                    scaled = v / np.abs(v).max()   # too large or small to square
                    length = math.sqrt(float(scaled @ scaled))
                units.append((scaled / length).tobytes() if length > 0 else None)
                dims.append(len(v))
            yield pd.DataFrame({"vec_id": frame["vec_id"].astype("Int64"), "dim": dims, "unit": units})

    return rows.select("vec_id", "embedding").mapInPandas(run, "vec_id long, dim int, unit binary")


def _matrix(units, dtype=np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(units), dtype=np.float64).reshape(len(units), -1).astype(dtype, copy=False)


GRAPH = "v long, u long, near float, old boolean, joined boolean"


def _best(lists: DataFrame, k: int) -> DataFrame:
    """The k nearest of each list, each neighbour once, and all rows that join components."""
    once = lists.groupBy("v", "u").agg(
        F.max("near").alias("near"), F.max("old").alias("old"), F.max("joined").alias("joined"))
    place = Window.partitionBy("v").orderBy(F.desc("near"), "u")
    return once.withColumn("place", F.row_number().over(place)).where(
        ((F.col("place") <= k) & (F.col("near") > -2)) | F.col("joined"))


def _lists(graph: DataFrame, k: int) -> DataFrame:
    return graph.where((F.col("place") <= k) & (F.col("near") > -2))


def _joins(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Rows that say two vectors are in one component; they are no neighbours."""
    apart = a != b
    return pd.DataFrame({"v": a[apart], "u": b[apart], "near": np.float32(-2), "old": False, "joined": True})


def seen_links(graph: DataFrame, least: float) -> DataFrame:
    """``a, b``: all links that a round has seen, as list places and joins."""
    return graph.where(F.col("joined") | (F.col("near") >= least)).select(
        F.col("v").alias("a"), F.col("u").alias("b"))


def bits_of(n: int, chunk: int) -> int:
    """Hyperplanes of a table, so that its buckets hold about a quarter of a chunk."""
    return min(24, max(0, math.ceil(math.log2(max(1, n / (chunk / 4))))))


def tables_needed(bits: int, threshold: float, chance: float) -> int:
    """Tables after which a pair at the threshold has met in a bucket with that chance."""
    meets = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if meets >= 1 else math.ceil(math.log(1 - chance) / math.log1p(-meets))


def first_graph(vectors: DataFrame, n: int, k: int, tables: int, chunk: int, seed: int, least: float) -> DataFrame:
    """Neighbour lists from random hyperplane buckets; buckets above a chunk are dealt out by hash.

    Vectors of one ``own`` are no neighbours. All links seen in a bucket (``least`` and above) leave it, as
    a spanning forest, whether or not they find a place in a list.
    """
    bits = bits_of(n, chunk)

    def code(frames):
        planes: dict[int, np.ndarray] = {}
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, tables * bits))
                signs = (_matrix(part["unit"]) @ planes[dim] > 0).reshape(len(part), tables, bits)
                codes = signs @ (1 << np.arange(bits, dtype=np.int64))
                for t in range(tables):
                    yield pd.DataFrame({"rep": part["rep"], "t": t, "code": codes[:, t], "dim": dim})

    def compare(frames: Iterator[pd.DataFrame]):
        for group in groups(frames, "bucket"):
            if len(group) < 2:
                continue
            ids, own = group["rep"].to_numpy(np.int64), group["own"].to_numpy(np.int64)
            if (own == own[0]).all():
                continue
            x = _matrix(group["unit"], np.float32)
            forest = Forest(ids)
            for start in range(0, len(ids), 512):  # chunks vary in size
                near = x[start:start + 512] @ x.T
                near[own[start:start + 512, None] == own[None, :]] = -2
                top = min(k, len(ids) - 1)
                u = np.argpartition(-near, top - 1, axis=1)[:, :top]
                lists = pd.DataFrame({"v": np.repeat(ids[start:start + 512], top), "u": ids[u].ravel(),
                                      "near": np.take_along_axis(near, u, axis=1).ravel(), "old": False,
                                      "joined": False})
                yield lists[lists["near"] > -2]
                for i, j in zip(*np.nonzero(near >= least)):
                    if i + start < j:
                        forest.join(int(i) + start, int(j))
            yield _joins(ids, forest.roots())

    coded = stage(vectors.select("rep", "dim", "unit").mapInPandas(
        code, "rep long, t int, code long, dim int"), "codes")
    sizes = coded.groupBy("t", "dim", "code").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    part = F.pmod(F.xxhash64("rep", "t"), F.expr(f"(size + {chunk} - 1) div {chunk}"))
    dealt = coded.join(sizes, ["t", "dim", "code"]).select(
        "rep", F.xxhash64("t", "dim", "code", part).alias("bucket"))
    lists = (dealt.join(vectors.select("rep", "own", "unit"), "rep").repartition("bucket")
             .sortWithinPartitions("bucket").mapInPandas(compare, GRAPH))
    return stage(_best(lists, k), "graph")


def refined(vectors: DataFrame, graph: DataFrame, k: int, least: float) -> DataFrame:
    """One round: around each vector, its neighbours (either way) get to know each other.

    Only pairs with a link that is new since the last round are compared, and only what
    betters a list leaves the task, or joins neighbours that no known link joins.
    """
    graph = _lists(graph, k)
    worst = graph.groupBy("v").agg(F.min("near").alias("worst"), F.count(F.lit(1)).alias("held"))
    back = Window.partitionBy("u").orderBy(F.xxhash64("v"))
    reverse = graph.select("v", "u", "old", "near").withColumn("n", F.row_number().over(back)).where(
        F.col("n") <= k).select(F.col("u").alias("v"), F.col("v").alias("u"), "old", "near")
    around = graph.select("v", "u", "old", "near").union(reverse).groupBy("v", "u").agg(
        F.min("old").alias("old"), (F.max("near") >= least).alias("linked"))
    bar = F.when(F.col("held") < k, -2.0).otherwise(F.col("worst")).cast("float")
    met = (around.join(vectors.select(F.col("rep").alias("u"), "own", "unit"), "u")
           .join(worst.select(F.col("v").alias("u"), bar.alias("bar")), "u", "left"))

    def compare(frames: Iterator[pd.DataFrame]):
        for group in groups(frames, "v"):
            if len(group) < 2 or group["old"].all():
                continue
            ids, own = group["u"].to_numpy(np.int64), group["own"].to_numpy(np.int64)
            old = group["old"].to_numpy(bool)
            bars = group["bar"].fillna(-2.0).to_numpy(np.float32)
            x = _matrix(group["unit"], np.float32)
            near = x @ x.T
            apart = own[:, None] != own[None, :]
            better = (near > bars[:, None]) & ~(old[:, None] & old[None, :]) & apart
            a, b = np.nonzero(better)
            yield pd.DataFrame({"v": ids[a], "u": ids[b], "near": near[a, b], "old": False, "joined": False})
            # Neighbours linked with v are joined by v.
            linked = group["linked"].to_numpy(bool)
            a, b = np.nonzero((near >= least) & apart & ~(linked[:, None] & linked[None, :]))
            if len(a):
                forest = Forest(ids)
                for i in np.flatnonzero(linked)[1:]:
                    forest.join(int(np.flatnonzero(linked)[0]), int(i))
                before = forest.roots()
                for i, j in zip(a, b):
                    if i < j:
                        forest.join(int(i), int(j))
                yield _joins(before, forest.roots())

    found = met.repartition("v").sortWithinPartitions("v").mapInPandas(compare, GRAPH)
    known = graph.select("v", "u", "near", F.lit(True).alias("old"), F.lit(False).alias("joined"))
    return stage(_best(found.union(known), k), "graph")


def descended(vectors: DataFrame, n: int, *, neighbours: int, tables: int, chunk: int, rounds: int, least: float,
              seed: int) -> DataFrame:
    """``a, b``: links by NN-descent, until no list is full of links.

    A list full of links hides those beyond its last place. The vectors of such lists are searched again
    with lists that leave out what their links already reach, until what is left outside fits
    the lists. A link between two vectors is hidden only if both lists are full.
    """
    edges, taken = None, vectors.withColumn("own", F.col("rep"))
    for again in itertools.count():
        enough = max(tables, tables_needed(bits_of(n, chunk), least, CHANCE))
        graph = first_graph(taken, n, neighbours, enough, chunk, seed + 1000 * again, least)
        seen = seen_links(graph, least)
        edges = seen if edges is None else edges.union(seen)
        for _ in range(rounds):
            graph = refined(taken, graph, neighbours, least)
            edges = edges.union(seen_links(graph, least))
            if _lists(graph, neighbours).where("NOT old").count() <= SETTLED * n * neighbours:
                break
        full = _lists(graph, neighbours).where(F.col("near") >= least).groupBy("v").agg(
            F.count(F.lit(1)).alias("held")).where(F.col("held") == neighbours).select(F.col("v").alias("rep"))
        if full.isEmpty():
            return edges
        # Each turn joins what full lists reach, so there are fewer components in the next.
        edges = stage(edges.distinct(), "seen")
        reached = components(edges).withColumnRenamed("id", "rep").withColumnRenamed("component", "own")
        taken = stage(taken.drop("own").join(full, "rep").join(reached, "rep"), "full")
        n = taken.count()


def all_links(vectors: DataFrame, clusters: DataFrame, least: float, at_once: int) -> DataFrame:
    """``a, b``: clusters or vectors that links join, from comparing each vector with all others.

    The vectors go round in slices; each task compares its own with the slice.
    """
    spark = vectors.sparkSession
    known = stage(vectors.select("rep", "dim", "unit").join(clusters.withColumnRenamed("id", "rep"), "rep", "left").select(
        "dim", "unit", F.coalesce("component", "rep").alias("own")), "all")
    slices = -(-known.count() // at_once)
    found = None
    for k in range(slices):
        part = known.where(F.pmod(F.xxhash64("unit"), F.lit(slices)) == k).toPandas()
        sent = spark.sparkContext.broadcast({
            int(dim): (own["own"].to_numpy(np.int64), _matrix(own["unit"], np.float32))
            for dim, own in part.groupby("dim")})

        def compare(frames, sent=sent):
            for frame in frames:
                for dim, own in frame.groupby("dim"):
                    if dim not in sent.value:
                        continue
                    ids, x = sent.value[dim]
                    for start in range(0, len(own), 512):
                        mine = own["own"].to_numpy(np.int64)[start:start + 512]
                        hit = _matrix(own["unit"].iloc[start:start + 512], np.float32) @ x.T >= least
                        a, b = np.nonzero(hit & (mine[:, None] != ids[None, :]))
                        yield pd.DataFrame({"a": mine[a], "b": ids[b]}).drop_duplicates()

        links = stage(known.mapInPandas(compare, "a long, b long").distinct(), "all_links")
        sent.unpersist()
        found = links if found is None else found.union(links)
    inside = clusters.select(F.col("id").alias("a"), F.col("component").alias("b"))
    return inside if found is None else found.union(inside)


def exact_links(vectors: DataFrame, clusters: DataFrame, threshold: float, block: int) -> DataFrame:
    """``rep, links, root, many``: all pairs of each cluster compared in double precision."""
    def compare(frames: Iterator[pd.DataFrame]):
        for group in groups(frames, "pair_key"):
            ids = group["rep"].to_numpy(np.int64)
            side = group["side"].to_numpy()
            x = _matrix(group["unit"])
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if side[0] != 2:
                linked &= side[:, None] != side[None, :]
            forest = Forest(ids)
            forest.link(linked)
            yield pd.DataFrame({"rep": ids, "links": linked @ group["copies"].to_numpy(np.int64),
                                "root": forest.roots(), "many": group["many"].to_numpy()})

    members = seated(clusters.withColumnRenamed("id", "rep"), "component", "rep", block)
    dealt = in_pairs(members.join(vectors.select("rep", "unit", "copies"), "rep"), "component").select(
        "pair_key", "side", (F.col("seats") > 1).alias("many"), "rep", "copies", "unit")
    return (dealt.repartition("pair_key").sortWithinPartitions("pair_key")
            .mapInPandas(compare, "rep long, links long, root long, many boolean"))


def audit(vectors: DataFrame, links: DataFrame, threshold: float, sample: int, small: int) -> float:
    """Share of vectors with all links found, of a sample of those that have links, compared with all.

    Each vector counts once, however many links it has. A second sample is taken from those with
    at most ``small`` links found; the lesser share counts.
    """
    spark = vectors.sparkSession
    held = vectors.select("rep").join(links, "rep", "left").select("rep", F.coalesce("links", F.lit(0)).alias("links"))
    order = F.xxhash64("rep")
    picked = held.orderBy(order).limit(sample).union(
        held.where(F.col("links") <= small).orderBy(order).limit(sample)).distinct()
    probes = vectors.join(F.broadcast(picked), "rep").select("rep", "dim", "unit").toPandas()
    sent = spark.sparkContext.broadcast({
        int(dim): (part["rep"].to_numpy(np.int64), _matrix(part["unit"]))
        for dim, part in probes.groupby("dim")})

    def count(frames):
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                if dim in sent.value:
                    ids, x = sent.value[dim]
                    hit = x @ _matrix(part["unit"]).T >= threshold
                    hit &= ids[:, None] != part["rep"].to_numpy(np.int64)[None, :]
                    yield pd.DataFrame({"rep": ids, "n": hit @ part["copies"].to_numpy(np.int64)})

    there = vectors.mapInPandas(count, "rep long, n long").groupBy("rep").agg(F.sum("n").alias("n"))
    whole = F.avg((F.col("links") >= F.col("n")).cast("int"))
    shares = there.where("n > 0").join(held, "rep").agg(
        whole, F.avg(F.when(F.col("links") <= small, (F.col("links") >= F.col("n")).cast("int")))).first()
    return min((share for share in shares if share is not None), default=1.0)


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, *, neighbours: int = NEIGHBOURS,
                    tables: int = TABLES, chunk: int = CHUNK, rounds: int = ROUNDS, block: int = BLOCK,
                    sample: int = AUDIT, recall: float = RECALL, attempts: int = ATTEMPTS) -> DataFrame:
    """Vectors (``vec_id, embedding``) linked by cosine.

    Returns ``vec_id, n_links, component_id, kept``: other vectors at or above the
    threshold, the least vector reachable by links, whether the vector is that one.

    1. Equal directions become one vector with a number of copies.
    2. A first neighbour graph from hash buckets is refined: neighbours of a vector are
       compared with each other, better ones replace worse, until few places change.
    3. Where the threshold goes through a list, its links are those above. A saturated
       list (all above) is enlarged to everything its links reach, and its vector is searched again for
       neighbours outside of that. Every link seen on the way counts. Inside the clusters all pairs are
       compared in double precision, in pairs of blocks. Links are counted there.
    4. An audit compares a sample with all vectors; where a lesser share than ``recall`` of them
       has all its links the work is repeated from other hash tables, on top of the links found. If that does not help, all
       vectors are compared with all.

    Vectors that are NULL, empty, zero or hold NULL or non-finite components link with nothing, nor do
    vectors of different dimensions, nor rows without an id (kept, component NULL). Rows
    that repeat an id count once, by the least of their vectors. No rows give no rows.
    """
    units = stage(unit_vectors(rows), "units")
    if not units.where("vec_id IS NOT NULL").groupBy("vec_id").count().where("count > 1").isEmpty():
        units = stage(units.groupBy("vec_id").agg(F.min(F.struct("unit", "dim")).alias("_u")).select(
            "vec_id", "_u.dim", "_u.unit"), "units")
    valid = units.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    vectors = stage(valid.groupBy("unit", "dim").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors")
    n = vectors.count()

    least = threshold - FLOAT_SLACK
    edges = exact = links = None
    for attempt in range(attempts + 1):
        if attempt < attempts:
            near = descended(vectors, n, neighbours=neighbours, tables=tables, chunk=chunk, rounds=rounds,
                             least=least, seed=attempt + 1)
            edges = near if edges is None else edges.union(near)
        else:
            edges = all_links(vectors, clusters, least, 16 * BLOCK)
        clusters = components(edges)
        exact = stage(exact_links(vectors, clusters, threshold, block), "links")
        links = exact.groupBy("rep").agg(F.sum("links").alias("links"))
        if attempt < attempts:
            if audit(vectors, links, threshold, sample, neighbours) >= recall:
                break

    settled = exact.where("NOT many").select(F.col("rep").alias("id"), F.col("root").alias("component"))
    across = exact.where("many")
    if not across.isEmpty():
        settled = settled.union(components(across, "rep", "root"))
    classes = (vectors.join(links, "rep", "left")
               .join(settled.withColumnRenamed("id", "rep"), "rep", "left")
               .select("unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    named = units.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("unit")).alias("unit"))
    own = F.coalesce("component_id", "vec_id")
    return named.join(classes, "unit", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"),
        own.eqNullSafe(F.col("vec_id")).alias("kept"))


@query("op1_embedding_neardup")
def op1_embedding_neardup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(read(spark, sf, "embeddings"))
