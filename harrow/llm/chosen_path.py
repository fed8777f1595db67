"""N-gram Jaccard join by chosen paths."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from harrow.llm.common import Forest, components, groups, in_pairs, in_tasks, read, seated, stage, words_of
from harrow.llm.registry import query

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.995
COORDINATES = 48     # sampled tokens of a set, at least; else those of the runs needed
LEVELS = 4           # tokens on the longest path
SMALL = 64           # sets that are compared without another split
BLOCK = 128          # sets on a side of an exact comparison
SLACK = 0.22         # below the threshold at which an estimate still makes a candidate
COLUMNS_AT_ONCE = 8192

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _WordHashes(dict):
    """64-bit hashes of words; forgets when it grows past a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(words: list[bytes], width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit shingles; the whole text is one if it is shorter."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    n = max(1, len(h) - width + 1)
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        mixed = (mixed ^ h[k:k + n]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * _MIX[1]
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


def _sampling(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240)
    factors = draw.integers(0, 2 ** 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 2 ** 63, coordinates, dtype=np.uint64)


def sampled_tokens(tokens: np.ndarray, factors: np.ndarray, shifts: np.ndarray, whole: bool = False) -> np.ndarray:
    """One token of the set per coordinate: the least under the coordinate's own order; half of its bits, or all.

    Two sets sample the same token at a coordinate with probability equal to their
    Jaccard similarity.
    """
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(tokens), 1024):
        part = tokens[start:start + 1024, None] * factors
        part += shifts
        np.minimum(least, part.min(axis=0), out=least)
    return least if whole else (least >> np.uint64(32)).astype(np.uint32)


def token_samples(docs: DataFrame, width: int, coordinates: int, whole: bool = False) -> DataFrame:
    """``doc_id, set_key, tokens, sample``: size, identity and sampled tokens of each set."""
    factors, shifts = _sampling(coordinates)

    def run(frames):
        hashes = _WordHashes()
        for frame in frames:
            keys, counts, samples = [], [], []
            for text in frame["text"]:
                tokens = shingles(words_of(text), width, hashes)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                counts.append(len(tokens))
                samples.append(sampled_tokens(tokens, factors, shifts, whole).tobytes() if len(tokens) else None)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "set_key": keys, "tokens": counts,
                                "sample": samples})

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, set_key binary, tokens long, sample binary")


def leaves(sets: DataFrame, runs: list[int], levels: int, small: int) -> DataFrame:
    """``leaf, depth, rep`` of the small buckets, and of those still large at the last level.

    Every set walks down all runs at once. A bucket with more than ``small`` sets is
    split by the next sampled token of its run; one that is small is a leaf. Counts are
    combined before the shuffle; nothing is gathered.
    """
    found, n = None, sets.count() * len(runs)
    nodes = sets.select("rep", F.explode(F.array(*[F.lit(r) for r in runs])).alias("run"), "sample")
    for level in range(levels):
        token = F.expr(f"substring(sample, 4 * (run * {levels} + {level}) + 1, 4)")
        path = [F.col("path")] if level else [F.col("run")]
        nodes = nodes.select("rep", "run", F.xxhash64(*path, token).alias("path"))
        sizes = nodes.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        nodes = stage(in_tasks(nodes.join(sizes, "path"), n), "paths")
        last = level == levels - 1
        leaf = (nodes if last else nodes.where(F.col("size") <= small)).select(
            F.col("path").alias("leaf"), F.lit(level + 1).alias("depth"), "rep")
        found = leaf if found is None else found.union(leaf)
        nodes = nodes.where(F.col("size") > small).drop("size")
        if last or nodes.isEmpty():
            return found
        nodes = nodes.join(sets.select("rep", "sample"), "rep")
    return found


def candidates(buckets: DataFrame, sets: DataFrame, threshold: float, coordinates: int,
               block: int) -> DataFrame:
    """Pairs of sets (a spanning forest per bucket) whose samples agree well enough."""
    # The estimate errs by sqrt(p(1-p)/k); exact comparison follows.
    least = max(0.0, threshold - SLACK)

    def compare(frames: Iterator[pd.DataFrame]):
        for group in groups(frames, "pair_key"):
            if len(group) < 2:
                continue
            ids = group["rep"].to_numpy(np.int64)
            side = group["side"].to_numpy()
            counts = group["tokens"].to_numpy(np.float64)
            marks = np.frombuffer(b"".join(group["sample"]), dtype=np.uint32).reshape(len(ids), -1)
            near = np.zeros((len(ids), len(ids)), dtype=bool)
            for i in range(len(ids)):
                same = (marks[i + 1:] == marks[i]).sum(axis=1) >= least * coordinates
                low = np.minimum(counts[i], counts[i + 1:]) >= threshold * np.maximum(
                    counts[i], counts[i + 1:])
                near[i, i + 1:] = same & low
            if side[0] != 2:
                near &= side[:, None] != side[None, :]
            if not near.any():
                continue
            forest = Forest(ids)
            forest.link(near | near.T)
            roots = forest.roots()
            linked = roots != ids
            yield pd.DataFrame({"a": ids[linked], "b": roots[linked]})

    members = seated(buckets, "leaf", "rep", block).join(sets.select("rep", "tokens", "sample"), "rep")
    dealt = in_pairs(members, "leaf").select("pair_key", "side", "rep", "tokens", "sample")
    return (dealt.repartition("pair_key").sortWithinPartitions("pair_key")
            .mapInPandas(compare, "a long, b long").distinct())


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections; only tokens that two sets share are looked at, in slices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = np.concatenate(([True], tokens[1:] != tokens[:-1]))
    column = np.cumsum(first) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    out = np.zeros((n, n), dtype=np.float32)
    width = int(column.max()) + 1 if len(column) else 0
    for start in range(0, width, COLUMNS_AT_ONCE):
        stop = min(width, start + COLUMNS_AT_ONCE)
        lo, hi = np.searchsorted(column, [start, stop])
        part = np.zeros((n, stop - start), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        out += part @ part.T
    return out


def exact_links(docs: DataFrame, sets: DataFrame, clusters: DataFrame, width: int, threshold: float,
                block: int, repeated: bool) -> DataFrame:
    """``rep, links, root, many`` from exact comparison of all pairs inside clusters.

    Every pair of a cluster meets in one task. ``links`` weighs a linked set by the
    documents that hold it; ``root`` is the least set it is joined to there.
    """
    def cut(frames):
        hashes = _WordHashes()
        for frame in frames:
            tokens = [shingles(words_of(t), width, hashes).tobytes() for t in frame.pop("text")]
            own = [xxhash.xxh3_128_digest(t) == k for t, k in zip(tokens, frame.pop("set_key"))]
            frame["tokens"] = tokens
            yield frame[own]

    def compare(frames: Iterator[pd.DataFrame]):
        for group in groups(frames, "pair_key"):
            ids = group["rep"].to_numpy(np.int64)
            side = group["side"].to_numpy()
            copies = group["copies"].to_numpy(np.int64)
            sets_ = [np.frombuffer(t, dtype=np.uint64) for t in group["tokens"]]
            shared = overlaps(sets_)
            counts = np.array([len(s) for s in sets_], dtype=np.float64)
            union = counts[:, None] + counts[None, :] - shared
            linked = shared >= threshold * union - 1e-9
            np.fill_diagonal(linked, False)
            if side[0] != 2:
                linked &= side[:, None] != side[None, :]
            forest = Forest(ids)
            forest.link(linked)
            yield pd.DataFrame({"rep": ids, "links": linked @ copies, "root": forest.roots(),
                                "many": group["many"].to_numpy()})

    members = seated(clusters.withColumnRenamed("id", "rep"), "component", "rep", block)
    seats = members.join(sets.select("rep", "copies", "set_key"), "rep").withColumnRenamed("rep", "doc_id")
    texts = docs.select("doc_id", "text").join(seats, "doc_id").select(
        F.col("doc_id").alias("rep"), "component", "seat", "seats", "copies", "set_key", "text")
    tokens = texts.mapInPandas(cut, "rep long, component long, seat long, seats long, copies long, "
                                    "tokens binary")
    if repeated:
        tokens = tokens.dropDuplicates(["rep"])
    dealt = in_pairs(tokens, "component").select(
        "pair_key", "side", (F.col("seats") > 1).alias("many"), "rep", "copies", "tokens")
    return (dealt.repartition("pair_key").sortWithinPartitions("pair_key")
            .mapInPandas(compare, "rep long, links long, root long, many boolean"))


def runs_needed(threshold: float, depth: int, recall: float) -> int:
    """Runs after which a pair at the threshold has met in a leaf of that depth."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** depth))


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE,
                 recall: float = RECALL, *, small: int = SMALL, levels: int = LEVELS,
                 coordinates: int = COORDINATES, block: int = BLOCK) -> DataFrame:
    """Documents (``doc_id, text``) linked by Jaccard similarity of their word shingles.

    Returns ``doc_id, class_id, n_links, component_id, kept``: the least document with
    the same shingles, the number of other documents at or above the threshold, the least
    document reachable by links, and whether the document is that one.

    1. Documents with equal shingle sets become one class; only one set of each goes on.
    2. Chosen paths: each run puts sets into buckets by a sampled token they share and
       splits large buckets by further tokens. There are as many runs as a pair at the threshold
       needs to meet with probability ``recall`` in buckets split to the last level; a lower threshold
       takes more runs, and more sampled tokens for them.
    3. Buckets are compared by their samples, in blocks; what comes near the threshold
       makes clusters.
    4. Inside a cluster all pairs are compared exactly, in pairs of blocks; links are
       counted there and only a spanning forest leaves the task.

    A text shorter than a shingle is one shingle. Texts that are NULL or without words, and rows with
    a NULL id, link with nothing (``class_id`` and ``component_id`` are their own id, kept). Rows that
    repeat an id count once, by the least of their sets. No rows give no rows.
    """
    # As many samples as the deepest paths may call for.
    coordinates = max(coordinates, levels * runs_needed(threshold, levels, recall))
    samples = stage(token_samples(docs, width, coordinates), "samples")
    repeated = not samples.where("doc_id IS NOT NULL").groupBy("doc_id").count().where(
        "count > 1").isEmpty()
    if repeated:
        least = F.min(F.struct("set_key", "tokens", "sample")).alias("_set")
        samples = stage(samples.groupBy("doc_id").agg(least).select("doc_id", "_set.*"), "samples")
    named = samples.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = named.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets = stage(classes.join(named.select(F.col("doc_id").alias("rep"), "tokens", "sample"), "rep"), "sets")

    # All runs walk down together, as many as the deepest paths call for.
    buckets = leaves(sets, list(range(runs_needed(threshold, levels, recall))), levels, small)
    near = candidates(buckets.select("leaf", "rep"), sets, threshold, coordinates, 4 * block)
    clusters = components(near)
    exact = stage(exact_links(docs, sets, clusters, width, threshold, block, repeated), "links")
    settled = exact.where("NOT many").select(F.col("rep").alias("id"), F.col("root").alias("component"))
    across = exact.where("many")
    if not across.isEmpty():
        settled = settled.union(components(across, "rep", "root"))
    counts = exact.groupBy("rep").agg(F.sum("links").alias("_links"))
    found = (sets.select("rep", "copies", "set_key")
             .join(counts, "rep", "left").join(settled.withColumnRenamed("id", "rep"), "rep", "left")
             .select("set_key", "rep", (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    joined = samples.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")) \
        .join(found, "set_key", "left")
    own = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def one_of_each_group(docs: DataFrame, **settings) -> DataFrame:
    """Documents with one left of each group of near duplicates.

    The least id stays. Of rows that repeat an id the one with the least text stays;
    rows without an id stay as they are.
    """
    result = jaccard_join(docs, **settings)
    left = docs.join(result.where("NOT kept").select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    named = docs.where("doc_id IS NOT NULL")
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    place = Window.partitionBy("doc_id").orderBy(F.col("_doc.text").asc_nulls_last())
    packed = left.select("doc_id", F.struct(*left.columns).alias("_doc"))
    firsts = packed.where("doc_id IS NOT NULL").withColumn("_n", F.row_number().over(place)).where("_n = 1")
    return firsts.select("_doc.*").union(left.where("doc_id IS NULL"))


@query("op2_jaccard")
def op2_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join(read(spark, sf, "documents"))
