"""Benchmark decontamination by a prefix-filtered containment join."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from harrow.llm.common import dealt_out, read, stage, words_of
from harrow.llm.registry import query

WINDOW = 10
BLOCK_WINDOWS = 200_000  # item windows that one broadcast index may hold
BLOCK_BYTES = 16 << 20   # and bytes of their words
COUNTED_WORDS = 300_000  # words that are counted in one pass over the documents; beyond, those of each block

Window = tuple[bytes, ...]


def item_windows(text: str | None, width: int = WINDOW) -> set[Window]:
    """Windows of an item: runs of ``width`` words, or the whole of a shorter item."""
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1))}


def staged_windows(items: DataFrame, width: int) -> DataFrame:
    """``item_id, words`` of each window of each item, its words joined by blanks."""
    def cut(frames):
        for frame in frames:
            yield pd.DataFrame(
                [(int(i), b" ".join(w)) for i, t in zip(frame["item_id"], frame["text"])
                 for w in item_windows(t, width)], columns=["item_id", "words"])

    clean = items.where("item_id IS NOT NULL").select("item_id", "text")
    return stage(clean.mapInPandas(cut, "item_id long, words binary").distinct(), "windows")


def blocks_needed(windows: DataFrame, block_windows: int, block_bytes: int) -> int:
    """Blocks by number and bytes of the windows, known before any is fetched."""
    count, size = windows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    return max(-(-count // block_windows), -(-size // block_bytes))


def item_blocks(windows: DataFrame, blocks: int) -> Iterator[dict[Window, list[int]]]:
    """Windows with the items they occur in, dealt to blocks by hash; each block is fetched alone."""
    for k in range(blocks):
        part = windows.where(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k)
        index: dict[Window, list[int]] = defaultdict(list)
        for item, words in part.toLocalIterator():
            index[tuple(bytes(words).split(b" "))].append(item)
        yield dict(index)


def rarity(docs: DataFrame, words: set[bytes]) -> Counter:
    """Number of documents that hold each of the given words, over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(words))

    def count(frames):
        found: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                found.update(sent.value.intersection(words_of(text)))
        if found:   # a frame without rows has no strings to tell its type by
            yield pd.DataFrame({"word": list(found.keys()), "n": list(found.values())})

    rows = (docs.select("text").mapInPandas(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))
    return Counter({bytes(w): n for w, n in rows.toLocalIterator()})


def _joined(index: dict[Window, list[int]], frequency: Counter):
    """The prefix index: rarest word -> its offset and the window's length -> windows.

    All words of a window must occur, so one prefix word is enough. There are as many offsets and
    lengths under a word as a window has words, and their lengths, however many windows there are.
    """
    prefix: dict[bytes, dict[tuple[int, int], set[Window]]] = defaultdict(lambda: defaultdict(set))
    for window in index:
        offset = min(range(len(window)), key=lambda k: (frequency[window[k]], window[k], k))
        prefix[window[offset]][offset, len(window)].add(window)
    return {word: dict(places) for word, places in prefix.items()}


def few_words(windows: DataFrame, most: int) -> set[bytes] | None:
    """The words of all windows, or None if there are more than ``most``."""
    def split(frames):
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"word": list({w for x in frame["words"] for w in bytes(x).split(b" ")})})

    found = windows.mapInPandas(split, "word binary").distinct().limit(most + 1)
    words = {bytes(r[0]) for r in found.toLocalIterator()}
    return None if len(words) > most else words


def occurrences(words: list[bytes], prefix: dict, keys: frozenset) -> tuple[set[Window], list[tuple[int, int]]]:
    """Windows that occur in a document and the stretches of words they cover."""
    present = keys.intersection(words)
    if not present:
        return set(), []
    found, stretches, n = set(), [], len(words)
    for at, word in enumerate(words):
        if word in present:
            for (offset, length), windows in prefix[word].items():
                start, end = at - offset, at - offset + length
                # Length and position first, then the words themselves.
                if start >= 0 and end <= n and (window := tuple(words[start:end])) in windows:
                    found.add(window)
                    stretches.append((start, end))
    return found, merged(stretches)


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(stretches):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def benchmark_hits(docs: DataFrame, items: DataFrame, width: int = WINDOW, *, doc_id: str = "doc_id",
                   block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_words, item_ids, stretches`` per document: which benchmark items occur where.

    Words are ASCII letters (lower-cased) and digits and all past ASCII. An item's windows
    are its runs of ``width`` words; a shorter item is one window. Document frequencies of the
    items' words are counted over all documents; each window is looked up by its rarest
    word, then checked for length, position and all its words. ``stretches`` are the
    covered runs of words (start, end), merged; ``item_ids`` is sorted.

    The windows are broadcast in blocks of a bounded size; documents are never gathered,
    and a passage that many documents share is found in each by itself. NULL texts
    have no words; items without words or id never occur; NULL ids and repeated rows are rows
    like others. An empty table gives an empty result, an empty benchmark no hits.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col("text").alias("text"))
    indexes = _indexes(narrow, items, width, block_windows, block_bytes)
    # Rows that share an id but not a text are kept apart by a key of the text.
    keyed = narrow.withColumn("row_key", F.xxhash64("text"))
    if len(indexes) <= 1:
        return keyed.mapInPandas(_search(indexes[0] if indexes else None), HITS).drop("row_key")
    parts = [keyed.mapInPandas(_search(sent), HITS) for sent in indexes]
    return _together(reduce(DataFrame.union, parts), len(indexes))


def _indexes(docs: DataFrame, items: DataFrame, width: int, block_windows: int, block_bytes: int = BLOCK_BYTES,
             counted_words: int = COUNTED_WORDS) -> list:
    """One broadcast index per block of item windows.

    Where the items have few different words, one pass over the documents counts them for all blocks.
    """
    windows = staged_windows(items, width)
    blocks = blocks_needed(windows, block_windows, block_bytes)
    words = few_words(windows, counted_words) if blocks > 1 else None
    of_all = None if words is None else rarity(docs, words)
    indexes = []
    for index in item_blocks(windows, blocks):
        frequency = rarity(docs, {w for window in index for w in window}) if of_all is None else of_all
        indexes.append(docs.sparkSession.sparkContext.broadcast((_joined(index, frequency), index)))
    return indexes


HITS = "doc_id long, row_key long, n_words long, item_ids array<long>, stretches array<array<int>>"


def _search(sent):
    def run(frames):
        prefix, owners = sent.value if sent is not None else ({}, {})
        keys = frozenset(prefix)
        for frame in frames:
            counts, ids, stretches = [], [], []
            for text in frame["text"]:
                words = words_of(text)
                found, covered = occurrences(words, prefix, keys)
                counts.append(len(words))
                ids.append(sorted({i for w in found for i in owners[w]}))
                stretches.append([list(s) for s in covered])
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "row_key": frame["row_key"],
                                "n_words": counts, "item_ids": ids, "stretches": stretches})
    return run


def _together(parts: DataFrame, blocks: int) -> DataFrame:
    """What several blocks found in a document; equal rows are counted and dealt out again."""
    def merge(frames):
        for frame in frames:
            frame["item_ids"] = [sorted({int(i) for p in x for i in p}) for x in frame["item_ids"]]
            frame["stretches"] = [[list(s) for s in merged([tuple(s) for p in x for s in p])]
                                  for x in frame["stretches"]]
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    grouped = parts.groupBy("doc_id", "row_key", "n_words").agg(
        F.collect_set("item_ids").alias("item_ids"), F.collect_set("stretches").alias("stretches"),
        (F.count(F.lit(1)) / blocks).cast("long").alias("copies"))
    return dealt_out(grouped.mapInPandas(merge, HITS + ", copies long"), "copies", "copy").select(
        "doc_id", "n_words", "item_ids", "stretches")


def contamination(docs: DataFrame, items: DataFrame, width: int = WINDOW, **settings) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` per document."""
    hits = benchmark_hits(docs, items, width, **settings)
    n_hit = F.aggregate("stretches", F.lit(0).cast("long"), lambda s, x: s + (x[1] - x[0]))
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_benchmark(docs: DataFrame, items: DataFrame, width: int = WINDOW,
                      block_windows: int = BLOCK_WINDOWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents in which no window of an item occurs, all columns as they were."""
    def keep(sent):
        def run(batches):
            prefix = sent.value[0]
            keys = frozenset(prefix)
            for batch in batches:
                clean = [not occurrences(words_of(t), prefix, keys)[0]
                         for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))
        return run

    for sent in _indexes(docs, items, width, block_windows, block_bytes):
        docs = docs.mapInArrow(keep(sent), docs.schema)
    return docs


DECONTAMINATION_SQL = r"""items AS (SELECT item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(words)) AS width, array_to_string(
    words[i:i + least(10, len(words)) - 1], ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(2, len(words) - 8))) AS i FROM items WHERE len(words) > 0)),
texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM docs),
runs AS (SELECT r, i, width, array_to_string(words[i:i + width - 1], ' ') AS w FROM (
    SELECT r, words, width, unnest(range(1, len(words) - width + 2)) AS i
    FROM texts, (SELECT DISTINCT width FROM windows))),
found AS (SELECT r, i, width, item_id FROM runs JOIN windows USING (width, w)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest(range(i, i + width)) AS p FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids FROM (
    SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM found) GROUP BY r),
checked AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AS contaminated
  FROM texts LEFT JOIN hit USING (r) LEFT JOIN named USING (r))"""


@query("op7_decontamination",
       f"WITH docs AS (SELECT * FROM documents), {DECONTAMINATION_SQL} SELECT * FROM checked")
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contamination(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
