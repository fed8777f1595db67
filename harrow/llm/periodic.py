"""Runs of repeated words: Lyndon arrays from Baier's grouping, roots extended into runs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from harrow.llm.common import read
from harrow.llm.registry import query

LEAST_LENGTH = 6     # words of a run, at least
LEAST_PERIODS = 4    # and periods
NARROWINGS = 8       # rounds of leaving out places without a repetition near enough

Run = tuple[int, int, int]   # start, length, period


def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that starts at each place.

    Phase one of Baier's suffix sorter. Suffixes are grouped by a known prefix, their context, at
    first one symbol. The highest group goes first and is final: its context is the longest
    Lyndon word there. Each of its suffixes has as predecessor the nearest one before it in a lower
    group; a predecessor of l of them gets its context prolonged by l times the final one and
    moves to a group just above its own. Final suffixes leave a linked list of places, so
    the predecessor is the left neighbour that is still in it. Linear in time and memory.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int64)
    _, first = np.unique(symbols, return_inverse=True)
    order = np.argsort(first, kind="stable")
    members = [m.tolist() for m in np.split(order + 1, np.flatnonzero(np.diff(first[order])) + 1)]
    group = [-1, *first.tolist()]              # of places 1..n; 0 and n + 1 stand before and behind
    context = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))
    lengths = [0] * (n + 1)

    g = len(members) - 1
    while g >= 0:
        size, met = context[g], []
        for place in members[g]:               # ascending, so predecessors ascend as well
            if group[place] != g:
                continue                       # has moved up since
            lengths[place] = size
            before, behind = left[place], right[place]
            right[before], left[behind] = behind, before
            if met and met[-1][1] == before:
                met[-1][0] += 1
            elif before:
                met.append([1, before])
        members[g] = None
        met.sort(key=lambda m: -m[0])          # stable: places stay ascending
        made: dict[tuple[int, int], int] = {}
        for times, before in met:
            home = group[before]
            new = made.get((times, home))
            if new is None:
                new = made[times, home] = len(members)
                members.append([])
                context.append(context[home] + times * size)
                over = above[home]
                below.append(home)
                above.append(over)
                above[home] = new
                if over < len(below):
                    below[over] = new
            members[new].append(before)
            group[before] = new
        g = below[g]
    return np.array(lengths[1:], dtype=np.int64)


def _agree(symbols: np.ndarray, i: int, j: int, step: int) -> int:
    """How many symbols from places i and j on (back, for step -1) are the same; i < j.

    Compared in slices that double, so a pair that differs soon costs little.
    """
    most = len(symbols) - j if step > 0 else i + 1
    same, width = 0, 16
    while same < most:
        width = min(width, most - same)
        if step > 0:
            differ = symbols[i + same:i + same + width] != symbols[j + same:j + same + width]
        else:
            a, b = i - same + 1, j - same + 1
            differ = (symbols[a - width:a] != symbols[b - width:b])[::-1]
        at = int(differ.argmax())
        if differ[at]:
            return same + at
        same, width = same + width, width * 2
    return most


def _repeating(symbols: np.ndarray, length: int, periods: int) -> list[tuple[int, int]]:
    """Stretches outside of which no run lies; runs lie whole in one of them.

    A run of period q has at least 2 * q places at which a whole window of ``width`` symbols starts
    inside it, so each such window stands again q places before or behind. Places whose window has no
    equal one within a ``periods``-th of their stretch are left out, again in what remains; any
    number of such rounds is right.
    """
    width = max(1, min(max(length, periods * q) - 2 * q + 1 for q in range(1, length + 1)))
    n = len(symbols) - width + 1
    if n <= 0:
        return []
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(width):                    # equal windows have equal values; others may by chance
        mixed = (mixed ^ symbols[k:k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    gap = np.where(mixed[order[1:]] == mixed[order[:-1]], np.diff(order), n)
    distance = np.full(n, n)
    distance[order[1:]] = gap
    distance[order[:-1]] = np.minimum(distance[order[:-1]], gap)
    places = np.flatnonzero(distance < n)
    stretches: list[tuple[int, int]] = []
    for _ in range(NARROWINGS):
        if not len(places):
            return []
        cut = np.flatnonzero(np.diff(places) > 1) + 1
        starts, ends = places[np.r_[0, cut]], places[np.r_[cut - 1, len(places) - 1]] + width
        sizes = np.where(ends - starts >= length, ends - starts, 0)
        kept = distance[places] * periods <= np.repeat(sizes, np.diff(np.r_[0, cut, len(places)]))
        stretches = list(zip(starts.tolist(), ends.tolist()))
        if kept.all():
            break
        places = places[kept]
    return stretches


def runs_of(symbols: np.ndarray, length: int = LEAST_LENGTH, periods: int = LEAST_PERIODS) -> list[Run]:
    """All runs ``start, length, period`` of at least so many symbols and periods, by start, then period.

    A run is a stretch of smallest period q that neither neighbour prolongs. Under one of the two
    orders of symbols every root of it is the longest Lyndon word where it starts. So
    roots are read from both Lyndon arrays, where they stand ``periods`` - 1 times in a row, and
    extended as far as the period goes, either way.
    """
    if length < 1 or periods < 2:
        raise ValueError("a run has two periods at least")
    found: set[Run] = set()
    for begin, end in _repeating(symbols, length, periods):
        part = symbols[begin:end]
        for ordered in (part, part.max() - part):
            roots = lyndon_array(ordered)
            places = np.arange(len(part))
            fits = places + roots * (periods - 1) <= len(part)
            for k in range(1, periods - 1):
                fits[fits] = roots[places[fits] + k * roots[fits]] == roots[fits]
            last: dict[int, int] = {}         # end of the last run of each period
            for place in places[fits].tolist():
                q = int(roots[place])
                i = begin + place
                if i + q <= last.get(q, 0):
                    continue                  # a later root of the same run
                ahead = _agree(symbols, i, i + q, 1)
                if ahead < q * (periods - 2):
                    continue
                back = _agree(symbols, i - 1, i + q - 1, -1) if i else 0
                last[q] = i + q + ahead
                if back + q + ahead >= max(length, periods * q):
                    found.add((i - back, back + q + ahead, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each of n words stays: those of a run after its first period go."""
    edges = np.zeros(n + 1, dtype=np.int64)
    for start, size, period in runs:
        edges[start + period] += 1
        edges[start + size] -= 1
    return np.cumsum(edges[:-1]) == 0


RUNS = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_RUNS_TYPE = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, length: int = LEAST_LENGTH, periods: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id, runs, collapsed``: runs of each whole text in words, and the text without repetitions.

    Words are what ASCII blanks part, compared as they are; ``runs`` holds start, length and period by start,
    then period. ``collapsed`` is the words that no run repeats, joined by one space. One row per row, whatever its
    id: a NULL or empty text has no runs and collapses to an empty one; equal rows give equal
    rows. Other columns are not looked at. A text is one task's work, in memory linear in it.
    """
    def run(batches):
        for batch in batches:
            found, collapsed = [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode("utf-8").split()
                numbers: dict[bytes, int] = {}
                symbols = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
                runs = runs_of(symbols, length, periods) if len(words) >= length else []
                if runs:
                    stay = kept_words(len(words), runs)
                    words = [words[i] for i in np.flatnonzero(stay).tolist()]
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                collapsed.append(b" ".join(words).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(found, _RUNS_TYPE),
                 pa.array(collapsed, pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {RUNS}")


def digests(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the one of greatest exponent, and hashes of runs and text."""
    def better(a: Column, b: Column) -> Column:
        return F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)

    # Runs come by start, then period, so of equal exponents the first one stays.
    best = F.aggregate("runs", F.col("runs")[0], better)
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.withColumn("_best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"_best.{k}").alias(k) for k in ("start", "length", "period")],
        F.floor(F.expr("1000 * _best.length div _best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_periodic_ends(docs: DataFrame) -> DataFrame:
    """Documents, one in ten with a periodic end: its words from one on repeat the first of these.

    With h the CRC-32 of the id as text, g = h div 10 and n words, h mod 10 = 0 chooses; word
    a + i becomes word a + i mod p for a = g mod n, p = 1 + (n - a) div (3 + g mod 8). A NULL id is left alone.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), F.floor(h / 10).alias("_g"))
    many = F.size("_words")
    bounds = chosen.withColumn("_a", F.when(many > 0, F.col("_g") % many).cast("int"))
    period = (F.lit(1) + F.expr("(size(_words) - _a) div (3 + _g % 8)")).cast("int")
    head = F.slice("_words", F.lit(1), F.col("_a"))
    tail = F.transform(F.sequence(F.lit(0), many - F.col("_a") - 1),
                       lambda i: F.element_at("_words", (F.col("_a") + i % F.col("_p") + 1).cast("int")))
    return bounds.withColumn("_p", period).select(
        "doc_id", F.when(F.col("_a").isNotNull(), F.array_join(F.concat(head, tail), " "))
        .otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return digests(periodic_runs(with_periodic_ends(read(spark, sf, "documents"))))
