"""Corpus operators against brute force, over odd rows and small hot groups."""

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harrow.llm import chosen_path, curriculum, decontaminate, language, nn_descent, quality, sharding
from harrow.llm import token_counts, toxicity, url_lists
from harrow.llm.common import components, numbered_copies, words_of
from tests.conftest import rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def documents(spark, texts, ids=None, source=None):
    data = [(ids[i] if ids else i, t, "en", source[i] if source else "s", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def copies():
    """Base texts, a group of near copies, a group of equal ones, odd texts."""
    base = [prose(60 + 7 * k, k) for k in range(25)]
    near = []
    for k in range(150):
        words = base[0].split() * 2
        words[k % len(words)] = f"changed{k}"
        near.append(" ".join(words))
    odd = [None, "", " .,; ", "one", "one", "one two three four", "x" * 50_000, prose(9000, 99)]
    return base + near + [base[1]] * 30 + [base[2] + " and one word more"] + odd


def brute_jaccard(texts, threshold=0.8):
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if (w := words_of(t)) else set() for t in texts]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i].add(j)
                links[j].add(i)
    return links


def reach(links, n):
    label = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in links[i])])
            moved |= low < label[i]
            label[i] = low
    return label


@pytest.mark.parametrize("block", [16, 128])
def test_jaccard_join(spark, copies, block):
    links = brute_jaccard(copies)
    label = reach(links, len(copies))
    got = chosen_path.jaccard_join(documents(spark, copies).withColumn("rep", F.lit(1)), block=block, small=16)
    assert {r["doc_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got.collect()} == {
        i: (len(links[i]), label[i], label[i] == i) for i in range(len(copies))}


def test_jaccard_join_of_repeated_and_missing_ids(spark):
    text = prose(40, 1)
    df = documents(spark, [text, text, text, prose(40, 2), text], [7, 7, None, 8, 3])
    got = rows(chosen_path.jaccard_join(df).select("doc_id", "n_links", "component_id", "kept"))
    assert got == [(None, 0, None, True), (3, 1, 3, True), (7, 1, 3, False), (8, 0, 8, True)]
    assert rows(chosen_path.one_of_each_group(df).select("doc_id")) == [(None,), (3,), (8,)]
    assert chosen_path.jaccard_join(df.limit(0)).count() == 0
    assert chosen_path.runs_needed(0.8, 1, 0.995) == 4


def test_components(spark):
    chain = [(i, i + 1) for i in range(10, 60)] + [(100, k) for k in range(101, 140)] + [(5, 5)]
    got = dict(rows(components(spark.createDataFrame(chain, "a long, b long"))))
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 140)}}


def test_embeddings(spark):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=32)
    vectors = [draw.normal(size=32).tolist() for _ in range(120)]
    vectors += [(centre + 0.08 * draw.normal(size=32)).tolist() for _ in range(60)] + [centre.tolist()] * 20
    x = np.array(vectors)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = {i: set(np.flatnonzero(x[i] @ x.T >= 0.95).tolist()) - {i} for i in range(len(x))}
    label = reach(links, len(x))
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [None] * 32, [1.0] * 4, [1e30] * 4, [float("inf")] * 4]
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors + odd)],
                               "vec_id long, embedding array<float>, unit int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in nn_descent.near_duplicates(df, block=16).collect()}
    n = len(x)
    # The two vectors of four equal parts point one way.
    want = {i: (len(links[i]), label[i], label[i] == i) for i in range(n)}
    want |= {n + k: (0, n + k, True) for k in range(len(odd))}
    want |= {n + 5: (1, n + 5, True), n + 6: (1, n + 5, False)}
    assert got == want
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


def tight_groups(spark, groups, size, cross, seed=7):
    """Groups inside which all list places go to the own group (0.999 and more), linked by ``cross`` or not."""
    draw = np.random.default_rng(seed)
    base, *ways = np.linalg.qr(draw.normal(size=(64, groups + 1)))[0].T
    centres = [cross ** 0.5 * base + (1 - cross) ** 0.5 * way for way in ways]
    x = np.array([c + 0.002 * draw.normal(size=64) for c in centres for _ in range(size)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    x /= np.linalg.norm(x, axis=1)[:, None]
    return df, (x @ x.T >= 0.95).sum(axis=1) - 1


def test_links_beyond_full_lists(spark):
    df, links = tight_groups(spark, 3, 200, 0.967)
    assert (links == 599).all()
    got = rows(nn_descent.near_duplicates(df, attempts=1, recall=0.0).select("vec_id", "n_links", "component_id"))
    assert got == [(i, 599, 0) for i in range(600)]


def test_all_are_compared_when_the_audit_stays_low(spark):
    df, links = tight_groups(spark, 40, 2, 0.5)
    assert (links == 1).all()
    got = rows(nn_descent.near_duplicates(df, tables=1, chunk=2, rounds=0, attempts=1).select(
        "vec_id", "n_links", "component_id"))
    assert got == [(i, 1, i - i % 2) for i in range(80)]


def test_audit_counts_vectors_not_links(spark):
    hot, _ = tight_groups(spark, 1, 300, 0.5)
    pairs, _ = tight_groups(spark, 20, 2, 0.5, seed=8)
    df = hot.union(pairs.withColumn("vec_id", F.col("vec_id") + 300))
    got = rows(nn_descent.near_duplicates(df, tables=1, chunk=2, rounds=0, attempts=1).select("vec_id", "n_links"))
    assert got == [(i, 299) for i in range(300)] + [(300 + i, 1) for i in range(40)]
    # All links of the group found, none of the pairs.
    vectors = nn_descent.unit_vectors(df).select(F.col("vec_id").alias("rep"), "dim", "unit", F.lit(1).alias("copies"))
    found = spark.range(300).select(F.col("id").alias("rep"), F.lit(299).cast("long").alias("links"))
    assert nn_descent.audit(vectors, found, 0.95, 400, 8) == 0.0


def test_tables_follow_the_size():
    for n in (1_000, 100_000, 10_000_000):
        bits = nn_descent.bits_of(n, 192)
        tables = max(12, nn_descent.tables_needed(bits, 0.95, nn_descent.CHANCE))
        meets = (1 - np.arccos(0.95) / np.pi) ** bits
        assert 1 - (1 - meets) ** tables >= 0.999


def brute_hits(text, items, width=10):
    words, hit, ids = words_of(text), set(), set()
    for item, content in items:
        for window in decontaminate.item_windows(content, width):
            for i in range(len(words) - len(window) + 1):
                if tuple(words[i:i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    ids.add(item)
    return len(words), len(hit), len(ids), hashlib.sha256(
        ",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block_windows", [200_000, 7])
def test_decontamination(spark, block_windows):
    items = [(1, prose(30, 1)), (2, "Short Item here"), (10, prose(12, 3)), (11, None), (12, " . "), (None, "zz zz")]
    part = " ".join(items[0][1].split()[5:20])
    texts = [part.upper() + " x", "a short item here, again SHORT ITEM HERE", f"{items[2][1]} {part}", "short item",
             None, "", prose(500, 8), f"b {part} c {part}", *[part] * 5]
    ids = [*range(8), 8, 8, None, 9, 9]
    df = documents(spark, texts, ids).withColumn("item_ids", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontaminate.contamination(df, bench, block_windows=block_windows))
    want = [(i, *brute_hits(t, [x for x in items if x[0] is not None])) for i, t in zip(ids, texts)]
    assert got == sorted(want, key=lambda r: tuple((v is not None, v) for v in r))
    clean = decontaminate.without_benchmark(df, bench, block_windows=block_windows)
    assert clean.columns == df.columns
    assert sorted(r[0] for r in clean.select("doc_id").collect()) == [i for i, *_, c in want if not c]
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(df, bench.limit(0)).where("contaminated").count() == 0


def test_blocks_of_items_by_words_and_bytes(spark):
    bench = spark.createDataFrame([(i, prose(14, i)) for i in range(20)], "item_id long, text string")
    df = documents(spark, [prose(14, i) + " " + prose(40, 50 + i) for i in range(0, 40, 3)])
    whole = rows(decontaminate.contamination(df, bench))
    assert sum(r[-1] for r in whole) == 7
    assert rows(decontaminate.contamination(df, bench, block_bytes=500)) == whole
    windows = decontaminate.staged_windows(bench, 10)
    assert decontaminate.blocks_needed(windows, 1000, 500) > 5 and decontaminate.blocks_needed(windows, 30, 1 << 20) == 4
    words = decontaminate.few_words(windows, 10_000)
    assert words == {w for t in bench.collect() for w in decontaminate.words_of(t.text)}
    assert decontaminate.few_words(windows, 3) is None
    counts = [len(decontaminate._indexes(df, bench, 10, 30, 1 << 20, counted_words=n)) for n in (3, 10_000)]
    assert counts == [4, 4]


def test_very_many_windows_under_one_word():
    r = random.Random(1)
    names = [b"w%d" % i for i in range(400)]
    index = {(b"same", *r.choices(names, k=9)): [i] for i in range(100_000)}
    index |= {(*r.choices(names, k=4), b"same"): [-1]}
    prefix = decontaminate._joined(index, Counter(dict.fromkeys(names, 9)))     # the rarest word is the same
    hit = next(iter(index))
    text = [b"same"] * 2000 + list(hit) + [b"same"] * 2000
    started = time.perf_counter()
    found, stretches = decontaminate.occurrences(text, prefix, frozenset(prefix))
    assert time.perf_counter() - started < 5
    assert found == {hit} and stretches == [(2000, 2010)]


def test_shards_fit_and_lose_nothing(spark, tmp_path):
    sizes = [3, 50, 7, 900, 12] * 40
    df = spark.createDataFrame([(i if i % 3 else 0, s, "same" if i % 3 == 0 else str(i)) for i, s in enumerate(sizes)]
                               + [(None, None, None)] * 300 + [(1, 40, "hot")] * 300, "doc_id long, n long, digest string")
    placed = sharding.assign_shards(df, "n", 500).toPandas()
    assert len(placed) == len(sizes) + 600 and placed["n"].sum() == sum(sizes) + 40 * 300
    for _, shard in placed.groupby(["shard_depth", "shard_prefix"]):
        assert len(shard) == shard["shard_rows"].iloc[0] and shard["n"].sum() == shard["shard_bytes"].iloc[0]
        assert shard["n"].sum() <= 500 or len(shard) == 1
    # A bucket is split only if it has to be: two buckets of one parent do not fit one shard.
    sums = placed.groupby(["shard_depth", "shard_prefix"])["n"].sum().to_dict()
    assert all(sums.get((d, p ^ 1), 501) + s > 500 for (d, p), s in sums.items() if d)
    assert sharding.assign_shards(df.limit(0), "n", 500).count() == 0
    docs = documents(spark, ["abc", "abc", None, "", "x" * 1000], [1, 1, 2, None, 3]).withColumn("shard", F.lit("old"))
    sharding.write_shards(docs, str(tmp_path / "s"), limit=100)
    again = spark.read.parquet(str(tmp_path / "s"))
    assert rows(again.select("doc_id", "text")) == rows(docs.select("doc_id", "text"))
    plan = sharding.document_shards(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_copies_are_numbered(spark):
    df = spark.createDataFrame([(1, None)] * 2500 + [(2, "a")], "a int, b string")
    got = numbered_copies(df)
    assert got.where("a = 1").select("_copy").distinct().count() == 2500 and got.count() == 2501


def test_mix(spark):
    sizes = {"a": [100] * 30, "b": [10] * 10, "c": [7, 0, 50], None: [1000, 3000]}
    data = [(i, s, n) for i, (s, n) in enumerate((s, n) for s, ns in sizes.items() for n in ns)] + [(None, "a", 5)] * 4
    df = spark.createDataFrame(data, "doc_id long, source string, size long")
    got = curriculum.mixed(df, bucket_rows=4).toPandas()
    again = curriculum.mixed(df.orderBy(F.desc("doc_id")), bucket_rows=1000).toPandas()
    key = ["doc_id", "source", "size", "taken", "position"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    total = sum(n for *_, n in data)
    targets = got.drop_duplicates("source")["target"].sum()
    assert abs(targets - 1.5 * total) < 1e-6 and (got["taken"] <= 2 * got["size"]).all()
    for _, one in got.groupby("source", dropna=False):
        assert abs(one["taken"].sum() - one["target"].iloc[0]) < 1 and one["target"].iloc[0] <= 2 * one["size"].sum() + 1e-9
    taken = got["position"].dropna()
    assert taken.is_monotonic_increasing and ((taken >= 0) & (taken <= 1)).all()
    assert curriculum.mixed(df.limit(0)).count() == 0


def test_training_time_inverts_the_schedule(spark):
    knots = ((0.0, 0.2), (0.4, 2.0), (0.7, 2.0), (1.0, 0.5))
    t = np.linspace(0, 1, 2001)
    w = np.interp(t, [k[0] for k in knots], [k[1] for k in knots])
    area = np.concatenate(([0], np.cumsum((w[1:] + w[:-1]) / 2 * np.diff(t))))
    df = spark.createDataFrame([(float(x),) for x in np.linspace(0, 0.999, 50)], "x double")
    for r in df.select("x", curriculum.training_time(F.col("x"), knots).alias("t")).collect():
        assert abs(np.interp(r["t"], t, area) / area[-1] - r["x"]) < 1e-4


def test_training_stream(spark):
    texts = ["a b c", "a b c", None, "d e", "f " * 50]
    df = documents(spark, texts, [1, 1, 2, None, 3], ["x", "x", "y", None, "z"]).withColumn("copy", F.lit(1))
    got = curriculum.training_stream(df, share=2.0)
    assert got.columns == df.columns
    assert Counter(r["text"] for r in got.collect()) == {"a b c": 4, "d e": 2, "f " * 50: 2}


def noisy(seed, bad):
    words = prose(80, seed).split()
    return " ".join(w.upper() + "!!" if bad and k % 2 else w for k, w in enumerate(words)) + "."


def test_quality(spark):
    docs = documents(spark, [noisy(k, k % 4 == 0) for k in range(400)] + [None, "", "x " * 30_000]).withColumn(
        "quality", F.lit(0)).withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(k, int(k % 4 > 0), None) for k in range(400)] + [(1, None, 1), (2, 5, 1), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == 403 and got["score"].between(0, 1).all()
    assert all(got.loc[k, "held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(403))
    held = [k for k in range(400) if got.loc[k, "held_out"]]
    assert np.mean([got.loc[k, "predicted"] == (k % 4 > 0) for k in held]) > 0.97
    kept = quality.of_quality(docs, labels)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(
        got.index[got["score"] >= 0.5])
    # Labels of held-out rows do not matter.
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.allclose(got["score"], quality.quality_scores(docs, turned).toPandas().set_index("doc_id")["score"][got.index])
    none = quality.quality_scores(docs, labels.limit(0)).toPandas()
    assert (none["score"] == 0.5).all() and quality.quality_scores(docs.limit(0), labels).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.arange(6.0), np.array([0, 1, 0, 3, 2, 5.0]), np.array([5, 5, 5, 5, 5, 5.0]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and y[0] < 0.1 and y[-1] > 0.9


def test_language(spark):
    ends = {"aa": "ong", "bb": "ier", "cc": "ado"}
    texts, langs = [], []
    for k in range(300):
        lang = list(ends)[k % 3]
        r = random.Random(k)
        texts.append(" ".join("".join(r.choice("bdfgklmnst") for _ in range(4)) + ends[lang] for _ in range(12)))
        langs.append(lang)
    df = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(zip(texts, langs))]
                               + [(300, None, "aa"), (301, "12 34 !", None), (302, "q" * 40_000 + "ado", None), (None, "x", None)],
                               "doc_id long, text string, lang string").withColumn("word", F.lit(1))
    got = language.language_predictions(df).toPandas()
    assert len(got) == 304 and got["score"].between(0, 1).all()
    by = got.dropna(subset="doc_id").set_index("doc_id")
    assert tuple(by.loc[300, ["lang_pred", "score"]]) == ("und", 0.0) and by.loc[301, "lang_pred"] == "und"
    held = [k for k in range(300) if by.loc[k, "held_out"]]
    assert held and all(zlib.crc32(str(k).encode()) % 4 == 2 for k in held)
    assert np.mean([by.loc[k, "lang_pred"] == langs[k] for k in held]) > 0.95
    unlearned = language.language_predictions(df.withColumn("lang", F.lit(None).cast("string"))).toPandas()
    assert (unlearned["lang_pred"] == "und").all() and language.language_predictions(df.limit(0)).count() == 0


def test_backoff_goes_from_words_to_shorter_grams():
    model = language.LanguageModel(["a", "b"], np.zeros(2), {"known": (1.0, 0.0)}, [
        {"<newx": (0.0, 5.0)}, {}, {}, {}, {"x": (0.0, 1.0)}])
    assert model.vector("known") == (1, 0) and model.vector("newx") == (0, 5)
    assert model.vector("zx") == (0, 1) and model.vector("zz") == (0, 0)


def test_toxicity(spark):
    texts = [prose(60, k) + (" you nasty blurgh and blurghish thing" if k % 3 == 0 else "") for k in range(300)]
    texts += ["bl0rg nothing", "so n4sty, you BLURGH", "so nasty, you bІurgh".replace("І", "l"), None, "", "x" * 100_000]
    docs = documents(spark, texts).withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(300)] + [(None, 1, 1), (5, 1, None)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(docs, labels).toPandas().set_index("doc_id")
    assert len(got) == 306 and got["score"].between(0, 1).all()
    held = [k for k in range(300) if got.loc[k, "held_out"]]
    assert all(zlib.crc32(str(k).encode()) % 5 == 0 for k in held)
    assert all(got.loc[k, "predicted"] == (k % 3 == 0) for k in held)
    assert got.loc[[301, 302], "predicted"].tolist() == [1, 1] and got.loc[[300, 303, 304, 305], "predicted"].sum() == 0
    blank = toxicity.toxicity_scores(docs, labels.limit(0)).toPandas()
    assert (blank["score"] == 0.5).all() and toxicity.toxicity_scores(docs.limit(0), labels).count() == 0


def test_folding_and_exceptions():
    assert toxicity.folded("St0p $tup1d sтuрid 1diot") == "stop stupid stupid idiot"
    assert toxicity.folded("word$$$ than%%% in 2010!!! 3 a!") == "word$$$ than%%% in 2010!!! 3 a!"
    lexicon = toxicity.Lexicon({"trash ": 5.0, "stup": 6.0})
    assert lexicon.measure("put it in the trash can") < 0 < lexicon.measure("it is trash")
    assert lexicon.measure("strash trashy") < 0 < lexicon.measure("stupidity")
    assert lexicon.measure("stupid " + "word " * 50) > lexicon.measure("stupid " + "word " * 5000) > 0
    assert lexicon.measure(None) < 0 and lexicon.measure("") < 0


def test_start_and_whole_word_of_one_spelling():
    for weights in ({"scum": 5.0, "scum ": 6.0}, {"scum ": 6.0, "scum": 5.0}):
        lexicon = toxicity.Lexicon(weights)
        assert lexicon.measure("a scumbag here") > 0 and lexicon.measure("ascumbag") < 0
        assert lexicon.measure("a scum at noon") > lexicon.measure("a scumbag here")


def test_url_lists(spark):
    captures = spark.createDataFrame(
        [(1, "http://www.Bad.example.com/x/y?q", 100), (1, "http://www.Bad.example.com/x/y?q", 100),
         (2, "https://u@sub.bad.example.com:8080/", 250), (3, "http://bad.example.com/ok/page", 150), (4, None, 1),
         (5, "http://bad.example.com/", None), (6, "no url", 5), (7, "http://notbad.example.com/", 150),
         (8, "http://bad.example.com/x", 200)], "page_id long, url string, fetched long").withColumn("since", F.lit(1))
    entries = spark.createDataFrame(
        [("bad.example.com", "block", 100, 1), ("bad.example.com", "remove", 200, 2), ("bad.example.com", "block", 250, 3),
         ("bad.example.com/ok", "allow", 0, 4), ("bad.example.com", "allow", 100, 0), (None, "block", 1, 1)],
        "pattern string, action string, at long, entry_id long")
    got = url_lists.decide(captures, entries, period_s=30)
    assert rows(got.select("page_id", "blocked", "pattern", "since", "n_active")) == [
        (1, True, "bad.example.com", 100, 1), (1, True, "bad.example.com", 100, 1), (2, True, "bad.example.com", 250, 1),
        (3, False, "bad.example.com/ok", 0, 2), (4, False, None, None, 0), (5, False, None, None, 0),
        (6, False, None, None, 0), (7, False, None, None, 0), (8, False, None, None, 0)]
    assert url_lists.decide(captures.limit(0), entries).count() == 0
    assert url_lists.decide(captures, entries.limit(0)).where("blocked").count() == 0


def test_url_lists_of_deep_hosts_and_paths(spark):
    host, folders = "a.b.c.d.e.f.g.h.i.j.spam.example", "/".join(f"f{k}" for k in range(12))
    captures = spark.createDataFrame([(1, f"http://{host}/", 5), (2, f"http://{host}/{folders}/page", 5)],
                                     "page_id long, url string, fetched long")
    entries = spark.createDataFrame([("spam.example", "block", 0, 1), (f"{host}/{folders}", "allow", 0, 2)],
                                    "pattern string, action string, at long, entry_id long")
    got = url_lists.decide(captures, entries)
    assert rows(got.select("page_id", "blocked", "pattern", "n_active")) == [
        (1, True, "spam.example", 1), (2, False, f"{host}/{folders}", 2)]


def test_token_rollup(spark, tmp_path):
    path, schema = str(tmp_path / "r"), "source string, lang string, version string, tokens long"
    first = spark.createDataFrame([("a", "en", "1", 5), ("a", "en", "1", 7), (None, None, "1", None)], schema)
    after = spark.createDataFrame([("a", "en", "1", 6), ("b", "en", "1", 7)], schema)
    assert token_counts.totals(spark, path).count() == 0
    assert token_counts.commit(token_counts.inserted(first), path, "one")
    assert not token_counts.commit(token_counts.inserted(first), path, "one")
    want = [(None, None, "1", 1, 0), ("a", "en", "1", 2, 12)]
    assert rows(token_counts.totals(spark, path)) == want
    # Deltas without a commit, as after a crash, do not count and are written anew.
    token_counts.deleted(first).groupBy("source", "lang", "version").agg(
        F.sum("sign").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{path}/deltas/two")
    assert rows(token_counts.totals(spark, path)) == want
    assert token_counts.commit(token_counts.revised(first, after), path, "two")
    want = [("a", "en", "1", 1, 6), ("b", "en", "1", 1, 7)]
    assert rows(token_counts.totals(spark, path)) == want
    token_counts.compact(spark, path, str(tmp_path / "c"))
    assert not token_counts.commit(token_counts.inserted(first), str(tmp_path / "c"), "one")
    assert rows(token_counts.totals(spark, str(tmp_path / "c"))) == want


def test_tokenizer_file(spark):
    file = "/opt/tokenizers/byte_bpe_50k.json"
    pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer
    texts = ["A whole sentence, with <|endoftext|> inside.", "", None]
    tokenizer = Tokenizer.from_file(file)
    tokenizer.encode_special_tokens = True
    got = token_counts.tokenized(documents(spark, texts), file, "bpe")
    assert rows(got.select("doc_id", "tokens")) == [
        (i, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts)]
