"""Compacted token rollups, batch names of any kind, languages that few documents have."""

import random

from pyspark.sql import functions as F

from harrow.llm import language, token_counts
from tests.conftest import rows

KEYS = "source string, lang string, version string, tokens bigint"


def test_compaction_of_many_batches_and_of_none(spark, tmp_path):
    path, to = str(tmp_path / "a"), str(tmp_path / "b")
    token_counts.compact(spark, path, to)
    assert token_counts.totals(spark, to).count() == 0
    names = ["plain", "a/b", "../up", "x=1 %20", "ü", ""]
    for k, name in enumerate(names):
        changes = token_counts.inserted(spark.createDataFrame([("s", None, "v", k)], KEYS))
        assert token_counts.commit(changes, path, name)
        assert not token_counts.commit(changes, path, name)
    want = [("s", None, "v", 6, 15)]
    assert rows(token_counts.totals(spark, path)) == want
    token_counts.compact(spark, path, to)
    assert rows(token_counts.totals(spark, to)) == want
    assert all(token_counts.is_committed(spark, to, n) for n in names)
    again = str(tmp_path / "c")
    token_counts.commit(token_counts.deleted(spark.createDataFrame([("s", None, "v", 5)], KEYS)), to, "later")
    token_counts.compact(spark, to, again)
    assert rows(token_counts.totals(spark, again)) == [("s", None, "v", 5, 10)]


def test_text_without_a_letter(spark):
    assert language.words("½ ² ① 12 _") == []
    assert language.words("a½ Ünï 3x") == ["a½", "ünï", "x"]
    docs = spark.createDataFrame([(1, "some words here", "en"), (2, "½", "en"), (3, None, "en"), (4, "", None)],
                                 "doc_id long, text string, lang string")
    found = {r.doc_id: r.lang_pred for r in language.language_predictions(docs).collect()}
    assert [found[k] for k in (2, 3, 4)] == ["und"] * 3


def test_a_language_of_few_documents_is_learned(spark):
    r = random.Random(2)
    common = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    rare = ["".join(r.choice("rstuvwxy") for _ in range(5)) for _ in range(300)]
    data = [(i, " ".join(r.choice(common) for _ in range(12)), "big") for i in range(6000)]
    data += [(10_000 + i, " ".join(r.choice(rare) for _ in range(12)), "small") for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    found = language.language_predictions(docs, fit_rows=100, language_rows=20)
    assert found.where("doc_id >= 10000 AND lang_pred <> 'small'").isEmpty()
    assert found.where((F.col("doc_id") < 10000) & (F.col("lang_pred") != "big")).isEmpty()
