"""Which rows models learn from, and how their sums are taken."""

import numpy as np
import pytest

from harrow.llm import chosen_path, decontaminate, quality, toxicity
from harrow.llm.common import summed
from tests.conftest import rows
from tests.llm.test_operators import brute_jaccard, documents, prose


def test_sums_come_from_tasks_with_rows_alone(spark, monkeypatch):
    sent = []
    table = spark.range(1000).selectExpr("array(double(id), 1.0D) AS x").repartition(100)

    def partial(batch):
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        return x.T @ x

    want = np.array([[sum(i * i for i in range(1000)), 499500], [499500, 1000]], dtype=float)
    for tasks in (1, 100):
        np.testing.assert_allclose(summed(table, partial, (2, 2), tasks), want)
    assert summed(table.limit(0), partial, (2, 2), 1).sum() == 0
    collected = type(table).toLocalIterator
    monkeypatch.setattr(type(table), "toLocalIterator", lambda df: (sent.append(r) or r for r in collected(df)))
    summed(table.where("x[0] < 5"), partial, (2, 2), 1)
    assert 1 <= len(sent) <= 5      # of 100 partitions those that have a row


def test_weights_are_those_of_the_normal_equations(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, len(quality.FEATURES)))
    y = (x[:, 0] + 0.2 * draw.normal(size=300) > 0).astype(int)
    table = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))],
                                  "doc_id long, x array<double>, y int")
    model = quality.fit(table.repartition(7), fourier=40)
    z = model.lift(x)
    np.testing.assert_allclose(model.centre, x.mean(axis=0), atol=1e-12)
    penalty = np.eye(41) * quality.RIDGE * 300
    penalty[-1, -1] = 1e-9
    np.testing.assert_allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-7)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.8


def test_copies_go_and_passages_stay(spark):
    base, other = prose(300, 1).split(), prose(300, 2).split()
    near = base[:150] + ["changed"] + base[151:]
    passage = other[:200] + base[:100]
    texts = [base, near, passage, base, prose(200, 3).split(), near]
    table = spark.createDataFrame([(i, " ".join(t), y) for (i, t), y in zip(enumerate(texts), [1, 1, 1, 0, 0, 0])],
                                  "doc_id long, text string, y int")
    table = table.union(spark.createDataFrame([(4, " ".join(texts[4]), 1)], table.schema))
    assert rows(toxicity.without_copies(table).select("doc_id", "y")) == [(0, 1), (2, 1), (3, 0), (4, 0), (4, 1)]


@pytest.mark.parametrize("threshold", [0.5, 0.7])
def test_low_thresholds_get_the_runs_they_need(spark, threshold):
    texts = []
    for k in range(130):
        base = prose(80, 1000 + k).split()
        for c, changes in enumerate((2, 3, 4, 5) if threshold < 0.6 else (1, 2, 2, 1)):
            words = list(base)
            for at in range(changes):
                words[4 + (3 * c + 15 * at) % 72] = f"w{k}c{c}"
            texts.append(" ".join(words))
        texts.append(" ".join(base))
    want = brute_jaccard(texts, threshold)
    expected = sum(len(v) for v in want.values())
    assert expected >= 1000
    found = chosen_path.jaccard_join(documents(spark, texts), threshold=threshold)
    links = {r.doc_id: r.n_links for r in found.collect()}
    total = sum(links.values())
    assert expected * 0.99 <= total <= expected


def test_partitions_without_rows_are_counted(spark):
    table = spark.createDataFrame([(0, "some words of text", 1)], "doc_id long, text string, y int").repartition(6)
    assert {r.part for r in toxicity.part_counts(table).collect()} >= {"some ", "words ", "of ", "text "}
    kept = decontaminate.without_benchmark(
        documents(spark, [prose(40, 1), prose(40, 2)]).repartition(8).where("doc_id < 5"),
        spark.createDataFrame([(1, prose(40, 1))], "item_id long, text string").repartition(8))
    assert [r.doc_id for r in kept.collect()] == [1]
