import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import ordinal
from tallyweave.llm.queries import op4_toxicity, op7_quality
from tallyweave.llm.shared import read_table

LARGER = "/root/testdata/sf0.1"


def test_gradients_order_thresholds_and_share_weights():
    rng = np.random.default_rng(0)
    grades, samples = [], []
    for _ in range(600):
        n_bad = rng.integers(0, 7)
        samples.append(np.unique(np.concatenate((rng.choice(np.arange(100, 400), 15, replace=False), rng.choice(20, n_bad, replace=False)))))
        grades.append(min(3, n_bad // 2))
    model = ordinal.fit(samples, np.array(grades), np.ones(600))
    assert model.grades == [0, 1, 2, 3] and (np.diff(model.thresholds) >= 0).all()
    p = model.probabilities([model.score(s) for s in samples])
    assert np.allclose(p.sum(axis=1), 1) and (p >= 0).all()
    expected = p @ np.arange(4)
    assert np.corrcoef(expected, grades)[0, 1] > 0.8
    assert (p.argmax(axis=1) == grades).mean() > 0.6


@pytest.mark.parametrize(("grade", "least"), [("quality", 0.9), ("toxic", 0.9)])
def test_held_out_accuracy(spark, grade, least):
    docs, labels = read_table(spark, LARGER, "documents"), read_table(spark, LARGER, "labels")
    odd = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1
    model = ordinal.train(docs, labels.where(odd), grade)
    rows = ordinal.scored(docs, model).join(labels.where(~odd), "doc_id").select("tail", grade).collect()
    truth, said = np.array([r[1] > 0 for r in rows]), np.array([r[0] >= 0.5 for r in rows])
    balanced = (said[truth].mean() + (~said[~truth]).mean()) / 2
    print(grade, len(rows), balanced)
    assert balanced >= least


def test_whole_tables(spark, sf):
    ids = {r[0] for r in read_table(spark, sf, "documents").select("doc_id").collect()}
    a, b = op4_toxicity(spark, sf).collect(), op7_quality(spark, sf).collect()
    assert {r["doc_id"] for r in a} == {r["doc_id"] for r in b} == ids and len(a) == len(b) == len(ids)
    assert all(r["toxic"] == (r["expected_severity"] >= 0.5) for r in a)


def test_hard_cases(spark, doc_cases, no_docs):
    schema = "doc_id long, quality int"
    labels = spark.createDataFrame([(1, 2), (1, 0), (3, 0), (4, 0), (6, 1), (None, 1), (10, None), (99, 1)], schema)
    model = ordinal.train(doc_cases, labels, "quality")
    assert model.grades == [0, 1, 2]
    rows = ordinal.scored(doc_cases, model).collect()
    assert len(rows) == doc_cases.count() and all(0 <= r["expected"] <= 2 and 0 <= r["tail"] <= 1 for r in rows)
    kept = ordinal.selected(doc_cases, model, 0.5)
    assert kept.columns == doc_cases.columns and kept.count() == sum(r["tail"] >= 0.5 for r in rows)
    assert ordinal.scored(no_docs, model).isEmpty() and ordinal.selected(no_docs, model, 0.5).isEmpty()
    none = ordinal.train(doc_cases, spark.createDataFrame([], schema), "quality")
    assert ordinal.selected(doc_cases, none, 0.5).count() == doc_cases.count()
    assert ordinal.train(doc_cases, spark.createDataFrame([(1, 1), (3, 1)], schema), "quality").grades == [1]


@pytest.mark.parametrize(("grade", "query"), [("toxic", op4_toxicity), ("quality", op7_quality)])
def test_scores_worked_out_the_plain_way(spark, sf, grade, query):
    import math

    docs = read_table(spark, sf, "documents")
    model = ordinal.train(docs, read_table(spark, sf, "labels"), grade)
    got = {r[0]: (r[1], r[2]) for r in query(spark, sf).collect()}
    weights, edges = model.weights.tolist(), model.thresholds.tolist()
    for r in docs.collect():
        score = sum(weights[i] for i in set(ordinal.features(r["text"] or "").tolist()))
        at_most = [1 / (1 + math.exp(min(40, max(-40, score - e)))) for e in edges] + [1.0]
        p = [b - a for a, b in zip([0.0, *at_most], at_most)]
        expected, tail = sum(g * x for g, x in zip(model.grades, p, strict=True)), 1 - p[0]
        assert math.isclose(got[r["doc_id"]][0], expected, abs_tol=1e-9)
        if grade == "quality":
            assert math.isclose(got[r["doc_id"]][1], tail, abs_tol=1e-9)
    assert len(got) == docs.count()
