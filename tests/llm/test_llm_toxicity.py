import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lotlens.llm import toxicity


def loss(state, rows, columns, values, grades, n, ridge):
    """The ordinal log loss written from its definition, for numeric slopes."""
    w, theta = state[:n], np.append(state[n:], np.inf)
    score = np.bincount(rows, w[columns] * values, len(grades))
    below = lambda k: 0.0 * score if k < 0 else 1 / (1 + np.exp(score - theta[k]))
    p = np.array([below(g)[i] - below(g - 1)[i] for i, g in enumerate(grades)])
    share = np.bincount(grades) / len(grades)
    weight = 1 / share[grades] ** 0.5
    return -(weight / weight.mean() * np.log(p)).mean() + ridge / 2 * (w**2).sum()


def test_fit_is_a_minimum_of_the_ordinal_loss():
    rng = np.random.default_rng(2)
    n, features = 400, 4
    dense = rng.random((n, features)) * (rng.random((n, features)) < 0.5)
    grades = np.digitize(dense @ [3, 2, 0, -1] + rng.logistic(size=n), [1.0, 2.5])
    rows, columns = np.nonzero(dense)
    w, theta = toxicity.fit_weights(rows, columns, dense[rows, columns], grades, features, ridge=0.01, rounds=3000, rate=0.02)
    assert theta[0] < theta[1] and w[0] > w[1] > w[3]
    state = np.concatenate([w, theta])
    for i in range(len(state)):
        step = np.zeros_like(state)
        step[i] = 1e-4
        args = rows, columns, dense[rows, columns], grades, features, 0.01
        assert abs(loss(state + step, *args) - loss(state - step, *args)) / 2e-4 < 2e-3


def test_severity_is_the_expected_grade():
    model = toxicity.Model({}, np.array([0.0, 1.0]))
    p1, p2 = 1 / (1 + np.exp(-0.3)), 1 / (1 + np.exp(0.7))
    assert model.severity(np.array([0.3]))[0] == pytest.approx(1 * (p1 - p2) + 2 * p2)
    assert toxicity.Model().severity(np.zeros(2)).tolist() == [0, 0]


def test_train_and_grade_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts, grades = [], []
    for i in range(900):
        g = (i % 3 == 0) + (i % 9 == 0)
        words = [word() for _ in range(40)] + ["grumble"] * (2 if g else 0) + ["grumbledest"] * (4 if g == 2 else 0)
        rng.shuffle(words)
        texts.append(" ".join(words))
        grades.append(g)
    rows = [(i, t, 1.5) for i, t in enumerate(texts)] + [(5000, None, 0.0), (5001, "", 0.0), (5002, "Grumble! grumbles a b", 0.0), (None, texts[0], 0.0), (5003, "calm words " * 4000, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, severity double")
    labels = spark.createDataFrame([(i, g) for i, g in enumerate(grades) if i < 600] + [(0, 0), (None, 2), (3, None)], "doc_id long, grade int")
    model = toxicity.train(docs, labels)
    got = {}
    for r in docs.select("doc_id", toxicity.grade(docs, model).alias("s")).collect():
        got[r.doc_id] = r.s
    right = [got[i].grade == g for i, g in enumerate(grades) if i >= 600]
    assert sum(right) / len(right) > 0.95
    assert got[5002].toxic and not got[5003].toxic and got[5000] == got[5001] and not got[5000].toxic and got[None].toxic
    assert toxicity.train(docs, labels.where("grade = 0")).weights == {}
    assert toxicity.train(docs.limit(0), labels).weights == {}
    assert docs.where(F.lit(False)).select(toxicity.grade(docs, model)).count() == 0


def test_tasks_with_labels_of_one_kind(spark):
    docs = spark.createDataFrame([(i, ("grumble " if i % 2 else "calm ") + f"word{i}") for i in range(60)], "doc_id long, text string").repartition(100)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, grade int")
    one = pa.RecordBatch.from_arrays([pa.array(["grumble"]), pa.array([1], pa.int32())], names=["text", "grade"])
    assert len({str(b.schema) for b in toxicity._feature_counts(iter([one]))}) == 1
    assert toxicity.train(docs, labels, least=0.5).weights
