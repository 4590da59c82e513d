"""Cumulative-link regression: the fit itself, and texts with planted words."""

import random

import numpy as np

from evigrid.llm import toxicity as T

from .odd import ODD, docs


def test_fit_orders_grades():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(600):
        n = int(rng.integers(0, 5))
        rows.append(np.sort(rng.choice(6, size=n, replace=False)))
        grades.append(0 if n < 1 else 1 if n < 3 else 2)
    w, theta = T.fit_cumulative(rows, np.array(grades), 8)
    assert theta[0] < theta[1] and (w[:6] > 0.5).all() and (abs(w[6:]) < 1e-6).all()
    score = np.array([w[r].sum() for r in rows])
    found = (score > theta[0]).astype(int) + (score > theta[1])
    assert (found == np.array(grades)).mean() > 0.95


def test_gradient_is_that_of_the_likelihood():
    """One Adam step from zero moves every parameter towards a better likelihood."""
    rows, grades = [np.array([0]), np.array([1]), np.array([0, 1]), np.array([], int)], np.array([1, 0, 2, 0])

    def loss(w, theta):
        s = np.array([w[r].sum() for r in rows])
        up = np.concatenate([np.ones((4, 1)), 1 / (1 + np.exp(theta - s[:, None])), np.zeros((4, 1))], axis=1)
        return -np.log(up[range(4), grades] - up[range(4), grades + 1]).sum()
    before = loss(np.zeros(2), np.array([0.0, 1.0]))
    assert loss(*T.fit_cumulative(rows, grades, 2, steps=1)) < before > loss(*T.fit_cumulative(rows, grades, 2, steps=200)) + 1


def texts(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8)))
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 80))]
        toxic = i % 5 == 0
        for k in range((i // 5 % 3 + 1) * 2 if toxic else 0):
            words[rng.randrange(len(words))] = ["Gribble!", "zok" + rng.choice(["ig", "en", "ung"])][k % 2]
        yield i, " ".join(words), toxic


def test_held_out_texts(spark):
    rows = list(texts(600, 3))
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows if i < 400] + [(None, 1, 1), (401, 1, None)], "doc_id long, quality int, toxic int")
    df = docs(spark, [(i, t) for i, t, _ in rows])
    model = T.train(df, labels)
    assert sorted(model.thresholds) == model.thresholds and len(model.thresholds) == 2
    out = {r.doc_id: r for r in T.grade(df, model).collect()}
    truth = {i: t for i, _, t in rows}
    # 40 toxic and 160 clean texts that the training did not see; in one, a single weak word is left
    assert sum(out[i].rejected != truth[i] for i in truth if i >= 400) <= 1
    assert not any(out[i].rejected for i in truth if not truth[i])
    light = [out[i].severity for i in truth if i >= 400 and truth[i] and i // 5 % 3 == 0]
    heavy = [out[i].severity for i in truth if i >= 400 and truth[i] and i // 5 % 3 == 2]
    assert np.mean(light) < np.mean(heavy) <= 2 and all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in out.values())
    again = T.train(df.repartition(5), labels)
    assert again.weights == model.weights and again.thresholds == model.thresholds
    assert T.train(df, labels.where("toxic = 0")) is None and T.train(df.limit(0), labels) is None


def test_odd_documents(spark):
    df = docs(spark, ODD)
    model = T.Model({"=same": 9.0}, [1.0, 2.0])
    out = T.grade(df, model, carry=True)
    assert sorted(((r.row.doc_id, r.row.text) for r in out.collect()), key=repr) == sorted(ODD, key=repr)
    assert {r.key for r in out.where("rejected").select(out.doc_id.alias("key")).collect()} == {3}
    assert T.grade(df, None).where("rejected OR severity <> 0").count() == 0 and T.grade(df.limit(0), model).count() == 0
