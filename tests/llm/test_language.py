"""Rank-order language profiles: held-out accuracy and edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from evigrid.llm import language as L
from evigrid.llm.common import fold
from evigrid.llm.ngrams import letters_table, packed_ngrams

from .odd import ODD, docs

SYLLABLES = {"aa": "ba ko mi ra tu", "bb": "sch ein ung ver lich", "cc": "ção nha ões ria"}


def texts(n, seed):
    rng = random.Random(seed)
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        parts = SYLLABLES[lang].split()
        yield i, " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(rng.randrange(8, 60))), lang


def test_held_out_accuracy(spark):
    rows = list(texts(300, 1))
    out = L.identify(docs(spark, rows), fold(F.col("doc_id")) % 5 == 0).collect()
    truth = {i: lang for i, _, lang in rows}
    held = [r for r in out if r.held_out]
    assert len(out) == 300 and 30 < len(held) < 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_grams_by_hand():
    letters = letters_table()
    pack = lambda s: sum(ord(c) << 21 * k for k, c in enumerate(reversed(s)))
    want = ["a", "b", "c", " a", "ab", "b ", " c", "c ", " ab", "ab ", " c "]
    assert sorted(packed_ngrams("AB-- c!", letters).tolist()) == sorted(map(pack, want))
    assert packed_ngrams("12 !?", letters).tolist() == [] and packed_ngrams("", letters).tolist() == []


def test_distance_by_hand():
    ranker = L.Ranker({"x": np.array([5, 6, 7]), "y": np.array([7, 8])}, 3)
    # ranks of the text: 7 first, then 5; x: |2 - 0| + |0 - 1| = 3, y: 0 + 3 = 3; the tie goes to x
    assert ranker.predict(np.array([7, 7, 5])) == ("x", 1 - 3 / 6)
    assert ranker.predict(np.array([], np.int64)) == ("und", 0.0) == L.Ranker({}, 3).predict(np.array([1]))


def test_labels_are_no_input(spark):
    rows = list(texts(80, 2))
    held = fold(F.col("doc_id")) % 5 == 0
    df = docs(spark, rows)
    other = df.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit("q"))
    assert sorted(map(tuple, L.identify(df, held).collect())) == sorted(map(tuple, L.identify(other, held).collect()))


def test_odd_documents(spark):
    df = docs(spark, [(i, t, None if k % 2 else "en") for k, (i, t) in enumerate(ODD)])
    out = L.identify(df, fold(F.col("doc_id")) % 5 == 0)
    found = sorted(((r.doc_id, r.lang_pred) for r in out.collect()), key=repr)
    want = [(i, "en" if t and any(c.isalpha() for c in t) else "und") for i, t in ODD]
    assert found == sorted(want, key=repr)
    assert L.identify(df.limit(0), F.lit(False)).count() == 0
    assert {r.lang_pred for r in L.identify(df, F.lit(True)).collect()} == {"und"}
