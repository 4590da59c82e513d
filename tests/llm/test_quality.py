"""Base counts against a plain computation, and the verdict on labelled texts."""

import random
import re

import numpy as np

from evigrid.llm import quality as Q
from evigrid.llm.ngrams import hashed_ngrams

from .odd import ODD, docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_counts():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "a b a ", " ", "\n", "\t", "#", "é", "\x0b", " ", "x y z\n"]) for _ in range(rng.randrange(60)))
        assert Q.base_counts(text) == plain(text), repr(text)
    assert Q.base_counts("a b c a b c") == (6, 6, 0, 0, 6)


def sample(rng, good, n=70):
    word = lambda: "".join(rng.choice("aeioutnsrl") for _ in range(rng.randrange(2, 8)))
    return " ".join(word() if good else word().upper() + rng.choice(["!!", "$$$", "%%"]) for _ in range(n))


def test_verdict(spark):
    rng = random.Random(3)
    rows = [(i, sample(rng, i % 4 > 0)) for i in range(200)] + [(500, "too short")]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 2)] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in Q.assess(docs(spark, rows), labels).collect()}
    assert all(out[i].kept == (i % 4 > 0) and not out[i].base_failed for i in range(200))
    assert out[500].base_failed and not out[500].kept
    again = {r.doc_id: r for r in Q.assess(docs(spark, rows).repartition(5), labels).collect()}
    assert again == out


def test_ratio_and_split():
    target, raw = np.array([5, 0, 1]), np.array([5, 5, 2])
    assert Q.log_ratio(target, raw).argmax() == 0 and not Q.log_ratio(np.zeros(3), raw).any()
    assert -1 < Q.split_point([0.1, 0.2], [-1.0, -2.0]) < 0.1 and Q.split_point([], [1.0]) == -np.inf
    assert len(hashed_ngrams("ab", 3, 8)) == 1 and len(hashed_ngrams("abcd", 3, 8)) == 2 and len(hashed_ngrams("", 3, 8)) == 0


def test_threshold_of_all_rows(spark):
    rng = random.Random(5)
    for size, digits in ((400, 1), (400, 6), (3, 1)):
        rows = [(int(rng.random() < 0.6), round(rng.gauss(0, 1), digits)) for _ in range(size)] + [(1, 0.5), (0, -0.5)]
        good, bad = ([s for y, s in rows if y == k] for k in (1, 0))
        rated = spark.createDataFrame(rows, "y int, score double").repartition(4)
        assert Q.threshold(rated) == Q.split_point(good, bad)
    assert Q.threshold(spark.createDataFrame([(1, 0.5)], "y int, score double")) == -np.inf


def test_every_label_counts(spark):
    # 4,050 labelled good documents: each of their buckets is in the trusted side, however their keys hash.
    rows = [(i, f"w{i:05d}") for i in range(4050)]
    texts = spark.createDataFrame([(1, t) for _, t in rows] + [(0, "other"), (None, "none"), (1, None)], "y int, text string")
    target, raw = Q.bucket_counts(texts, 3, 8)
    assert target.sum() == 4 * 4050 and raw.sum() == 4 * 4050 + 3 + 2
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.score for r in Q.assess(docs(spark, rows), labels, bits=8).collect()}
    assert all(abs(s) < 1e-12 for s in out.values())  # the trusted side is the corpus, so no bucket differs


def test_odd_documents(spark):
    df = docs(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = Q.assess(df, none)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out.collect()), key=repr)
    want = []
    for i, t in ODD:
        c = Q.base_counts(t or "")
        failed = c[0] < 50 or 100 * c[4] > 50 * c[0]
        want.append((i, *c, failed, not failed))
    assert got == sorted(want, key=repr)
    assert Q.assess(df.limit(0), none).count() == 0
