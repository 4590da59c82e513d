"""Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evigrid.llm import jaccard_join as J

from .odd import ODD, docs


def shingles(text, n=3):
    words = (text or "").encode().lower().split()
    return frozenset(zip(*(words[k:] for k in range(n)))) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows, percent=90, n=3):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    out = []
    for i, (key, _) in enumerate(rows):
        mine = [k for j, (k, _) in enumerate(rows) if root(j) == root(i) and k is not None]
        out.append((key, len(sets[i]), min(mine) if mine else None))
    return sorted(out, key=repr)


def classes(spark, rows, **options):
    return sorted((tuple(r) for r in J.jaccard_classes(docs(spark, rows).repartition(3), **options).collect()), key=repr)


def corpus(seed, n=140):
    """Families of copies with few and many edits, a passage many share, sizes from one word on."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    passage = [word() for _ in range(12)]
    bases = [[word() for _ in range(rng.choice([1, 2, 3, 20, 60, 150, 600]))] for _ in range(12)]
    rows = []
    for i in range(n):
        words = list(rng.choice(bases if i % 3 else bases[5:7]))  # two hot families
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = word()
        if rng.random() < 0.3:
            words += passage
        rows.append((i * 7 % n, " ".join(words) if rng.random() < 0.7 else "\n".join(words).upper()))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(J, "BLOCK", 5)  # lists in many blocks
    rows = corpus(seed)
    assert classes(spark, rows) == brute(rows)


def test_lower_threshold_and_other_length(spark):
    rows = corpus(4, 90)
    assert classes(spark, rows, percent=70) == brute(rows, 70)


def test_chain_of_links(spark):
    """Neighbours in the chain are similar, its ends are not."""
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(25):
        words[i * 4] = f"x{i}"
        rows.append((100 + i, " ".join(words)))
    got = classes(spark, rows)
    assert got == brute(rows) and {g[2] for g in got} == {100}


def test_components_of_paths(spark):
    rng = random.Random(5)
    names = rng.sample(range(-(1 << 60), 1 << 60), 300)
    links = spark.createDataFrame([(names[i], names[i + 1]) for i in range(299) if i % 100 != 99], "a long, b long")
    out = {r.set: r.root for r in J.components(links).collect()}
    assert all(out[names[i]] == min(names[i // 100 * 100:i // 100 * 100 + 100]) for i in range(300))


def test_signatures_bound_the_difference(spark):
    rng = np.random.default_rng(1)
    pairs = []
    for n in (5, 250, 300, 700, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for keep in (0.95, 0.8):
            b = np.unique(np.concatenate([a[:int(keep * len(a))], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)]))
            pairs.append((J.signature(a), J.signature(b), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(pairs, "x array<long>, y array<long>, d int")
    for r in df.select("d", J.apart(F.col("x"), F.col("y")).alias("bits")).collect():
        assert r.bits <= r.d and (r.d - r.bits) % 2 == 0


def test_odd_documents(spark):
    rows = [*ODD, (9, "A b"), (10, "a B"), (11, "no id here")]
    assert classes(spark, rows) == brute(rows)
    assert J.jaccard_classes(docs(spark, rows).limit(0)).count() == 0
    assert classes(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_links_against_all_pairs(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(J, "BLOCK", 5)
    rows = [*corpus(seed), (900, None), (901, ""), (None, "no id here"), (902, "No id here")]
    sets = [shingles(t) for _, t in rows]
    linked = lambda x, y, both: both and 100 * both >= 90 * (len(x) + len(y) - both)
    want = [(k, sum(bool(i != j and linked(sets[i], t, len(sets[i] & t))) for j, t in enumerate(sets))) for i, (k, _) in enumerate(rows)]
    df = docs(spark, rows).repartition(3)
    assert sorted(map(tuple, J.link_counts(df).collect()), key=repr) == sorted(want, key=repr)
    joined = sorted((tuple(r) for r in J.jaccard_join(df).collect()), key=repr)
    assert sorted(((r[0], r[3]) for r in joined), key=repr) == sorted(want, key=repr)
    assert [r[:3] for r in joined] == sorted((tuple(r) for r in J.jaccard_classes(df).collect()), key=repr)
    distinct = sorted(set(sets), key=repr)
    links = J.jaccard_links(df).collect()
    assert len(links) == len(set(links)) == sum(bool(linked(x, y, len(x & y))) for i, x in enumerate(distinct) for y in distinct[:i])
    assert all(r.a < r.b for r in links)


def test_overlaps_of_all_pairs():
    rng = np.random.default_rng(3)
    for m, universe in ((2, 40), (30, 60), (60, 100_000)):
        sets = [np.unique(rng.integers(-universe, universe, rng.integers(1, 80))) for _ in range(m)]
        found = J.overlaps(sets)
        assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(m) for j in range(m) if i != j)


@pytest.mark.parametrize("pieces", [1, 7])
def test_links_of_a_large_family_are_no_rows(spark, pieces, monkeypatch):
    """Links of a family are counted per set: no table has a row per pair."""
    m, stored = 210, []
    monkeypatch.setattr(J, "PIECE", -(-m // pieces))
    keep = J.store
    monkeypatch.setattr(J, "store", lambda df, name: stored.append(keep(df, name)) or stored[-1])
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join([*base[:i % 290], f"x{i}", *base[i % 290 + 1:]]) for i in range(m)] + ["alone"]
    rows = [(i, texts[i % len(texts)]) for i in range(len(texts) + 3)]  # three equal texts
    got = {r.doc_id: r for r in J.jaccard_join(docs(spark, rows).repartition(3)).collect()}
    assert [got[i].n_links for i in range(len(rows))] == [0 if i == m else m + 2 for i in range(len(rows))]
    assert {r.component_id for r in got.values()} == {0, m}
    assert all(df.count() < m * (m - 1) / 4 for df in stored if {"a", "b"} <= set(df.columns))
