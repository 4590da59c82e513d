"""Permutation index: exact where everything is reranked, recall elsewhere."""

import numpy as np
import pytest

from evigrid.llm import permutation_index as P

SCHEMA = "vec_id long, embedding array<float>, label int, score double, ids string"


def table(spark, ids, vectors):
    return spark.createDataFrame([(None if i is None else int(i), None if v is None else [None if x is None else float(x) for x in v], 0, 1.0, "x")
                                  for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def exact(ids, vectors, queries, k=10):
    out = {}
    v = np.asarray(vectors, np.float32).astype(float)
    for i in queries:
        d = np.sqrt(((v - v[list(ids).index(i)]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[i] = [(r + 1, int(ids[j]), float(d[j])) for r, j in enumerate(order)]
    return out


def search(df, queries, **options):
    index, pivots = P.build(df)
    out = {}
    for r in P.search(index, pivots, queries, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    ids, v = np.arange(60), rng.normal(size=(60, 8))
    v[10:30] = v[10]  # ties go to the smaller id
    df = table(spark, ids, v)
    got, want = search(df, df.where("vec_id % 10 = 0")), exact(ids, v, range(0, 60, 10))
    assert got.keys() == want.keys()
    for q in want:
        assert [g[:2] for g in got[q]] == [w[:2] for w in want[q]] and np.allclose([g[2] for g in got[q]], [w[2] for w in want[q]])


@pytest.mark.parametrize("at_once", [4096, 7])
def test_recall(spark, at_once):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 64)) * 0.3
    ids, v = np.arange(3000), (centres[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 64)))
    v[500:1500] = v[500]  # a very common vector
    df = table(spark, ids, v)
    got, want = search(df, df.where("vec_id % 100 = 0"), at_once=at_once), exact(ids, v, range(0, 3000, 100))
    hits = sum(len({g[1] for g in got[q]} & {w[1] for w in want[q]}) for q in want)
    assert hits >= 0.9 * 10 * len(want)
    assert [g[1] for g in got[500]] == list(range(501, 511))


def test_footrule_of_postings():
    """The gain read from the files orders rows as the footrule distance of the truncated orders does."""
    rng = np.random.default_rng(3)
    pivots, v = rng.normal(size=(20, 5)), rng.normal(size=(50, 5))
    order, length = P.orders(v, pivots, 6), 6
    place = np.full((50, 20), length)
    np.put_along_axis(place, order, np.arange(length)[None, :].repeat(50, 0), 1)
    far = np.abs(place - place[0]).sum(axis=1)
    gain = np.array([sum(min(length - list(order[0]).index(p), length - list(o).index(p)) for p in set(o) & set(order[0])) for o in order])
    assert len(set((far + 2 * gain).tolist())) == 1


def test_odd_vectors(spark):
    bad = [None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [], [1, 2, 3]]
    df = table(spark, [0, 1, 2, 2, None, *range(10, 17)], [[1, 1], [1, 2], [5, 5], [2, 2], [1, 1], *bad])
    got = search(df, df)
    assert got[0] == [(1, 1, 1.0), (2, 2, pytest.approx(2 ** 0.5))] and set(got) == {0, 1, 2}
    assert search(df.limit(0), df.limit(0)) == {} and search(df, df.limit(0)) == {}
    assert search(df.where("vec_id = 0"), df.where("vec_id = 0")) == {}


def test_result_and_recall_under_any_partitioning(spark):
    """The same rows in other partitions and blocks: the same result, and at least nine in ten of the true neighbours."""
    rng = np.random.default_rng(4)
    for n in (2500, 9000):
        centres = rng.normal(size=(10, 64)) * 0.3
        ids, v = np.arange(n), (centres[rng.integers(0, 10, n)] + rng.normal(size=(n, 64)))
        df = table(spark, ids, v)
        asked = df.where("vec_id % 100 = 0")
        results = []
        for rows, block in ((df, 2048), (df.repartition(7, "vec_id"), 300)):
            index, frame = P.build(rows, block=block)
            results.append(sorted(map(tuple, P.search(index, frame, asked).collect())))
        assert results[0] == results[1] and frame.rows == n
        want = exact(ids, v, range(0, n, 100))
        found = {q: {r[2] for r in results[0] if r[0] == q} for q in want}
        assert sum(len(found[q] & {w[1] for w in want[q]}) for q in want) >= 0.9 * 10 * len(want)
