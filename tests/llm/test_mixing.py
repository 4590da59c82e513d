"""Source mix against a direct computation."""

import hashlib
import re

from pyspark.sql import functions as F

from evigrid.llm import mixing as M

from .odd import ODD, docs


def direct(rows):
    """(doc_id, size, source_size, target, taken) by sorting, one source at a time."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)) for i, t, s in rows]
    sources = sorted({r[1] for r in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[2] for r in sized if r[1] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    total, capped = sum(size.values()), set()
    while True:
        rest, w = total - sum(3 * size[s] for s in capped), sum(weight[s] for s in sources if s not in capped)
        more = {s for s in sources if s not in capped and 3 * size[s] * w < weight[s] * rest}
        if not more:
            break
        capped |= more
    target = {s: float(3 * size[s]) if s in capped else weight[s] * rest / w for s in sources}
    out = []
    for s in sources:
        copies = int(target[s] // size[s]) if size[s] else 0
        need, best = target[s] - copies * size[s], (0, -1)
        mine = sorted({r[3] for r in sized if r[1] == s})
        if need > 0:
            best = min(((abs(sum(r[2] for r in sized if r[1] == s and r[3] <= h) - need), k) for k, h in enumerate([-1, *mine])))
            best = (best[0], [-1, *mine][best[1]])
        out += [(r[0], r[2], size[s], target[s], r[2] * (copies + (r[3] <= best[1]))) for r in sized if r[1] == s]
    return sorted(out, key=repr)


def test_against_sorting(spark):
    rows = [(i, "word " * (i * 7 % 40), None if i % 11 == 0 else f"s{min(i % 13, 4)}") for i in range(400)]
    # one source so small that its target is cut, one hot
    rows += [(1000 + i, "w " * 3, "tiny") for i in range(3)] + [(2000 + i, "hot words here", "s0") for i in range(300)]
    df = docs(spark, [(i, t, "en", s) for i, t, s in rows])
    got = sorted((tuple(r) for r in M.mix(df).collect()), key=repr)
    want = direct(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 1e-6 for g, w in zip(got, want, strict=True))
    totals = {}
    for g in got:
        totals.setdefault(g[2:4], [0, 0])[0] += g[4]
        assert g[4] <= 3 * g[1]
    assert all(abs(t - key[1]) <= 40 for key, (t, _) in totals.items())
    assert sum(abs(g[4] - w[4]) for g, w in zip(got, want, strict=True)) == 0
    assert got == sorted((tuple(r) for r in M.mix(df.repartition(7)).collect()), key=repr)


def test_thresholds_are_nested(spark):
    df = docs(spark, [(i, "a b c", "en", "s") for i in range(200)])
    half = {r.doc_id for r in M.mix(df, share=0.5).where("taken > 0").collect()}
    more = {r.doc_id for r in M.mix(df, share=0.8).where("taken > 0").collect()}
    assert len(half) == 100 and len(more) == 160 and half < more


def test_odd_documents(spark):
    df = docs(spark, [(i, t, "en", None if k % 3 else "s") for k, (i, t) in enumerate(ODD)])
    mixed = M.mix(df)
    assert mixed.count() == len(ODD) and mixed.where("size = 0 AND taken <> 0").count() == 0
    rows = M.mixed_documents(df)
    assert rows.columns == df.columns
    assert rows.agg(F.sum(M.word_count(F.col("text")))).first()[0] == mixed.agg(F.sum("taken")).first()[0]
    assert M.mix(df.limit(0)).count() == M.mixed_documents(df.limit(0)).count() == 0
    assert {r.taken for r in M.mix(docs(spark, [(1, None), (2, "")])).collect()} == {0}
