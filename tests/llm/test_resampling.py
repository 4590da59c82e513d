"""Importance resampling against a direct computation, CRCs against zlib."""

import hashlib
import math
import re
import zlib

import numpy as np
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from evigrid.llm import resampling as R

from .odd import ODD, docs


def features(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def direct(rows, target, percent=5, least=20, buckets=10_000):
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in features(text)[1]:
                side[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for i, text in rows:
        words, fs = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(min_size=1, max_size=90).map(lambda b: b.hex().encode()), max_size=12), max_size=5), st.integers(1, 9))
def test_crcs_of_substrings(texts, chunk):
    ends = np.concatenate([R.running_crcs(w) for w in texts]) if texts else np.empty(0, np.uint32)
    sizes = np.array([len(x) for w in texts for x in w], np.uint32)
    doc = np.repeat(np.arange(len(texts)), list(map(len, texts)))
    got = sorted((int(c), int(d)) for crc, ds in R.feature_crcs(ends, sizes, doc, 3, chunk) for c, d in zip(crc, ds, strict=True))
    assert got == sorted((zlib.crc32(b" ".join(w[i:i + n])), k) for k, w in enumerate(texts) for n in (1, 2, 3) for i in range(len(w) - n + 1))


def test_long_words_and_moves():
    crc = np.array([0x12345678, 0xFFFFFFFF, 0], np.uint32)
    for length in (0, 1, 63, 64, 65, 1000, 123_457):
        tail = b"q" * length
        both = [zlib.crc32(tail, zlib.crc32(x)) for x in (b"a", b"bc", b"")]
        moved = R.shifted(np.array([zlib.crc32(x) for x in (b"a", b"bc", b"")], np.uint32), np.full(3, length))
        assert [int(m) ^ zlib.crc32(tail) for m in moved] == both
    assert R.shifted(crc, np.zeros(3, np.int64)).tolist() == crc.tolist()


def test_against_direct(spark):
    rows = [(i, " ".join(f"W{(i * 7 + k * k) % 61},é{k % 5}" for k in range(i % 47))) for i in range(300)]
    rows += [(900 + i, "the same text again and again " * 9) for i in range(200)]
    target = ["w1 é1 w2 é2 the same text", None, "", "w5,é0 again"]
    df, items = docs(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = rows_of(R.resample(df, items))
    assert got == direct(rows, target) and sum(r[4] is not None for r in got) > 10
    assert got == rows_of(R.resample(df.repartition(9), items))
    drawn = R.drawn_documents(df, items)
    assert drawn.columns == df.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r in got if r[4] is not None}


def test_hot_id_and_ties(spark):
    rows = [(7, "one two three four five " * 5)] * 300 + [(None, "one two three four five " * 5)] * 20 + [(i, "x y " * 15) for i in range(100, 180)]
    got = rows_of(R.resample(docs(spark, rows), docs(spark, [(1, "one two three")])))
    assert got == direct(rows, ["one two three"])
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 21))


def test_odd_documents(spark):
    df = docs(spark, ODD)
    assert rows_of(R.resample(df, df)) == direct(ODD, [t for _, t in ODD])
    assert rows_of(R.resample(df, df.limit(0))) == direct(ODD, [])
    assert R.resample(df.limit(0), df).count() == 0
    assert R.resample(df, df).schema.simpleString() == "struct<doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint>"
    assert R.drawn_documents(df.limit(0), df).agg(F.count("*")).first()[0] == 0
