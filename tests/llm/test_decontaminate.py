"""Decontamination against windows compared one by one."""

import hashlib
import re

from hypothesis import given, settings, strategies as st

from evigrid.llm import decontaminate as D

from .odd import ODD, docs


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def windows(ws, n=10):
    n = min(n, len(ws))
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)} if n else set()


def direct(text, items, n=10):
    ws, hit, found = words(text), set(), set()
    for key, item in items:
        for w in windows(words(item), n):
            for i in range(len(ws) - len(w) + 1):
                if tuple(ws[i:i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add("" if key is None else str(key))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def table(spark, items):
    return spark.createDataFrame([(k, t, 1, "x") for k, t in items], "item_id long, text string, hits int, row string")


few = st.lists(st.sampled_from("abc"), max_size=12)


@settings(max_examples=300, deadline=None)
@given(st.lists(few, max_size=6), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 5))
def test_automaton(pieces, text, n):
    automaton = D.Automaton([(k, [w.encode() for w in p]) for k, p in enumerate(pieces)], n)
    spans, found = automaton.match([w.encode() for w in text])
    want = direct(" ".join(text), [(k, " ".join(p)) for k, p in enumerate(pieces)], n)
    assert sum(b - a + 1 for a, b in spans) == want[1] and len(found) == want[2]
    assert hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest() == want[3]
    assert all(x[1] + 1 < y[0] for x, y in zip(spans, spans[1:]))


ITEMS = [(1, " ".join(f"w{i}" for i in range(25))), (10, "Short item, here"), (2, None), (3, "..."), (None, "q " * 9 + "z"), (4, " ".join(f"w{i}" for i in range(5, 30))),
         (4, "another text of item four with more than ten words in it all"), (5, " ".join(f"w{i}" for i in range(25)))]
TEXTS = [(1, "before " + " ".join(f"W{i}" for i in range(3, 14)) + ", after"), (2, " ".join(f"w{i}" for i in range(9))), (3, "a SHORT-item here"), (4, "q " * 30 + "z"),
         (5, " ".join(f"w{i}" for i in range(30)) + " short item here another text of item four with more than ten words in it all")]


def test_against_windows(spark):
    rows = TEXTS + ODD
    for block in (1_000_000, 30):
        got = sorted((tuple(r) for r in D.report(docs(spark, rows), table(spark, ITEMS), block_words=block).collect()), key=repr)
        assert got == sorted(((i, *direct(t, ITEMS)) for i, t in rows), key=repr)


def test_long_items_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE", 7)
    long = [(1, " ".join(f"w{i}" for i in range(100)))]
    rows = [(i, " ".join(f"w{k}" for k in range(i, i + 10))) for i in range(95)]
    got = {r.doc_id: r.n_hit for r in D.report(docs(spark, rows), table(spark, long)).collect()}
    assert got == {i: 10 if i <= 90 else 0 for i in range(95)}


def test_clean(spark):
    df = docs(spark, TEXTS)
    rows = {r.doc_id: r.text for r in D.clean(df, table(spark, ITEMS), coverage=0.9).collect()}
    assert D.clean(df, table(spark, ITEMS)).columns == df.columns
    assert rows[1] == "before , after" and rows[2] == TEXTS[1][1] and rows[3] == "a " and rows[4] == "q " * 21 and 5 not in rows
    kept = {r.doc_id: r.text for r in D.clean(df, table(spark, ITEMS), coverage=1.0, longest=3).collect()}
    assert kept[3] == "a SHORT-item here" and kept[5].strip() == ""


def test_empty_tables(spark):
    df, items = docs(spark, ODD), table(spark, ITEMS)
    assert D.report(df.limit(0), items).count() == 0
    none = D.report(df, items.limit(0)).collect()
    assert len(none) == len(ODD) and not any(r.contaminated for r in none) and {r.n_words for r in none if r.doc_id == 6} == {15_000}
    assert D.clean(df, items.limit(0)).count() == len(ODD)
