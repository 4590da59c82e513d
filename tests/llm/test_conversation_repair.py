"""Conversation repair against a search over all edits."""

import functools
import hashlib
import random
import re
import zlib

from hypothesis import given, settings, strategies as st

from evigrid.llm import conversation_repair as R

FOLLOWS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    """(role, text, fault) by the rules, rows in order."""
    seen, out = set(), []
    for role, text in rows:
        ink = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def best(rows):
    """(cost, audit, lines): the best way on from every row and state, last row first."""
    @functools.cache
    def on(i, state, inserts=0):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 4:
            ways += [join(5, "I", (f"{NAMES[t]}:",), on(i, FOLLOWS[state, t], inserts + 1)) for t in "ua" if (state, t) in FOLLOWS]
        if i < len(rows):
            role, text, fault = rows[i]
            ways.append(join(2, "D", (), on(i + 1, state)))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault else 0
                if (state, role[:1]) in FOLLOWS:
                    ways.append(join(extra, "K", (f"{role}:{text}",), on(i + 1, FOLLOWS[state, role[:1]])))
                ways += [join(extra + 1, "R", (f"{NAMES[t]}:{text}",), on(i + 1, FOLLOWS[state, t])) for t in "ua" if (state, t) in FOLLOWS]
        return min(ways, default=(10**9, "", ()))

    def join(cost, letter, lines, rest):
        return cost + rest[0], letter + rest[1], lines + rest[2]

    return on(0, "")


def direct(rows):
    """The row of a conversation from its (turn, role, text) in order."""
    found = faults([r[1:] for r in rows])
    cost, audit, lines = best(tuple(found))
    turns = [r[0] for r in rows if r[0] is not None]
    count = [sum(f[2] == name for f in found) for name in ("blank", "duplicate", "truncated")]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def placed(rows):
    """Rows (turn, role, text) in the operator's order."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1][:1], hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).hexdigest()))


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, digest string")


said = st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", " "]), st.sampled_from(["Hi.", "Oh!", "cut", " ", "", "x?\n"]))


@settings(max_examples=250, deadline=None)
@given(st.lists(said, max_size=9), st.lists(st.integers(0, 9), max_size=4), st.integers(1, 4))
def test_segments_and_their_joining(rows, cuts, piece):
    """A conversation cut anywhere into tasks and pieces gives what the search gives."""
    found, seen, stream = faults(rows), set(), []
    for k, (role, text, fault) in enumerate(found):
        stream.append({"conv_id": 1, "turn": k, "token": role[:1], "fresh": (role, text) not in seen, "blank": fault == "blank",
                       "cut": not text.rstrip().endswith((".", "!", "?")), "n": 1})
        seen.add((role, text))
    places = [0, *sorted(c for c in cuts if c < len(rows)), len(rows)]
    old, R.PIECE = R.PIECE, piece
    try:
        parts = [s for part, (a, b) in enumerate(zip(places, places[1:])) for s in R.segments(iter(stream[a:b]), part)]
    finally:
        R.PIECE = old
    got = R.joined(parts)
    want = direct([(k, *r) for k, r in enumerate(rows)])
    assert (got["gaps"], got["blank"], got["duplicate"], got["truncated"], got["illegal"], got["cost"], got["audit"]) == want[:7]


def test_stacks_of_the_grammar():
    p = R.parser()
    for sentence, good in {"": 1, "ua": 1, "sua": 1, "suaua": 1, "s": 0, "u": 0, "uau": 0}.items():
        at = 0
        for t in sentence:
            at = p.following[at][t]
        assert (p.ends[at] == 0) == bool(good)
    assert "s" not in p.following[p.following[0]["s"]] and len(p.following) == 8


def rows_of(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_against_search(spark):
    rng = random.Random(3)
    texts = ["Hello there.", "Fine!", "no end", "  ", None, "Why?", "Fine! ", "\x1c"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "assistant", None, "tool"]), rng.choice(texts)) for c in range(60) for t in rng.sample(range(12), rng.randrange(1, 9))]
    rows += [(None, None, "user", "No ids."), (None, 3, "assistant", "None."), (70, None, "user", "A."), (70, None, "user", "A."), (70, 0, "assistant", "B.")]
    rows += [(71, 1, "user", "Same turn.")] * 3 + [(71, 1, "assistant", "Same turn.")] * 2
    want = {c: direct(placed(rs)) for c, rs in damaged(rows).items()}
    assert rows_of(R.repair(R.damage(table(spark, rows)), times=R.F.col("times"))) == want
    none = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    lost = rows_of(R.repair(R.damage(table(spark, [(none, 0, "user", "gone.")])), times=R.F.col("times")))
    assert lost == {none: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_hot_conversation_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 40)
    rng = random.Random(4)
    rows = [(5, t, rng.choice(["user", "assistant"]), f"{rng.randrange(150)} said{rng.choice('.!?,')}") for t in range(400)]
    rows += [(5, 500, "user", "again and again.")] * 100 + [(c, t, "ua"[t % 2] + "x", "ok.") for c in (1, 9) for t in range(3)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = table(spark, rows)
        got = rows_of(R.repair(df))
        convs = {}
        for c, *r in rows:
            convs.setdefault(c, []).append(tuple(r))
        import sys
        sys.setrecursionlimit(20_000)
        assert got == {c: direct(placed(rs)) for c, rs in convs.items()}
        turns = R.repaired_turns(df).where("conv_id = 5").orderBy("turn").collect()
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in turns).encode()).hexdigest() == got[5][7]
        assert [r.turn for r in turns] == list(range(len(turns))) and "".join(r.edit for r in turns) == got[5][6].replace("D", "")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_odd_tables(spark):
    df = table(spark, [(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "é\U0001f600."), (2, 0, None, None), (2, 0, None, None)])
    got = rows_of(R.repair(df))
    assert got[1][:6] == (0, 0, 0, 0, 0, 0) and got[2][1] == 2 and got[2][6] == "DD"
    assert R.repair(df.limit(0)).count() == 0 and R.repaired_turns(df.limit(0)).count() == 0
    assert R.repair(df.withColumn("conv_id", R.F.col("conv_id").cast("string"))).count() == 2
