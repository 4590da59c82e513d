"""Conversation structure repair by generalised LR parsing with weighted edits.

The role initials of a conversation have to be a sentence of C -> empty | P | s P; P -> Q | P Q; Q -> u a. The parser's stacks form a graph: a stack
is its top and the stack below, kept once. Before each row it may shift inserted roles, then it keeps, reroles or deletes the row;
parses that reach the same stack merge, the one with the least (cost, audit) stays. An audit names the edits in order, so two audits over the same
rows never contain one another and the order of extended audits follows from the order before and the new letters.

A conversation is no unit of work: rows are dealt by ranges of (conversation, turn), and each task parses what it has of a conversation from every
stack it may begin with, in pieces. The pieces give cost and audit from stack to stack and are joined like the rows before.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import store

# The parser's table. State -> role initial -> state; state -> (left side, length); (state, left side) -> state.
SHIFT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 6}, 3: {"u": 2}, 5: {"u": 2}}
REDUCE = {4: ("P", 1), 6: ("Q", 2), 7: ("P", 2)}
GOTO = {(0, "P"): 3, (0, "Q"): 4, (1, "P"): 5, (1, "Q"): 4, (3, "Q"): 7, (5, "Q"): 7}
ACCEPTED = {0, 3, 5}

# Costs, and the roles an edit may give.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}

#: Rows parsed in one piece.
PIECE = 4096
WHITE = " \t\n\x0b\x0c\r"

SEGMENT = ("conv_id {kind}, part int, piece int, opens boolean, closes boolean, n long, blank long, duplicate long, truncated long, illegal long, first string, "
           "last string, low_turn long, high_turn long, turns long, ways array<struct<start: int, stop: int, cost: long, audit: string>>")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Stack(NamedTuple):
    """A node of the graph: the top and what is below."""
    top: int
    below: Stack | None


class Parser(NamedTuple):
    """What the table gives for whole stacks, numbered from the empty one: next stack by role initial, fewest inserts to
    every stack that inserts reach, and fewest inserts to an accepted one."""
    following: list[dict[str, int]]
    inserts: list[dict[int, int]]
    ends: list[int]


def shifted(stack: Stack, token: str) -> Stack | None:
    """The stack after a token and all reductions, None where the table has no way."""
    to = SHIFT.get(stack.top, {}).get(token)
    if to is None:
        return None
    stack = Stack(to, stack)
    while stack.top in REDUCE:
        left, length = REDUCE[stack.top]
        for _ in range(length):
            stack = stack.below
        stack = Stack(GOTO[stack.top, left], stack)
    return stack


@cache
def parser() -> Parser:
    nodes, following = [Stack(0, None)], []
    for stack in nodes:  # grows as new stacks appear
        ways = {}
        for token in "sua":
            to = shifted(stack, token)
            if to is not None:
                if to not in nodes:
                    nodes.append(to)
                ways[token] = nodes.index(to)
        following.append(ways)
    inserts = []
    for k in range(len(nodes)):
        reached, edge = {k: 0}, [k]
        while edge:
            new = {following[x][t]: reached[x] + 1 for x in edge for t in ROLES if t in following[x]}
            edge = [x for x in new if x not in reached]
            reached |= {x: new[x] for x in edge}
        inserts.append(reached)
    ends = [min(n for x, n in reached.items() if nodes[x].top in ACCEPTED) for reached in inserts]
    return Parser(following, inserts, ends)


@cache
def options(token: str, forced: bool, cut: bool) -> list[list[tuple[int, int, str]]]:
    """For every stack (stack after, cost, letters) of a row with the inserts before it; ``forced``: it has to be deleted."""
    p, out = parser(), []
    for reached in p.inserts:
        best: dict[int, tuple[int, str]] = {}
        for x, n in reached.items():
            edits = [(x, DELETE, "D")]
            if not forced:
                edits += [(p.following[x][t], (CUT if cut else 0) + c, e) for t, c, e in ((token, 0, "K"), ("u", REROLE, "R"), ("a", REROLE, "R"))
                          if t in p.following[x]]
            for to, cost, letter in edits:
                value = cost + INSERT * n, "I" * n + letter
                best[to] = min(best.get(to, value), value)
        out.append([(to, cost, letters) for to, (cost, letters) in sorted(best.items())])
    return out


class Paths:
    """Cheapest parses from one stack to all others: per stack the cost and the place of its audit among the others' audits."""

    def __init__(self, start: int):
        self.start = start
        self.tops: dict[int, tuple[int, int]] = {start: (0, 0)}
        self.back: list[dict[int, tuple[int, str]]] = []

    def step(self, ways: list[list[tuple[int, int, str]]]) -> None:
        best: dict[int, tuple[int, int, str, int]] = {}
        for top, (cost, place) in self.tops.items():
            for to, more, letters in ways[top]:
                value = cost + more, place, letters, top
                if to not in best or value < best[to]:
                    best[to] = value
        order = {to: k for k, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
        self.tops = {to: (v[0], order[to]) for to, v in best.items()}
        self.back.append({to: (v[3], v[2]) for to, v in best.items()})

    def audit(self, top: int) -> str:
        letters = []
        for back in reversed(self.back):
            top, some = back[top]
            letters.append(some)
        return "".join(reversed(letters))

    def accepted(self) -> tuple[int, str]:
        """(cost, audit) of the best parse that ends here."""
        ends = parser().ends
        cost, _, n, top = min((cost + INSERT * ends[top], place, ends[top], top) for top, (cost, place) in self.tops.items())
        return cost, self.audit(top) + "I" * n


class Segment:
    """Counts and parses of consecutive rows of one conversation."""

    def __init__(self, conv, opens: bool):
        self.conv, self.opens = conv, opens
        self.paths = [Paths(k) for k in range(1 if opens else len(parser().following))]
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, token: str, fresh: bool, blank: bool, cut: bool) -> None:
        fault = "blank" if blank else "duplicate" if not fresh else "truncated" if cut else None
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.illegal += self.n > 0 and self.last + token not in LEGAL
        self.first, self.last, self.n = token if self.n == 0 else self.first, token, self.n + 1
        if turn is not None and turn != self.high:
            self.turns, self.high, self.low = self.turns + 1, turn, turn if self.low is None else self.low
        ways = options(token, fault in ("blank", "duplicate"), fault == "truncated")
        for path in self.paths:
            path.step(ways)

    def row(self, part: int, piece: int, closes: bool) -> dict:
        """``closes``: the conversation ends here, so only accepted parses count (stop -1)."""
        ways = []
        for path in self.paths:
            ends = [(-1, *path.accepted())] if closes else [(top, cost, path.audit(top)) for top, (cost, _) in sorted(path.tops.items())]
            ways += [{"start": path.start, "stop": stop, "cost": cost, "audit": audit} for stop, cost, audit in ends]
        return {"conv_id": self.conv, "part": part, "piece": piece, "opens": self.opens, "closes": closes, "n": self.n, "blank": self.blank,
                "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "first": self.first, "last": self.last,
                "low_turn": self.low, "high_turn": self.high, "turns": self.turns, "ways": ways}


def segments(rows: Iterator[dict], part: int) -> Iterator[dict]:
    """Segments of the sorted rows of one task. Its first conversation may have begun, its last one may go on elsewhere."""
    now, piece, begun = None, 0, False
    for r in rows:
        if now is None or r["conv_id"] != now.conv:
            if now is not None:
                yield now.row(part, piece, True)
            now, piece, begun = Segment(r["conv_id"], begun), 0, True
        for k in range(r["n"]):
            if now.n == PIECE:
                yield now.row(part, piece, False)
                now, piece = Segment(now.conv, False), piece + 1
            now.add(r["turn"], r["token"], r["fresh"] and k == 0, r["blank"], r["cut"])
    if now is not None:
        yield now.row(part, piece, False)


def joined(parts: list[dict]) -> dict:
    """Counts, cost and audit of a conversation from its segments in order."""
    out = dict.fromkeys((*COUNTS, "n", "turns"), 0)
    low = high = last = None
    paths = Paths(0)
    for s in parts:
        if not s["n"]:
            continue
        for name in ("blank", "duplicate", "truncated", "illegal", "n", "turns"):
            out[name] += s[name]
        out["illegal"] += last is not None and last + s["first"] not in LEGAL
        last = s["last"]
        if s["low_turn"] is not None:
            out["turns"] -= s["low_turn"] == high
            low, high = s["low_turn"] if low is None else low, s["high_turn"]
        ways: list[list[tuple[int, int, str]]] = [[] for _ in parser().following]
        for w in s["ways"]:
            ways[w["start"]].append((w["stop"], w["cost"], w["audit"]))
        paths.step(ways)
    out["gaps"] = high - low + 1 - out["turns"] if high is not None else 0
    if -1 in paths.tops:
        out["cost"], out["audit"] = paths.tops[-1][0], paths.audit(-1)
    else:
        out["cost"], out["audit"] = paths.accepted()
    return out


def faults(turns: DataFrame, key: str, turn: str, role: str, text: str, times: Column) -> DataFrame:
    """Rows of equal (conversation, turn, role, text) as one row: ``n`` of them, role initial ``token``, whether the first of them is
    ``fresh`` in its conversation, whether their text is ``blank`` or ``cut`` short. Texts stay behind, their digest stands for them."""
    said, who = F.coalesce(text, F.lit(" ")), F.coalesce(role, F.lit(" "))
    end = F.rtrim(said, F.lit(WHITE))
    rows = turns.select(F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.substring(who, 1, 1).alias("token"),
                        row_digest(who, said).alias("digest"), (F.length(end) == 0).alias("blank"),
                        (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("cut"), times.cast("long").alias("n"))
    groups = store(rows.groupBy("conv_id", "turn", "token", "digest", "blank", "cut").agg(F.sum("n").alias("n")), "repair-rows")
    # null turns come first
    begin = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("begin")
    seen = store(groups.where(F.col("n") > 0).groupBy("conv_id", "digest").agg(begin, F.count("*").alias("places")).where(F.col("places") > 1)
                 .select(F.col("conv_id").alias("c"), F.col("digest").alias("g"), "begin"), "repair-seen")
    later = groups.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("g")), "left")
    fresh = F.col("begin").isNull() | F.col("begin.turn").eqNullSafe(F.col("turn"))
    return later.select("conv_id", "turn", "token", "digest", fresh.alias("fresh"), "blank", "cut", "n")


def row_digest(role: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.length(role), role, text).cast("binary"), 256)


def order() -> list[Column]:
    return [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("token"), F.col("digest")]


def parse(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """One row per conversation: ``conv_id``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit`` of the
    cheapest repair. See ``repair``."""
    found = faults(turns, key, turn, F.col(role), F.col(text), F.lit(1) if times is None else times)
    ranges = found.repartitionByRange(*order()).sortWithinPartitions(*order()).withColumn("part", F.spark_partition_id())
    kind = turns.schema[key].dataType.simpleString()

    def parse_range(batches):
        import pyarrow as pa

        batches = filter(len, batches)
        head = next(batches, None)
        if head is None:
            return
        schema = segment_schema(head.schema.field("conv_id").type)
        held, size = [], 0
        for s in segments(listed(head, batches), head.column("part")[0].as_py()):
            held.append(s)
            size += s["n"] * len(s["ways"]) + 100
            if size > 1 << 22:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    found = store(ranges.select("conv_id", "turn", "token", "fresh", "blank", "cut", "n", "part").mapInArrow(parse_range, SEGMENT.format(kind=kind)), "repair-segments")
    # A conversation whose segments were all met in one task needs no meeting; the others have few segments per task.
    whole = F.col("opens") & F.col("closes")
    counts = [F.when(F.col("low_turn").isNull(), 0).otherwise(F.col("high_turn") - F.col("low_turn") + 1 - F.col("turns")).alias("gaps"),
              *COUNTS[1:5], F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit")]
    parts = (found.where(~whole).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("part", "piece", *[c for c in found.columns if c not in ("conv_id", "part", "piece")]))).alias("parts")))

    def join(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(batch.num_rows):  # one conversation at a time
                one = batch.slice(at, 1)
                row = joined(one.column("parts").to_pylist()[0])
                yield pa.RecordBatch.from_arrays([one.column("conv_id"), *(pa.array([row[c]], pa.int64()) for c in COUNTS), pa.array([row["audit"]])],
                                                 ["conv_id", *COUNTS, "audit"])

    rest = parts.mapInArrow(join, f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")
    return found.where(whole).select("conv_id", *counts).unionByName(rest)


def listed(head, rest) -> Iterator[dict]:
    """Rows of Arrow batches, a few at a time."""
    for batch in itertools.chain([head], rest):
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def segment_schema(ids):
    """The Arrow form of SEGMENT for a type of conversation ids."""
    import pyarrow as pa

    way = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    longs = [(c, pa.int64()) for c in ("n", "blank", "duplicate", "truncated", "illegal")]
    return pa.schema([("conv_id", ids), ("part", pa.int32()), ("piece", pa.int32()), ("opens", pa.bool_()), ("closes", pa.bool_()), *longs,
                      ("first", pa.string()), ("last", pa.string()), ("low_turn", pa.int64()), ("high_turn", pa.int64()), ("turns", pa.int64()),
                      ("ways", pa.list_(way))])


class Replay:
    """Applies an audit to the rows of one conversation: (edit, role, text) in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.top = audit, 0, 0

    def _role(self) -> str:
        following = parser().following[self.top]
        token = next(t for t in ROLES if t in following)
        self.top = following[token]
        return ROLES[token]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._role(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.top = parser().following[self.top][role[:1]]
        yield edit, self._role() if edit == "R" else role, text


def replayed(turns: DataFrame, audits: DataFrame, make, schema: str, key: str, turn: str, role: str, text: str, times: Column) -> DataFrame:
    """``make(rows, type of ids)`` over the rows of every conversation in order, its audit row first; rows stream through, none is held."""
    who, said = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    rows = turns.select(F.col(key).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.substring(who, 1, 1).alias("token"),
                        row_digest(who, said).alias("digest"), who.alias("role"), said.alias("text"), times.cast("int").alias("n")).where(F.col("n") > 0)
    head = audits.select("conv_id", F.struct(*COUNTS, "audit").alias("head"))
    both = rows.unionByName(head, allowMissingColumns=True)
    dealt = (both.repartition("conv_id")
             .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("head").isNull(), *order()[1:]))

    def stream(batches):
        head = next(batches, None)
        if head is not None:
            yield from make(listed(head, batches), head.schema.field("conv_id").type)

    return dealt.select("conv_id", "role", "text", "n", "head").mapInArrow(stream, schema)


def conversations(rows: Iterator[dict]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """(header, edits) of each conversation; its edits have to be read before the next one is asked for."""
    ahead = next(rows, None)

    def edits(header):
        nonlocal ahead
        replay = Replay(header["head"]["audit"])
        while (ahead := next(rows, None)) is not None and ahead["head"] is None:
            for _ in range(ahead["n"]):
                yield from replay.row(ahead["role"], ahead["text"])
        yield from replay.inserted()

    while ahead is not None:
        yield ahead, edits(ahead)


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """One row per conversation: ``conv_id``, ``gaps`` (missing turn numbers), ``blank``, ``duplicate``, ``truncated`` (rows by first
    fault), ``illegal`` (neighbours out of order), ``cost`` and ``audit`` of the cheapest repair (least audit on ties), ``repaired_sha256``.

    ``times`` says how often a row stands (default once); a conversation whose rows all stand 0 times has zeros, an empty audit and the
    hash of the empty string. Null roles and texts are one blank. Rows are taken by turn, nulls first; rows of one turn by role
    initial and digest, equal ones side by side. A null conversation is one conversation. Other columns are not read. The
    digest of a conversation's text is sequential by nature: its rows stream through one task, none is held. An empty table gives an empty result.
    """
    times = F.lit(1) if times is None else times
    audits = store(parse(turns, key, turn, role, text, times), "repair-audits")
    kind = turns.schema[key].dataType.simpleString()

    def digests(rows, ids):
        import pyarrow as pa

        schema = pa.schema([("conv_id", ids), *((c, pa.int64()) for c in COUNTS),
                            ("audit", pa.string()), ("repaired_sha256", pa.string())])
        held, size = [], 0
        for header, edits in conversations(rows):
            digest, between = hashlib.sha256(), b""
            for edit, who, said in edits:
                if edit != "D":
                    digest.update(between + f"{who}:{said}".encode())
                    between = b"\n"
            held.append({"conv_id": header["conv_id"], **header["head"], "repaired_sha256": digest.hexdigest()})
            size += len(header["head"]["audit"]) + 100
            if size > 1 << 20:
                yield pa.RecordBatch.from_pylist(held, schema)
                held, size = [], 0
        yield pa.RecordBatch.from_pylist(held, schema)

    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string, repaired_sha256 string"
    return replayed(turns, audits, digests, schema, key, turn, role, text, times).withColumnRenamed("conv_id", key)


def repaired_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: Column | None = None) -> DataFrame:
    """The repaired conversations: ``conv_id``, ``turn`` (counted from 0), ``role``, ``text``, ``edit`` (K, R or I)."""
    times = F.lit(1) if times is None else times
    audits = store(parse(turns, key, turn, role, text, times), "repair-audits")
    kind = turns.schema[key].dataType.simpleString()

    def lines(rows, ids):
        import pyarrow as pa

        schema = pa.schema([("conv_id", ids), ("turn", pa.int64()), ("role", pa.string()),
                            ("text", pa.string()), ("edit", pa.string())])
        held = []
        for header, edits in conversations(rows):
            place = 0
            for edit, who, said in edits:
                if edit != "D":
                    held.append({"conv_id": header["conv_id"], "turn": place, "role": who, "text": said, "edit": edit})
                    place += 1
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        yield pa.RecordBatch.from_pylist(held, schema)

    schema = f"conv_id {kind}, turn long, role string, text string, edit string"
    return replayed(turns, audits, lines, schema, key, turn, role, text, times).withColumnRenamed("conv_id", key)


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with the faults that a hash of conversation and turn gives them: ``key``, ``turn``, ``role``, ``text`` and ``times`` (0: dropped, 2: repeated)."""
    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(shown(key), F.lit(":"), shown(turn)).cast("binary")) % 20
    said = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown(text), "[.!?]", "")).otherwise(shown(text))
    return turns.select(F.col(key), F.col(turn), F.when(kind == 4, "user").otherwise(shown(role)).alias(role), said.alias(text),
                        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


#: The same rows in DuckDB: all conversations row by row over the states of an automaton.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT b::BIGINT AS v, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
one AS MATERIALIZED (SELECT v, c FROM bits WHERE k = 8),
far AS (
  SELECT v, c, 0::BIGINT AS d FROM one
  UNION ALL SELECT far.v, xor(far.c >> 8, one.c), d + 1 FROM far JOIN one ON one.v = far.c & 255 WHERE d < 50),
k0 AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS f FROM conversations),
k1 AS (SELECT f, strlen(f) AS l, unnest(range(strlen(f))) AS i, hex(encode(f)) AS x FROM k0),
crc AS MATERIALIZED (
  SELECT f, xor(xor(bit_xor(far.c), CASE l WHEN 1 THEN 16777215 WHEN 2 THEN 65535 WHEN 3 THEN 255 ELSE 0 END), 4294967295) % 20 AS kind
  FROM k1 JOIN far ON far.d = l - 1 - i AND far.v = xor(('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT, CASE WHEN i < 4 THEN 255 ELSE 0 END) GROUP BY f, l),
hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM conversations JOIN crc ON f = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')),
seq AS (SELECT *, substr(role, 1, 1) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 1),
               sha256(length(role)::VARCHAR || ':' || role || ':' || text), copy) AS i FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup, lead(t) OVER (PARTITION BY conv_id ORDER BY i) AS nxt FROM seq),
f AS MATERIALIZED (
  SELECT conv_id, i, turn, role, text, t, nxt, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, dup,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut FROM seen),
nx(st, t, r, q) AS (VALUES ('z', 's', '', 's'), ('z', 'u', 'user', 'u'), ('s', 'u', 'user', 'u'), ('u', 'a', 'assistant', 'a'), ('a', 'u', 'user', 'u')),
ins AS MATERIALIZED (
  SELECT st, st AS q, 0 AS n, ''::VARCHAR AS lines FROM (VALUES ('z'), ('s'), ('u'), ('a')) v(st)
  UNION ALL SELECT st, q, 1, chr(10) || r || ':' FROM nx WHERE r <> ''
  UNION ALL SELECT a.st, b.q, 2, chr(10) || a.r || ':' || chr(10) || b.r || ':' FROM nx a JOIN nx b ON b.st = a.q WHERE a.r <> '' AND b.r <> ''),
opt AS MATERIALIZED (
  SELECT st, q, 'any' AS t, 2 + 5 * n AS c, repeat('I', n) || 'D' AS e, lines, '' AS r FROM ins
  UNION ALL SELECT i.st, nx.q, nx.t, 5 * n, repeat('I', n) || 'K', lines, 'own' FROM ins i JOIN nx ON nx.st = i.q
  UNION ALL SELECT i.st, nx.q, 'good', 5 * n + 1, repeat('I', n) || 'R', lines, nx.r FROM ins i JOIN nx ON nx.st = i.q WHERE nx.r <> ''),
cur AS (
  SELECT conv_id, 0::BIGINT AS i, 'z' AS st, {'c': 0::BIGINT, 'a': '', 'o': ''} AS best FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT f.conv_id, f.i, opt.q, min({'c': best.c + opt.c + CASE WHEN r <> '' AND cut THEN 5 ELSE 0 END, 'a': best.a || e,
                                     'o': best.o || lines || CASE r WHEN '' THEN '' WHEN 'own' THEN chr(10) || role || ':' || text ELSE chr(10) || r || ':' || text END})
  FROM cur JOIN f ON f.conv_id IS NOT DISTINCT FROM cur.conv_id AND f.i = cur.i + 1
  JOIN opt ON opt.st = cur.st AND (opt.t = 'any' OR (NOT blank AND NOT dup AND (opt.t = 'good' OR opt.t = f.t)))
  GROUP BY f.conv_id, f.i, opt.q),
last AS (
  SELECT conv_id, min({'c': best.c + 5 * n, 'a': best.a || repeat('I', n), 'o': best.o || lines}) AS best
  FROM (SELECT *, max(i) OVER (PARTITION BY conv_id) AS top FROM cur) x JOIN ins ON ins.st = x.st AND (ins.q = 'a' OR (ins.q = 'z'))
  WHERE i = top GROUP BY conv_id),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND dup) AS duplicate, count(*) FILTER (NOT blank AND NOT dup AND cut) AS truncated,
         count(*) FILTER (nxt IS NOT NULL AND t || nxt NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c AS cost, best.a AS audit,
       sha256(substr(best.o, 2)) AS repaired_sha256
FROM last l LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM l.conv_id
"""
