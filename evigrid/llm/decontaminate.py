"""Benchmark decontamination with a generalised suffix automaton of normalised test items.

The items' words feed one automaton (of every block of items); a document's words stream through it, and at each word the state
tells the longest run of words ending there that occurs in an item. Runs of at least a window are hits: every window inside them is a window of
an item. The state of the run's last window names the items. Spans beyond a length and documents beyond a coverage are removed.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from .common import slices, store, worker_memory
from .resampling import words_of

# What is a word once A-Z are lower-cased, in Spark's and Python's notation.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IN_TEXT = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Windows of an item that stay together; longer items are cut with an overlap, so that no window is lost.
PIECE = 10_000


class Automaton:
    """All runs of words of the given pieces. Most states have one way on, kept in two arrays; the others have a table."""

    def __init__(self, pieces: Iterable[tuple[int, list[bytes]]], window: int):
        self.window, self.vocabulary = window, {}
        self.link, self.length = array("q", [-1]), array("q", [0])
        self.word, self.to = array("q", [-1]), array("q", [0])
        self.ways: dict[int, dict[int, int]] = {0: {}}
        kept = []
        for item, words in pieces:
            if words:
                ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
                kept.append((item, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        #: items of the windows in a state; (length, item) of whole items shorter than a window
        self.items: dict[int, set[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        for item, ids in kept:
            if len(ids) < window:
                state = self._state(ids)
                if (len(ids), item) not in self.short.setdefault(state, []):
                    self.short[state].append((len(ids), item))
                continue
            state = length = 0
            for w in ids:
                state, length = self.step(state, length, w)
                if length >= window:
                    self.items.setdefault(self._last_window(state), set()).add(item)
        self.least = min((m for marks in self.short.values() for m, _ in marks), default=window)

    def _way(self, state: int, w: int) -> int:
        """The next state, 0 for none."""
        if self.word[state] == w:
            return self.to[state]
        ways = self.ways.get(state)
        return ways.get(w, 0) if ways else 0

    def _set(self, state: int, w: int, to: int) -> None:
        if self.word[state] == w or (self.word[state] < 0 and state):
            self.word[state], self.to[state] = w, to
        else:
            self.ways.setdefault(state, {})[w] = to

    def _add(self, length: int, link: int, like: int | None = None) -> int:
        state = len(self.length)
        self.length.append(length)
        self.link.append(link)
        self.word.append(-1 if like is None else self.word[like])
        self.to.append(0 if like is None else self.to[like])
        if like in self.ways:
            self.ways[state] = dict(self.ways[like])
        return state

    def _split(self, p: int, w: int, q: int) -> int:
        """The state of the runs of ``q`` that are one word longer than those of ``p``."""
        if self.length[p] + 1 == self.length[q]:
            return q
        clone = self._add(self.length[p] + 1, self.link[q], q)
        while p >= 0 and self._way(p, w) == q:
            self._set(p, w, clone)
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, w: int) -> int:
        if q := self._way(last, w):  # the run occurs in an earlier piece
            return self._split(last, w, q)
        new, p = self._add(self.length[last] + 1, 0), last
        while p >= 0 and not self._way(p, w):
            self._set(p, w, new)
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self._way(p, w))
        return new

    def _state(self, ids: list[int]) -> int:
        state = 0
        for w in ids:
            state = self._way(state, w)
        return state

    def step(self, state: int, length: int, w: int) -> tuple[int, int]:
        """State and length of the longest run that ends with ``w``."""
        while not (to := self._way(state, w)):
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.length[state]
        return to, length + 1

    def _last_window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit words as (first, last) runs, neither overlapping nor adjacent, and the items whose windows occur."""
        ids = list(map(self.vocabulary.get, words))
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        word, to, ways, link, lengths, least, window, short = (
            self.word, self.to, self.ways, self.link, self.length, self.least, self.window, self.short)
        root = ways[0]
        state = length = 0
        for i, w in enumerate(ids):
            if w is None:
                state = length = 0
                continue
            while state:
                if word[state] == w:
                    state = to[state]
                    length += 1
                    break
                if state in ways and w in ways[state]:
                    state = ways[state][w]
                    length += 1
                    break
                state = link[state]
                length = lengths[state]
            else:
                state = root.get(w, 0)
                length = 1 if state else 0
            if length < least:
                continue
            start = i + 1
            if length >= window:
                start = i - length + 1
                if state not in seen:
                    seen.add(state)
                    found |= self.items[self._last_window(state)]
            if short:
                at = state
                while at > 0:
                    for m, item in short.get(at, ()):
                        if m <= length:
                            found.add(item)
                            start = min(start, i - m + 1)
                    at = link[at]
            if start <= i:
                while spans and spans[-1][1] >= start - 1:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, found


def words_column(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def item_blocks(items: DataFrame, window: int, key: str, text: str, block_words: int) -> Iterator[tuple[list[str], list[tuple[int, list[bytes]]]]]:
    """Item ids and pieces (number of the id, words), at most ``block_words`` + one piece of words at a time on the driver."""
    words = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), words_column(F.col(text)).alias("w")).where(F.size("w") > 0)
    cut = F.when(F.size("w") < window + PIECE, F.array("w")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size("w") - window, F.lit(PIECE)), lambda i: F.slice("w", i + 1, F.lit(PIECE + window - 1))))
    ids: dict[str, int] = {}
    pieces: list[tuple[int, list[bytes]]] = []
    held = 0
    for r in store(words.select("id", F.explode(cut).alias("w")), "leak-items").toLocalIterator():
        pieces.append((ids.setdefault(r["id"], len(ids)), [w.encode() for w in r["w"]]))
        held += len(r["w"])
        if held >= block_words:
            yield list(ids), pieces
            ids, pieces, held = {}, [], 0
    if pieces:
        yield list(ids), pieces


def kept_automaton(name: str, block: Broadcast, window: int) -> Automaton:
    """The automaton of a block, built once in a worker; an earlier block's makes room."""
    memory = worker_memory("decontaminate", dict)
    if name not in memory:
        memory.clear()
        memory[name] = Automaton(block.value[1], window)
    return memory[name]


def merged(one: list[tuple[int, int]], two: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(one + two):
        if out and out[-1][1] >= first - 1:
            out[-1] = out[-1][0], max(out[-1][1], last)
        else:
            out.append((first, last))
    return out


def passed(rows: DataFrame, block: tuple[list[str], list[tuple[int, list[bytes]]]], window: int) -> DataFrame:
    """``rows`` (row, text, n_words, hits, items) with the hits and items of one block added."""
    sent = rows.sparkSession.sparkContext.broadcast(block)  # bounded by block_words
    name = hashlib.sha256(repr((window, block)).encode()).hexdigest()

    def stream(batches):
        import pyarrow as pa

        automaton, ids = kept_automaton(name, sent, window), sent.value[0]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in slices(batches):
            counts, hits, items = [], [], []
            old_hits, old_items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            for text, h, known in zip(batch.column("text").cast(pa.binary()).to_pylist(), old_hits, old_items, strict=True):
                words = words_of(text)
                spans, found = automaton.match(words)
                counts.append(len(words))
                hits.append([{"first": a, "last": b} for a, b in (merged([(x["first"], x["last"]) for x in h], spans) if h else spans)])
                items.append(sorted({*known, *(ids[k] for k in found)}))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(counts, pa.int64()), pa.array(hits, kind),
                                              pa.array(items, pa.list_(pa.string()))], ["row", "text", "n_words", "hits", "items"])

    return rows.mapInArrow(stream, rows.schema)


def find(docs: DataFrame, items: DataFrame, window: int = 10, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", carry: bool = True, block_words: int = 1_000_000) -> DataFrame:
    """Every document as ``row`` (its columns; without ``carry`` its key alone), ``text``, ``n_words``, ``hits`` (runs of hit
    words, counted from 0, merged where they touch) and ``items`` (ids of the items with an occurring window, as strings, sorted).

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Null and empty texts have no
    words and no hits; an item without words has no window; a null item id is the empty string and rows with the same
    item id are one item. Repeated documents and null keys stay. Items are taken in blocks of about ``block_words`` words, one pass over
    the documents each, so neither driver nor worker ever holds more than one block. Texts of any length are streamed whole.
    """
    rows = docs.select(F.struct("*" if carry else F.col(key)).alias("row"), F.col(text).alias("text"), F.lit(0).cast("long").alias("n_words"),
                       F.expr("cast(array() as array<struct<first: int, last: int>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    done = None
    for block in item_blocks(items, window, item_key, item_text, block_words):
        done = passed(store(done, "leak-pass") if done is not None else rows, block, window)
    return done if done is not None else rows.withColumn("n_words", F.size(words_column(F.col("text"))).cast("long"))


def hit_words() -> Column:
    """Number of hit words of a row of ``find``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + (h["last"] - h["first"] + 1))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, longest: int = 0, coverage: float = 0.5, text: str = "text", **options) -> DataFrame:
    """The documents without what they share with the items, in the columns of ``docs``.

    Spans of more than ``longest`` hit words are cut out of the text, from the first character of their first word to
    the last of their last one; documents with more than ``coverage`` of their words hit are left out.
    """
    found = find(docs, items, window, text=text, **options).where(hit_words() <= coverage * F.col("n_words"))

    def cut(batches):
        import pyarrow as pa

        for batch in slices(batches):
            texts = []
            for t, hits in zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True):
                hits = [h for h in hits if h["last"] - h["first"] >= longest]
                if hits:
                    places, parts, at = [m.span() for m in IN_TEXT.finditer(t)], [], 0
                    for h in hits:
                        parts.append(t[at:places[h["first"]][0]])
                        at = places[h["last"]][1]
                    t = "".join([*parts, t[at:]])
                texts.append(t)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    kept = found.select("row", "text", "hits")
    cleaned = kept.mapInArrow(cut, kept.drop("hits").schema)
    return cleaned.select(*(F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per document: ``key``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256`` (ids joined by commas), ``contaminated``."""
    rows = find(docs, items, key=key, carry=False, **options)
    return rows.select(F.col("row")[key].alias(key), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


#: The same rows in DuckDB: windows joined as texts.
ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS k FROM b WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS f FROM i),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d),
hit AS MATERIALIZED (SELECT r, k, n, item_id FROM (SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS f FROM p, (SELECT DISTINCT n FROM win) s WHERE k + n - 1 <= len(w)) x JOIN win USING (n, f)),
h AS (SELECT r, count(DISTINCT k + o) AS n_hit FROM hit, range(10) t(o) WHERE o < n GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
