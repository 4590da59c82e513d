"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a word form a linked list; a heap holds its adjacent pairs by merge rank. The lowest
rank (leftmost on ties) is merged until no ranked pair is left, so the number of tokens is the number of
initial symbols less the number of merges; identifiers are never emitted.
"""

from __future__ import annotations

import heapq
import json

import regex
from pyspark.sql import DataFrame

from .common import worker_memory

#: Words whose counts one worker remembers, and their longest length in characters; a full memory is emptied, which changes no result.
REMEMBERED, LONGEST = 1_000_000, 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    shifted = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [shifted.get(b, chr(b)) for b in range(256)]


class MergeCounter:
    """Counts tokens of whole texts under a byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, definition: bytes, pattern: str):
        spec = json.loads(definition)
        model, vocab = spec["model"], spec["model"]["vocab"]
        special = spec.get("added_tokens") or []
        if (model["type"] != "BPE" or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges")
                or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special)):
            raise ValueError("not a plain byte-level BPE file")
        self.start = [vocab[s] for s in byte_symbols()]
        # (left, right) packed into one number -> rank; rank -> merged symbol
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] << 32 | vocab[right]] = rank
            self.made.append(vocab[left + right])
        names = sorted((t["content"] for t in special if t["content"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.words = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def merges(self, data: bytes) -> int:
        """How many merges the heap makes in one word."""
        ids, n, get, made = [self.start[b] for b in data], len(data), self.ranks.get, self.made
        # A heap entry is rank * n + position: the lowest rank first, then the leftmost.
        heap = [rank * n + i for i in range(n - 1) if (rank := get(ids[i] << 32 | ids[i + 1])) is not None]
        if not heap:
            return 0
        heapq.heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            if j == n or ids[i] < 0 or get(ids[i] << 32 | ids[j]) != rank:
                continue  # one of the two was merged meanwhile
            merges += 1
            ids[i], ids[j], after[i] = made[rank], -1, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (rank := get(ids[i] << 32 | ids[k])) is not None:
                    heapq.heappush(heap, rank * n + i)
            if (k := before[i]) >= 0 and (rank := get(ids[k] << 32 | ids[i])) is not None:
                heapq.heappush(heap, rank * n + k)
        return merges

    def word(self, word: str) -> int:
        data = word.encode()
        count = len(data) - self.merges(data) if len(data) > 1 else len(data)
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[word] = count
        return count

    def count(self, text: str) -> int:
        """Tokens of a text; each special string in it is one token, as the library has it by default."""
        parts = self.special.split(text) if self.special else [text]
        total, known = len(parts) - 1, self.known
        for part in parts:
            for word in self.words.findall(part):
                total += known.get(word) or self.word(word)
        return total


def token_counts(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None, limit: int = 512,
                 key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``vocabulary`` is a byte-level BPE ``.json`` (default ``byte_bpe_50k.json``), read on the driver and
    sent to the tasks (1.6 MB). Null and empty texts have 0 bytes and 0 tokens; repeated rows and
    null keys stay as they are; other columns are not read, whatever their names. Texts of any length are
    counted whole; one word of n bytes takes O(n log n) steps.
    """
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    with open(vocabulary, "rb") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    pattern = pattern or public_tokenizers.PATTERN

    def count(batches):
        import pyarrow as pa

        counter = worker_memory(f"count {vocabulary} {pattern}", lambda: MergeCounter(definition.value, pattern))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array([n > limit for n in tokens], pa.bool_())], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
