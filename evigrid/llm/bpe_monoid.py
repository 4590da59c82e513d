"""Byte-level BPE encoding and decoding by monoid tree reduction.

A word is halved until its pieces are short; encodings of neighbours are joined up the tree. A join
re-encodes a window around the boundary and widens it until the window's first and last tokens come out
as they were: a token sequence is the encoding of its bytes exactly if every adjacent pair of it is the encoding
of its own bytes, so nothing outside the window can change. Decoding is the plain monoid: concatenation.
"""

from __future__ import annotations

import base64
import hashlib

import regex
from pyspark.sql import DataFrame

from .common import slices, worker_memory

#: Pieces of at most so many bytes are merged directly; windows below it need no tree either.
LEAF = 24
#: Words whose ids one worker remembers, half of them in each of two generations, and their longest length in characters.
REMEMBERED, LONGEST = 150_000, 64


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank of a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class TreeCodec:
    """Encodes and decodes texts under a rank file, each match of the pattern on its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.words = ranks, regex.compile(pattern)
        self.tokens = {i: t for t, i in ranks.items()}
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def leaf(self, data: bytes) -> list[bytes]:
        """Direct merging of a short piece: again and again the lowest-ranked adjacent pair, leftmost first."""
        get, none = self.ranks.get, 1 << 40
        parts = [data[i:i + 1] for i in range(len(data))]
        pairs = [get(data[i:i + 2], none) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) < none:
            at = pairs.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
        return parts

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of two neighbours from their encodings. Changes ``left``."""
        if not left or not right:
            return left or right
        reach = 2
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = b"".join(left[i:]) + b"".join(right[:j])
            new = self.leaf(window) if len(window) <= 2 * LEAF or reach >= max(len(left), len(right)) else self.tree(window)
            if (i == 0 or new[0] == left[i]) and (j == len(right) or new[-1] == right[j - 1]):
                left[i:] = new
                left.extend(right[j:])
                return left
            reach *= 2

    def tree(self, data: bytes) -> list[bytes]:
        """Encodings of halves, joined up the tree (bottom-up, so the depth of a long word needs no stack)."""
        level = [self.leaf(data[i:i + LEAF]) for i in range(0, len(data), LEAF)]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def word(self, word: str) -> tuple[int, ...]:
        """The ids of a word that the younger generation does not know. A full one replaces the older, so words in use are kept."""
        if (ids := self.older.get(word)) is None:
            data = word.encode()
            if (rank := self.ranks.get(data)) is not None:
                ids = (rank,)
            else:
                ids = tuple(self.ranks[t] for t in self.tree(data))
        if len(word) <= LONGEST:
            if len(self.known) >= REMEMBERED // 2:
                self.known, self.older = {}, self.known
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for word in self.words.findall(text):
            out += self.known.get(word) or self.word(word)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of a sequence of ids: the concatenation of their tokens."""
        return b"".join(map(self.tokens.__getitem__, ids))


def sent_codec(df: DataFrame, vocabulary: str | None, pattern: str | None):
    """A function that gives a worker its codec; the rank file is read here and sent along."""
    import public_tokenizers

    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")
    pattern = pattern or public_tokenizers.PATTERN
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    return lambda: worker_memory(f"codec {vocabulary} {pattern}", lambda: TreeCodec(read_ranks(ranks.value), pattern))


def encode_documents(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None,
                     key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids`` (array of int) of every document; null texts count as empty, empty ones have no ids.

    ``vocabulary`` is a ``.tiktoken`` rank file, read on the driver and sent to the tasks (0.8 MB). Repeated rows, null
    keys and any other columns are left alone; texts of any length are encoded whole.
    """
    codec_here = sent_codec(docs, vocabulary, pattern)

    def encode(batches):
        import pyarrow as pa

        codec = codec_here()
        for batch in slices(batches, 128):
            ids = [codec.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None, pattern: str | None = None,
                     key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``data`` (bytes) of every row of ids; null ids count as none. An unknown id fails the job."""
    codec_here = sent_codec(encoded, vocabulary, pattern)

    def decode(batches):
        import pyarrow as pa

        codec = codec_here()
        for batch in slices(batches, 128):
            data = [codec.decode(i or []) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], [key, "data"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(decode, f"`{key}` {kind}, data binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None,
               key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every document, decodes the ids, and returns the digests of both: ``key``, ``n_tokens``,
    ``ids_sha256`` (decimal ids joined by one space), ``decoded_sha256``. One pass, no id leaves its task.

    Null texts count as empty; repeated rows and null keys stay.
    """
    codec_here = sent_codec(docs, vocabulary, pattern)

    def digest(batches):
        import pyarrow as pa

        codec = codec_here()
        names = {i: str(i) for i in codec.tokens}
        for batch in slices(batches, 128):
            counts, sent, back = [], [], []
            for t in batch.column(1).to_pylist():
                ids = codec.encode(t or "")
                counts.append(len(ids))
                sent.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(sent, pa.string()), pa.array(back, pa.string())],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        digest, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
