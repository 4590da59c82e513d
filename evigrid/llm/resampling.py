"""Target-distribution importance resampling over hashed word n-grams, with CRCs of substrings from prefix CRCs.

A document is scanned once: its words, joined by one space, give a running CRC at the end of every word, and these are
stored with the words' lengths. The CRC of any n-gram follows from the running CRCs before and after it: moving the first one
over the n-gram's length (a linear map over GF(2)) and adding it to the second cancels everything before the n-gram. Neither
the corpus counts nor the scores read a text again.

A bucket's gain is the rounded log ratio of its frequency in the target and in the corpus; a document's weight is the sum of
the gains of its features. Gumbel noise from a hash of the id makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import itertools
import math
from functools import cache
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import slices, store

#: Reflected polynomial of the CRC (a fixed value).
POLYNOMIAL = 0xEDB88320
#: Lengths with a table of their own; longer n-grams go over powers of two.
SHORT = 64
#: Words whose features are handled at once, whatever the length of a document.
CHUNK = 1 << 19

#: Lower-cases A-Z and turns every other byte that is no digit, letter or part of a longer code point into a blank.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    """The words of a text's UTF-8 bytes."""
    return data.translate(FOLDED).split() if data else []


def over_zero_byte(crc: np.ndarray) -> np.ndarray:
    """The linear part of appending one byte."""
    for _ in range(8):
        crc = crc >> np.uint32(1) ^ np.where(crc & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return crc


@cache
def shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """Images of each byte of a CRC (4 x 256) under the move over 0 to SHORT - 1 bytes, and over SHORT * 2^j bytes."""
    one = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    short = [one]
    for _ in range(SHORT):
        short.append(over_zero_byte(short[-1]))
    powers = [short.pop()]
    for _ in range(36):
        powers.append(mapped(powers[-1].ravel(), powers[-1].ravel(), 0).reshape(4, 256))
    return np.concatenate([t.ravel() for t in short]), [t.ravel() for t in powers]


def mapped(crc: np.ndarray, table: np.ndarray, at) -> np.ndarray:
    """``crc`` through the table (or, with ``at``, the table per value) of a linear map."""
    out = table[at + (crc & np.uint32(255))]
    for k in (1, 2, 3):
        out = out ^ table[at + (crc >> np.uint32(8 * k) & np.uint32(255)) + 256 * k]
    return out


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Every CRC moved over ``length`` bytes."""
    short, powers = shift_tables()
    out = mapped(crc, short, length % SHORT * 1024)
    rest = length // SHORT
    for j in range(int(rest.max(initial=0)).bit_length()):
        some = np.flatnonzero(rest >> j & 1)
        out[some] = mapped(out[some], powers[j], 0)
    return out


def running_crcs(words: list[bytes]) -> np.ndarray:
    """The CRC of the text so far at the end of every word, each word with one blank in front."""
    pieces = (b" " + b" ".join(words)).replace(b" ", b"\n ").split(b"\n")[1:] if words else []
    return np.fromiter(itertools.accumulate(pieces, lambda crc, piece: crc32(piece, crc), initial=0), np.uint32, len(words) + 1)[1:]


def after_blank(crc: np.ndarray) -> np.ndarray:
    """Running CRCs one blank further."""
    table = shift_tables()[0][1024:1280]  # over one byte, lowest byte
    register = crc ^ np.uint32(0xFFFFFFFF)
    return (register >> np.uint32(8) ^ table[(register ^ np.uint32(32)) & np.uint32(255)]) ^ np.uint32(0xFFFFFFFF)


def feature_crcs(ends: np.ndarray, sizes: np.ndarray, doc: np.ndarray, longest: int, chunk: int = CHUNK):
    """(CRCs, documents) of all runs of 1 to ``longest`` words, from running CRCs and word lengths of documents one after
    the other; ``doc`` is the document of every word. At most ``chunk`` runs come at once."""
    first = np.concatenate(([True], doc[1:] != doc[:-1])) if len(doc) else np.empty(0, bool)
    before = np.where(first, np.uint32(0), np.concatenate((ends[:1], ends[:-1])))
    starts = after_blank(before)
    place = np.concatenate(([0], np.cumsum(sizes.astype(np.int64) + 1)))
    for n in range(1, longest + 1):
        for low in range(0, len(ends) - n + 1, chunk):
            high = min(low + chunk, len(ends) - n + 1)
            last = slice(low + n - 1, high + n - 1)
            inside = np.flatnonzero(doc[low:high] == doc[last])
            length = (place[low + n:high + n] - place[low:high] - 1)[inside]
            yield ends[last][inside] ^ shifted(starts[low:high][inside], length), doc[low:high][inside]


def scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``n_words``, ``ends`` (running CRCs) and ``sizes`` (bytes of every word) of each text, 32-bit little-endian."""
    def read(batches):
        import pyarrow as pa

        for batch in slices(batches):
            words = [words_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([running_crcs(w).tobytes() for w in words], pa.binary()),
                 pa.array([np.fromiter(map(len, w), np.uint32, len(w)).tobytes() for w in words], pa.binary())],
                ["id", "n_words", "ends", "sizes"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, F.col(text).cast("binary")).mapInArrow(read, f"id {kind}, n_words long, ends binary, sizes binary")


def joined(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Running CRCs, word lengths and documents of a batch of scanned rows."""
    ends, sizes = batch.column("ends").to_pylist(), batch.column("sizes").to_pylist()
    doc = np.repeat(np.arange(len(ends)), [len(e) // 4 for e in ends])
    return np.frombuffer(b"".join(ends), "<u4"), np.frombuffer(b"".join(sizes), "<u4"), doc


def bucket_counts(scanned: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features per bucket over all scanned rows; each task sends one row per bucket it met, ``buckets`` numbers reach the driver."""
    def count(batches):
        import pyarrow as pa

        sums = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            for crc, _ in feature_crcs(*joined(batch), longest):
                sums += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(sums[met], pa.int64())], ["bucket", "n"])

    sums = np.zeros(buckets, np.int64)
    for r in scanned.select("ends", "sizes").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r["bucket"]] = r["n"]
    return sums


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of every bucket, one count added on both sides."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n))))
                     for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(scanned: DataFrame, gains: np.ndarray, longest: int) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight`` of every scanned row."""
    buckets = np.uint32(len(gains))

    def sums(batches):
        import pyarrow as pa

        for batch in slices(batches):
            weight, features = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for crc, doc in feature_crcs(*joined(batch), longest):
                # doubles hold these sums exactly: a chunk has fewer than 2^20 gains
                weight += np.bincount(doc, gains[crc % buckets], batch.num_rows).astype(np.int64)
                features += np.bincount(doc, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(features), pa.array(weight)],
                                             ["id", "n_words", "n_features", "weight"])

    kind = scanned.schema["id"].dataType.simpleString()
    return scanned.mapInArrow(sums, f"id {kind}, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from a hash of the key (null: empty)."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digits, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, draws: int) -> DataFrame:
    """``scored`` with ``rank`` (1 for the highest score, null beyond ``draws``; ties to the smaller id, null last).

    Rows equal in all columns are one row with a number until the end, so one id that repeats is no hot key. Ranges of (score,
    id) are sorted each in its own task; only their row counts meet.
    """
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight"), F.col("n_features")]
    groups = scored.groupBy("id", "n_features", "weight", "score").agg(F.count("*").alias("rows"))
    ranges = store(groups.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "draw-ranges")
    # One row per range: the only global window.
    before = (ranges.groupBy("part").agg(F.sum("rows").alias("n"))
              .select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before")))
    inside = F.sum("rows").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    placed = (ranges.withColumn("inside", inside).join(before, F.col("part") == F.col("p"))
              .withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))))
    rank = F.col("before") + F.col("inside") + F.col("place")
    return placed.select("id", "n_features", "weight", "score", F.when(rank <= draws, rank).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, buckets: int = 10_000, longest: int = 3,
             key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """One row per document: ``key``, ``n_features``, ``weight``, ``score``, ``rank`` (of the drawn ones, 1 first).

    ``percent`` of the documents with at least ``least`` words are drawn (rounded down). Features are runs of 1 to ``longest``
    words; ``target`` is any table of texts and is scanned like the corpus. Null and empty texts have no feature and weight 0;
    a null key has the noise of the empty text and comes last among ties; repeated rows stay, each may be drawn. Without any
    target text gains compare with a uniform target. An empty table gives an empty result; other columns are not read. Long
    texts are scanned whole, their features made ``CHUNK`` at a time.
    """
    scanned = store(scan(docs, key, text), "draw-scan")
    wanted = store(scan(target.select(target_text, F.lit(None).cast("string").alias("target_id")), "target_id", target_text), "draw-target")
    gains = gains_of(bucket_counts(scanned, buckets, longest), bucket_counts(wanted, buckets, longest))
    weighed = weigh(scanned, gains, longest)
    scored = store(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "draw-scores")
    able = F.col("n_words") >= least
    draws = percent * scored.where(able).count() // 100
    short = scored.where(~able).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked(scored.where(able), draws).unionByName(short).withColumnRenamed("id", key)


def drawn_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` with a drawn key (null for null), with their own columns: rows that repeat a drawn key come along."""
    drawn = resample(docs, target, key=key, **options).where(F.col("rank").isNotNull()).select(F.col(key).alias("drawn_key")).distinct()
    return docs.join(drawn, docs[key].eqNullSafe(F.col("drawn_key")), "left_semi")


#: The same rows in DuckDB; a CRC is the sum over GF(2) of what each byte adds at its distance from the end.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT b::BIGINT AS v, b::BIGINT AS c, 0 AS k FROM range(256) t(b)
  UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
one AS MATERIALIZED (SELECT v, c FROM bits WHERE k = 8),
w0 AS (SELECT 'd' AS side, rowid_ AS r, doc_id AS id, text FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents)
       UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark),
w1 AS MATERIALIZED (SELECT side, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM w0),
p AS (SELECT side, r, w, unnest(range(1, len(w) + 1)) AS i FROM w1),
f AS MATERIALIZED (SELECT side, r, array_to_string(w[i:i + n - 1], ' ') AS f FROM p, range(1, 4) t(n) WHERE i + n - 1 <= len(w)),
g AS MATERIALIZED (SELECT f, hex(encode(f)) AS x, strlen(f) AS l FROM (SELECT DISTINCT f FROM f)),
far AS (
  SELECT v, c, 0::BIGINT AS d FROM one
  UNION ALL SELECT far.v, xor(far.c >> 8, one.c), d + 1 FROM far JOIN one ON one.v = far.c & 255 WHERE d + 1 < (SELECT max(l) FROM g)),
-- the register starts with ones: they act as the first four bytes turned over
crc AS MATERIALIZED (
  SELECT f, xor(bit_xor(far.c), CASE l WHEN 1 THEN 16777215 WHEN 2 THEN 65535 WHEN 3 THEN 255 ELSE 0 END) AS c
  FROM (SELECT f, l, unnest(range(l)) AS i, x FROM g) b
  JOIN far ON far.d = l - 1 - i AND far.v = xor(('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT, CASE WHEN i < 4 THEN 255 ELSE 0 END)
  GROUP BY f, l),
b AS MATERIALIZED (SELECT side, r, xor(c, 4294967295) % 10000 AS bucket, count(*) AS n FROM f JOIN crc USING (f) GROUP BY ALL),
s AS (SELECT bucket, sum(CASE side WHEN 'd' THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE side WHEN 't' THEN n ELSE 0 END)::DOUBLE AS t FROM b GROUP BY bucket),
a AS (SELECT sum(s) AS ss, sum(t) AS tt FROM s),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (tt_.ss + 10000) / ((s + 1) * (tt_.tt + 10000))))::BIGINT AS gain FROM s, a tt_),
d AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM b JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r),
e AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM w1 LEFT JOIN d USING (r) WHERE side = 'd'),
k AS (SELECT *, n_words >= 20 AS able, sum((n_words >= 20)::INT) OVER () * 5 // 100 AS draws,
             row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, weight, n_features) AS place FROM e)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN able AND place <= draws THEN place END::BIGINT AS rank FROM k
"""
