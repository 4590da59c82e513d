"""Quality rules: base counts, and the log-likelihood ratio of hashed n-grams between trusted target and raw corpus.

Both sides are multinomials over hashed character n-grams: the target from labelled good documents, the raw side from every
document. A document's score is the mean log ratio of its n-grams, so length does not count; documents at or above one fixed
threshold, fitted to every labelled document, are kept, no draw is made.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import store
from .ngrams import hashed_ngrams

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
FEWEST_WORDS, REPEATED_PERCENT = 50, 50


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly the six blanks
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    repeated = 0
    if len(words) > 3:
        number = itertools.count()
        seen: dict[bytes, int] = {}
        ids = np.array([seen[w] if w in seen else seen.setdefault(w, next(number)) for w in words], np.int64)
        pairs = ids[:-1] * len(words) + ids[1:]
        if len(words) >= 1 << 20:  # keeps the packed triple inside 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        triples = pairs[:-1] * len(words) + ids[2:]
        _, at, counts = np.unique(triples, return_inverse=True, return_counts=True)
        starts = np.flatnonzero(counts[at] > 1)
        covered = np.zeros(len(words), bool)
        for i in range(3):
            covered[starts + i] = True
        repeated = int(covered.sum())
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated


def base_failed(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < FEWEST_WORDS or 100 * counts[4] > REPEATED_PERCENT * counts[0]


def bucket_counts(texts: DataFrame, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each hash bucket occurs over the rows of ``texts`` (y, text) with y = 1, and over all; 2^bits pairs reach the driver."""
    def count(batches):
        import pyarrow as pa

        sums = np.zeros((2, 1 << bits), np.int64)
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    buckets = hashed_ngrams(t, n, bits)
                    np.add.at(sums[1], buckets, 1)
                    if y == 1:
                        np.add.at(sums[0], buckets, 1)
        found = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *[pa.array(side[found], pa.int64()) for side in sums]],
                                         ["bucket", "target", "n"])

    rows = texts.mapInArrow(count, "bucket int, target long, n long").groupBy("bucket").agg(
        F.sum("target").alias("target"), F.sum("n").alias("n")).collect()
    sums = np.zeros((2, 1 << bits), np.int64)
    for r in rows:
        sums[:, r["bucket"]] = r["target"], r["n"]
    return sums[0], sums[1]


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Log ratio per bucket, both sides with one added count; zeros where the target saw nothing."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def score(text: str, ratio: np.ndarray, n: int, bits: int) -> float:
    buckets = hashed_ngrams(text, n, bits)
    return float(ratio[buckets].mean()) if len(buckets) else 0.0


def split_point(good: list[float], bad: list[float]) -> float:
    """The threshold with the best balanced accuracy, halfway between neighbours (the middle one on ties); without examples
    of both sides nothing is refused."""
    if not good or not bad:
        return -np.inf
    values = np.unique(np.array(good + bad))
    cuts = np.concatenate(([values[0] - 1.0], (values[:-1] + values[1:]) / 2))
    good_sorted, bad_sorted = np.sort(good), np.sort(bad)
    kept = 1 - np.searchsorted(good_sorted, cuts) / len(good)
    refused = np.searchsorted(bad_sorted, cuts) / len(bad)
    value = kept + refused
    best = cuts[value >= value.max() - 1e-12]
    return float(best[len(best) // 2])


def threshold(rated: DataFrame) -> float:
    """``split_point`` of all rows of ``rated`` (y, score), over ranges of scores: neither a task nor the driver holds them all."""
    counts = rated.groupBy("score").agg(F.sum("y").alias("good"), F.sum(1 - F.col("y")).alias("bad"))
    ranged = store(counts.repartitionByRange("score").withColumn("part", F.spark_partition_id()), "scores")
    parts = Window.orderBy("part")  # one row per range
    earlier = parts.rowsBetween(Window.unboundedPreceding, -1)
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0)
    ranges = ranged.groupBy("part").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"), F.max("score").alias("top")).select(
        "part", F.lag("top").over(parts).alias("last"), F.coalesce(F.sum("g").over(earlier), zero).alias("g0"),
        F.coalesce(F.sum("b").over(earlier), zero).alias("b0"), F.sum("g").over(whole).alias("goods"), F.sum("b").over(whole).alias("bads"))
    order = Window.partitionBy("part").orderBy("score")
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    good, bad = (F.col(f"{c[0]}0") + F.coalesce(F.sum(c).over(below), zero) for c in ("good", "bad"))
    before = F.coalesce(F.lag("score").over(order), "last")
    middle = (before + F.col("score")) / 2
    # Balanced accuracy of the cut below a score, as a whole number: ties are exact.
    cuts = store(ranged.join(ranges, "part").where("goods > 0 AND bads > 0").select(
        "part", F.when(before.isNull(), F.col("score") - 1.0).when(middle > before, middle).otherwise(F.col("score")).alias("cut"),
        (bad * F.col("goods") - good * F.col("bads")).alias("value")), "cuts")
    best = cuts.where(F.col("value") == cuts.agg(F.max("value")).scalar())
    held = sorted((r["part"], r["n"]) for r in best.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per range
    at = sum(n for _, n in held) // 2
    for part, n in held:
        if at < n:
            return best.where(F.col("part") == part).orderBy("cut").offset(at).first()["cut"]
        at -= n
    return -np.inf


def assess(docs: DataFrame, labels: DataFrame, n: int = 3, bits: int = 14, key: str = "doc_id", text: str = "text",
           label: str = "quality") -> DataFrame:
    """One row per document: ``key``, the base counts, ``base_failed``, ``kept``, then ``score``.

    The raw side counts all documents, the trusted side all that ``labels`` calls good. The threshold is fitted to all labelled documents
    (both classes, base failures left out). Without labels of both classes ``kept`` is the base verdict alone. Null labels take no part; a key
    with several labels has the largest. Null texts count as empty (0 words, so failed). Null keys and repeated rows stay; other columns are
    ignored.
    """
    spark = docs.sparkSession
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
             .groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")))
    # Labels are held per partition and texts stream past them: neither side is broadcast or sorted at any size.
    marked = docs.select(key, text).join(known.hint("shuffle_hash"), F.col(key) == F.col("k"), "left")
    target, raw = bucket_counts(marked.select("y", text), n, bits)
    sent = spark.sparkContext.broadcast(log_ratio(target, raw))

    def judge(batches):
        import pyarrow as pa

        ratio = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [base_counts(t) for t in texts]
            failed = [base_failed(c) for c in counts]
            scores = [score(t, ratio, n, bits) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(5)], pa.array(failed, pa.bool_()),
                 pa.array(scores, pa.float64())],
                [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"])

    kind = docs.schema[key].dataType.simpleString()
    judged = store(docs.select(key, text).mapInArrow(
        judge, f"`{key}` {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
               "base_failed boolean, score double"), "judged")  # no texts
    limit = threshold(judged.where("NOT base_failed").join(known, F.col(key) == F.col("k")).select("y", "score"))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(float(limit)))).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
