"""Toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w.x - theta_k): one weight vector for all grades, one ordered threshold a grade. Features are
sparse: which words and parts of words a text has, of those that set labelled toxic texts apart, and how many of its words have any. The severity is
the expected grade, the sum of P(grade >= k).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .common import labelled_sample, sample_rows, slices

WORDS = regex.compile(r"\p{L}+")
PARTS = (3, 4, 5)
#: Words whose features a worker remembers.
REMEMBERED = 200_000


def word_features(word: str) -> list[str]:
    """A word (marked by =) and its parts, with ^ and $ at its ends."""
    marked = f"^{word}$"
    return ["=" + word, *(marked[i:i + n] for n in PARTS for i in range(len(marked) - n + 1))]


def features(text: str) -> set[str]:
    """The distinct features of a text's lower-cased words."""
    return {f for w in set(WORDS.findall(text.lower())) for f in word_features(w)}


#: Features of how many words of a text have a chosen feature.
LEVELS = {"+1": 1, "+2": 2, "+4": 4, "+8": 8}


class Chosen:
    """The features of a text among the chosen ones; remembers which words have any."""

    def __init__(self, names):
        self.names, self.known = set(names), {}

    def of(self, text: str) -> tuple[set[str], int]:
        """The chosen features of a text, its levels included, and how many of its words have any."""
        out: set[str] = set()
        known, hits, words = self.known, 0, WORDS.findall(text.lower())
        for w in set(words):
            hit = known.get(w)
            if hit is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                hit = known[w] = tuple(self.names.intersection(word_features(w)))
            if hit:
                out.update(hit)
                hits += words.count(w)
        out.update(k for k, least in LEVELS.items() if hits >= least)
        return out, hits


@dataclass
class Model:
    """Feature weights and thresholds; ``grades`` - 1 thresholds in rising order."""
    weights: dict[str, float]
    thresholds: list[float]

    def at_least(self, present) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        total = math.fsum(self.weights[f] for f in sorted(present) if f in self.weights)
        return [1 / (1 + math.exp(min(700.0, t - total))) for t in self.thresholds]


def fit_cumulative(rows: list[np.ndarray], grades: np.ndarray, n_features: int, penalty: float = 0.02, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood (Adam on the whole sample, fixed start and steps).

    Thresholds are a first one and positive gaps, so they stay ordered.
    """
    top = int(grades.max()) if len(grades) else 0
    lengths = np.array([len(r) for r in rows])
    at = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), lengths)
    param = np.concatenate([np.zeros(n_features), [0.0], np.zeros(max(0, top - 1))])
    m, v = np.zeros_like(param), np.zeros_like(param)
    for step in range(1, steps + 1):
        w, first, gaps = param[:n_features], param[n_features], np.exp(param[n_features + 1:])
        theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(doc, w[at], len(rows))
        upper = np.concatenate([np.ones((len(rows), 1)), 1 / (1 + np.exp(np.clip(theta - score[:, None], -500, 500))), np.zeros((len(rows), 1))], axis=1)
        slope = upper * (1 - upper)  # zero at both ends
        i = np.arange(len(rows))
        chance = np.maximum(upper[i, grades] - upper[i, grades + 1], 1e-12)
        by_score = (slope[i, grades] - slope[i, grades + 1]) / chance
        by_theta = np.zeros((len(rows), top + 2))
        by_theta[i, grades] -= slope[i, grades] / chance
        by_theta[i, grades + 1] += slope[i, grades + 1] / chance
        t = by_theta[:, 1:top + 1].mean(axis=0)
        grad = np.empty_like(param)
        grad[:n_features] = np.bincount(at, by_score[doc], n_features) / len(rows) - penalty * w / max(1, n_features)
        grad[n_features] = t.sum()
        grad[n_features + 1:] = np.cumsum(t[::-1])[::-1][1:] * gaps
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        param = param + 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return param[:n_features], param[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(param[n_features + 1:]))])


def cover(present: list[np.ndarray], toxic: np.ndarray, names: list[str], least: int, times: int = 4, clean_cost: int = 20) -> list[str]:
    """A few features that between them occur in the toxic texts and hardly in the clean ones.

    The next feature is the one with the most toxic texts not yet reached ``times`` times, each clean text it occurs in counting ``clean_cost`` against it
    (ties: the longer, then the smaller); parts of a chosen feature, and what it is part of, tell nothing new. It ends when none reaches
    ``least``.
    """
    whole = [f"^{f[1:]}$" if f.startswith("=") else f for f in names]
    doc = np.repeat(np.arange(len(present)), [len(p) for p in present])
    at = np.concatenate([*present, np.empty(0, np.int64)]).astype(np.int64)
    clean = np.bincount(at[~toxic[doc]], minlength=len(names))
    order = np.array(sorted(range(len(names)), key=lambda i: (-len(names[i]), names[i])), np.int64)
    missing, found = np.where(toxic, times, 0), []
    while len(found) < len(names):
        reached = np.bincount(at[missing[doc] > 0], minlength=len(names))
        worth = np.where(reached >= least, reached - clean_cost * clean, -1)[order]
        best = order[int(worth.argmax())]
        if worth.max() <= 0:
            break
        found.append(names[best])
        missing[doc[at == best]] -= 1
        near = [i for i, w in enumerate(whole) if w in whole[best] or whole[best] in w]
        rest = ~np.isin(at, near)
        doc, at = doc[rest], at[rest]
    return sorted(found)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, n_features: int = 1000, least: int = 5, apart: float = 5.0, odds: float = 3.0,
          key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """The model of a bounded sample of labelled documents: at most ``per_class`` of each label 0/1. None without both.

    Features: at most ``n_features`` that occur in ``least`` toxic texts or more and whose log odds against the clean ones are ``odds`` at
    least and ``apart`` standard errors above zero; of these, the few that ``cover`` the toxic texts. Grades: 0 clean; toxic texts with at most the median number of words with such features
    are 1, those with more are 2. Copies of a text count once in the sample.
    """
    sample = labelled_sample(labels.select(key, label), label, per_class, key)
    if len(set(sample.values())) < 2:
        return None
    spark = docs.sparkSession
    chosen = (sample_rows(docs.select(key, text), sample, key).where(F.length(text) > 0)
              .groupBy(F.md5(F.col(text).cast("binary")).alias("h"), "y").agg(F.first(text).alias(text)).select("y", text))

    def count(batches):
        import pyarrow as pa

        held: dict[tuple[str, int], int] = {}
        totals = [0, 0]
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[y] += 1
                for f in features(t):
                    held[f, y] = held.get((f, y), 0) + 1
        for y in (0, 1):
            held["", y] = totals[y]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in held], pa.string()), pa.array([y for _, y in held], pa.int32()),
                                          pa.array(list(held.values()), pa.int64())], ["feature", "y", "n"])

    counts = (chosen.mapInArrow(count, "feature string, y int, n long").groupBy("feature")
              .agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good")))
    ranked = counts.where((F.col("bad") >= least) | (F.col("feature") == "")).collect()
    total = next(((r["bad"], r["good"]) for r in ranked if r["feature"] == ""), (0, 0))
    if not min(total):
        return None
    strong = []
    for r in ranked:
        if not r["feature"]:
            continue
        a, b = r["bad"] + 0.5, r["good"] + 0.5
        ratio = math.log(a / (total[0] + 1 - a)) - math.log(b / (total[1] + 1 - b))
        z = ratio / math.sqrt(1 / a + 1 / b)
        if z >= apart and ratio >= odds:
            strong.append((-z, r["feature"]))
    names = sorted(f for _, f in sorted(strong)[:n_features])

    def vectors(names):
        place = {f: i for i, f in enumerate(names)}

        def read(batches):
            import pyarrow as pa

            chosen_of = Chosen(set(place) - set(LEVELS))
            for batch in batches:
                found = [chosen_of.of(t) for t in batch.column(1).to_pylist()]
                at = [sorted(place[f] for f in fs if f in place) for fs, _ in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array([h for _, h in found], pa.int32())],
                                                 ["y", "at", "hits"])
        rows = chosen.mapInArrow(read, "y int, at array<int>, hits int").collect()  # bounded by the sample
        return sorted(rows, key=lambda r: (r["y"], r["hits"], r["at"]))

    rows = vectors(names)
    names = cover([np.array(r["at"], np.int64) for r in rows], np.array([r["y"] == 1 for r in rows]), names, least) + list(LEVELS)
    rows = vectors(names)
    middle = float(np.median([r["hits"] for r in rows if r["y"]]))
    grades = np.array([0 if not r["y"] else 1 if r["hits"] <= middle else 2 for r in rows])
    w, theta = fit_cumulative([np.array(r["at"], np.int64) for r in rows], grades, len(names))
    return Model(dict(zip(names, w.tolist(), strict=True)), theta[:int(grades.max())].tolist())


def grade(docs: DataFrame, model: Model | None, limit: float = 0.5, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """One row per document: ``key``, ``severity`` (expected grade), ``grade`` (the highest one at least as likely as not),
    ``rejected`` (P(grade >= 1) > ``limit``); with ``carry`` also ``row``, all columns of ``docs``.

    Null and empty texts have no features and are never rejected; without a model nothing is. Repeated rows and null keys
    stay; whole texts of any length count; further columns are ignored, whatever their names.
    """
    def rate(batches):
        import pyarrow as pa

        m, chosen = model, Chosen(set(model.weights) - set(LEVELS) if model else ())  # at most a few thousand weights travel with the function
        for batch in slices(batches):
            severity, grades, rejected = [], [], []
            texts = batch.column(1).field(at) if carry else batch.column(1)
            for t in texts.to_pylist():
                chances = m.at_least(chosen.of(t)[0]) if m and m.weights and t else []
                severity.append(math.fsum(chances))
                grades.append(sum(p >= 0.5 for p in chances))
                rejected.append(bool(chances) and chances[0] > limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity, pa.float64()), pa.array(grades, pa.int32()), pa.array(rejected, pa.bool_()),
                                              *batch.columns[1:1 + carry]], ["key", "severity", "grade", "rejected", "row"][:4 + carry])

    # A carried row brings the text along; it travels once.
    at = docs.columns.index(text) if carry else 0
    rows = docs.select(F.col(key).alias("key"), F.struct("*").alias("row") if carry else F.col(text).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    out = rows.mapInArrow(rate, f"key {kinds['key']}, severity double, grade int, rejected boolean" + (f", row {kinds['row']}" if carry else ""))
    return out.withColumnRenamed("key", key)
