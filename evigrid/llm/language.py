"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its most frequent n-grams; a document is compared by the out-of-place
distance of its own most frequent n-grams, and takes the nearest profile.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import worker_memory
from .ngrams import letters_table, packed_ngrams

#: Distinct n-grams a task holds before it passes their counts on.
HELD = 500_000


def profiles(docs: DataFrame, size: int = 400, longest: int = 3, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of every language, by falling count (ties: the smaller n-gram).

    All rows with a text and a language count. Counts are summed in the tasks before the shuffle. What comes back is
    ``size`` numbers a language; the number of languages is the bound.
    """
    def count(batches):
        import pyarrow as pa

        letters = worker_memory("letters", letters_table)
        held: dict[tuple[str, int], int] = {}

        def rows():
            langs, grams, counts = [k[0] for k in held], [k[1] for k in held], list(held.values())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())],
                                              ["lang", "gram", "n"])
        for batch in batches:
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams, counts = np.unique(packed_ngrams(t, letters, longest), return_counts=True)
                for g, n in zip(grams.tolist(), counts.tolist(), strict=True):
                    held[name, g] = held.get((name, g), 0) + n
                if len(held) > HELD:
                    yield rows()
        yield rows()

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))  # cut to `size` before the shuffle too
    rows = counts.withColumn("place", best).where(F.col("place") <= size).select("lang", "gram", "place").collect()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        found.setdefault(r["lang"], []).append(r["gram"])
    # A language seen only in texts without letters has no n-grams and cannot be predicted.
    return {k: np.array(v, np.int64) for k, v in sorted(found.items(), key=lambda kv: kv[0].encode())}


class Ranker:
    """Out-of-place distances to all profiles at once."""

    def __init__(self, learned: dict[str, np.ndarray], size: int):
        self.names, self.size = list(learned), size
        self.grams = np.unique(np.concatenate([*learned.values(), np.empty(0, np.int64)]))
        self.places = np.full((len(self.names), len(self.grams) + 1), -1, np.int64)
        for i, name in enumerate(self.names):
            self.places[i, np.searchsorted(self.grams, learned[name])] = np.arange(len(learned[name]))

    def predict(self, grams: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.names:
            return "und", 0.0
        found, counts = np.unique(grams, return_counts=True)
        found = found[np.lexsort((found, -counts))][:self.size]
        at = np.searchsorted(self.grams, found)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != found)] = len(self.grams)
        places = self.places[:, at]
        # An n-gram the profile does not have is out of place by the largest possible distance.
        apart = np.where(places < 0, self.size, np.abs(places - np.arange(len(found)))).sum(axis=1)
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (self.size * len(found)))


def identify(docs: DataFrame, held_out: Column, size: int = 400, longest: int = 3, key: str = "doc_id", text: str = "text",
             lang: str = "lang") -> DataFrame:
    """One row per document: ``key``, ``held_out``, ``lang_pred``, ``score`` (1: all n-grams in place, 0: none known).

    Profiles come from rows outside ``held_out``; the prediction reads the text alone. Null texts and texts without a letter
    are ``und`` with score 0, as is everything where nothing could be learned; ties go to the language first in
    code-point order. Whole texts of any length count; repeated rows and null keys stay; other columns are ignored.
    """
    learned = docs.sparkSession.sparkContext.broadcast(profiles(docs.where(~held_out), size, longest, text, lang))

    def predict(batches):
        import pyarrow as pa

        letters, ranker = worker_memory("letters", letters_table), Ranker(learned.value, size)
        for batch in batches:
            found = [ranker.predict(packed_ngrams(t or "", letters, longest)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], [key, "held_out", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, held_out.alias("held_out"), text).mapInArrow(
        predict, f"`{key}` {kind}, held_out boolean, lang_pred string, score double")
