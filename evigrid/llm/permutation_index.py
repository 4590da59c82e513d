"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Blocks of vectors post their rows in one inverted file per pivot,
with the place the pivot has. A query reads the files of its own pivots and ranks the rows they hold by the footrule distance of
the two orders. How near an order has to be is set once per query, over the whole index, from a sample of its vectors; only rows at least as near are
measured with the original vectors. So the result depends on no block or partition.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import store


def valid(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def vectors_of(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part: valid ones of the most common dimension (the larger
    on ties), one row per id (the first in component order if an id repeats)."""
    v = rows.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col(key).isNotNull() & F.coalesce(valid(F.col("vector")), F.lit(False)))
    top = v.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not top:
        return v
    return v.where(F.size("vector") == top[0]["n"]).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def orders(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` nearest pivots of each vector in order (ties: the lower pivot)."""
    far = (pivots * pivots).sum(axis=1) - 2 * vectors @ pivots.T
    return np.argsort(far, axis=1, kind="stable")[:, :length]


class Frame(NamedTuple):
    """What an index is read with: its pivots, the places of the pivots in the orders of sampled vectors, the number of vectors, the orders' length."""

    pivots: np.ndarray
    places: np.ndarray
    rows: int
    length: int


def build(rows: DataFrame, n_pivots: int = 1024, length: int = 64, block: int = 2048, sample: int = 4096, key: str = "vec_id",
          vector: str = "embedding") -> tuple[DataFrame, Frame]:
    """The index of all vectors, as a stored table with one row per block, and what it is read with.

    Sampled are at most ``sample`` vectors, the first by md5 of the id; the first ``n_pivots`` of them are the pivots. A block row has ``ids`` (ascending), ``vectors`` (flat), and the
    inverted files one after the other: ``starts`` of each pivot's file, ``rows`` and ``places`` of its postings.
    """
    vectors = vectors_of(rows, key, vector)
    first = vectors.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary"))).limit(sample).collect()
    some = np.array([r["vector"] for r in first], float) if first else np.empty((0, 0))
    pivots = np.unique(some[:n_pivots], axis=0)
    order = orders(some, pivots, length).astype(np.int64) if first else np.empty((0, 0), np.int64)
    places = np.full((len(some), len(pivots)), length, np.int16)
    if first:
        np.put_along_axis(places, order, np.arange(order.shape[1], dtype=np.int16)[None, :].repeat(len(some), 0), 1)

    def post(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                sort = np.argsort(ids, kind="stable")
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[sort]
                order = orders(flat, pivots, length)
                who, place = np.repeat(np.arange(len(ids)), order.shape[1]), np.tile(np.arange(order.shape[1]), len(ids))
                by = np.argsort(order.ravel(), kind="stable")
                starts = np.searchsorted(order.ravel()[by], np.arange(len(pivots) + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[sort]], pa.list_(pa.int64())), pa.array([flat.ravel()], pa.list_(pa.float64())), pa.array([starts], pa.list_(pa.int32())),
                     pa.array([who[by]], pa.list_(pa.int32())), pa.array([place[by]], pa.list_(pa.int16()))], ["ids", "vectors", "starts", "rows", "places"])

    blocks = vectors.select("vec_id", "vector").mapInArrow(
        post, "ids array<long>, vectors array<double>, starts array<int>, rows array<int>, places array<short>")
    index = store(blocks, "ann-index")
    return index, Frame(pivots, places, index.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0], length)


def search(index: DataFrame, frame: Frame, queries: DataFrame, k: int = 10, rerank: float = 16.0, at_once: int = 4096, key: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (Euclidean distance): the ``k`` nearest found of each query.

    About ``rerank`` times the square root of the number of vectors are measured per query, over the whole index: those whose order is at least as
    near the query's by footrule as that share of the sampled ones, all of equal distance included. With 256 vectors or fewer that is
    every one. Queries are taken ``at_once`` at a time; those and the pivots go to every task, which keeps the best ``k`` of each
    query over its blocks. The query's own id is no candidate; ties in the result go to the smaller id; invalid queries give no rows; an
    empty index gives an empty result.
    """
    spark = index.sparkSession
    asked = vectors_of(queries, key, vector).select("vec_id", "vector")
    if not len(frame.pivots):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = store(asked.mapInArrow(lambda batches: _bounds(batches, frame, rerank), "vec_id long, vector array<double>, bound int"), "ann-queries")
    pieces = -(-asked.count() // at_once) or 1
    results = None
    for piece in range(pieces):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(pieces)) == piece).orderBy("vec_id").collect()  # about at_once rows
        if not mine:
            continue
        q = np.array([r["vector"] for r in mine], float)
        if q.shape[1] != frame.pivots.shape[1]:
            continue
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in mine]), q, orders(q, frame.pivots, frame.length), np.array([r["bound"] for r in mine])))
        part = index.mapInArrow(lambda batches, sent=sent: _nearest(batches, *sent.value, k, frame.length), "query_id long, vec_id long, score double")
        results = part if results is None else results.unionByName(part)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return results.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bounds(batches, frame: Frame, rerank: float):
    """The gain (see ``_nearest``) that a row needs to be measured, of each query."""
    import pyarrow as pa

    size = len(frame.places)
    share = min(1.0, rerank / max(frame.rows, 1) ** 0.5)
    wanted = min(size, max(16, int(np.ceil(share * size))))  # a sample tells no smaller share
    for batch in batches:
        bounds = []
        for vector in batch.column(1).to_pylist():
            v = np.array([vector], float)
            if wanted == size or v.shape[1] != frame.pivots.shape[1]:
                bounds.append(0)
                continue
            order = orders(v, frame.pivots, frame.length)[0]
            gain = np.minimum(frame.length - frame.places[:, order], frame.length - np.arange(len(order))).sum(axis=1)
            bounds.append(int(np.partition(gain, size - wanted)[size - wanted]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bounds, pa.int32())], ["vec_id", "vector", "bound"])


def _nearest(batches, q_ids, q, q_order, bounds, k, length):
    """The best ``k`` of every query over the blocks of one task.

    The gain of a row is the sum, over shared pivots, of the smaller distance to the list's end; footrule distance is a constant less twice the gain.
    """
    import pyarrow as pa

    best_d = np.full((len(q_ids), k), np.inf)
    best_i = np.full((len(q_ids), k), np.iinfo(np.int64).max)
    for batch in batches:
        for b in range(batch.num_rows):
            ids, flat, starts, rows, places = (batch.column(c)[b].values.to_numpy(zero_copy_only=False) for c in range(5))
            flat = flat.reshape(len(ids), -1)
            if flat.shape[1] != q.shape[1]:
                continue
            ends = (length - places).astype(np.int16)
            for i in range(len(q_ids)):
                if bounds[i] > 0:
                    files = [(starts[p], starts[p + 1]) for p in q_order[i]]
                    own_end = np.repeat(np.arange(length, length - len(files), -1, dtype=np.int16), [e - s for s, e in files])
                    gain = np.bincount(np.concatenate([rows[s:e] for s, e in files]), np.minimum(own_end, np.concatenate([ends[s:e] for s, e in files])), len(ids))
                    near = np.flatnonzero(gain >= bounds[i])
                    if not len(near):
                        continue
                else:
                    near = np.arange(len(ids))
                d = np.sqrt(((flat[near] - q[i]) ** 2).sum(axis=1))
                own = ids[near]
                other = own != q_ids[i]
                d, own = np.concatenate([best_d[i], d[other]]), np.concatenate([best_i[i], own[other]])
                top = np.lexsort((own, d))[:k]
                best_d[i], best_i[i] = d[top], own[top]
    found = np.isfinite(best_d)
    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, found.sum(axis=1)), pa.int64()), pa.array(best_i[found], pa.int64()),
                                      pa.array(best_d[found], pa.float64())], ["query_id", "vec_id", "score"])
