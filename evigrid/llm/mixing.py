"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit hash of its key. Sizes are summed by source and hash bucket; the bucket in which
a source's budget runs out is found from the running sum over its buckets and only that bucket is split further, until it
holds a single hash. The result is one threshold per source, and selection is a filter: nothing is sorted. Thresholds
are nested: a larger budget keeps every document a smaller one took.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, store

HASH_BITS, LEVEL_BITS = 60, 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_hash(key: Column) -> Column:
    """The first 60 bits of the md5 of the key as text (null: the empty text)."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame, source: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3,
                   share: float = 1.0) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source (columns ``source``, ``source_size``).

    Sources take the weights by turns in code-point order, null last. ``share`` of all sizes is dealt by weight; a target
    stops at ``cap`` times its source's size and the excess goes to the others by weight until none is above. Each round is
    one aggregate; a round without a newly capped source ends it.
    """
    # One row per source: the only global window, over the table of sources.
    rank = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")).cast("long")
    table = store(sizes.withColumn("weight", weight), "mix-sources")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget = int(total * share)
    capped, level = F.lit(False), None
    while True:
        row = table.agg(F.sum(F.when(capped, cap * F.col("source_size"))).alias("c"), F.sum(F.when(~capped, F.col("weight"))).alias("w"),
                        F.count(F.when(capped, 1)).alias("n")).first()
        if not row["w"] or level == (row["c"], row["w"], row["n"]):
            break
        level = (row["c"], row["w"], row["n"])
        # capped: cap * size * open weights < weight * what is left for them
        left = max(0, budget - (row["c"] or 0))
        capped = F.expr(f"{cap} * source_size * {row['w']} < weight * {left}")
    rest, open_weight = max(0, budget - (row["c"] or 0)), row["w"] or 1
    target = F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(open_weight)))
    return table.select(source, "source_size", target.alias("target"))


def thresholds(sized: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """``targets`` with ``copies`` (whole copies of every document) and ``last_hash``: documents with a hash up to it
    give one more copy, so that the words taken come nearest to the target (the smaller choice on ties).

    ``sized``: ``source``, ``size``, ``hash`` of every document, stored.
    """
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    want = targets.withColumn("copies", copies).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    state = store(want.select(source, "need", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bucket")), "mix-state")
    same, rows, done = F.col("s.source").eqNullSafe(F.col("d.source")), sized, None
    found, shift = None, HASH_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        # Below the first level only rows of the boundary bucket of their source are left.
        within = rows.groupBy(source, F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        run = Window.partitionBy("d.source").orderBy("d.bucket")  # at most 2^LEVEL_BITS rows of a source
        sums = (within.alias("d").join(state.alias("s"), same)
                .select("d.source", "need", "d.bucket", "d.low", "d.high", "d.size",
                        (F.col("before") + F.sum("d.size").over(run)).alias("upto")))
        # The first bucket that takes the sum beyond what is needed; sources without one take all their documents.
        edge = (sums.where(F.col("upto") > F.col("need")).groupBy(source).agg(F.min_by(
            F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "size", "low", "high", "need"), "bucket").alias("e"))
            .select(source, "e.*"))
        edge = store(edge, "mix-edge")
        single = F.col("low") == F.col("high")
        # A bucket with one hash ends the search: take it too if that is nearer.
        ended = edge.where(single).select(source, F.when(
            F.col("before") + F.col("size") - F.col("need") < F.col("need") - F.col("before"), F.col("low")).otherwise(F.col("low") - 1).alias("last_hash"))
        found = ended if found is None else found.unionByName(ended)
        state = edge.where(~single).select(source, "need", "before", "bucket")
        if not state.head(1):
            break
        rows = store(rows.alias("d").join(state.alias("s"), same & (F.shiftright("d.hash", shift) == F.col("s.bucket")))
                     .select("d.source", "d.size", "d.hash"), "mix-rows")
    f = found.withColumnRenamed(source, "f_source")
    every = F.lit((1 << HASH_BITS) - 1)
    return (want.join(f, F.col(source).eqNullSafe(F.col("f_source")), "left")
            .select(source, "source_size", "target", "copies",
                    F.when(F.col("need") <= 0, F.lit(-1)).otherwise(F.coalesce("last_hash", every)).alias("last_hash")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0, key: str = "doc_id",
        text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """One row per document: ``doc_id``, ``size`` (words), ``source_size``, ``target`` (both of its source), ``taken``
    (words the mix takes of it, copies counted); with ``carry`` also ``row``, all columns of ``docs``.

    Null and empty texts have size 0 and take 0; a null source is a source of its own, last in order; rows with the same key
    share a hash and go the same way; a source of size 0 has target 0. Reruns agree, since hashes depend on keys alone.
    An empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    sized = store(docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"),
                              word_count(F.col(text)).alias("size"), key_hash(F.col(key)).alias("hash")), "mix-sizes")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source", weights, cap, share)
    limits = store(thresholds(sized, store(targets, "mix-targets")), "mix-limits")
    t = limits.withColumnRenamed("source", "t_source")
    rows = sized if not carry else docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), F.struct("*").alias("row"),
        word_count(F.col(text)).alias("size"), key_hash(F.col(key)).alias("hash"))
    # The table of thresholds has one row per source; its written size decides whether it is broadcast.
    joined = rows.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    taken = F.col("size") * (F.col("copies") + F.when(F.col("hash") <= F.col("last_hash"), 1).otherwise(0))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, share: float = 1.0,
                    key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    rows = mix(docs, weights, cap, share, key, text, source, carry=True)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return rows.where(times > 0).select("row", F.explode(F.sequence(F.lit(1), times))).select("row.*")


#: The same rows in DuckDB.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s0),
-- capped sources are those with the smallest 3 * size / weight: the first prefix after which none is above
o AS (SELECT *, 30 // w * source_size AS r FROM s),
p AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
             sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ow, sum(source_size) OVER () AS total FROM o),
q AS (SELECT *, 3 * source_size * ow < w * (total - c) AS capped FROM p),
u AS (SELECT sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) AS c, sum(CASE WHEN capped THEN 0 ELSE w END) AS ow, max(total) AS total FROM q),
t AS (SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * (u.total - u.c))::DOUBLE / u.ow::DOUBLE END AS target FROM q, u),
v AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
x AS (SELECT d.doc_id, d.size, d.h, v.*, target - copies * source_size AS need,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM d JOIN v ON d.source IS NOT DISTINCT FROM v.source)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN need > 0 AND (upto <= need OR (upto - own <= need AND upto - need < need - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
