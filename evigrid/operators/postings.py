"""A stored posting index with the largest contribution of every term in every block, and ranking that skips by it.

Cases with the same gate facts (features, failure modes, repairability) are dealt into blocks of about ``BLOCK`` cases. A block therefore has one
verdict of both gates for a query, reached before any case of it is read, and the sum of its terms' largest contributions bounds the score
of each of its cases. ``search`` reads the postings of blocks that can still hold one of a query's best cases, and no others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

#: Cases a block holds on average, and blocks of one term that one slice of the directory holds.
BLOCK, SLICE = 64, 4096
#: Rows of wanted (query, block, term) that are sent to the postings; of more, both sides are shuffled.
FEW = 1 << 17
#: Room for rounding where a bound is held against a score.
SLACK = 1e-6
KEY = ["profile", "bucket"]


@dataclass(frozen=True)
class PostingIndex:
    """Four stored tables.

    ``postings``: profile, bucket, term, case_id, part (what the term adds to the case). ``directory``: term, slice, profile, bucket, top (largest part
    of the term in the block). ``terms``: term, top, slices. ``profiles``: profile, n (cases) and the gate facts all its cases share.
    """

    postings: DataFrame
    directory: DataFrame
    terms: DataFrame
    profiles: DataFrame


def _facts():
    """Gate facts as a text that is equal exactly where they are."""
    entries = lambda c: F.sort_array(F.map_entries(c)).alias(c)
    return F.to_json(F.struct(entries("features"), F.col("failure_modes"), entries("repairability")))


def build_index(corpus: DataFrame, parts: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> PostingIndex:
    """Index of ``corpus`` (case_id, unique; tokens; features, failure_modes, repairability; null facts are facts of their own).

    ``parts`` takes the corpus with two further columns and returns (profile, bucket, case_id, term, part), dealt by block. An empty corpus, or one without tokens,
    gives empty tables. Profiles are numbered, not hashed, so different facts never share a block.
    """
    known = corpus.withColumn("facts", _facts())
    same = known.groupBy("facts").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("features", "failure_modes", "repairability")])
    profiles = cut_lineage(same.withColumn("profile", F.monotonically_increasing_id()))
    buckets = F.ceil(F.col("n") / F.lit(block))
    placed = (known.select("case_id", "tokens", "facts").join(profiles.select("facts", "profile", "n"), "facts")
              .withColumn("bucket", F.pmod(F.xxhash64("case_id"), buckets)).drop("facts", "n"))
    found = parts(placed).select(*KEY, "term", "case_id", "part")
    postings = cut_lineage(found.sortWithinPartitions(*KEY, "term"))
    tops = cut_lineage(postings.groupBy("term", *KEY).agg(F.max("part").alias("top")))
    terms = cut_lineage(tops.groupBy("term").agg(F.max("top").alias("top"), F.ceil(F.count("*") / F.lit(SLICE)).alias("slices")))
    # A term of very many blocks is dealt over slices, so that no later join meets it under one key.
    directory = tops.join(terms.select("term", "slices"), "term").select(
        "term", F.pmod(F.xxhash64(*KEY), F.col("slices")).alias("slice"), *KEY, "top")
    return PostingIndex(postings, cut_lineage(directory), terms, profiles)


def search(index: PostingIndex, queries: DataFrame, judge: Callable[[DataFrame], DataFrame], bonus: DataFrame, top: int,
           first: int = 3, seeds: int = 2) -> DataFrame:
    """(query_id, case_id, bm25, score): scored cases among which the best ``top`` of every query are, exactly, ties included.

    ``queries`` is (query_id, term), distinct; ``bonus`` (query_id, bonus) the most the gates can add. ``judge`` takes rows with query_id and the
    gate facts and returns the rows it keeps with an ``adjustment``. The ``seeds`` blocks of the highest bounds among those with one of a query's
    ``first`` terms of most weight are scored; the last of the best ``top`` is a floor. The other blocks with these terms follow where their
    bound meets the floor, which they may raise; then blocks of lighter terms, of those terms alone that can still lift a case to the floor.
    Queries without a known term have no rows.
    """
    weight = F.greatest(F.col("top"), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("weight"), "term")  # the terms of one query
    lighter = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    asked = queries.join(index.terms, "term").withColumn("weight", weight)
    asked = cut_lineage(asked.withColumn("place", F.row_number().over(order)).withColumn("rest", F.sum("weight").over(lighter)))
    pair = ["query_id", *KEY]

    def blocks_with(wanted: DataFrame) -> DataFrame:
        dealt = wanted.select("query_id", "term", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice"))
        return index.directory.select("term", "slice", *KEY).join(dealt, ["term", "slice"]).select(*pair).distinct()

    def bounded(pairs: DataFrame) -> DataFrame:
        """Blocks the gates let pass, with the gates' adjustment and the most a case of the block can score."""
        facts = index.profiles.select("profile", F.col("features").alias("case_features"), "failure_modes", "repairability")
        passed = judge(pairs.join(facts, "profile")).select(*pair, "adjustment")
        tops = index.directory.select("term", *KEY, weight.alias("most"))
        terms = passed.join(asked.select("query_id", "term"), "query_id").join(tops, ["term", *KEY])
        return terms.groupBy(*pair, "adjustment").agg((F.sum("most") + F.col("adjustment")).alias("bound"))

    def scored(pairs: DataFrame) -> DataFrame:
        wanted = cut_lineage(pairs.select(*pair, "adjustment").join(asked.select("query_id", "term"), "query_id"))
        terms = index.postings.join(wanted.hint("broadcast" if wanted.count() <= FEW else "merge"), ["term", *KEY])
        sums = terms.groupBy("query_id", "case_id", "adjustment").agg(F.round(F.sum("part"), 9).alias("bm25")).filter("bm25 > 0")
        return sums.select("query_id", "case_id", "bm25", F.round(F.col("bm25") + F.col("adjustment"), 9).alias("score"))

    def floors(cases: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id")
        kept = cases.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
        return kept.groupBy("query_id").agg(F.when(F.count("*") == top, F.min("score")).alias("floor"))

    def reaching(rows: DataFrame, floor: DataFrame, most) -> DataFrame:
        return rows.join(floor, "query_id", "left").filter(F.col("floor").isNull() | (most + SLACK >= F.col("floor"))).drop("floor")

    heavy = cut_lineage(bounded(blocks_with(asked.filter(F.col("place") <= first)))
                        .withColumn("turn", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), *KEY))))
    start = cut_lineage(scored(heavy.filter(F.col("turn") <= seeds)))
    near = scored(reaching(heavy.filter(F.col("turn") > seeds), floors(start), F.col("bound")))
    judged = cut_lineage(start.unionByName(near))
    floor = cut_lineage(floors(judged))
    most = F.col("rest") + F.coalesce("bonus", F.lit(0.0))
    lesser = reaching(asked.filter(F.col("place") > first).join(bonus, "query_id", "left"), floor, most)
    others = bounded(blocks_with(lesser).join(heavy.select(*pair), pair, "left_anti"))
    return judged.unionByName(scored(reaching(others, floor, F.col("bound"))))
