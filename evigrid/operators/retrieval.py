"""BM25 over case terms, feature and failure gates, top-2 ranking, metrics."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.texts import tokens
from ..plans.knowledge import FEATURES, corpus_identity
from ..plans.taxonomy import CATEGORIES, RESTRICTED_CATEGORIES, classify, failure_phase, trusted_code
from ..session import cut_lineage
from .postings import PostingIndex, build_index, search

# Okapi parameters, gate weights, result size.
K1, B, EPSILON = 1.5, 0.75, 0.25
MATCH_BONUS, CONFLICT_PENALTY = 0.5, 0.25
TOP = 2
#: Pairs of a query and a case that one task adds up.
PAIRS = 1 << 20
BOUNDARY = ("method",)


def corpus_tokens(cases: DataFrame) -> DataFrame:
    """Tokens of the joined terms of a case, duplicates kept."""
    return cases.withColumn("tokens", tokens(F.array_join("terms", " ")))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """(term, df, dl) in one pass over the corpus; the row with a NULL term counts cases and their tokens.

    A case adds each of its terms once, so no (case, term) pair is shuffled, only one row per term and task.
    """
    none = F.lit(None).cast("string")
    rows = corpus.select(F.size("tokens").alias("dl"), F.explode(F.concat(
        F.array_distinct("tokens"), F.array(none))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("dl"))


def corpus_size(stats: DataFrame) -> tuple[Column, Column]:
    """(number of cases, mean length) as scalar subqueries."""
    whole = stats.filter("term IS NULL")
    return (whole.agg(F.sum("df")).scalar(), whole.agg(F.sum("dl") / F.sum("df")).scalar())


def bm25_stats(stats: DataFrame) -> DataFrame:
    """(term, df, idf); a negative idf becomes a quarter of the mean over all terms."""
    n, _ = corpus_size(stats)
    raw = stats.filter("term IS NOT NULL").withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).scalar()
    return raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def term_parts(queries: DataFrame | None, corpus: DataFrame, stats: DataFrame, keep: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """(case_id, term, part): what each term of any query (None: every term) adds to the score of a case; linear in the corpus.

    ``keep`` names columns of the corpus that come along. Cases are dealt by them, or by ``case_id`` without any, once, as whole rows, over ``tasks``
    partitions if given: their terms stay together in every later step by these columns.
    """
    _, avgdl = corpus_size(stats)
    idf = bm25_stats(stats).select("term", "idf")
    if queries is not None:
        # Stored, so that the join is planned by what is there, not by the size of the whole vocabulary.
        idf = cut_lineage(idf.join(queries.select("term").distinct(), "term", "left_semi"))
    dealt = corpus.select("case_id", *keep, "tokens").repartition(*([tasks] if tasks else []), *(keep or ("case_id",)))
    words = dealt.select("case_id", *keep, F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    found = words.join(idf, "term").groupBy("case_id", *keep, "dl", "term", "idf").agg(F.count("*").alias("tf"))
    tf, dl = F.col("tf"), F.col("dl")
    return found.select("case_id", *keep, "term", (F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))).alias("part"))


def bm25_scores(queries: DataFrame, corpus: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """(query_id, case_id, score) for every case sharing a token with the query.

    ``queries`` is (query_id, term), distinct. All pairs that share a term are the product of this function; ``top_cases`` ranks without
    building them. The corpus is read twice, for the statistics, which are stored (one row per term), and for the scores. All terms of a case
    are in one partition, so with queries small enough to be sent to all tasks no hit and no pair is shuffled; there are as many partitions as keep
    the pairs of one task at ``PAIRS``.
    """
    stats = cut_lineage(corpus_stats(corpus)) if stats is None else stats
    cases = stats.filter("term IS NULL").agg(F.sum("df")).first()[0] or 0
    queries = cut_lineage(queries.select("query_id", "term"))  # read three times, and joined by its real size
    pairs = cases * queries.select("query_id").distinct().count()
    fewest = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as many as the facts of the gates are dealt over
    hits = term_parts(queries, corpus, stats, tasks=max(fewest, -(-pairs // PAIRS))).join(queries, "term")
    # Nine digits: equal cases tie exactly whatever the order of summation.
    return hits.groupBy("query_id", "case_id").agg(F.round(F.sum("part"), 9).alias("score"))


def top_cases(queries: DataFrame, corpus: DataFrame, judge: Callable[[DataFrame], DataFrame], bonus: DataFrame, top: int,
              stats: DataFrame | None = None, first: int = 3) -> DataFrame:
    """(query_id, case_id, score): judged cases among which the best ``top`` of every query are, exactly.

    Cases with one of the ``first`` terms of most weight are scored in full; the last of their best ``top`` is a floor. A case without
    any of a query's heavier terms cannot score more than its lighter terms allow together with the largest ``bonus`` (query_id, bonus), so
    further candidates come only from terms down to where that bound meets the floor; common terms are looked at for few queries.
    ``judge`` takes (query_id, case_id, bm25) and returns the rows it keeps with their ``score``.
    """
    stats = cut_lineage(corpus_stats(corpus)) if stats is None else stats
    parts = cut_lineage(term_parts(queries, corpus, stats))
    bound = F.greatest(F.col("idf") * (K1 + 1), F.lit(0.0))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "term")  # the terms of one query
    lighter = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    asked = queries.join(bm25_stats(stats).select("term", "idf"), "term").withColumn("bound", bound)
    asked = cut_lineage(asked.withColumn("place", F.row_number().over(order)).withColumn("rest", F.sum("bound").over(lighter)))

    def full(pairs: DataFrame) -> DataFrame:
        terms = pairs.join(asked.select("query_id", "term"), "query_id").join(parts, ["case_id", "term"])
        return terms.groupBy("query_id", "case_id").agg(F.round(F.sum("part"), 9).alias("bm25")).filter("bm25 > 0")

    def with_terms(wanted: DataFrame) -> DataFrame:
        return parts.select("case_id", "term").join(wanted.select("query_id", "term"), "term").select("query_id", "case_id").distinct()

    some = cut_lineage(with_terms(asked.filter(F.col("place") <= first)))
    judged = cut_lineage(judge(full(some)).select("query_id", "case_id", "score"))
    floor = rank_cases(judged, top).groupBy("query_id").agg(F.when(F.count("*") == top, F.min("score")).alias("floor"))
    reach = asked.join(floor, "query_id", "left").join(bonus, "query_id", "left")
    more = reach.filter((F.col("place") > first) & (F.col("floor").isNull() | (F.col("rest") + F.coalesce("bonus", F.lit(0.0)) + 1e-6 >= F.col("floor"))))
    others = with_terms(more).join(some, ["query_id", "case_id"], "left_anti")
    return judged.unionByName(judge(full(others)).select("query_id", "case_id", "score"))


def case_index(cases: DataFrame, stats: DataFrame | None = None, queries: DataFrame | None = None) -> PostingIndex:
    """Posting index of all terms of the cases, or of those of the given queries (query_id, term); for any number of ``retrieve`` calls."""
    corpus = cases if "tokens" in cases.columns else corpus_tokens(cases)
    stats = cut_lineage(corpus_stats(corpus)) if stats is None else stats
    return build_index(corpus, lambda placed: term_parts(queries, placed, stats, ("profile", "bucket")))


def candidates(scores: DataFrame) -> DataFrame:
    return scores.filter("score > 0")


# ---------------------------------------------------------------- gates

def feature_verdicts(query: Column, case: Column) -> Column:
    """Array of (key, verdict): match, conflict, ignored or boundary per feature."""
    def verdict(key):
        q = F.coalesce(F.try_element_at(query, F.lit(key)), F.lit("unknown"))
        c = F.try_element_at(case, F.lit(key))
        other = "boundary" if key in BOUNDARY else "conflict"
        return F.struct(F.lit(key).alias("key"), F.when(
            c.isNull() | (c == "unknown") | (q == "unknown"), "ignored").when(q == c, "match")
            .otherwise(other).alias("verdict"))
    return F.array(*[verdict(k) for k in FEATURES])


def feature_gate(pairs: DataFrame, query: str = "query_features", case: str = "case_features") -> DataFrame:
    """Add matched, conflicted, filtered and adjustment columns."""
    v = feature_verdicts(F.col(query), F.col(case))
    count = lambda kind: F.size(F.filter(v, lambda x: x["verdict"] == kind))
    return (pairs.withColumn("matched", count("match")).withColumn("conflicted", count("conflict"))
            .withColumn("filtered", count("boundary") > 0)
            .withColumn("adjustment", F.col("matched") * MATCH_BONUS - F.col("conflicted") * CONFLICT_PENALTY))


def failure_gate(pairs: DataFrame) -> DataFrame:
    """Add failure_matched, failure_conflicted, failure_filtered and failure_adjustment.

    Reads error_code, category, phase, is_classified of the query and failure_modes and
    repairability of the case.
    """
    modes = F.coalesce("failure_modes", F.array().cast("array<struct<code:string,category:string,phase:string,signal:string>>"))
    has = F.size(modes) > 0
    known = F.coalesce("is_classified", F.lit(False))
    held = lambda part: F.transform(modes, lambda m: m[part])
    same = {p: F.coalesce(F.array_contains(held(c), F.col(p)), F.lit(False))
            for p, c in (("error_code", "code"), ("category", "category"), ("phase", "phase"))}
    auto = F.coalesce(F.array_contains(F.map_values("repairability"), "auto_applied"), F.lit(False))
    restricted = F.coalesce(F.col("category").isin(*RESTRICTED_CATEGORIES), F.lit(False))
    num = lambda c: c.cast("int")
    matched = F.when(known, sum((num(same[p]) for p in same), F.lit(0))).otherwise(0)
    conflicted = F.when(known & has, num(~same["category"]) + num(~same["phase"])).otherwise(0)
    return (pairs.withColumn("failure_matched", matched).withColumn("failure_conflicted", conflicted)
            .withColumn("failure_filtered", restricted & auto)
            .withColumn("failure_adjustment", F.col("failure_matched") * MATCH_BONUS
                        - F.col("failure_conflicted") * CONFLICT_PENALTY))


# ---------------------------------------------------------------- retrieval

def known_failures(context: DataFrame) -> DataFrame:
    """Registered codes take category and phase from the taxonomy; others keep a declared real category."""
    if "category" not in context.columns:
        context = context.withColumn("category", F.lit(None).cast("string"))
    declared = context.withColumn("_declared", F.when(F.col("category").isin(*CATEGORIES), F.col("category"))).drop("category")
    return classify(declared).withColumn("category", F.when(F.col("is_classified"), F.col("category")).otherwise(
        F.col("_declared"))).drop("_declared")


@dataclass(frozen=True)
class Retrieval:
    """Top cases per query; ``gates``: the audit rows of both gates for every pair that shares a term; ``audit``: those of the cases that
    are shown, or would be without gates."""

    judged: Callable[[], DataFrame]
    rank: Callable[[], DataFrame]
    shown: Callable[[], DataFrame]

    @cached_property
    def gates(self) -> DataFrame:
        return self.judged()

    @cached_property
    def ranked(self) -> DataFrame:
        return self.rank()

    @cached_property
    def audit(self) -> DataFrame:
        return self.shown()


def rank_cases(scored: DataFrame, top: int = TOP) -> DataFrame:
    """Best ``top`` per query by (score desc, case_id); Spark keeps ``top`` rows per task and query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "case_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def retrieve(query_terms: DataFrame, query_context: DataFrame, cases: DataFrame, *, enabled: bool = True,
             use_features: bool = True, use_failures: bool = True, top: int = TOP,
             stats: DataFrame | None = None, index: PostingIndex | None = None) -> Retrieval:
    """BM25, then the feature gate, then the failure gate where any case carries failure modes.

    ``query_context``: query_id, query_features map, error_code. ``cases``: case_id, terms or
    tokens, features, failure_modes, repairability. ``index``: that of ``case_index`` for these cases; without one the
    ranking makes one of the terms of these queries.
    """
    corpus = cases if "tokens" in cases.columns else corpus_tokens(cases)
    stats = cut_lineage(corpus_stats(corpus)) if stats is None else stats
    facts = cases.select("case_id", F.col("features").alias("case_features"), "failure_modes", "repairability")
    known = cut_lineage(known_failures(query_context))  # joined to all pairs by its real size
    active = F.lit(False)
    if use_failures:
        active = F.coalesce(cases.agg(F.bool_or(F.size("failure_modes") > 0)).scalar(), F.lit(False))

    def verdicts(rows: DataFrame) -> DataFrame:
        """Both gates for rows with a query and the facts of a case, or of all cases of a block."""
        pairs = failure_gate(feature_gate(rows.join(known, "query_id", "left")))
        if not use_features:
            pairs = pairs.withColumns({"filtered": F.lit(False), "adjustment": F.lit(0.0), "matched": F.lit(0), "conflicted": F.lit(0)})
        pairs = (pairs.withColumn("failure_filtered", F.col("failure_filtered") & active & ~F.col("filtered"))
                 .withColumn("failure_adjustment", F.when(active, F.col("failure_adjustment")).otherwise(0.0)))
        return pairs if enabled else pairs.filter(F.lit(False))

    def passed(blocks: DataFrame) -> DataFrame:
        kept = verdicts(blocks).filter("NOT filtered AND NOT failure_filtered")
        return kept.withColumn("adjustment", F.col("adjustment") + F.col("failure_adjustment"))

    def either(blocks: DataFrame) -> DataFrame:
        """Blocks for queries that are asked twice, as (query_id, gated)."""
        rows = verdicts(blocks.withColumn("way", F.col("query_id")).withColumn("query_id", F.col("way.query_id")))
        kept = rows.filter(~F.col("way.gated") | (~F.col("filtered") & ~F.col("failure_filtered")))
        total = F.when(F.col("way.gated"), F.col("adjustment") + F.col("failure_adjustment")).otherwise(0.0)
        return kept.withColumn("adjustment", total).withColumn("query_id", F.col("way"))

    @cache
    def postings() -> PostingIndex:
        return index or case_index(corpus, stats, query_terms)

    def bonuses() -> DataFrame:
        most = F.coalesce(F.size("query_features"), F.lit(0)) * MATCH_BONUS if use_features else F.lit(0.0)
        return query_context.select("query_id", (most + (3 * MATCH_BONUS if use_failures else 0.0)).alias("bonus"))

    def rank() -> DataFrame:
        best = rank_cases(search(postings(), query_terms, passed, bonuses(), top), top)
        return best.select("query_id", "case_id", F.bround("score", 6).alias("score"), "rank")

    def shown() -> DataFrame:
        # Both rankings come from one search, which reads the index once for them.
        way = lambda gated: F.struct("query_id", F.lit(gated).alias("gated"))
        terms = query_terms.select(F.explode(F.array(way(False), way(True))).alias("query_id"), "term")
        bonus = bonuses().select(F.inline(F.array(F.struct(way(False).alias("query_id"), F.lit(0.0).alias("bonus")), F.struct(way(True).alias("query_id"), "bonus"))))
        best = cut_lineage(rank_cases(search(postings(), terms, either, bonus, top), top).select("query_id.*", "case_id", "bm25", "rank"))
        plain = best.filter("NOT gated").select("query_id", "case_id", "bm25", F.col("rank").alias("plain_rank"))
        both = plain.join(best.filter("gated").drop("gated"), ["query_id", "case_id", "bm25"], "full")
        return verdicts(both.join(facts, "case_id"))

    def judged() -> DataFrame:
        scored = candidates(bm25_scores(query_terms, corpus, stats)).withColumnRenamed("score", "bm25")
        # Pairs lie by case: they stream past the facts of their partition's cases, neither moved nor sorted.
        return verdicts(scored.join(facts.hint("shuffle_hash"), "case_id"))

    return Retrieval(judged, rank, shown)


def failure_diagnosis(failures: DataFrame) -> DataFrame:
    """Classified failures with their lifecycle bucket; unclassified ones have no diagnosis."""
    known = classify(failures.withColumn("error_code", trusted_code(F.col("error_code")))).filter("is_classified")
    return known.withColumn("failure_phase", failure_phase(F.col("phase")))


@dataclass(frozen=True)
class FailureRetrieval:
    """``diagnosis``: one row per classified failure; ``knowledge_gate``: (structure, error_code, case_id, filtered, matched, conflicted) where the
    failure gate said something of a case."""

    diagnosis: DataFrame
    knowledge_gate: DataFrame


def failure_retrieval(failures: DataFrame, structures: DataFrame, context: DataFrame, cases: DataFrame,
                      index: PostingIndex | None = None) -> FailureRetrieval:
    """Cases for failed sources, ranked under what failed; unclassified failures have no row.

    ``failures``: source columns, structure, error_code. ``structures``: structure, term, distinct. ``context``: structure, query_features. Many
    sources share structure and code, so each distinct pair is ranked once. ``diagnosis`` adds category, phase, failure_phase, ``case_ids``
    (best first, empty if none), ``gate_applied`` and ``corpus_sha256`` to the failures.
    """
    known = cut_lineage(failure_diagnosis(failures))
    pairs = cut_lineage(known.select("structure", "error_code").distinct().withColumn("query_id", F.monotonically_increasing_id()))
    terms = pairs.join(structures, "structure").select("query_id", "term")
    asked = pairs.join(context, "structure", "left").select("query_id", "query_features", "error_code")
    out = retrieve(terms, asked, cases, index=index)
    best = out.ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "case_id"))).alias("best"))  # two at most
    said = out.gates.filter("NOT filtered").select(
        "query_id", "case_id", F.col("failure_filtered").alias("filtered"), (~F.col("failure_filtered") & (F.col("failure_matched") > 0)).alias("matched"),
        (~F.col("failure_filtered") & (F.col("failure_conflicted") > 0)).alias("conflicted")).filter("filtered OR matched OR conflicted")
    said = cut_lineage(said)
    ranked = (pairs.join(best, "query_id", "left").join(said.select("query_id", F.lit(True).alias("applied")).distinct(), "query_id", "left")
              .select("structure", "error_code", F.coalesce(F.transform("best", lambda b: b["case_id"].cast("string")), F.array().cast("array<string>")).alias("case_ids"),
                      F.coalesce("applied", F.lit(False)).alias("gate_applied")))
    digest = corpus_identity(cases).select("corpus_sha256").scalar()
    diagnosis = known.join(cut_lineage(ranked), ["structure", "error_code"]).withColumn("corpus_sha256", digest)
    return FailureRetrieval(diagnosis, said.join(pairs, "query_id").select("structure", "error_code", "case_id", "filtered", "matched", "conflicted"))


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, group: list[str]) -> DataFrame:
    """top1, top2 and MRR@2 per group over queries that have labels; a group without any is a row of NULLs.

    ``queries``: group columns, query_id, labelled. Queries without labels count as
    not applicable, not as misses.
    """
    hits = ranked.join(relevant, ["query_id", "case_id"], "left_semi").groupBy(*group, "query_id").agg(
        F.min("rank").alias("hit"))
    per_query = queries.join(hits, [*group, "query_id"], "left")
    mean = lambda value: F.round(F.avg(F.when(F.col("labelled"), value)), 6)
    return per_query.groupBy(*group).agg(
        F.count_if("labelled").alias("labelled"),
        mean(F.coalesce((F.col("hit") == 1).cast("int"), F.lit(0))).alias("top1"),
        mean(F.col("hit").isNotNull().cast("int")).alias("top2"),
        mean(F.coalesce(1 / F.col("hit"), F.lit(0.0))).alias("mrr"))


def code_hits(ranked: DataFrame, cases: DataFrame, failures: DataFrame, group: list[str]) -> DataFrame:
    """Share of labelled queries whose top cases know the failure, and of unsafe results among restricted ones."""
    facts = cases.select("case_id", F.transform("failure_modes", lambda m: m["code"]).alias("codes"),
                         F.array_contains(F.map_values("repairability"), "auto_applied").alias("auto"))
    rows = classify(failures).join(ranked.join(facts, "case_id"), "query_id", "left")
    known = F.coalesce(F.array_contains("codes", F.col("error_code")), F.lit(False))
    restricted = F.col("category").isin(*RESTRICTED_CATEGORIES) & F.col("case_id").isNotNull()
    per_query = rows.groupBy(*group, "query_id", "labelled").agg(
        F.bool_or(known).alias("hit"), F.count_if(restricted).alias("shown"),
        F.count_if(restricted & F.coalesce("auto", F.lit(False))).alias("unsafe"))
    return per_query.groupBy(*group).agg(
        F.round(F.avg(F.when(F.col("labelled"), F.col("hit").cast("int"))), 6).alias("code_hit"),
        F.round(F.coalesce(F.try_divide(F.sum("unsafe"), F.sum("shown")), F.lit(0.0)), 6).alias("unsafe_rate"))
