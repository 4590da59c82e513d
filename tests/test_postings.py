"""The posting index: ranking equal to all pairs, blocks that share gate facts, skipped blocks, hot terms over slices, audit rows."""

import random

import pytest
from pyspark.sql import functions as F

from evigrid.operators import postings as P, retrieval as R
from evigrid.plans import knowledge as K

FACTS = [  # (features, failure_modes, repairability)
    (None, None, None),
    ({"method": "GET", "page_location": "query"}, [("duplicate_id", "DATA_INTEGRITY", "executing", "s")], {"duplicate_id": "rejected"}),
    ({"page_location": "query", "method": "GET"}, [("duplicate_id", "DATA_INTEGRITY", "executing", "s")], {"duplicate_id": "rejected"}),
    ({"method": "POST"}, [("pointer_not_found", "PLAN_SEMANTIC", "analyzing", "s")], {"pointer_not_found": "auto_applied"}),
    ({"method": "GET"}, [("pointer_not_found", "PLAN_SEMANTIC", "analyzing", "s")], {"pointer_not_found": "auto_applied"}),
]
SCHEMA = K.CASE_SCHEMA.replace("case_id string, terms", "case_id int, tokens")


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    words = ["the", "of"] + [f"w{i}" for i in range(60)]
    rows = [(i, [rng.choice(words[:2] if rng.random() < 0.4 else words) for _ in range(rng.randrange(1, 25))], *FACTS[i % 7 % 5]) for i in range(400)]
    rows += [(900 + i, ["w1", "w2"], *FACTS[0]) for i in range(30)] + [(990, [], *FACTS[1]), (991, ["w1", "w2"], *FACTS[4])]
    return R.cut_lineage(spark.createDataFrame(rows, SCHEMA))


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(12)
    words = ["the", "of"] + [f"w{i}" for i in range(60)]
    terms = [(q, t) for q in range(30) for t in rng.sample(words, rng.randrange(1, 9))] + [(50, "w1"), (50, "w2"), (51, "nowhere"), (52, "the")]
    codes = ("duplicate_id", "pointer_not_found", "nope", None)
    ctx = [(q, None if q % 5 == 4 else {"method": "GET" if q % 2 else "POST"}, codes[q % 4]) for q in sorted({q for q, _ in terms})]
    return (spark.createDataFrame(terms, "query_id int, term string"),
            spark.createDataFrame(ctx, "query_id int, query_features map<string,string>, error_code string"))


def rows_of(df):
    return sorted(((r.query_id, r["rank"], r.case_id, r.score) for r in df.collect()))


def all_pairs(out):
    kept = out.gates.filter("NOT filtered AND NOT failure_filtered").withColumn(
        "score", F.round(F.col("bm25") + F.col("adjustment") + F.col("failure_adjustment"), 9))
    return R.rank_cases(kept.select("query_id", "case_id", "score")).withColumn("score", F.bround("score", 6))


@pytest.mark.parametrize("options", [{}, {"use_features": False, "use_failures": False}])
def test_ranking_equals_all_pairs(spark, corpus, asked, options, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 3)  # common terms fill several slices
    stats = R.cut_lineage(R.corpus_stats(corpus))
    index = P.build_index(corpus, lambda placed: R.term_parts(None, placed, stats, ("profile", "bucket")), block=4)
    assert index.terms.agg(F.max("slices")).first()[0] > 3
    out = R.retrieve(*asked, corpus, stats=stats, index=index, **options)
    want = rows_of(all_pairs(out))
    assert rows_of(out.ranked) == want and len(want) > 50
    assert not any(q == 51 for q, *_ in want)


def test_blocks_share_their_facts(spark, corpus):
    index = R.case_index(corpus)
    # Equal facts in another order of keys are one profile; null facts are one of their own.
    assert index.profiles.count() == 4
    assert index.postings.select("case_id").distinct().count() == 431  # all with tokens
    held = index.postings.select("profile", "case_id").distinct().groupBy("case_id").count()
    assert held.filter("count > 1").count() == 0
    tops = index.postings.groupBy("term", "profile", "bucket").agg(F.max("part").alias("top"))
    assert tops.exceptAll(index.directory.select("term", "profile", "bucket", "top")).count() == 0


def test_blocks_below_the_floor_are_not_scored(spark):
    rows = [(i, [f"rare{i % 40}"] * 3 + ["common"] * (i % 3 + 1) + [f"x{i}"], None, None, None) for i in range(2000)]
    corpus = spark.createDataFrame(rows, SCHEMA)
    terms = spark.createDataFrame([(q, t) for q in range(40) for t in (f"rare{q}", "common")], "query_id int, term string")
    stats = R.cut_lineage(R.corpus_stats(corpus))
    index = P.build_index(corpus, lambda placed: R.term_parts(None, placed, stats, ("profile", "bucket")), block=8)
    bonus = terms.select("query_id").distinct().withColumn("bonus", F.lit(0.0))
    judged = R.cut_lineage(P.search(index, terms, lambda b: b.withColumn("adjustment", F.lit(0.0)), bonus, 2, first=1))
    every = R.candidates(R.bm25_scores(terms, corpus, stats))
    assert every.count() == 40 * 2000 and judged.count() < 40 * 500
    assert judged.count() == judged.select("query_id", "case_id").distinct().count()
    assert rows_of(R.rank_cases(judged)) == rows_of(R.rank_cases(every))


def test_audit_rows(spark, corpus, asked):
    out = R.retrieve(*asked, corpus)
    name = ["query_id", "case_id", "matched", "conflicted", "filtered", "failure_matched", "failure_conflicted", "failure_filtered", "adjustment", "failure_adjustment"]
    rows = out.audit.collect()
    shown = {(r.query_id, r.case_id): r["rank"] for r in rows if r["rank"]}
    plain = {(r.query_id, r.case_id): r.plain_rank for r in rows if r.plain_rank}
    assert shown == {(r.query_id, r.case_id): r["rank"] for r in all_pairs(out).collect()}
    best = R.rank_cases(out.gates.withColumnRenamed("bm25", "score").select("query_id", "case_id", "score"))
    assert plain == {(r.query_id, r.case_id): r["rank"] for r in best.collect()}
    every = {tuple(r)[:2]: tuple(r) for r in out.gates.select(*name).collect()}
    assert all(tuple(r[c] for c in name) == every[r.query_id, r.case_id] for r in rows)
    # A case the gates removed is told, with its place without them.
    assert any((r.filtered or r.failure_filtered) and r["rank"] is None and r.plain_rank for r in rows)


def test_empty_corpus_and_disabled(spark, corpus, asked):
    none = spark.createDataFrame([], SCHEMA)
    assert R.retrieve(*asked, none).ranked.count() == 0
    off = R.retrieve(*asked, corpus, enabled=False)
    assert off.ranked.count() == 0 and off.audit.count() == 0


def test_audit_searches_once(spark, corpus, asked, monkeypatch):
    """Both rankings of an audit come from one search, whether wanted rows are sent to the postings or shuffled; cases are dealt by block, once."""
    calls = []
    monkeypatch.setattr(R, "search", lambda *a, **k: calls.append(1) or P.search(*a, **k))
    stats = R.cut_lineage(R.corpus_stats(corpus))
    audits = []
    for few in (P.FEW, 0):
        monkeypatch.setattr(P, "FEW", few)
        audits.append(sorted(map(repr, R.retrieve(*asked, corpus, stats=stats).audit.collect())))
    assert audits[0] == audits[1] and len(audits[0]) > 50 and len(calls) == 2
    placed = corpus.withColumns({"profile": F.col("case_id") % 2, "bucket": F.col("case_id") % 3})
    plan = R.term_parts(asked[0], placed, stats, ("profile", "bucket"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(profile" in plan and "hashpartitioning(case_id" not in plan
