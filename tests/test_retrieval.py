"""BM25 goldens, gates, ablation metrics, evidence features, knowledge rules."""

import json
import math
from collections import Counter

from pyspark.sql import functions as F

from evigrid.operators import features as E, retrieval as R
from evigrid.plans import knowledge as K, taxonomy

SUMMARY = {"method": "GET", "query": {"page": "1"}, "shape": {"items": [{"id": "<integer>"}], "total": "<integer>"}}


def summaries(spark, rows):
    data = [(q, s.get("method"), s.get("query"), json.dumps(s["body"]) if "body" in s else None, json.dumps(s["shape"])) for q, s in rows]
    df = spark.createDataFrame(data, "query_id string, method string, query map<string,string>, b string, r string")
    return df.withColumn("request_body_shape", F.parse_json("b")).withColumn("response_shape", F.parse_json("r"))


def cases(spark, rows):
    return spark.createDataFrame([(c["id"], c["terms"], c.get("features"), c.get("failure_modes"), c.get("repairability")) for c in rows], K.CASE_SCHEMA)


def brute(corpus, query):
    """Independent scorer over token lists."""
    n, avg = len(corpus), sum(map(len, corpus.values())) / len(corpus)
    df = Counter(t for words in corpus.values() for t in set(words))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    out = {}
    for case, words in corpus.items():
        tf = Counter(words)
        out[case] = sum((raw[t] if raw[t] >= 0 else floor) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(words) / avg))
                        for t in query if t in raw and tf[t])
    return out


def test_published_scores(spark):
    corpus = K.runtime_cases(spark)
    ctx = spark.createDataFrame([("q", {}, None)], "query_id string, query_features map<string,string>, error_code string")
    out = R.retrieve(E.query_tokens(summaries(spark, [("q", SUMMARY)])), ctx, corpus)
    assert [(r.case_id, r.score) for r in out.ranked.orderBy("rank").collect()] == [("page_items", 3.405262), ("rows_more", 0.520824)]
    assert R.retrieve(E.query_tokens(summaries(spark, [("q", SUMMARY)])), ctx, corpus, enabled=False).ranked.count() == 0


def test_scores_with_negative_idf_match_brute_force(spark):
    corpus = {"a": "x x y".split(), "b": "x z".split(), "c": "x y w w w".split(), "d": "x".split(), "e": "q".split()}
    df = spark.createDataFrame([(k, v) for k, v in corpus.items()], "case_id string, tokens array<string>")
    query = ["x", "y", "w", "nope"]
    terms = spark.createDataFrame([("q", t) for t in query], "query_id string, term string")
    got = {r.case_id: r.score for r in R.bm25_scores(terms, df).collect()}
    want = brute(corpus, query)
    assert got.keys() == {"a", "b", "c", "d"} and all(abs(got[k] - want[k]) < 1e-8 for k in got)


def mode(code):
    _, category, phase, *_ = taxonomy.SPECS[code]
    return [{"code": code, "category": category, "phase": phase, "signal": "s"}]


GET, POST = {"method": "GET", "page_location": "query"}, {"method": "POST", "page_location": "json_body"}
CORPUS = [
    {"id": "get_pager", "terms": ["items", "gm"], "features": GET, "failure_modes": mode("pointer_not_found"), "repairability": {"pointer_not_found": "auto_applied"}},
    {"id": "legacy_case", "terms": ["has_next", "lm"]},
    {"id": "loc_guard", "terms": ["page", "lg"], "features": GET, "failure_modes": mode("page_location_mismatch"),
     "repairability": {"page_location_mismatch": "proposal_only"}},
    {"id": "nested_total", "terms": ["id", "nt"], "features": GET, "failure_modes": mode("invalid_total_pointer")},
    {"id": "post_pager", "terms": ["total", "pp"], "features": POST, "failure_modes": mode("pointer_not_found"), "repairability": {"pointer_not_found": "auto_applied"}},
]
EXPECTED = {"pointer_not_found": "get_pager", "page_location_mismatch": "loc_guard", "invalid_total_pointer": "nested_total", "invalid_url": None}


def test_ablation_metrics(spark):
    shape = {"items": [{"id": "<integer>"}], "has_next": "<boolean>", "total": "<integer>"}
    rows = summaries(spark, [(c, {**SUMMARY, "shape": shape}) for c in EXPECTED])
    feats = E.evidence_features(rows, []).select("query_id", E.feature_map().alias("query_features"))
    ctx = feats.withColumn("error_code", F.col("query_id"))
    asked = spark.createDataFrame([(c, e is not None) for c, e in EXPECTED.items()], "query_id string, labelled boolean").withColumn("group", F.lit("g"))
    relevant = spark.createDataFrame([(c, e) for c, e in EXPECTED.items() if e], "query_id string, case_id string")
    want = {"bm25": (0.333333, 0.333333, 0.333333, 0.0), "feature_gate": (0.333333, 0.666667, 0.5, 0.0), "failure_aware": (1.0, 1.0, 1.0, 1.0)}
    strip = {"bm25": ("features", "failure_modes", "repairability"), "feature_gate": ("failure_modes", "repairability"), "failure_aware": ()}
    for name, dropped in strip.items():
        corpus = cases(spark, [{k: v for k, v in c.items() if k not in dropped} for c in CORPUS])
        ranked = R.retrieve(E.query_tokens(rows), ctx, corpus).ranked.withColumn("group", F.lit("g")).cache()
        m = R.retrieval_metrics(ranked, relevant, asked, ["group"]).first()
        failures = asked.withColumn("error_code", F.col("query_id"))
        h = R.code_hits(ranked.drop("group"), corpus, failures, ["group"]).first()
        assert (m.top1, m.top2, m.mrr, h.code_hit) == want[name] and h.unsafe_rate == 0.0, name


def test_evidence_features(spark):
    rows = [
        ("flag", {"method": "GET", "query": {"page": "1"}, "shape": {"rows": [{"id": "<integer>"}], "more": "<boolean>"}}),
        ("total", {"method": "GET", "query": {"q": "<value>"}, "shape": {"data": {"list": [], "other": []}, "count": "<integer>"}}),
        ("pages", {"method": "POST", "query": {}, "body": {"page": 2}, "shape": {"totalPages": "<integer>"}}),
        ("root", {"method": "POST", "query": {"p": "3"}, "body": {"n": "<integer>"}, "shape": [{"Total Amount": "<number>"}]}),
        ("none", {"method": "PUT", "query": {}, "shape": {}}),
        ("mixed", {"method": "GET", "query": {"page": "1"}, "shape": {"a": ["<string>"]}}),
        ("mixed", {"method": "POST", "query": {}, "body": {"page": 1}, "shape": {"b": ["<string>"]}}),
    ]
    got = {r.query_id: tuple(r)[1:] for r in E.evidence_features(summaries(spark, rows), ["id", "total amount"]).collect()}
    assert got == {
        "flag": ("GET", "query", "nested", "boolean_flag", "present", "aliased_required", "single_candidate"),
        "total": ("GET", "unknown", "nested", "total_int_only", "absent", "aliased_required", "multiple_candidates"),
        # "totalPages" is one word to the tokenizer.
        "pages": ("POST", "json_body", "unknown", "total_pages_ambiguous", "absent", "aliased_required", "unknown"),
        "root": ("POST", "query", "root_list", "none", "absent", "aliased_required", "single_candidate"),
        "none": ("unknown", "unknown", "unknown", "none", "unknown", "unknown", "unknown"),
        "mixed": ("unknown", "unknown", "nested", "none", "absent", "aliased_required", "multiple_candidates")}


def test_taxonomy(spark):
    assert len(taxonomy.ROWS) == len(taxonomy.SPECS) == 73
    df = taxonomy.classify(spark.createDataFrame([("pointer_not_found",), ("network_error",), ("nope",), (None,)], "error_code string"))
    assert [(r.category, r.phase, r.repairable, r.retryable) for r in df.collect()] == [
        ("PLAN_SEMANTIC", "analyzing", True, False), ("TRANSPORT", "executing", False, True), ("UNCLASSIFIED", "unknown", False, False), (None, None, False, False)]
    assert taxonomy.repairability_of("pointer_not_found") == "auto_applied" and taxonomy.repairability_of("duplicate_id") == "rejected"
    assert taxonomy.repairability_of("page_location_mismatch") == "proposal_only"


def test_knowledge_rules(spark):
    good = cases(spark, CORPUS)
    assert good.select(K.case_violation(good).alias("c")).filter("c IS NOT NULL").count() == 0
    bad = cases(spark, [{"id": "a", "terms": ["t"], "repairability": {"duplicate_id": "proposal_only"}}, {"id": "", "terms": ["t"]},
                        {"id": "b", "terms": ["t"], "failure_modes": mode("duplicate_id") + mode("duplicate_id")}])
    assert [r[0] for r in bad.select(K.case_violation(bad)).collect()] == ["repairability_mismatch", "invalid_case_id", "duplicate_failure_mode"]


def test_top_cases_equal_all_pairs(spark):
    """Bounds leave out only pairs that cannot be among the best, also with ties, common words and few candidates."""
    import random
    rng = random.Random(6)
    words = ["the", "of", "and"] + [f"w{i}" for i in range(40)]
    docs = [(i, [rng.choice(words[:3] if rng.random() < 0.5 else words) for _ in range(rng.randrange(1, 30))]) for i in range(150)] + [(200, ["w1"]), (201, ["w1"])]
    corpus = spark.createDataFrame(docs, "case_id int, tokens array<string>")
    queries = spark.createDataFrame([(q, t) for q in range(40) for t in rng.sample(words, rng.randrange(1, 9))] + [(99, "nowhere")], "query_id int, term string")
    stats = R.corpus_stats(corpus)
    extra = lambda df: df.withColumn("score", F.round(F.col("bm25") + (F.col("case_id") % 5 == 0).cast("int") * 1.5, 9)).filter("case_id % 7 <> 0")
    bonus = queries.select("query_id").distinct().withColumn("bonus", F.lit(1.5))
    best = R.rank_cases(R.top_cases(queries, corpus, extra, bonus, 2, stats, first=1))
    every = R.candidates(R.bm25_scores(queries, corpus, stats)).withColumnRenamed("score", "bm25")
    want = R.rank_cases(extra(every).select("query_id", "case_id", "score"))
    key = lambda df: sorted((r.query_id, r["rank"], r.case_id, r.score) for r in df.collect())
    assert key(best) == key(want) and len(key(want)) > 70


def test_group_without_labels_is_null(spark):
    asked = spark.createDataFrame([("g", "a", True), ("g", "b", False), ("h", "c", False)], "group string, query_id string, labelled boolean")
    ranked = spark.createDataFrame([("g", "a", "x", 2), ("g", "b", "x", 1), ("h", "c", "x", 1)], "group string, query_id string, case_id string, rank int")
    out = {r["group"]: tuple(r)[1:] for r in R.retrieval_metrics(ranked, ranked.select("query_id", "case_id"), asked, ["group"]).collect()}
    assert out == {"g": (1, 0.0, 1.0, 0.5), "h": (0, None, None, None)}


def test_corpus_identity(spark):
    one = lambda rows: K.corpus_identity(cases(spark, rows)).first()
    whole = one(CORPUS)
    assert (whole.cases, whole.repairability_consistency) == (5, 1.0)
    turned = [dict(c, features=dict(reversed(list(c["features"].items()))) if c.get("features") else None) for c in reversed(CORPUS)]
    assert one(turned).corpus_sha256 == whole.corpus_sha256 != one(CORPUS[1:]).corpus_sha256
    # A multiset: a repeated case counts; so does every part of a case.
    assert one([*CORPUS, CORPUS[0]]).corpus_sha256 != whole.corpus_sha256
    for part, value in (("terms", ["items"]), ("features", POST), ("failure_modes", None), ("repairability", None)):
        assert one([{**CORPUS[0], part: value}, *CORPUS[1:]]).corpus_sha256 != whole.corpus_sha256
    assert one([{**CORPUS[0], "repairability": {"duplicate_id": "auto_applied"}}]).repairability_consistency == 0.0
    assert one([{**CORPUS[0], "repairability": {"no_such_code": "rejected"}}]).repairability_consistency == 0.0
    assert (one([]).cases, one([]).repairability_consistency) == (0, 1.0)


def test_failure_retrieval(spark):
    failures = spark.createDataFrame([("s1", "k", "pointer_not_found"), ("s2", "k", "duplicate_id"), ("s3", "k", "duplicate_id"), ("s4", "k", "incomplete_items"),
                                      ("s5", "other", "pointer_not_found")], "source_id string, structure string, error_code string")
    terms = spark.createDataFrame([("k", "items"), ("k", "total"), ("k", "id"), ("other", "nowhere")], "structure string, term string")
    context = spark.createDataFrame([("k", {"method": "GET"})], "structure string, query_features map<string,string>")
    out = R.failure_retrieval(failures, terms, context, cases(spark, CORPUS))
    got = {r.source_id: r for r in out.diagnosis.collect()}
    # A plain error has no trusted code, so no diagnosis; a structure no case shares has no cases.
    assert got.keys() == {"s1", "s2", "s3", "s5"}
    assert (got["s1"].category, got["s1"].phase, got["s1"].failure_phase, got["s1"].case_ids[0]) == ("PLAN_SEMANTIC", "analyzing", "planning", "get_pager")
    # A restricted failure is shown no case that repairs by itself: the gate changes the row.
    assert "get_pager" not in got["s2"].case_ids and got["s2"].case_ids == got["s3"].case_ids and got["s2"].gate_applied
    assert got["s5"].case_ids == [] and not got["s5"].gate_applied
    assert {r.corpus_sha256 for r in got.values()} == {K.corpus_identity(cases(spark, CORPUS)).first().corpus_sha256}
    said = {(r.error_code, r.case_id): (r.filtered, r.matched, r.conflicted) for r in out.knowledge_gate.collect()}
    assert said["duplicate_id", "get_pager"] == (True, False, False) and said["pointer_not_found", "get_pager"] == (False, True, False)
    # The feature gate has removed the POST case before.
    assert ("pointer_not_found", "post_pager") not in said
    plain = R.failure_retrieval(failures, terms, context, cases(spark, [{k: v for k, v in c.items() if k in ("id", "terms")} for c in CORPUS]))
    assert plain.knowledge_gate.count() == 0 and not any(r.gate_applied for r in plain.diagnosis.collect())


def scored_cases(spark, n=60):
    words = ["page", "rows", "total", "more", "cursor", "next", "amount"]
    rows = [{"id": f"c{i}", "terms": [words[j % 7] for j in range(i, i + 2 + i % 5)], "features": {"method": "GET" if i % 2 else "POST"}} for i in range(n)]
    asked = spark.createDataFrame([(q, w) for q in range(4) for w in words[q:q + 3]], "query_id int, term string")
    return rows, R.corpus_tokens(cases(spark, rows)), asked


def test_pairs_stay_with_their_case(spark, tmp_path, monkeypatch):
    rows, corpus, asked = scored_cases(spark)
    spark.createDataFrame([(q, {"method": "GET"}, "nope") for q in range(4)],
                          "query_id int, query_features map<string,string>, error_code string").write.parquet(f"{tmp_path}/context")
    context = spark.read.parquet(f"{tmp_path}/context")
    scores = R.bm25_scores(asked, corpus)
    got = {(r.query_id, r.case_id): r.score for r in scores.collect()}
    lists, terms = {c["id"]: c["terms"] for c in rows}, {}
    for q, w in asked.collect():
        terms.setdefault(q, []).append(w)
    want = {(q, c): round(s, 9) for q, t in terms.items() for c, s in brute(lists, t).items() if set(t) & set(lists[c])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in got)
    gates = R.retrieve(asked, context, corpus).gates
    for plan in (scores._jdf.queryExecution().executedPlan().toString(), gates._jdf.queryExecution().executedPlan().toString()):
        assert "hashpartitioning(query_id" not in plan and "SortMergeJoin" not in plan
    assert gates.count() == sum(s > 0 for s in got.values())
    # Tasks grow in number with the pairs, not in size.
    monkeypatch.setattr(R, "PAIRS", 20)
    assert "hashpartitioning(case_id" in (plan := R.bm25_scores(asked, corpus)._jdf.queryExecution().executedPlan().toString()) and ", 12)" in plan
    assert {(r.query_id, r.case_id): r.score for r in R.bm25_scores(asked, corpus).collect()} == got


def test_rankings_share_an_index(spark, tmp_path, monkeypatch):
    from evigrid.workloads import retrieval as Q

    docs = [(i, f"page rows w{i % 5} total{i % 3} more", ["en", "fr", "de"][i % 3]) for i in range(30)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"rows w{i} more") for i in range(4)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    built, build = [], R.build_index
    monkeypatch.setattr(R, "build_index", lambda *a: built.append(1) or build(*a))
    assert Q.retrieval_metrics(spark, str(tmp_path)).count() == 3 and len(built) == 1
    assert Q.code_hits(spark, str(tmp_path)).count() == 2 and len(built) == 2


def test_metrics_count_every_item(spark, tmp_path):
    """Each item has one document of its own; the good ones are those of the items 0 and 5."""
    from evigrid.workloads import retrieval as Q

    spark.createDataFrame([(i, f"word{i} of case", "de") for i in range(10)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"word{i}") for i in range(10)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(10)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r["group"]: tuple(r)[1:] for r in Q.retrieval_metrics(spark, str(tmp_path)).collect()}
    assert out["bm25"] == (10, 0.2, 0.2, 0.2) and len(out) == 3


def test_diagnosis_stores_structures(spark, tmp_path, monkeypatch):
    from evigrid.workloads import retrieval as Q

    rows = [(c, c * 100 + i, 1.5 + i, "O") for c in range(10) for i in range(7)]
    spark.createDataFrame(rows, "o_custkey long, o_orderkey long, o_totalprice double, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    seen, ranked = [], R.retrieve
    monkeypatch.setattr(R, "retrieve", lambda terms, context, *a, **k: seen.append(terms.inputFiles() + context.inputFiles()) or ranked(terms, context, *a, **k))
    assert {r.source_id for r in Q.failure_diagnosis(spark, str(tmp_path)).collect()} == {1, 2, 3, 4, 5, 6}
    assert seen and seen[0] and not [f for f in seen[0] if "orders.parquet" in f]
