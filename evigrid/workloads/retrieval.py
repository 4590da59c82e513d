"""Queries: BM25 case retrieval, evidence features, gates, metrics, knowledge rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import texts as X, walks
from ..operators import collect as C, features as E, retrieval as R
from ..plans import knowledge as K, taxonomy
from ..session import cut_lineage
from . import inputs as I
from .collection import outcome
from .registry import query

FAMILY = """
dl AS (SELECT case_id, len(tokens) AS dl FROM corpus),
tf AS (SELECT case_id, term, count(*) AS tf FROM (SELECT case_id, unnest(tokens) AS term FROM corpus) GROUP BY ALL),
size AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), size),
idf AS (SELECT term, df, CASE WHEN raw<0 THEN 0.25*(SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
scores AS (SELECT query_id, case_id, round(sum(idf*tf*2.5/(tf+1.5*(0.25+0.75*dl/avgdl))), 9) AS score
  FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (case_id), size GROUP BY ALL)
"""
BM25 = """
WITH corpus AS (SELECT doc_id AS case_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS tokens FROM documents),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark),
""" + FAMILY
GATED = BM25 + """
, pairs AS (SELECT s.*, CASE lang WHEN 'en' THEN 'GET' WHEN 'fr' THEN 'POST' END AS dm, CASE case_id%3 WHEN 0 THEN 'query' WHEN 1 THEN 'json_body' END AS dloc,
  CASE WHEN query_id%4=3 THEN NULL ELSE 'GET' END AS qm, CASE WHEN query_id%2=0 THEN 'query' ELSE 'json_body' END AS qloc
  FROM scores s JOIN documents d ON d.doc_id=s.case_id WHERE score>0),
gate AS (SELECT *, CAST(coalesce(dm=qm,false) AS INTEGER) + CAST(coalesce(dloc=qloc,false) AS INTEGER) AS matched,
  CAST(coalesce(dloc<>qloc,false) AS INTEGER) AS conflicted, coalesce(dm<>qm,false) AS filtered FROM pairs),
fail AS (SELECT *, CASE WHEN query_id%3=0 THEN CASE case_id%4 WHEN 0 THEN -0.5 WHEN 1 THEN 1.5 WHEN 2 THEN 0 ELSE 1.0 END
    WHEN query_id%3=1 THEN CASE case_id%4 WHEN 0 THEN 1.5 WHEN 2 THEN 0 ELSE -0.5 END ELSE 0 END AS fadj,
  query_id%3=1 AND case_id%4=1 AS ffiltered FROM gate),
"""


def corpus(spark, d):
    """Documents as cases: language and key pick the declared features and failure knowledge."""
    mode = lambda *v: F.array(F.struct(*[F.lit(x).alias(n) for n, x in zip(("code", "category", "phase", "signal"), v)]))
    k = F.col("doc_id") % 4
    return I.table(spark, d, "documents").select(
        F.col("doc_id").alias("case_id"), X.tokens(F.col("text")).alias("tokens"),
        F.map_filter(F.create_map(
            F.lit("method"), F.when(F.col("lang") == "en", "GET").when(F.col("lang") == "fr", "POST"),
            F.lit("page_location"), F.when(F.col("doc_id") % 3 == 0, "query").when(F.col("doc_id") % 3 == 1, "json_body")
            .otherwise("unknown")), lambda k, v: v.isNotNull()).alias("features"),
        F.when(k == 0, mode("duplicate_id", "DATA_INTEGRITY", "executing", "observed"))
        .when(k == 1, mode("pointer_not_found", "PLAN_SEMANTIC", "analyzing", "observed"))
        .when(k == 3, mode("page_location_mismatch", "PLAN_SEMANTIC", "analyzing", "observed")).alias("failure_modes"),
        F.when(k == 0, F.create_map(F.lit("duplicate_id"), F.lit("rejected")))
        .when(k == 1, F.create_map(F.lit("pointer_not_found"), F.lit("auto_applied")))
        .when(k == 3, F.create_map(F.lit("page_location_mismatch"), F.lit("proposal_only"))).alias("repairability"))


def terms(spark, d):
    return I.table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("term"))


def context(spark, d):
    i = F.col("item_id")
    return I.table(spark, d, "benchmark").select(
        i.alias("query_id"), F.create_map(
            F.lit("method"), F.when(i % 4 == 3, "unknown").otherwise("GET"),
            F.lit("page_location"), F.when(i % 2 == 0, "query").otherwise("json_body")).alias("query_features"),
        F.when(i % 3 == 0, "pointer_not_found").when(i % 3 == 1, "duplicate_id").otherwise("nope").alias("error_code"))


@query("corpus_tokens", "SELECT doc_id AS case_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS BIGINT) AS dl FROM documents")
def corpus_tokens(spark, d):
    lines = I.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), F.split("text", "\n").alias("terms"))
    return R.corpus_tokens(lines).select("case_id", F.size("tokens").cast("bigint").alias("dl"))


@query("bm25_stats", BM25 + " SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark, d):
    return R.bm25_stats(R.corpus_stats(corpus(spark, d))).select("term", "df", F.round("idf", 6).alias("idf"))


@query("bm25_score", BM25 + " SELECT query_id, case_id, round(score, 6) AS score FROM scores")
def bm25_score(spark, d):
    return R.bm25_scores(terms(spark, d), corpus(spark, d)).select("query_id", "case_id", F.round("score", 6).alias("score"))


@query("bm25_candidates", BM25 + " SELECT query_id, count(*) AS cases FROM scores WHERE score>0 GROUP BY ALL")
def bm25_candidates(spark, d):
    return R.candidates(R.bm25_scores(terms(spark, d), corpus(spark, d))).groupBy("query_id").agg(F.count("*").alias("cases"))


@query("rank_cases", BM25 + """
SELECT query_id, case_id, rank FROM (SELECT query_id, case_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS INTEGER) AS rank
  FROM scores WHERE score>0) WHERE rank<=2""")
def rank_cases(spark, d):
    """The two best cases by BM25 alone."""
    return run(spark, d, use_features=False, use_failures=False).ranked.select("query_id", "case_id", "rank")


def run(spark, d, **options):
    return R.retrieve(terms(spark, d), context(spark, d), corpus(spark, d), **options)


def indexed(spark, d):
    """Statistics and posting index for several rankings of the same queries."""
    stats = cut_lineage(R.corpus_stats(corpus(spark, d)))
    return stats, R.case_index(corpus(spark, d), stats, terms(spark, d))


@query("feature_gate", GATED + """
done AS (SELECT 1) SELECT query_id, case_id, CAST(matched AS INTEGER) AS matched, CAST(conflicted AS INTEGER) AS conflicted, filtered FROM gate""")
def feature_gate(spark, d):
    return run(spark, d, use_failures=False).gates.select("query_id", "case_id", "matched", "conflicted", "filtered")


@query("match_features_join", GATED + """
done AS (SELECT 1)
SELECT query_id, case_id, key, verdict FROM (SELECT query_id, case_id, 'method' AS key, CASE WHEN dm IS NULL OR qm IS NULL THEN 'ignored'
  WHEN dm=qm THEN 'match' ELSE 'boundary' END AS verdict FROM pairs
 UNION ALL SELECT query_id, case_id, 'page_location', CASE WHEN dloc IS NULL THEN 'ignored' WHEN dloc=qloc THEN 'match' ELSE 'conflict' END FROM pairs)
 WHERE verdict<>'ignored'""")
def match_features_join(spark, d):
    pairs = run(spark, d).gates
    verdicts = R.feature_verdicts(F.col("query_features"), F.col("case_features"))
    return pairs.select("query_id", "case_id", F.inline(F.filter(verdicts, lambda v: v["verdict"] != "ignored")))


@query("failure_gate", GATED + """
done AS (SELECT 1) SELECT query_id, case_id, CAST(fadj AS DOUBLE) AS adjustment, ffiltered AS filtered FROM fail WHERE NOT fail.filtered""")
def failure_gate(spark, d):
    return run(spark, d).gates.filter("NOT filtered").select(
        "query_id", "case_id", F.col("failure_adjustment").alias("adjustment"), F.col("failure_filtered").alias("filtered"))


TOP = """
kept AS (SELECT query_id, case_id, round(score + 0.5*matched - 0.25*conflicted + fadj, 9) AS final FROM fail WHERE NOT filtered AND NOT ffiltered),
ranked AS (SELECT query_id, case_id, final, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, case_id) AS rank FROM kept)
"""


@query("retrieve", GATED + TOP + "SELECT query_id, case_id, CAST(rank AS INTEGER) AS rank, round(final, 6) AS score FROM ranked WHERE rank<=2")
def retrieve(spark, d):
    return run(spark, d).ranked


@query("gate_audit", GATED + TOP + """
, plain AS (SELECT query_id, case_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM pairs)
SELECT f.query_id, f.case_id, round(f.score, 6) AS bm25, CAST(p.rank AS INTEGER) AS plain_rank, CAST(r.rank AS INTEGER) AS rank, CAST(matched AS INTEGER) AS matched,
  CAST(conflicted AS INTEGER) AS conflicted, f.filtered, CAST(fadj AS DOUBLE) AS failure_adjustment, ffiltered AND NOT f.filtered AS failure_filtered
FROM fail f LEFT JOIN (SELECT * FROM plain WHERE rank<=2) p USING (query_id, case_id) LEFT JOIN (SELECT * FROM ranked WHERE rank<=2) r USING (query_id, case_id)
WHERE p.rank IS NOT NULL OR r.rank IS NOT NULL""")
def gate_audit(spark, d):
    """What both gates say of the cases shown and of those that would be shown without them, from the index alone."""
    return run(spark, d).audit.select("query_id", "case_id", F.round("bm25", 6).alias("bm25"), "plain_rank", "rank", "matched", "conflicted", "filtered",
                                      "failure_adjustment", "failure_filtered")


@query("retrieval_metrics", GATED + TOP + """
, plain AS (SELECT query_id, case_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM pairs),
feat AS (SELECT query_id, case_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score + 0.5*matched - 0.25*conflicted, 9) DESC, case_id) AS rank FROM gate WHERE NOT filtered),
allr AS (SELECT 'bm25' AS grp, query_id, case_id, rank FROM plain UNION ALL SELECT 'feature_gate', query_id, case_id, rank FROM feat
  UNION ALL SELECT 'failure_aware', query_id, case_id, rank FROM ranked),
hits AS (SELECT grp, query_id, min(rank) AS hit FROM allr JOIN labels l ON l.doc_id=case_id WHERE rank<=2 AND quality=1 GROUP BY ALL),
per AS (SELECT g.grp, b.item_id, h.hit FROM (VALUES ('bm25'),('feature_gate'),('failure_aware')) g(grp), benchmark b
  LEFT JOIN hits h ON h.grp=g.grp AND h.query_id=b.item_id)
SELECT grp AS "group", count(*) AS labelled, round(avg(CASE WHEN hit=1 THEN 1.0 ELSE 0 END), 6) AS top1,
  round(avg(CASE WHEN hit IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS top2, round(avg(coalesce(1.0/hit, 0)), 6) AS mrr FROM per GROUP BY ALL""")
def retrieval_metrics(spark, d):
    good = I.table(spark, d, "labels").filter("quality = 1").select(F.col("doc_id").alias("case_id"))
    # Whether a case is relevant does not depend on the query, so every item of the benchmark counts.
    asked = I.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(True).alias("labelled"))
    stats, index = indexed(spark, d)
    parts = []
    for name, options in (("bm25", {"use_features": False, "use_failures": False}), ("feature_gate", {"use_failures": False}),
                          ("failure_aware", {})):
        ranked = run(spark, d, stats=stats, index=index, **options).ranked.withColumn("group", F.lit(name))
        relevant = ranked.join(good, "case_id", "left_semi").select("query_id", "case_id")
        parts.append(R.retrieval_metrics(ranked, relevant, asked.withColumn("group", F.lit(name)), ["group"]))
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("code_hits", GATED + TOP + """
, plain AS (SELECT query_id, case_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank FROM pairs),
shown AS (SELECT 'bm25' AS grp, query_id, case_id FROM plain WHERE rank<=2 UNION ALL SELECT 'failure_aware', query_id, case_id FROM ranked WHERE rank<=2),
per AS (SELECT g.grp, b.item_id, coalesce(bool_or((b.item_id%3=0 AND case_id%4=1) OR (b.item_id%3=1 AND case_id%4=0)), false) AS hit,
  count(case_id) FILTER (b.item_id%3<>0) AS n, count(case_id) FILTER (b.item_id%3<>0 AND case_id%4=1) AS bad
  FROM (VALUES ('bm25'),('failure_aware')) g(grp) CROSS JOIN benchmark b LEFT JOIN shown s ON s.grp=g.grp AND s.query_id=b.item_id GROUP BY ALL)
SELECT grp AS "group", round(avg(CASE WHEN item_id%5<>0 THEN CAST(hit AS INTEGER) END), 6) AS code_hit,
  round(coalesce(sum(bad) / nullif(sum(n), 0), 0), 6) AS unsafe_rate FROM per GROUP BY grp""")
def code_hits(spark, d):
    """Whether the top cases know the failure of a query, and how often a restricted failure is shown a case that repairs by itself."""
    i = F.col("query_id")
    asked = context(spark, d).select("query_id", "error_code", (i % 5 != 0).alias("labelled"))
    stats, index = indexed(spark, d)
    parts = []
    for name, options in (("bm25", {"use_features": False, "use_failures": False}), ("failure_aware", {})):
        ranked = run(spark, d, stats=stats, index=index, **options).ranked.select("query_id", "case_id")
        parts.append(R.code_hits(ranked, corpus(spark, d), asked.withColumn("group", F.lit(name)), ["group"]))
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- structure evidence

def summaries(spark, d):
    """Redacted summaries of the captured pages of every customer; every tenth customer posts its page number."""
    k = F.col("source_id") % 10
    page = F.col("page_no").cast("string")
    pages = I.order_pages(spark, d)
    return pages.select(
        F.col("source_id").alias("query_id"), F.when(k == 4, "POST").when((k == 6) & (F.col("page_no") == 2), "POST").otherwise("GET").alias("method"),
        F.when(k == 4, F.create_map(F.lit("lang"), F.lit("<value>"))).otherwise(F.create_map(F.lit("page"), page)).alias("query"),
        F.when(k == 4, F.parse_json(F.to_json(F.struct(F.col("page_no").alias("page"))))).alias("request_body_shape"),
        F.parse_json(walks.shape("body")).alias("response_shape"))


@query("evidence_features", outcome() + """
SELECT source_id AS query_id, CASE WHEN drift=6 AND n_pages>1 THEN 'unknown' WHEN drift=4 THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN drift=4 THEN 'json_body' ELSE 'query' END AS page_location, 'nested' AS items_container, 'boolean_flag' AS stop_signal,
  'present' AS continuation_flag, 'verbatim' AS field_mapping, CASE WHEN drift=6 THEN 'multiple_candidates' ELSE 'single_candidate' END AS ambiguity
FROM outcome""")
def evidence_features(spark, d):
    return E.evidence_features(summaries(spark, d), ["id", "amount"])


@query("query_tokens", outcome() + """
SELECT source_id AS query_id, unnest(CASE WHEN drift=4 THEN ['lang'] ELSE ['page'] END ||
  CASE drift WHEN 5 THEN ['entries'] WHEN 6 THEN ['entries','others'] ELSE ['rows'] END || ['id','amount','state','total','more']) AS term FROM outcome""")
def query_tokens(spark, d):
    return E.query_tokens(summaries(spark, d))


CASES_SQL = "WITH corpus AS (SELECT * FROM (VALUES " + ",".join(
    f"('{i}', [{','.join(repr(w.lower()) for w in t)}])" for i, t in K.RUNTIME_CASES) + ") t(case_id, tokens)),"


@query("failure_diagnosis", CASES_SQL + """
q AS (SELECT k AS query_id, unnest(['page', k, 'id','amount','state','total','more'] || CASE WHEN k='others' THEN ['entries'] ELSE [] END) AS term
  FROM (VALUES ('rows'),('entries'),('others')) t(k)),""" + FAMILY + """
, best AS (SELECT query_id, string_agg(case_id, ',' ORDER BY rank) AS cases FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, case_id) AS rank
  FROM scores WHERE score>0) WHERE rank<=2 GROUP BY ALL)
""" + outcome().replace("WITH seq", ", seq", 1) + """
SELECT source_id, code AS error_code, CASE code WHEN 'pointer_not_found' THEN 'planning' ELSE 'execution' END AS failure_phase, cases
FROM outcome JOIN best ON query_id = CASE drift WHEN 5 THEN 'entries' WHEN 6 THEN 'others' ELSE 'rows' END WHERE code <> 'incomplete_items'""")
def failure_diagnosis(spark, d):
    """Failed sources get the cases that best match their captured structure.

    Many sources share one structure, so each distinct set of key words is scored once.
    """
    failed = C.run_collection(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS)).violations
    keys = summaries(spark, d).withColumn("query", F.create_map(F.lit("page"), F.lit("1")))
    # Stored: the ranking reads the distinct sets several times.
    words = cut_lineage(E.query_tokens(keys).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("words")))
    sets = words.select(F.col("words").alias("query_id")).distinct()
    asked = sets.select("query_id", F.explode(F.split("query_id", " ")).alias("term"))
    nothing = sets.select("query_id", F.create_map().cast("map<string,string>").alias("query_features"), F.lit(None).cast("string").alias("error_code"))
    best = R.retrieve(asked, nothing, K.runtime_cases(spark)).ranked.groupBy(F.col("query_id").alias("words")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "case_id"))), lambda x: x["case_id"]), ",").alias("cases"))
    diagnosed = R.failure_diagnosis(failed).withColumnRenamed("source_id", "query_id")
    return diagnosed.join(words, "query_id").join(best, "words").select(
        F.col("query_id").alias("source_id"), "error_code", "failure_phase", "cases")


# Further cases beside the built-in ones, and what every case knows of failures: one code each, and the disposition declared for it.
FURTHER = (("amount_rows", ["amount", "rows", "state"]), ("entry_list", ["entries", "id", "total"]))
KNOWS = {"page_items": ("duplicate_id", "rejected"), "rows_more": ("pointer_not_found", "auto_applied"), "amount_rows": ("total_changed", "rejected"),
         "entry_list": ("pointer_not_found", "auto_applied"), "cursor_unsupported": ("page_location_mismatch", "proposal_only")}


def knowing_cases(spark):
    rows = []
    for case, words in (*K.RUNTIME_CASES, *FURTHER):
        code, disposition = KNOWS.get(case, (None, None))
        modes = [(code, *taxonomy.SPECS[code][1:3], "observed")] if code else None
        rows.append((case, words, None, modes, {code: disposition} if code else None))
    return spark.createDataFrame(rows, K.CASE_SCHEMA)


def failures_of(spark, d):
    """FailureRetrieval of the failed sources of the collection, by the key words of their captured structure."""
    failed = C.run_collection(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS)).violations
    keys = summaries(spark, d).withColumn("query", F.create_map(F.lit("page"), F.lit("1")))
    words = cut_lineage(E.query_tokens(keys).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("term")), " ").alias("structure")))
    sets = words.select("structure").distinct()
    asked = sets.select("structure", F.explode(F.split("structure", " ")).alias("term"))
    nothing = sets.select("structure", F.create_map().cast("map<string,string>").alias("query_features"))
    return R.failure_retrieval(failed.join(words.withColumnRenamed("query_id", "source_id"), "source_id"), asked, nothing, knowing_cases(spark))


SPEC_SQL = ",".join(f"('{c}','{taxonomy.SPECS[c][1]}','{taxonomy.SPECS[c][2]}')" for c in (
    "duplicate_id", "total_changed", "field_type_changed", "empty_page_with_next", "pointer_not_found", "page_location_mismatch"))
FAILED = "WITH corpus AS (SELECT * FROM (VALUES " + ",".join(
    f"('{i}', [{','.join(repr(w.lower()) for w in t)}])" for i, t in (*K.RUNTIME_CASES, *FURTHER)) + """) t(case_id, tokens)),
spec AS (SELECT * FROM (VALUES """ + SPEC_SQL + """) t(code, category, phase)),
knows AS (SELECT case_id, code, auto, category, phase FROM (VALUES """ + ",".join(
    f"('{i}','{c}',{str(a == 'auto_applied').lower()})" for i, (c, a) in KNOWS.items()) + """) t(case_id, code, auto) JOIN spec USING (code)),
q AS (SELECT k AS query_id, unnest(['page', k, 'id','amount','state','total','more'] || CASE WHEN k='others' THEN ['entries'] ELSE [] END) AS term
  FROM (VALUES ('rows'),('entries'),('others')) t(k)),""" + FAMILY + """
, told AS (SELECT query_id, s.case_id, f.code, score, f.category = 'DATA_INTEGRITY' AND coalesce(auto, false) AS filtered,
   CASE WHEN k.code IS NULL THEN 0 ELSE CAST(k.code=f.code AS INT) + CAST(k.category=f.category AS INT) + CAST(k.phase=f.phase AS INT) END AS matched,
   CASE WHEN k.code IS NULL THEN 0 ELSE CAST(k.category<>f.category AS INT) + CAST(k.phase<>f.phase AS INT) END AS conflicted
  FROM scores s CROSS JOIN spec f LEFT JOIN knows k ON k.case_id=s.case_id WHERE score>0)
, shown AS (SELECT *, row_number() OVER (PARTITION BY query_id, code ORDER BY round(score + 0.5*matched - 0.25*conflicted, 9) DESC, case_id) AS rank FROM told WHERE NOT filtered)
, best AS (SELECT query_id, code, string_agg(case_id, ',' ORDER BY rank) AS cases FROM shown WHERE rank<=2 GROUP BY ALL)
, applied AS (SELECT query_id, code, bool_or(filtered OR matched>0 OR conflicted>0) AS gate_applied FROM told GROUP BY ALL)
""" + outcome().replace("WITH seq", ", seq", 1) + """
, failed AS (SELECT *, CASE drift WHEN 5 THEN 'entries' WHEN 6 THEN 'others' ELSE 'rows' END AS query_id FROM outcome WHERE code <> 'incomplete_items')
"""


@query("failure_retrieval", FAILED + """
SELECT source_id, f.code AS error_code, category, phase, CASE f.code WHEN 'pointer_not_found' THEN 'planning' ELSE 'execution' END AS failure_phase,
  coalesce(cases, '') AS cases, gate_applied
FROM failed f JOIN spec USING (code) LEFT JOIN best USING (query_id, code) LEFT JOIN applied USING (query_id, code)""")
def failure_retrieval(spark, d):
    """Failed sources with the cases that fit their structure and their failure; restricted failures are shown no case that repairs by itself."""
    return failures_of(spark, d).diagnosis.select("source_id", "error_code", "category", "phase", "failure_phase",
                                                  F.array_join("case_ids", ",").alias("cases"), "gate_applied")


@query("knowledge_gate", FAILED + """
SELECT code AS error_code, case_id, filtered, NOT filtered AND matched>0 AS matched, NOT filtered AND conflicted>0 AS conflicted, count(*) AS sources
FROM failed JOIN told USING (query_id, code) WHERE filtered OR matched>0 OR conflicted>0 GROUP BY ALL""")
def knowledge_gate(spark, d):
    """What the failure gate says of every case, with the number of failed sources it is said to."""
    out = failures_of(spark, d)
    sources = out.diagnosis.groupBy("structure", "error_code").agg(F.count("*").alias("sources"))
    return out.knowledge_gate.join(sources, ["structure", "error_code"]).groupBy("error_code", "case_id", "filtered", "matched", "conflicted").agg(
        F.sum("sources").alias("sources"))


# ---------------------------------------------------------------- knowledge corpus

SUMS = ", ".join(f"sum(CAST('0x' || substr(d, {i + 1}, 8) AS BIGINT))" for i in range(0, 64, 8))


@query("corpus_identity", """
WITH cases AS (SELECT lang, doc_id%4 AS k, '{"case_id":"' || doc_id || '"' || coalesce(',"terms":[' ||
    CASE WHEN regexp_matches(lower(text), '[a-z0-9_]') THEN '"' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), '","') || '"' ELSE '' END || ']', '')
    || ',"features":[' || CASE lang WHEN 'en' THEN '{"key":"method","value":"GET"},' WHEN 'fr' THEN '{"key":"method","value":"POST"},' ELSE '' END
    || '{"key":"page_location","value":"' || CASE doc_id%3 WHEN 0 THEN 'query' WHEN 1 THEN 'json_body' ELSE 'unknown' END || '"}]' AS head FROM documents),
known AS (SELECT * FROM (VALUES (0,'duplicate_id','DATA_INTEGRITY','executing','rejected'), (1,'pointer_not_found','PLAN_SEMANTIC','analyzing','auto_applied'),
  (3,'page_location_mismatch','PLAN_SEMANTIC','analyzing','proposal_only')) t(k, code, category, phase, disposition)),
digests AS (SELECT lang, sha256(head || coalesce(',"failure_modes":[{"code":"' || code || '","category":"' || category || '","phase":"' || phase ||
  '","signal":"observed"}],"repairability":[{"key":"' || code || '","value":"' || disposition || '"}]', '') || '}') AS d FROM cases LEFT JOIN known USING (k))
SELECT lang, count(*) AS cases, sha256(concat_ws(',', count(*), """ + SUMS + """)) AS corpus_sha256, CAST(1 AS DOUBLE) AS repairability_consistency FROM digests GROUP BY lang""")
def corpus_identity(spark, d):
    """Digest of the cases of every language as a multiset, and whether what they declare is what the taxonomy projects."""
    cases = corpus(spark, d).join(I.table(spark, d, "documents").select(F.col("doc_id").alias("case_id"), "lang"), "case_id")
    return K.corpus_identity(cases, ["lang"])


@query("repairability_consistency", """
SELECT CAST(doc_id%8 AS INTEGER) AS rule, count(*) AS cases, CAST(CASE WHEN doc_id%8=6 THEN 0 ELSE 1 END AS DOUBLE) AS consistency FROM documents GROUP BY ALL""")
def repairability_consistency(spark, d):
    cases = knowledge(spark, d).withColumn("rule", (F.col("doc_id") % 8).cast("int"))
    return K.corpus_identity(cases, ["rule"]).select("rule", "cases", F.col("repairability_consistency").alias("consistency"))


def knowledge(spark, d):
    """Cases with one broken rule each, by ``doc_id % 8``."""
    k = F.col("case_id") % 8
    base = corpus(spark, d).withColumn("terms", F.when(k == 7, F.array(F.lit(None).cast("string"))).otherwise(F.array(F.lit("page"))))
    m = lambda *v: F.array(F.struct(*[F.lit(x).alias(n) for n, x in zip(("code", "category", "phase", "signal"), v)]))
    modes = (F.when(k == 0, m("duplicate_id", "DATA_INTEGRITY", "executing", "observed"))
             .when(k == 1, m("no_such_code", "DATA_INTEGRITY", "executing", "observed"))
             .when(k == 2, m("duplicate_id", "SECURITY", "executing", "observed"))
             .when(k == 3, m("duplicate_id", "DATA_INTEGRITY", "analyzing", "observed"))
             .when(k == 4, m("duplicate_id", "DATA_INTEGRITY", "executing", "Not A Signal"))
             .when(k == 5, F.concat(m("duplicate_id", "DATA_INTEGRITY", "executing", "a"), m("duplicate_id", "DATA_INTEGRITY", "executing", "b"))))
    declared = F.when(k == 6, F.create_map(F.lit("duplicate_id"), F.lit("auto_applied")))
    return base.select(F.col("case_id").cast("string").alias("case_id"), "terms", modes.alias("failure_modes"), declared.alias("repairability"), F.col("case_id").alias("doc_id"))


@query("knowledge_rules", """
SELECT doc_id, CASE doc_id%8 WHEN 1 THEN 'unknown_error_code' WHEN 2 THEN 'error_category_mismatch' WHEN 3 THEN 'error_phase_mismatch'
  WHEN 4 THEN 'invalid_signal' WHEN 5 THEN 'duplicate_failure_mode' WHEN 6 THEN 'repairability_mismatch' WHEN 7 THEN 'invalid_case_terms' ELSE '' END AS code FROM documents""")
def knowledge_rules(spark, d):
    cases = knowledge(spark, d)
    return cases.select("doc_id", F.coalesce(K.case_violation(cases), F.lit("")).alias("code"))


@query("load_cases", """
SELECT CASE WHEN doc_id%8=7 THEN 1 ELSE 2 END AS case_schema_version, count(*) AS cases, CAST(0 AS BIGINT) AS repeated_ids FROM documents GROUP BY 1""")
def load_cases(spark, d):
    cases = K.with_version(knowledge(spark, d))
    repeated = K.repeated_case_ids(cases).agg(F.count("*")).scalar()
    return cases.groupBy("case_schema_version").agg(F.count("*").alias("cases")).withColumn("repeated_ids", repeated)
