"""Queries: contamination audit between documents (development) and benchmark (frozen), set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_values as J, walks
from ..operators import overlap as O
from ..session import cut_lineage
from . import inputs as I
from .collection import SEQ
from .registry import query

# Lines are records, sentences are subtrees, the whole text is the payload.
VIEWS_SQL = """
WITH texts AS (SELECT 'd' || doc_id AS case_id, 'development' AS split, source || '-' || lang AS family_id, doc_id AS k, text FROM documents
  UNION ALL SELECT 'b' || item_id, 'frozen_evaluation', 'src' || (item_id%100) || '-en', item_id, text FROM benchmark),
views AS (SELECT case_id, split, family_id, k, sha256(CAST(length(text) AS VARCHAR)) AS sig,
  CASE WHEN k%3<>0 THEN sha256(lower(text)) END AS orc,
  list_distinct(list_transform(list_filter(string_split(text, chr(10)), lambda x: x<>''), lambda x: sha256(x))) AS recs,
  [sha256(text)] AS pays,
  list_distinct(list_transform(list_filter(string_split(replace(text, chr(10), ' '), '. '), lambda x: x<>''), lambda x: sha256(x))) AS subs,
  CAST(length(text)//50 AS VARCHAR) AS comp, CASE WHEN length(text)%2=0 THEN CAST(length(text)%50 AS VARCHAR) END AS pag,
  nullif(regexp_extract(text, '[0-9]{4}'), '') AS fail, CASE WHEN k%50=0 THEN 'rejected' ELSE 'none' END AS disp FROM texts),
pairs AS (SELECT least(l.case_id, r.case_id) AS left_case_id, greatest(l.case_id, r.case_id) AS right_case_id,
  l.family_id=r.family_id AS s1, l.sig=r.sig AS s2, coalesce(l.orc=r.orc,false) AS s3,
  len(l.recs)>0 AND list_sort(l.recs)=list_sort(r.recs) AS s4, list_has_any(l.pays, r.pays) AS s5,
  len(list_intersect(l.recs, r.recs)) AS nrec, len(list_intersect(l.subs, r.subs)) AS nsub,
  l.comp=r.comp AS w3, coalesce(l.pag=r.pag,false) AS w4, coalesce(l.fail=r.fail,false) AS w5, l.disp<>'none' AND l.disp=r.disp AS w6,
  l.case_id AS dev_id, r.case_id AS bench_id
  FROM views l JOIN views r ON l.split='development' AND r.split='frozen_evaluation'),
judged AS (SELECT *, nrec>0 AND NOT s4 AS w1, nsub>0 AS w2, CASE WHEN s1 OR s2 OR s3 OR s4 OR s5 THEN 'block'
  WHEN (nrec>0 AND NOT s4) OR nsub>0 OR w3 OR w4 OR w5 OR w6 THEN 'manual_review' ELSE 'auto_pass' END AS decision,
  array_to_string(list_filter([CASE WHEN s1 THEN 'S1' END, CASE WHEN s2 THEN 'S2' END, CASE WHEN s3 THEN 'S3' END, CASE WHEN s4 THEN 'S4' END,
    CASE WHEN s5 THEN 'S5' END], lambda x: x IS NOT NULL), ',') AS strong,
  array_to_string(list_filter([CASE WHEN nrec>0 AND NOT s4 THEN 'W1' END, CASE WHEN nsub>0 THEN 'W2' END, CASE WHEN w3 THEN 'W3' END,
    CASE WHEN w4 THEN 'W4' END, CASE WHEN w5 THEN 'W5' END, CASE WHEN w6 THEN 'W6' END], lambda x: x IS NOT NULL), ',') AS weak FROM pairs)
"""


def views(spark, d):
    """Digest views of all texts."""
    docs = I.table(spark, d, "documents").select(
        F.concat(F.lit("d"), "doc_id").alias("case_id"), F.lit("development").alias("split"),
        F.concat("source", F.lit("-"), "lang").alias("family_id"), F.col("doc_id").alias("k"), "text")
    frozen = I.table(spark, d, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("case_id"), F.lit("frozen_evaluation").alias("split"),
        F.concat(F.lit("src"), F.col("item_id") % 100, F.lit("-en")).alias("family_id"), F.col("item_id").alias("k"), "text")
    size = F.length("text")
    hashed = lambda a: F.array_distinct(F.transform(F.filter(a, lambda x: x != ""), lambda x: F.sha2(x, 256)))
    return docs.unionByName(frozen).select(
        "case_id", "split", "family_id", F.sha2(size.cast("string"), 256).alias("family_signature_digest"),
        F.when(F.col("k") % 3 != 0, F.sha2(F.lower("text"), 256)).alias("oracle_result_sha256"),
        hashed(F.split("text", "\n")).alias("record_hashes"), F.array(F.sha2("text", 256)).alias("response_payload_hashes"),
        hashed(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), r"\. ")).alias("nested_subtree_hashes"),
        F.floor(size / 50).cast("string").alias("endpoint_composition_signature"),
        F.when(size % 2 == 0, (size % 50).cast("string")).alias("pagination_signature"),
        F.nullif(F.regexp_extract("text", "[0-9]{4}", 0), F.lit("")).alias("failure_code"),
        F.when(F.col("k") % 50 == 0, "rejected").otherwise("none").alias("repair_disposition"))


def short(signals):
    return F.array_join(F.transform(signals, lambda s: F.substring(s, 1, 2)), ",")


@query("overlap_audit", VIEWS_SQL + """
SELECT left_case_id, right_case_id, decision, strong, weak FROM judged WHERE decision<>'auto_pass'""")
def overlap_audit(spark, d):
    return O.overlap_pairs(views(spark, d)).select("left_case_id", "right_case_id", "decision", short("strong_signals").alias("strong"),
                                                   short("weak_signals").alias("weak"))


@query("overlap_refused", """
SELECT CASE WHEN conv_id%5=0 THEN '' ELSE 'c' || conv_id END AS case_id, CASE WHEN conv_id%5=0 THEN 'empty_case_id' ELSE 'duplicate_case_id' END AS code
FROM conversations WHERE conv_id%5=0 OR conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*)>1)""")
def overlap_refused(spark, d):
    """Turns as cases: ids that are empty or repeat are refused before any audit."""
    k = F.col("conv_id")
    turns = I.table(spark, d, "conversations").select(F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("c"), k)).alias("case_id"), "text")
    return O.checked_views(turns)[1]


@query("screen_candidates", VIEWS_SQL + """
SELECT left_case_id, right_case_id, decision, strong FROM judged WHERE decision<>'auto_pass' AND bench_id LIKE '%0'""")
def screen_candidates(spark, d):
    """Every tenth benchmark item as a candidate, all in one batch against all documents."""
    v = views(spark, d)
    found = O.screen_candidates(v.filter("split = 'frozen_evaluation' AND case_id LIKE '%0'"), v.filter("split = 'development'"))
    return found.select("left_case_id", "right_case_id", "decision", short("strong_signals").alias("strong"))


@query("overlap_evidence", VIEWS_SQL + """
SELECT left_case_id, right_case_id, CAST(nrec AS INTEGER) AS shared_records, CAST(nsub AS INTEGER) AS shared_subtrees,
  CAST(s5 AS INTEGER) AS shared_payloads FROM judged WHERE decision='block'""")
def overlap_evidence(spark, d):
    return O.assert_public(O.overlap_pairs(views(spark, d))).filter("decision = 'block'").select(
        "left_case_id", "right_case_id", "shared_records", "shared_subtrees", "shared_payloads")


LINKS_SQL = """
, links AS (SELECT dev_id, bench_id, unnest(list_filter([CASE WHEN s1 THEN 'S1' END, CASE WHEN s2 THEN 'S2' END, CASE WHEN s3 THEN 'S3' END,
  CASE WHEN s4 THEN 'S4' END, CASE WHEN s5 THEN 'S5' END, CASE WHEN w1 THEN 'W1' END, CASE WHEN w2 THEN 'W2' END, CASE WHEN w3 THEN 'W3' END,
  CASE WHEN w4 THEN 'W4' END, CASE WHEN w5 THEN 'W5' END, CASE WHEN w6 THEN 'W6' END], lambda x: x IS NOT NULL)) AS signal FROM judged),
sides AS (SELECT dev_id AS case_id, signal FROM links UNION SELECT bench_id, signal FROM links)
"""


@query("overlap_cases", VIEWS_SQL + LINKS_SQL + """
SELECT v.case_id, CASE WHEN count(*) FILTER (signal LIKE 'S%')>0 THEN 'block' WHEN count(signal)>0 THEN 'manual_review' ELSE 'auto_pass' END AS decision,
  coalesce(string_agg(signal, ',' ORDER BY signal) , '') AS signals FROM views v LEFT JOIN sides USING (case_id) GROUP BY v.case_id""")
def overlap_cases(spark, d):
    cases = O.overlap_cases(views(spark, d))
    return cases.select("case_id", "decision", short(F.concat("strong_signals", "weak_signals")).alias("signals"))


@query("overlap_groups", VIEWS_SQL + """
SELECT signal, CAST(sum(n) AS BIGINT) AS pairs FROM (
 SELECT 'S1' AS signal, count(*) FILTER (s1) AS n FROM judged UNION ALL SELECT 'S2', count(*) FILTER (s2) FROM judged
 UNION ALL SELECT 'S3', count(*) FILTER (s3) FROM judged UNION ALL SELECT 'S4', count(*) FILTER (s4) FROM judged
 UNION ALL SELECT 'S5', count(*) FILTER (s5) FROM judged UNION ALL SELECT 'W1', sum(nrec) FILTER (w1) FROM judged
 UNION ALL SELECT 'W2', sum(nsub) FROM judged UNION ALL SELECT 'W3', count(*) FILTER (w3) FROM judged
 UNION ALL SELECT 'W4', count(*) FILTER (w4) FROM judged UNION ALL SELECT 'W5', count(*) FILTER (w5) FROM judged
 UNION ALL SELECT 'W6', count(*) FILTER (w6) FROM judged) GROUP BY signal HAVING sum(n)>0""")
def overlap_groups(spark, d):
    groups = O.overlap_groups(views(spark, d))
    return groups.groupBy(F.substring("signal", 1, 2).alias("signal")).agg(F.sum("pairs").alias("pairs"))


@query("strong_signals", VIEWS_SQL + "SELECT left_case_id, right_case_id, strong FROM judged WHERE strong<>''")
def strong_signals(spark, d):
    return O.overlap_pairs(views(spark, d)).filter(F.size("strong_signals") > 0).select(
        "left_case_id", "right_case_id", short("strong_signals").alias("strong"))


@query("weak_signals", VIEWS_SQL + "SELECT left_case_id, right_case_id, weak FROM judged WHERE weak<>''")
def weak_signals(spark, d):
    return O.overlap_pairs(views(spark, d)).filter(F.size("weak_signals") > 0).select(
        "left_case_id", "right_case_id", short("weak_signals").alias("weak"))


@query("overlap_decision", VIEWS_SQL + """
SELECT (SELECT count(*) FROM judged) AS pair_count, count(*) FILTER (decision='block') AS block, count(*) FILTER (decision='manual_review') AS manual_review,
  count(*) FILTER (decision='auto_pass') AS auto_pass FROM judged""")
def overlap_decision(spark, d):
    """Pairs without a signal are only counted."""
    v = views(spark, d)
    counted = O.overlap_pairs(v).agg(F.count_if(F.col("decision") == "block").alias("block"),
                                           F.count_if(F.col("decision") == "manual_review").alias("manual_review"))
    total = O.pair_count(v).scalar()
    return counted.withColumn("pair_count", total).withColumn(
        "auto_pass", F.col("pair_count") - F.col("block") - F.col("manual_review"))


@query("cross_split_pairs", "SELECT (SELECT count(*) FROM documents) * (SELECT count(*) FROM benchmark) AS pair_count")
def cross_split_pairs(spark, d):
    return O.pair_count(views(spark, d))


@query("audit_order", VIEWS_SQL + """
SELECT left_case_id, right_case_id, decision FROM judged WHERE decision='block' ORDER BY left_case_id, right_case_id""")
def audit_order(spark, d):
    pairs = O.overlap_pairs(views(spark, d)).filter("decision = 'block'")
    return O.report_order(pairs).select("left_case_id", "right_case_id", "decision")


SCREEN = VIEWS_SQL + """
, one AS (SELECT * FROM views WHERE case_id = 'b' || (SELECT min(item_id) FROM benchmark)),
scr AS (SELECT l.case_id AS known, CASE WHEN l.family_id=r.family_id OR l.sig=r.sig OR coalesce(l.orc=r.orc,false)
   OR (len(l.recs)>0 AND list_sort(l.recs)=list_sort(r.recs)) OR list_has_any(l.pays, r.pays) THEN 'block'
  WHEN list_has_any(l.recs, r.recs) OR list_has_any(l.subs, r.subs) OR l.comp=r.comp OR coalesce(l.pag=r.pag,false) OR coalesce(l.fail=r.fail,false)
   OR (l.disp<>'none' AND l.disp=r.disp) THEN 'manual_review' ELSE 'auto_pass' END AS decision
  FROM views l, one r WHERE l.split='development')
"""


def screened(spark, d):
    v = views(spark, d)
    first = I.table(spark, d, "benchmark").agg(F.concat(F.lit("b"), F.min("item_id"))).scalar()
    return O.screen_candidate(v.filter(F.col("case_id") == first), v.filter("split = 'development'"))


@query("candidate_screen", SCREEN + "SELECT known, decision FROM scr")
def candidate_screen(spark, d):
    pairs = screened(spark, d)
    return pairs.select(F.when(F.col("left_case_id").startswith("d"), F.col("left_case_id")).otherwise(
        F.col("right_case_id")).alias("known"), "decision")


@query("decision_rollup", SCREEN + """
SELECT count(*) AS pair_count, count(*) FILTER (decision='block') AS block, count(*) FILTER (decision='manual_review') AS manual_review,
  count(*) FILTER (decision='auto_pass') AS auto_pass, CASE WHEN count(*) FILTER (decision='block')>0 THEN 'block'
  WHEN count(*) FILTER (decision='manual_review')>0 THEN 'manual_review' ELSE 'auto_pass' END AS overall_decision FROM scr""")
def decision_rollup(spark, d):
    return O.assert_public(O.decision_rollup(screened(spark, d)))


# ---------------------------------------------------------------- digests and sets

@query("set_digest", VIEWS_SQL + """
SELECT case_id, sha256('[' || array_to_string(list_transform(list_sort(recs), lambda x: '"' || x || '"'), ',') || ']') AS digest FROM views WHERE len(recs)>0""")
def set_digest(spark, d):
    v = views(spark, d).filter(F.size("record_hashes") > 0)
    return v.select("case_id", J.set_digest(F.col("record_hashes")).alias("digest"))


@query("family_leakage", VIEWS_SQL + "SELECT sig AS signature_digest, count(*) AS families FROM views GROUP BY sig HAVING count(DISTINCT split)>1")
def family_leakage(spark, d):
    families = views(spark, d).select(F.col("case_id").alias("id"), "split", F.col("family_signature_digest").alias("signature_digest"))
    return O.family_leakage(families).select("signature_digest", "families")


@query("set_intersect", VIEWS_SQL + "SELECT left_case_id, right_case_id, CAST(nrec AS BIGINT) AS shared FROM judged WHERE nrec>0")
def set_intersect(spark, d):
    return O.overlap_pairs(views(spark, d)).filter("shared_records > 0").select(
        "left_case_id", "right_case_id", F.col("shared_records").cast("bigint").alias("shared"))


@query("set_equal", """
SELECT o_orderkey, count(DISTINCT l_linestatus) = 1 AND min(l_linestatus) = any_value(o_orderstatus) AS same
FROM orders JOIN lineitem ON l_orderkey=o_orderkey GROUP BY o_orderkey""")
def set_equal(spark, d):
    """Line states of an order against its own state, as sets."""
    lines = I.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_linestatus").alias("a"))
    orders = I.table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", (F.sort_array("a") == F.array("o_orderstatus")).alias("same"))


@query("set_subset", """
SELECT conv_id, bool_and(role IN ('user','assistant')) AS ok FROM conversations GROUP BY conv_id""")
def set_subset(spark, d):
    roles = I.table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("r"))
    return roles.select("conv_id", (F.size(F.array_except("r", F.array(F.lit("user"), F.lit("assistant")))) == 0).alias("ok"))


# ---------------------------------------------------------------- views from documents

def bundle_documents(spark, d):
    """One case per customer: fixture from its captured pages, oracle from its rows, split by customer key."""
    pages = I.order_pages(spark, d)
    rows = I.order_rows(spark, d).withColumn("_r", F.struct("id", "amount", "state"))
    k = F.col("source_id")
    answers = pages.groupBy("source_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(
        F.struct("page_no", "body"))), lambda x: x["body"]), ",").alias("answers"))
    first = rows.groupBy("source_id").agg(F.min("_r").alias("record"))
    cases = answers.join(first, "source_id")
    post = k % 4 == 0
    fixture = F.concat(F.lit('{"fields":["id"],"endpoints":[{"request_id":"r1","url":"http://127.0.0.1/","method":"'),
                       F.when(post, "POST").otherwise("GET"), F.lit('","query":'), F.when(post, "{}").otherwise('{"page":"1"}'),
                       F.lit(',"request_body":'), F.when(post, '{"page":1}').otherwise("null"), F.lit(',"responses":['),
                       "answers", F.lit("]}]}"))
    case = F.to_json(F.struct(
        F.when(k % 97 != 0, F.format_string("case_%d", k)).alias("id"),
        F.when(k % 2 == 0, "development").otherwise("frozen_evaluation").alias("split"), F.format_string("family_%d", k % 300).alias("family_id"),
        F.struct(F.when(k % 10 == 5, "auto_applied").otherwise("none").alias("policy_disposition")).alias("repair_expectation")))
    oracle = F.to_json(F.struct(F.array("record").alias("records"), F.when(k % 10 == 1, "duplicate_id").alias("expected_error_code")))
    out = cut_lineage(cases.select("source_id", F.parse_json(case).alias("case"), F.parse_json(oracle).alias("oracle"), F.parse_json(fixture).alias("fixture")))
    return out.withColumn("family_signature", F.parse_json(O.family_signature(J.as_array(J.pointer_get(F.col("fixture"), "/endpoints")))))


@query("normalize_views", SEQ + """
SELECT CASE WHEN source_id%97=0 THEN '' ELSE 'case_' || source_id END AS case_id, CASE WHEN source_id%97=0 THEN 'missing_case_id' ELSE '' END AS code,
  CAST(CASE WHEN source_id%97=0 THEN 0 ELSE n_pages END AS BIGINT) AS payloads, CASE WHEN source_id%97=0 OR drift<>1 THEN '' ELSE 'duplicate_id' END AS failure_code,
  CASE WHEN source_id%97=0 THEN '' ELSE sha256('{"amount":' || (SELECT amount FROM paged p WHERE p.source_id=s.source_id AND rn=1) || ',"id":' ||
    (SELECT id FROM paged p WHERE p.source_id=s.source_id AND rn=1) || ',"state":"' || (SELECT state FROM paged p WHERE p.source_id=s.source_id AND rn=1) || '"}') END AS record
FROM sources s""")
def normalize_views(spark, d):
    good, bad = O.normalize_views(bundle_documents(spark, d))
    none = F.lit("")
    ok = good.select("case_id", none.alias("code"), F.size("response_payload_hashes").cast("bigint").alias("payloads"),
                     F.coalesce("failure_code", none).alias("failure_code"), F.col("record_hashes")[0].alias("record"))
    return ok.unionByName(bad.select(F.coalesce("case_id", none).alias("case_id"), "code", F.lit(0).cast("bigint").alias("payloads"),
                                     none.alias("failure_code"), none.alias("record")))


@query("endpoint_composition", SEQ + """
, shapes AS (SELECT source_id, source_id%4=0 AS post, drift=6 AS two FROM sources)
SELECT source_id, sha256('{"endpoint_count":1,"endpoints":[{"body_placement":' || CAST(post AS VARCHAR) || ',"method":"' || CASE WHEN post THEN 'POST' ELSE 'GET' END ||
 '","pagination_location":"' || CASE WHEN post THEN 'json_body' ELSE 'query' END || '","query_placement":' || CAST(NOT post AS VARCHAR) ||
 ',"response_container":{"child_kinds":["bool","int","list"],"has_array_child":true,"root":"object"}}]}') AS digest FROM shapes""")
def endpoint_composition(spark, d):
    docs = bundle_documents(spark, d)
    return docs.select("source_id", O.endpoint_composition(J.as_array(J.pointer_get(F.col("fixture"), "/endpoints"))).alias("digest"))


@query("pagination_signature", SEQ + """
SELECT source_id, sha256('{"pagination":[{"continuation_flag":["more"],"method":"' || CASE WHEN source_id%4=0 THEN 'POST' ELSE 'GET' END ||
 '","page_kind":"page_number","page_location":"' || CASE WHEN source_id%4=0 THEN 'json_body' ELSE 'query' END || '","stop_signal":"total_present"}]}') AS digest FROM sources""")
def pagination_signature(spark, d):
    docs = bundle_documents(spark, d)
    return docs.select("source_id", O.pagination_signature(J.as_array(J.pointer_get(F.col("fixture"), "/endpoints"))).alias("digest"))


@query("family_signature", SEQ + """
, leaf AS (SELECT sha256('bool') AS b, sha256('int') AS i, sha256('str') AS s),
row_ AS (SELECT *, sha256('object[' || array_to_string(list_sort([i, s]), ',') || ']') AS r FROM leaf),
list_ AS (SELECT *, sha256('array[' || r || ']') AS l FROM row_),
body AS (SELECT sha256('object[' || array_to_string(list_sort([b, i, l]), ',') || ']') AS d FROM list_)
SELECT source_id, sha256('{"endpoints":[{"body_structure":"' || d || '","method":"' || CASE WHEN source_id%4=0 THEN 'POST' ELSE 'GET' END
 || '","paging":"page_number","query_present":' || CAST(source_id%4<>0 AS VARCHAR) || '}]}') AS digest FROM sources, body""")
def family_signature(spark, d):
    docs = bundle_documents(spark, d)
    return docs.select("source_id", J.digest(F.col("family_signature")).alias("digest"))


@query("page_kind_location", SEQ + """
SELECT source_id, 'page_number' AS kind, CASE WHEN source_id%4=0 THEN 'json_body' ELSE 'query' END AS location FROM sources""")
def page_kind_location(spark, d):
    e = J.pointer_get(F.col("fixture"), "/endpoints/0")
    q, b = J.pointer_get(e, "/query"), J.pointer_get(e, "/request_body")
    return bundle_documents(spark, d).select("source_id", O.page_kind(q, b).alias("kind"), O.page_location(q, b).alias("location"))


@query("continuation_stop", SEQ + "SELECT source_id, 'more' AS flags, 'total_present' AS stop FROM sources")
def continuation_stop(spark, d):
    answers = J.as_array(J.pointer_get(F.col("fixture"), "/endpoints/0/responses"))
    return bundle_documents(spark, d).select("source_id", F.array_join(O.continuation_flags(answers), ",").alias("flags"),
                                             O.stop_signal(answers).alias("stop"))


@query("nested_subtrees", SEQ + """
, b AS (SELECT source_id, page_no, drift, n_rows, CASE WHEN drift=4 AND page_no=2 THEN 0 ELSE n_rows END AS k FROM page_rows)
SELECT source_id, page_no, CAST(CASE WHEN k=0 THEN 0 ELSE k + 1 END AS BIGINT) AS subtrees FROM b""")
def nested_subtrees(spark, d):
    return I.order_pages(spark, d).select("source_id", "page_no", F.size(
        walks.nested_subtrees(F.array(F.parse_json("body")))).cast("bigint").alias("subtrees"))


@query("leak_safe_output", VIEWS_SQL + "SELECT decision, count(*) AS pairs FROM judged WHERE decision<>'auto_pass' GROUP BY decision")
def leak_safe_output(spark, d):
    public = O.assert_public(O.audit_order(O.overlap_pairs(views(spark, d))))
    return public.groupBy("decision").agg(F.count("*").alias("pairs"))
