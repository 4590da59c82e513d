"""Queries: plan validation, drift repair, task scoring, result comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.urls import local_origin
from ..operators import repair as R, scoring as S, validate as V
from ..operators.collect import run_collection
from ..operators.windows import sequence_numbers
from ..plans.taxonomy import classify
from . import inputs as I
from .collection import SEQ, outcome
from .registry import query


def observations(spark, d):
    """Page 1 of every customer as the observed request; ``source_id % 10`` spoils some of them."""
    k = F.col("source_id") % 10
    one = F.create_map(F.lit("page"), F.lit("1"))
    return I.order_pages(spark, d).filter("page_no = 1").select(
        "source_id", F.format_string("req_%d", "source_id").alias("request_id"),
        F.when(k.isin(7, 8), "POST").otherwise("GET").alias("method"),
        F.when(k == 1, "http://localhost:8000/api").otherwise("http://127.0.0.1:8000/api").alias("url"),
        F.when(k == 2, F.create_map(F.lit("page"), F.lit("one"))).when(
            k == 3, F.create_map(F.lit("page"), F.lit("1"), F.lit("token"), F.lit("x"))).otherwise(one).alias("query"),
        F.when(k == 8, F.parse_json(F.lit('{"page":1}'))).when(k == 7, F.parse_json(F.lit('{"page":"1"}'))).alias("request_body"), "body")


PLAN_CODE = """CASE drift WHEN 1 THEN 'only_literal_loopback_http_supported' WHEN 2 THEN 'unobserved_page_parameter' WHEN 3 THEN 'sensitive_request_not_supported'
  WHEN 5 THEN 'pointer_not_found' WHEN 6 THEN 'pointer_not_found' WHEN 7 THEN 'page_location_mismatch' WHEN 8 THEN 'page_location_mismatch' ELSE '' END"""


@query("validate_plan", SEQ + f"SELECT source_id, {PLAN_CODE} AS code FROM sources")
def validate_plan(spark, d):
    checked = V.validate_plans(I.order_plans(spark, d), observations(spark, d), list(I.FIELDS), target_code=local_origin(F.col("url"))[1])
    return checked.select("source_id", F.coalesce("code", F.lit("")).alias("code"))


@query("plan_observation", SEQ + "SELECT source_id, CASE WHEN source_id%13=0 THEN 'unknown_request_id' ELSE '' END AS code FROM sources")
def plan_observation(spark, d):
    plans = I.order_plans(spark, d)
    known = F.when(F.col("source_id") % 13 == 0, "other").otherwise(F.col("request_id"))
    seen = observations(spark, d).select(known.alias("request_id"), F.lit(True).alias("found"))
    return plans.join(seen, "request_id", "left").select("source_id", F.when(F.col("found").isNull(), "unknown_request_id").otherwise("").alias("code"))


@query("validate_pagination", SEQ + """
SELECT source_id, CASE drift WHEN 2 THEN 'unobserved_page_parameter' WHEN 7 THEN 'page_location_mismatch' WHEN 8 THEN 'page_location_mismatch' ELSE '' END AS code_query,
  CASE drift WHEN 7 THEN 'invalid_page_field_type' WHEN 8 THEN '' ELSE 'page_location_mismatch' END AS code_body FROM sources""")
def validate_pagination(spark, d):
    rule = lambda where: F.coalesce(V.page_location_rules(
        F.lit(where), F.lit("page"), F.col("method"), F.col("query"), F.col("request_body")), F.lit(""))
    return observations(spark, d).select("source_id", rule("query").alias("code_query"), rule("json_body").alias("code_body"))


@query("pointer_candidates", SEQ + """
SELECT source_id, CASE drift WHEN 5 THEN '/entries' WHEN 6 THEN '/entries,/others' ELSE '/rows' END AS items, '/total' AS total, '/more' AS has_next FROM sources""")
def pointer_candidates(spark, d):
    body = F.parse_json("body")
    pages = I.order_pages(spark, d).filter("page_no = 1")
    return pages.select("source_id", *[F.array_join(R.pointer_candidates(body, a), ",").alias(n) for a, n in (
        ("items_pointer", "items"), ("total_pointer", "total"), ("has_next_pointer", "has_next"))])


def audit(spark, d):
    checked = V.validate_plans(I.order_plans(spark, d), observations(spark, d), list(I.FIELDS), target_code=local_origin(F.col("url"))[1])
    failures = checked.filter("code IS NOT NULL").select("source_id", F.col("code").alias("error_code"))
    return R.repair_audit(failures, I.order_plans(spark, d), observations(spark, d), list(I.FIELDS), target_code=local_origin(F.col("url"))[1])


@query("relocate_pointer", SEQ + "SELECT source_id, CASE drift WHEN 5 THEN '/entries' ELSE '' END AS items_pointer FROM sources WHERE drift IN (5,6)")
def relocate_pointer(spark, d):
    return audit(spark, d).filter("error_code = 'pointer_not_found'").select(
        "source_id", F.when(F.size("modified_fields") > 0, F.col("candidate_items_pointer")).otherwise("").alias("items_pointer"))


@query("relocate_page", SEQ + "SELECT source_id, CASE drift WHEN 8 THEN 'json_body' ELSE '' END AS location, CASE drift WHEN 8 THEN 'valid' ELSE '' END AS result FROM sources WHERE drift IN (7,8)")
def relocate_page(spark, d):
    return audit(spark, d).filter("error_code = 'page_location_mismatch'").select(
        "source_id", F.when(F.size("modified_fields") > 0, F.col("candidate_pagination_location")).otherwise("").alias("location"),
        F.coalesce("validation_result", F.lit("")).alias("result"))


HASH = """sha256('{{"fields":{{"amount":"/amount","id":"/id","state":"/state"}},"has_next_pointer":' || CASE WHEN drift=8 THEN 'null' ELSE '"/more"' END ||
  ',"items_pointer":"' || {items} || '","page_parameter":"page","pagination_location":"' || {loc} || '","request_id":"req_' || source_id || '","total_pointer":' ||
  CASE WHEN drift=7 THEN 'null' ELSE '"/total"' END || ',"unique_key":"id"}}')"""


@query("repair_audit", SEQ + f"""
SELECT source_id, CASE WHEN drift IN (5,6) THEN 'pointer_not_found' WHEN drift IN (7,8) THEN 'page_location_mismatch' ELSE 'ValueError' END AS error_code,
  CASE WHEN drift IN (1,2,3) THEN 'unclassified' ELSE '' END AS rejection_code, CASE WHEN drift IN (1,2,3) THEN 'rejected' ELSE 'deferred' END AS outcome,
  CASE WHEN drift=5 THEN 'pointer_relocated' WHEN drift=8 THEN 'page_location_from_evidence' WHEN drift IN (6,7) THEN 'no_deterministic_candidate' ELSE '' END AS proposal_reason,
  CASE WHEN drift IN (5,8) THEN 'proposed' WHEN drift IN (6,7) THEN 'rejected' ELSE '' END AS proposal_outcome, drift=5 AS applicable,
  {HASH.format(items="'/rows'", loc="'query'")} AS original_plan_hash,
  CASE WHEN drift=5 THEN {HASH.format(items="'/entries'", loc="'query'")} WHEN drift=8 THEN {HASH.format(items="'/rows'", loc="'json_body'")} ELSE '' END AS candidate_plan_hash
FROM sources WHERE drift IN (1,2,3,5,6,7,8)""")
def repair_audit(spark, d):
    none = F.lit("")
    return audit(spark, d).select(
        "source_id", "error_code", F.coalesce("rejection_code", none).alias("rejection_code"), "outcome",
        F.coalesce("proposal_reason", none).alias("proposal_reason"), F.coalesce("proposal_outcome", none).alias("proposal_outcome"),
        "applicable", "original_plan_hash", F.coalesce("candidate_plan_hash", none).alias("candidate_plan_hash"))


@query("repair_policy", """
SELECT event_id, CASE event_id%6 WHEN 0 THEN 'not_repairable' WHEN 3 THEN 'not_repairable' WHEN 4 THEN 'unclassified' WHEN 5 THEN 'not_repairable'
  ELSE CASE WHEN event_id%4=3 THEN 'repair_budget_exhausted' WHEN event_id%5=2 THEN 'missing_original_plan' ELSE 'repairable' END END AS reason FROM events""")
def repair_policy(spark, d):
    from .admission import coded_events
    failures = coded_events(spark, d).withColumn("attempts", F.when(F.col("event_id") % 4 == 3, 1).otherwise(0)).withColumn(
        "original_plan_hash", F.when(F.col("event_id") % 5 != 2, F.lit("x")))
    return R.repair_policy(failures).select("event_id", F.col("policy_reason").alias("reason"))


@query("repair_and_rerun", outcome() + """
SELECT source_id, CASE WHEN drift=5 OR code IS NULL THEN 'succeeded' ELSE 'failed' END AS status, CASE WHEN drift=5 THEN '' ELSE coalesce(code,'') END AS error_code,
  CASE WHEN drift=5 OR code IS NULL THEN n ELSE 0 END AS count, CASE WHEN drift=5 THEN 'applied' WHEN code IS NOT NULL THEN 'rejected' ELSE '' END AS repair_outcome FROM outcome""")
def repair_and_rerun(spark, d):
    good = observations(spark, d).withColumns({
        "method": F.lit("GET"), "url": F.lit("http://127.0.0.1:8000/api"), "request_body": F.lit(None).cast("variant"),
        "query": F.create_map(F.lit("page"), F.lit("1"))})
    summary, _ = R.repair_and_rerun(I.order_pages(spark, d), I.order_plans(spark, d), good, list(I.FIELDS))
    return summary.select("source_id", "status", F.coalesce("error_code", F.lit("")).alias("error_code"), "count",
                          F.coalesce("repair_outcome", F.lit("")).alias("repair_outcome"))


# ---------------------------------------------------------------- scoring

def answers(spark, d):
    """Independent answers straight from the order table: counts and schema, and the ordered records."""
    doc = F.parse_json(F.to_json(F.struct("id", "amount", "state")))
    numbered = sequence_numbers(I.order_rows(spark, d), ["source_id"], ["id"], I._order_chunk(), "ordinal")
    rows = numbered.select(F.col("source_id").alias("task_id"), "ordinal", doc.alias("document"))
    counts = I.order_rows(spark, d).groupBy(F.col("source_id").alias("task_id")).agg(F.count("*").alias("record_count"))
    return counts.select(
        "task_id", "record_count", F.ceil(F.col("record_count") / I.PAGE_SIZE).alias("page_count"), F.lit("complete").alias("completeness"),
        F.create_map(*[F.lit(x) for x in ("id", "integer", "amount", "integer", "state", "string")]).alias("schema"),
        F.lit("id").alias("unique_key")), rows


def results(spark, d):
    run = run_collection(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS))
    reports = run.summary.select(F.col("source_id").alias("task_id"), "status", "pages", "completeness",
                                 *[F.lit(True).alias(f) if i < 2 else (F.col("source_id") % 3 != 0).alias(f) for i, f in enumerate(S.FLAGS)])
    doc = F.parse_json(F.to_json(F.struct(F.col("id").cast("bigint").alias("id"), F.col("amount").cast("bigint").alias("amount"), "state")))
    return reports, run.records.select(F.col("source_id").alias("task_id"), "ordinal", doc.alias("document"))


@query("task_success", outcome() + "SELECT source_id AS task_id, code IS NULL AND drift NOT IN (7,9) AS task_success FROM outcome")
def task_success(spark, d):
    reports, records = results(spark, d)
    return S.score_tasks(reports, records, *answers(spark, d)).select("task_id", "task_success")


@query("delivery_success", outcome() + """
SELECT source_id AS task_id, code IS NULL AND drift NOT IN (7,9) AND source_id%3<>0 AND source_id%7<>0 AS delivery_success FROM outcome""")
def delivery_success(spark, d):
    """The second collection of every seventh task has another first row."""
    reports, records = results(spark, d)
    second = records.withColumn("document", F.when((F.col("task_id") % 7 == 0) & (F.col("ordinal") == 1), F.parse_json(F.lit('{"id":0}')))
                                .otherwise(F.col("document")))
    return S.score_tasks(reports, records, *answers(spark, d), reports, second).select("task_id", "delivery_success")


@query("expected_rejection", outcome() + """
SELECT source_id, code IS NOT NULL AND code IN ('duplicate_id','total_changed') AND source_id%4<>1 AS passed FROM outcome""")
def expected_rejection(spark, d):
    summary = run_collection(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS)).summary
    df = classify(summary).withColumn("requests", F.when(F.col("source_id") % 4 != 1, F.col("pages")))
    return df.select("source_id", S.expected_rejection(
        F.col("status"), F.col("error_code"), F.col("phase"), F.col("requests"), F.lit(None).cast("string"),
        F.array(F.lit("duplicate_id"), F.lit("total_changed")), F.lit("executing"), F.lit(None).cast("string"), F.lit(10)).alias("passed"))


@query("benchmark_grade", outcome() + "SELECT source_id, source_id%7<>0 AS passed FROM outcome")
def benchmark_grade(spark, d):
    """Expectations from the order table; those of every seventh task are wrong."""
    n = I.order_rows(spark, d).groupBy("source_id").agg(F.count("*").alias("n"))
    k, pages = F.col("source_id") % 10, F.ceil(F.col("n") / I.PAGE_SIZE)
    many = F.col("n") > I.PAGE_SIZE
    kind = (F.when(k.isin(5, 6), "pointer_not_found").when((k == 1) & many, "duplicate_id").when((k == 2) & many, "total_changed")
            .when((k == 3) & many, "field_type_changed").when((k == 4) & many, "empty_page_with_next").when(k == 9, "incomplete_items"))
    off = F.when(F.col("source_id") % 7 == 0, 1).otherwise(0)
    expected = n.select("source_id", kind.isNotNull().alias("should_fail"), F.when(off == 0, kind).otherwise("other").alias("failure_kind"),
                        (F.col("n") + off).alias("record_count"), pages.alias("page_count"),
                        F.when(k == 7, "stop_condition_only").otherwise("complete").alias("expected_completeness"))
    summary = run_collection(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS)).summary
    return S.benchmark_grade(summary, expected)


@query("compare_results", SEQ + """
SELECT source_id AS task_id, drift<>1 AS record_count, drift<>2 AND NOT (drift=1 AND n=1) AS field_types, drift NOT IN (1,2,3) AS records, drift<>4 AS pages,
  drift NOT IN (1,2,3,4) AS matches FROM sources""")
def compare_results(spark, d):
    """The second result set misses a row (1), has other types (2), another value (3) or page count (4)."""
    # The rows are narrow and their documents are not, so they are dealt by number: splits by bytes hold millions of them.
    rows = I.dealt(I.order_rows(spark, d), "source_id").withColumn("task_id", F.col("source_id"))
    many = rows.groupBy("task_id").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    rows = rows.join(many, "task_id")
    k = F.col("task_id") % 10
    doc = lambda amount: F.parse_json(F.to_json(F.struct("id", amount.alias("amount"), "state"))).alias("document")
    left = rows.select("task_id", F.col("id").alias("ordinal"), doc(F.col("amount")))
    first = F.col("id") == F.col("low")
    right = rows.filter((k != 1) | ~first).select("task_id", F.col("id").alias("ordinal"), F.when(k == 2, doc(F.col("amount").cast("string"))).when(
        (k == 3) & first, doc(F.col("amount") + 1)).otherwise(doc(F.col("amount"))).alias("document"))
    facts = many.select("task_id", F.ceil(F.col("n") / 5).alias("pages"), F.lit("complete").alias("completeness"), F.col("n").alias("expected_total"))
    other = facts.withColumn("pages", F.col("pages") + F.when(k == 4, 1).otherwise(0))
    out = S.compare_results(facts, other, left, right, "id")
    return out.select("task_id", "record_count", "field_types", "records", "pages", "matches")
