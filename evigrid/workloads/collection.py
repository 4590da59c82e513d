"""Queries: paged JSON extraction, page and record integrity, paging, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_values as J, walks
from ..operators import collect as C, validate as V, windows as W
from ..plans.specs import ExtractionPlan, FieldSpec
from ..sources import pages as P
from . import inputs as I
from .registry import query

# The captured pages as SQL, straight from the base table.
SEQ = """
WITH seq AS (SELECT o_custkey AS source_id, o_orderkey AS id, CAST(round(o_totalprice*100) AS BIGINT) AS amount,
    o_orderstatus AS state, o_custkey % 10 AS drift,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn,
    count(*) OVER (PARTITION BY o_custkey) AS n,
    min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_id FROM orders),
paged AS (SELECT *, CAST((rn-1)//5+1 AS INTEGER) AS page_no, CAST((rn-1)%5 AS INTEGER) AS pos FROM seq),
sources AS (SELECT source_id, drift, n, (n+4)//5 AS n_pages FROM seq WHERE rn=1),
page_rows AS (SELECT source_id, page_no, any_value(drift) AS drift, any_value(n) AS n, count(*) AS n_rows
    FROM paged GROUP BY ALL),
items AS (SELECT source_id, page_no, pos, rn, n, drift, amount, state,
    CASE WHEN drift=1 AND page_no=2 AND pos=0 THEN first_id ELSE id END AS id
    FROM paged WHERE drift NOT IN (5,6) AND NOT (drift=4 AND page_no=2))
"""
OUTCOME = """
, outcome AS (SELECT source_id, drift, n, n_pages,
    CASE WHEN drift IN (5,6) THEN 'pointer_not_found'
         WHEN drift=1 AND n>5 THEN 'duplicate_id' WHEN drift=2 AND n>5 THEN 'total_changed'
         WHEN drift=3 AND n>5 THEN 'field_type_changed' WHEN drift=4 AND n>5 THEN 'empty_page_with_next'
         WHEN drift=9 THEN 'incomplete_items' END AS code,
    CASE WHEN drift IN (5,6) THEN 0 WHEN drift=9 THEN n_pages ELSE 2 END AS code_page FROM sources)
"""


def outcome():
    return SEQ + OUTCOME


def checked(spark, d, **options):
    return C.check_pages(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS), **options)


def page_level(df):
    return df.filter("pos IS NULL OR pos = 0")


@query("run_collection", outcome() + """
SELECT source_id, CASE WHEN code IS NULL THEN 'succeeded' ELSE 'failed' END AS status, coalesce(code,'') AS error_code,
  CAST(CASE WHEN code IS NOT NULL THEN 0 ELSE n END AS BIGINT) AS count,
  CAST(CASE WHEN code IS NOT NULL THEN code_page ELSE n_pages END AS BIGINT) AS pages,
  CAST(coalesce(CASE WHEN code IS NULL AND drift<>7 THEN n + CAST(drift=9 AS INTEGER) END, -1) AS BIGINT) AS expected_total,
  CASE WHEN code IS NOT NULL THEN '' WHEN drift=7 THEN 'stop_condition_only'
       ELSE 'complete' END AS completeness FROM outcome""")
def run_collection(spark, d):
    run = C.run_collection(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS))
    return run.summary.select(
        "source_id", "status", F.coalesce("error_code", F.lit("")).alias("error_code"), "count", "pages",
        F.coalesce("expected_total", F.lit(-1)).alias("expected_total"),
        F.coalesce("completeness", F.lit("")).alias("completeness"))


@query("collected_records", outcome() + """
SELECT i.source_id, i.page_no, i.pos, i.id, i.amount, i.state FROM items i JOIN outcome o USING (source_id)
WHERE o.code IS NULL""")
def collected_records(spark, d):
    specs = (FieldSpec("id", "integer"), FieldSpec("amount", "integer"), FieldSpec("state", "string", False))
    run = C.run_collection(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS), specs=specs)
    return run.records.select("source_id", "page_no", "pos", "id", "amount", "state")


@query("collection_summary", outcome() + """
SELECT coalesce(code, CASE WHEN drift=7 THEN 'stop_condition_only' ELSE 'complete' END) AS outcome, false AS record_limit_reached, count(*) AS sources,
  CAST(sum(CASE WHEN code IS NOT NULL THEN 0 ELSE n END) AS BIGINT) AS records
FROM outcome GROUP BY ALL""")
def collection_summary(spark, d):
    run = C.run_collection(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS))
    return run.summary.groupBy(F.coalesce("completeness", "error_code").alias("outcome"), "record_limit_reached").agg(
        F.count("*").alias("sources"), F.sum("count").alias("records"))


@query("scan_json_pages", SEQ + "SELECT source_id, count(*) AS pages, CAST(0 AS BIGINT) AS rejected FROM page_rows GROUP BY ALL")
def scan_json_pages(spark, d):
    return C.scan_json_pages(I.order_pages(spark, d)).groupBy("source_id").agg(
        F.count("*").alias("pages"), F.count_if(F.col("reject").isNotNull()).alias("rejected"))


@query("scan_text_bodies", """
SELECT doc_id, CASE WHEN octet_length(encode(text)) > 16384 THEN 'response_too_large' ELSE 'expected_json' END AS reject
FROM documents""")
def scan_text_bodies(spark, d):
    """Prose offered as JSON bodies: all of it must be refused."""
    docs = I.table(spark, d, "documents").select("doc_id", F.col("text").alias("body"))
    return C.scan_json_pages(docs, limit=16384).select("doc_id", "reject")


@query("pointer_get", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def pointer_get(spark, d):
    events = I.table(spark, d, "events")
    return events.select("event_id", J.as_text(J.pointer_get(F.parse_json("props"), "/k")).cast("bigint").alias("k"))


@query("field_value", SEQ + """
SELECT source_id, page_no, CASE WHEN drift IN (5,6) OR (drift=4 AND page_no=2) THEN 'pointer_not_found' ELSE '' END AS violation,
  coalesce(max(CASE WHEN pos=0 AND drift NOT IN (5,6) AND NOT (drift=4 AND page_no=2)
    THEN CASE WHEN drift=1 AND page_no=2 THEN first_id ELSE id END END), -1) AS first_id
FROM paged GROUP BY ALL""")
def field_value(spark, d):
    pages = I.order_pages(spark, d).withColumn("doc", F.parse_json("body"))
    value, code = J.field_value(F.col("doc"), "/rows/0/id")
    return pages.select("source_id", "page_no", F.coalesce(code, F.lit("")).alias("violation"),
                        F.coalesce(J.as_text(value).cast("bigint"), F.lit(-1)).alias("first_id"))


PLAN = ExtractionPlan("req_001", "/rows", dict(I.FIELDS), "id", has_next_pointer="/more", total_pointer="/total")


@query("extract_items", SEQ + """
SELECT source_id, page_no, pos, id, CAST(amount AS VARCHAR) AS amount, state, '' AS reject FROM items UNION ALL
SELECT DISTINCT source_id, page_no, -1, -1, '', '', 'pointer_not_found' FROM paged WHERE drift IN (5,6)""")
def extract_items(spark, d):
    """Items, and one row for a page whose list is not where the plan says."""
    items = C.extract_items(I.order_pages(spark, d), PLAN)
    none = F.lit("")
    return items.select("source_id", "page_no", F.coalesce("pos", F.lit(-1)).alias("pos"), F.coalesce(J.as_text(F.col("id")).cast("bigint"), F.lit(-1)).alias("id"),
                        *[F.coalesce(J.as_text(F.col(c)), none).alias(c) for c in ("amount", "state")], F.coalesce("reject", none).alias("reject"))


@query("preview_sample", SEQ + """
SELECT source_id, pos, id, 'integer,integer,string' AS types FROM items WHERE page_no=1 AND rn<=5""")
def preview_sample(spark, d):
    first = I.order_pages(spark, d).filter("page_no = 1")
    items = C.extract_items(first, PLAN).filter("reject IS NULL AND pos < 5")
    return items.select("source_id", "pos", J.as_text(F.col("id")).cast("bigint").alias("id"),
                        F.concat_ws(",", *[J.type_tag(F.col(n)) for n in I.FIELDS]).alias("types"))


@query("dup_key", SEQ + "SELECT source_id, page_no, pos, id FROM items WHERE drift=1 AND page_no=2 AND pos=0")
def dup_key(spark, d):
    return checked(spark, d).filter("key_seen_before").select(
        "source_id", "page_no", "pos", F.col("_cell.id.s").cast("bigint").alias("id"))


@query("total_changed", SEQ + """
, totals AS (SELECT source_id, page_no, CASE WHEN drift<>7 THEN n + CAST(drift=9 OR (drift=2 AND page_no>1) AS INTEGER) END AS total
  FROM page_rows)
SELECT source_id, page_no, CAST(coalesce(total,-1) AS BIGINT) AS total,
  coalesce(total <> lag(total) OVER (PARTITION BY source_id ORDER BY page_no), false) AS changed FROM totals""")
def total_changed(spark, d):
    return page_level(checked(spark, d)).select(
        "source_id", "page_no", F.coalesce("total", F.lit(-1)).alias("total"),
        F.coalesce(F.col("total") != F.col("previous_total"), F.lit(False)).alias("changed"))


@query("type_changed", SEQ + "SELECT source_id, page_no, pos FROM items WHERE drift=3 AND page_no>1")
def type_changed(spark, d):
    return checked(spark, d).filter("item_event.code = 'field_type_changed'").select(
        "source_id", "page_no", "pos")


@query("running_count", SEQ + """
, counts AS (SELECT source_id, page_no, drift, n, CASE WHEN drift IN (5,6) OR (drift=4 AND page_no=2) THEN 0 ELSE n_rows END AS k
  FROM page_rows)
SELECT source_id, page_no, CAST(sum(k) OVER (PARTITION BY source_id ORDER BY page_no) AS BIGINT) AS running_count FROM counts""")
def running_count(spark, d):
    return page_level(checked(spark, d)).select("source_id", "page_no", "running_count")


@query("stop_page", SEQ + """
SELECT source_id, CAST(CASE WHEN drift=4 AND n_pages=2 THEN -1 WHEN drift IN (5,6) THEN n_pages ELSE n_pages END AS BIGINT) AS stop_page
FROM sources""")
def stop_page(spark, d):
    pages = page_level(checked(spark, d))
    return pages.groupBy("source_id").agg(
        F.coalesce(F.min(F.when(~F.col("more"), F.col("page_no"))), F.lit(-1)).cast("bigint").alias("stop_page"))


@query("first_violation", outcome() + """
SELECT source_id, code, CAST(code_page AS BIGINT) AS page FROM outcome WHERE code IS NOT NULL""")
def first_violation(spark, d):
    run = C.run_collection(I.order_pages(spark, d), I.order_plans(spark, d), list(I.FIELDS))
    return run.violations.select("source_id", F.col("error_code").alias("code"), F.col("error_page").cast("bigint").alias("page"))


@query("paginate", SEQ + "SELECT source_id, page_no, pos, id, page_no*5 < n AS has_next FROM paged")
def paginate(spark, d):
    rows = W.paginate(I.order_rows(spark, d), ["source_id"], ["id"], I.PAGE_SIZE, I._order_chunk())
    return rows.select("source_id", "page_no", "pos", "id", "has_next")


@query("record_page_caps", SEQ + "SELECT source_id, page_no, pos, id FROM items WHERE page_no<=2 AND rn<=7")
def record_page_caps(spark, d):
    pages = P.cap_page_numbers(I.order_pages(spark, d), 2)
    items = P.cap_pages(C.extract_items(pages, PLAN).filter("reject IS NULL"), 7)
    return items.select("source_id", "page_no", "pos", J.as_text(F.col("id")).cast("bigint").alias("id"))


@query("json_type", """
SELECT event_id, CASE json_type(props) WHEN 'OBJECT' THEN 'object' END AS body_type,
  CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number'
    WHEN 'VARCHAR' THEN 'string' ELSE 'missing' END AS k_type FROM events""")
def json_type(spark, d):
    doc = F.parse_json("props")
    return I.table(spark, d, "events").select("event_id", J.type_tag(doc).alias("body_type"),
                                              J.type_tag(J.pointer_get(doc, "/k")).alias("k_type"))


@query("canonical_json", """
SELECT o_orderkey, sha256('{"amount":' || CAST(round(o_totalprice*100) AS BIGINT) || ',"id":' || o_orderkey ||
  ',"priority":"' || o_orderpriority || '"}') AS digest FROM orders""")
def canonical_json(spark, d):
    """Members written out of order; the digest must not see it."""
    row = F.struct(F.col("o_orderpriority").alias("priority"), F.col("o_orderkey").alias("id"),
                   F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"))
    return I.table(spark, d, "orders").select("o_orderkey", J.digest(F.parse_json(F.to_json(row))).alias("digest"))


@query("digest", """
SELECT event_id, sha256('{"type":"' || event_type || '","value":' || CAST(value AS VARCHAR) || '}') AS digest FROM events""")
def digest(spark, d):
    """Digests that keep a written ``1.0`` apart from ``1``."""
    body = F.to_json(F.struct("value", F.col("event_type").alias("type")))
    return I.table(spark, d, "events").select("event_id", J.exact_digest(body).alias("digest"))


@query("structure_paths", SEQ + """
, heads AS (SELECT source_id, page_no, drift, CASE WHEN drift IN (5,6) THEN 'entries' ELSE 'rows' END AS list_key,
  drift=4 AND page_no=2 AS blank, drift=3 AND page_no>1 AS textual FROM page_rows)
SELECT source_id, page_no, path, type, CAST(count(*) AS BIGINT) AS members FROM (
  SELECT h.source_id, h.page_no, '/'||list_key AS path, 'array' AS type FROM heads h
  UNION ALL SELECT source_id, page_no, '/total', 'integer' FROM heads
  UNION ALL SELECT source_id, page_no, '/more', 'boolean' FROM heads
  UNION ALL SELECT source_id, page_no, '/others', 'array' FROM heads WHERE drift=6
  UNION ALL SELECT h.source_id, h.page_no, '/'||k||'/'||f, CASE WHEN f='state' THEN 'string'
      WHEN f='amount' AND h.textual THEN 'string' ELSE 'integer' END
    FROM heads h JOIN paged p USING (source_id, page_no), (VALUES ('id'),('amount'),('state')) t(f),
      (SELECT unnest(['rows','entries','others']) AS k)
    WHERE NOT blank AND (k=list_key OR (k='others' AND h.drift=6))) GROUP BY ALL""")
def structure_paths(spark, d):
    pages = I.order_pages(spark, d).select("source_id", "page_no", F.explode(
        walks.structure_members(F.parse_json("body"))).alias("m"))
    return pages.groupBy("source_id", "page_no", "m.path", "m.type").agg(F.count("*").alias("members"))


@query("sensitive_keys", """
SELECT doc_id, regexp_matches(regexp_extract(text, '^\\S+'), '(?i)password|passwd|secret|token|authorization|cookie|api.?key|email|phone')
  OR doc_id % 7 = 0 AS sensitive FROM documents""")
def sensitive_keys(spark, d):
    """First word of every document as a member name two levels down; every 7th body is too deep to be cleared."""
    word = F.regexp_extract("text", r"^[^ \t\n\r\f]+", 0)
    flat = F.to_json(F.struct(F.array(F.create_map(word, F.col("doc_id"))).alias("rows")))
    deep = F.lit('{"a":{"a":{"a":{"a":{"a":{"a":{"a":1}}}}}}}')
    docs = I.table(spark, d, "documents")
    return docs.select("doc_id", walks.sensitive_keys(F.parse_json(
        F.when(F.col("doc_id") % 7 == 0, deep).otherwise(flat))).alias("sensitive"))


TAIL = '"total": "<integer>", "more": "<boolean>"}'
ROW = '[{"id": "<integer>", "amount": "<integer>", "state": "<string>"}]'


@query("shape", SEQ + f"""
SELECT CASE WHEN drift=5 THEN '{{"entries": {ROW}, {TAIL}' WHEN drift=6 THEN '{{"entries": {ROW}, "others": {ROW}, {TAIL}'
  WHEN drift=4 AND page_no=2 THEN '{{"rows": [], {TAIL}' WHEN drift=3 AND page_no>1 THEN replace('{{"rows": {ROW}, {TAIL}', '"amount": "<integer>"', '"amount": "<string>"')
  ELSE '{{"rows": {ROW}, {TAIL}' END AS shape, count(*) AS pages FROM page_rows GROUP BY 1""")
def shape(spark, d):
    pages = I.order_pages(spark, d)
    return pages.groupBy(walks.shape("body").alias("shape")).agg(F.count("*").alias("pages"))


@query("missing_counts", """
SELECT f AS field, CAST(CASE f WHEN 'quality' THEN (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL)
  ELSE (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL) END AS BIGINT) AS missing
FROM (VALUES ('quality'),('toxic')) t(f)""")
def missing_counts(spark, d):
    rows = I.table(spark, d, "documents").select("doc_id").join(I.table(spark, d, "labels"), "doc_id", "left")
    return V.missing_counts(rows, ["quality", "toxic"])


@query("verify_fields", SEQ + """
SELECT source_id, page_no, pos, 'amount' AS field, 'requested_field_type_mismatch' AS code FROM items WHERE drift=3 AND page_no>1""")
def verify_fields(spark, d):
    items = C.scan_json_pages(I.order_pages(spark, d)).select("source_id", "page_no", F.posexplode(
        J.as_array(J.pointer_get(F.col("document"), "/rows"))).alias("pos", "document"))
    specs = [FieldSpec("id", "integer"), FieldSpec("amount", "number"), FieldSpec("state", "string")]
    return V.verify_fields(items, specs, ["source_id", "page_no", "pos"]).drop("check")


@query("finite_check", """
SELECT event_id, event_id % 97 <> 0 AS finite FROM events""")
def finite_check(spark, d):
    """Values whose divisor vanishes are not finite."""
    value = F.when(F.col("event_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return I.table(spark, d, "events").select("event_id", V.is_finite(value).alias("finite"))


@query("dedupe_rows", "SELECT min(doc_id) AS doc_id, lang, sha256(text) AS text_digest FROM documents GROUP BY lang, text")
def dedupe_rows(spark, d):
    docs = I.table(spark, d, "documents").select("lang", "text", "doc_id")
    return V.keep_first(docs, [], ["lang", "text"], ["doc_id"]).select(
        "doc_id", "lang", F.sha2("text", 256).alias("text_digest"))


@query("duplicates_removed", "SELECT lang, count(*) - count(DISTINCT text) AS duplicates_removed FROM documents GROUP BY lang")
def duplicates_removed(spark, d):
    return V.duplicates_removed(I.table(spark, d, "documents"), ["lang"], ["text"])


@query("admissible_summary_fields", """
SELECT p_partkey, CASE WHEN p_partkey <= 0 THEN 'invalid_id' WHEN p_partkey % 11 = 0 THEN 'invalid_name'
  WHEN p_partkey % 13 = 0 THEN 'invalid_price' ELSE '' END AS code FROM part""")
def admissible_summary_fields(spark, d):
    part = I.table(spark, d, "part")
    row = F.struct(F.col("p_partkey").alias("id"),
                   F.when(F.col("p_partkey") % 11 == 0, F.lit("")).otherwise(F.col("p_name")).alias("name"),
                   F.when(F.col("p_partkey") % 13 == 0, F.lit(-1)).otherwise(F.lit(100)).alias("price_fen"))
    return part.select("p_partkey", F.coalesce(V.product_rules(F.parse_json(F.to_json(row))), F.lit("")).alias("code"))
