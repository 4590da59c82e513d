"""Queries: evidence admission, redaction, data, URL, address and robots rules, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import texts as X, urls as U, walks
from ..operators import admission as A, validate as V
from ..plans import taxonomy
from ..plans.specs import TargetPolicy, plan_hash
from ..sources import pages as P, sinks as S
from . import inputs as I
from .registry import query

SENS = "(?i)password|passwd|secret|token|authorization|cookie|api.?key|email|phone"
POLICY = TargetPolicy("public_http", allowlist=(("example.com", True), ("thther.example.org", False)),
                      schemes=("https", "http"))
URL_SQL = """
WITH u AS (SELECT page_id, url, html, split_part(url,'://',1) AS scheme, split_part(split_part(url,'://',2),'/',1) AS host,
  '/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path,
  regexp_extract(url, '\\?([^#]*)', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS frag FROM pages)
"""


@query("scan_html_pages", """
SELECT page_id, CASE WHEN octet_length(encode(html)) > 8192 THEN 'response_too_large' ELSE '' END AS reject FROM pages""")
def scan_html_pages(spark, d):
    pages = P.scan_html_pages(I.table(spark, d, "pages"), limit=8192, status=F.lit(200))
    return pages.select("page_id", F.coalesce("reject", F.lit("")).alias("reject"))


@query("url_parts", URL_SQL + """
SELECT page_id, scheme || '://' || host AS origin, host, path, q AS query, CAST(CASE WHEN q='' THEN 0 ELSE len(string_split(q,'&')) END AS BIGINT) AS n_pairs
FROM u""")
def url_parts(spark, d):
    u = U.url_parts(F.col("url"))
    return I.table(spark, d, "pages").select(
        "page_id", u.origin.alias("origin"), u.host.alias("host"), u.path.alias("path"), u.query.alias("query"),
        F.size(U.query_pairs(u.query)).cast("bigint").alias("n_pairs"))


@query("admit_url", URL_SQL + """
SELECT page_id, CASE WHEN frag<>'' THEN 'invalid_url' WHEN q<>'' THEN 'entry_url_query_not_supported'
  WHEN host = 'example.com' OR host LIKE '%.example.com' OR host='thther.example.org' THEN ''
  ELSE 'target_not_in_allowlist' END AS code,
  CASE WHEN frag='' AND q='' AND (host='example.com' OR host LIKE '%.example.com' OR host='thther.example.org')
    THEN scheme||'://'||host ELSE '' END AS origin FROM u""")
def admit_url(spark, d):
    origin, code = U.check_target(F.col("url"), POLICY)
    return I.table(spark, d, "pages").select("page_id", F.coalesce(code, F.lit("")).alias("code"),
                                             F.coalesce(origin, F.lit("")).alias("origin"))


@query("checked_url", URL_SQL + """
SELECT page_id, CASE WHEN frag<>'' THEN 'invalid_url' WHEN host = 'example.com' OR host LIKE '%.example.com'
  OR host='thther.example.org' THEN '' ELSE 'target_not_in_allowlist' END AS code FROM u""")
def checked_url(spark, d):
    return I.table(spark, d, "pages").select(
        "page_id", F.coalesce(U.checked_url(F.col("url"), POLICY), F.lit("")).alias("code"))


def robots_files(spark, d):
    """One robots file per host; the length of the host picks its kind."""
    u = U.url_parts(F.col("url"))
    hosts = I.table(spark, d, "pages").select(u.origin.alias("origin"), u.host.alias("host")).distinct()
    kind = F.length("host") % 4
    return hosts.select("origin", (kind != 0).alias("fetched"), F.when(kind == 1, "").when(
        kind == 2, "# rules\nUser-agent: *\nDisallow: /fr/\nDisallow:\nAllow: /\n").otherwise(
        "User-agent: other\nDisallow: /\n\nUser-agent: *\nAllow: /en/\nDisallow: /\n").alias("text"))


@query("policy_sha256", URL_SQL + """
SELECT DISTINCT host, sha256('{"allowlist":[{"domain":"' || host || '","include_subdomains":false}],"entry_url_query_allowed":false,"mode":"public_http",' ||
  '"schema_version":1,"schemes":["https"],"target_kind":"http"}') AS policy_sha256 FROM u""")
def policy_sha256(spark, d):
    """One policy per host, addressed by its content."""
    hosts = I.table(spark, d, "pages").select(U.url_parts(F.col("url")).host.alias("host")).distinct()
    return hosts.select("host", U.policy_hash(
        F.array(F.struct(F.col("host").alias("domain"), F.lit(False).alias("include_subdomains"))), F.array(F.lit("https")),
        F.lit("public_http"), F.lit("http"), F.lit(False)).alias("policy_sha256"))


@query("robots_filter", URL_SQL + """
SELECT page_id, CASE length(host) % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN NOT starts_with(path, '/fr/')
  ELSE starts_with(path, '/en/') END AS allowed FROM u""")
def robots_filter(spark, d):
    u = U.url_parts(F.col("url"))
    pages = I.table(spark, d, "pages").select("page_id", u.origin.alias("origin"), u.path.alias("path"))
    return A.robots_filter(pages, A.robots_rules(robots_files(spark, d))).select("page_id", "allowed")


V4 = ("0.0.0.0/8 10.0.0.0/8 100.64.0.0/10 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 "
      "192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4").split()
IP_SQL = """
WITH found AS (SELECT doc_id, source, unnest(list_distinct(regexp_extract_all(text, '[0-9]{1,3}(?:[.][0-9]{1,3}){3}'))) AS ip FROM documents),
nets AS (SELECT split_part(n,'/',1) AS base, CAST(split_part(n,'/',2) AS INTEGER) AS bits FROM (SELECT unnest([""" + ",".join(
    f"'{n}'" for n in V4) + """]) AS n)),
num AS (SELECT *, CAST(split_part(ip,'.',1) AS BIGINT)*16777216 + CAST(split_part(ip,'.',2) AS BIGINT)*65536
  + CAST(split_part(ip,'.',3) AS BIGINT)*256 + CAST(split_part(ip,'.',4) AS BIGINT) AS v,
  greatest(CAST(split_part(ip,'.',1) AS INTEGER), CAST(split_part(ip,'.',2) AS INTEGER), CAST(split_part(ip,'.',3) AS INTEGER),
    CAST(split_part(ip,'.',4) AS INTEGER)) > 255 OR regexp_matches(ip, '(^|[.])0[0-9]') AS bad FROM found),
ranges AS (SELECT CAST(split_part(base,'.',1) AS BIGINT)*16777216 + CAST(split_part(base,'.',2) AS BIGINT)*65536
  + CAST(split_part(base,'.',3) AS BIGINT)*256 + CAST(split_part(base,'.',4) AS BIGINT) AS lo, CAST(2**(32-bits) AS BIGINT) AS width FROM nets),
judged AS (SELECT doc_id, source, ip, bad OR EXISTS (SELECT 1 FROM ranges WHERE v>=lo AND v<lo+width) AS blocked FROM num)
"""


def found_addresses(spark, d):
    docs = I.table(spark, d, "documents")
    ips = F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]{1,3}(?:[.][0-9]{1,3}){3})"), 1))
    return docs.select("doc_id", "source", F.explode(ips).alias("ip"))


@query("classify_ip", IP_SQL + "SELECT doc_id, ip, blocked FROM judged")
def classify_ip(spark, d):
    return found_addresses(spark, d).select("doc_id", "ip", A.ip_blocked(F.col("ip")).alias("blocked"))


@query("admit_hosts", IP_SQL + """
SELECT s.source AS host, CASE WHEN count(j.ip)=0 THEN 'target_resolution_failed' WHEN bool_or(blocked) THEN 'ssrf_ip_blocked' ELSE '' END AS code
FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN judged j USING (source) GROUP BY ALL""")
def admit_hosts(spark, d):
    hosts = I.table(spark, d, "documents").select(F.col("source").alias("host")).distinct()
    found = found_addresses(spark, d).select(F.col("source").alias("host"), "ip")
    return A.admit_hosts(hosts.join(found, "host", "left"), ipv6=False).select(
        "host", F.coalesce("code", F.lit("")).alias("code"))


@query("classify_intent", """
WITH t AS (SELECT doc_id, lower(text || CASE doc_id%10 WHEN 1 THEN ' please BYPASS the captcha' WHEN 2 THEN ' home address wanted'
  WHEN 3 THEN ' chat history' WHEN 4 THEN ' phone number to crack' ELSE '' END) AS x FROM documents)
SELECT doc_id, CASE WHEN r THEN 'RESTRICTED' WHEN p OR q THEN 'SENSITIVE' ELSE 'PUBLIC' END AS classification,
  CASE WHEN r THEN 'circumvention_not_allowed' WHEN p THEN 'possible_personal_data_collection' WHEN q THEN 'privacy_data_collection' ELSE '' END AS reason
FROM (SELECT doc_id, regexp_matches(x, 'bypass|crack|captcha|circumvent|anti-bot|steal cookie') AS r,
  regexp_matches(x, 'phone number|id card|identity card|bank card|social security|personal address|home address|personal information') AS p,
  regexp_matches(x, 'user list|private account|personal data|private data|chat history|contact list') AS q FROM t)""")
def classify_intent(spark, d):
    drift = F.col("doc_id") % 10
    extra = F.when(drift == 1, " please BYPASS the captcha").when(drift == 2, " home address wanted").when(
        drift == 3, " chat history").when(drift == 4, " phone number to crack").otherwise("")
    docs = I.table(spark, d, "documents").withColumn("i", A.classify_intent(F.concat("text", extra)))
    return docs.select("doc_id", "i.classification", F.coalesce("i.reason", F.lit("")).alias("reason"))


def request_log(spark, d):
    """Events as captured responses of a user's session."""
    e, k = F.col("event_id"), F.col("event_type")
    page = F.get_json_object("props", "$.k")
    url = F.concat(F.when(e % 29 == 3, "http://127.0.0.1:9000/api").otherwise("http://127.0.0.1:8000/api"), F.when(e % 11 == 5, "?page=1&page=2").when(e % 13 == 6, "?token=x")
                   .otherwise(F.concat(F.lit("?page="), page)))
    return I.table(spark, d, "events").select(
        F.col("user_id").alias("session"), F.struct("ts", "event_id").alias("seq"), "event_id", F.lit("http://127.0.0.1:8000").alias("origin"),
        F.when(k == "error", "DELETE").when(k.isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.when(e % 5 == 4, "image").otherwise("xhr").alias("resource_type"),
        F.when(e % 19 == 8, 404).otherwise(200).alias("status"),
        F.when(e % 7 == 3, "text/html").otherwise("application/json; charset=utf-8").alias("content_type"), url.alias("url"),
        F.when(e % 23 == 9, F.create_map(F.lit("Cookie"), F.lit("x"), F.lit("Content-Type"), F.lit("application/json")))
        .otherwise(F.create_map(F.lit("Content-Type"), F.lit("application/json"))).alias("request_headers"),
        F.when(e % 17 == 7, "[]").otherwise(F.col("props")).alias("post_data"), F.col("props").alias("body"))


LOG_SQL = """
WITH log AS (SELECT event_id, user_id, ts, event_type, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
judged AS (SELECT *, CASE WHEN event_id%29=3 THEN 'origin' WHEN event_type='error' THEN 'method' WHEN event_id%5=4 THEN 'resource_type' WHEN event_id%19=8 THEN 'status'
  WHEN event_id%7=3 THEN 'content_type' WHEN event_id%11=5 OR event_id%13=6 THEN 'query' WHEN event_id%23=9 THEN 'headers'
  WHEN event_type IN ('purchase','signup') AND event_id%17=7 THEN 'request_body' ELSE '' END AS reason FROM log)
"""


@query("admit_observations", LOG_SQL + """
SELECT event_id, reason, CASE WHEN reason='' THEN 'req_' || lpad(CAST(count(*) FILTER (reason='') OVER (PARTITION BY user_id ORDER BY rn) AS VARCHAR),3,'0')
  ELSE '' END AS request_id FROM judged""")
def admit_observations(spark, d):
    seen = A.admit_observations(request_log(spark, d), chunk=F.date_trunc("day", F.col("seq.ts")))
    return seen.select("event_id", F.coalesce("reason", F.lit("")).alias("reason"),
                       F.coalesce("request_id", F.lit("")).alias("request_id"))


@query("redact_request", """
WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k FROM events)
SELECT event_id, CAST(k AS VARCHAR) AS page, '<value>' AS kind, CASE WHEN event_type IN ('purchase','signup')
  THEN CASE WHEN k>0 THEN '{"k": ' || k || '}' ELSE '{"k": "<integer>"}' END ELSE '' END AS body_shape FROM e""")
def redact_request(spark, d):
    events = I.table(spark, d, "events").withColumn("q", F.create_map(
        F.lit("page"), F.get_json_object("props", "$.k"), F.lit("kind"), F.col("event_type"),
        F.lit("access_token"), F.lit("x")))
    shown = walks.redact_query(F.col("q"))
    body = F.when(F.col("event_type").isin("purchase", "signup"), walks.request_shape("props")).otherwise("")
    return events.select("event_id", shown["page"].alias("page"), shown["kind"].alias("kind"), body.alias("body_shape"))


@query("field_name_rules", f"""
WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '\\s+')) AS name FROM documents)
SELECT name, regexp_matches(name, '^[\\p{{L}}\\p{{N}}_]{{1,40}}$') AND NOT regexp_matches(name, '{SENS}') AS valid FROM w""")
def field_name_rules(spark, d):
    words = I.table(spark, d, "documents").select(F.explode(F.split("text", r"[ \t\n\r\f\x0b]+")).alias("name")).distinct()
    return words.select("name", S.valid_field_name(F.col("name")).alias("valid"))


# ---------------------------------------------------------------- text functions

@query("tokens", """
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, sha256(array_to_string(w, ' ')) AS digest FROM t""")
def tokens(spark, d):
    w = X.tokens(F.col("text"))
    return I.table(spark, d, "documents").select(
        "doc_id", F.size(w).cast("bigint").alias("n"), F.sha2(F.array_join(w, " "), 256).alias("digest"))


@query("normalize_name", "SELECT p_partkey, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9_]+'), '') AS name FROM part")
def normalize_name(spark, d):
    return I.table(spark, d, "part").select("p_partkey", X.normalize_name(F.col("p_name")).alias("name"))


@query("source_digest", "SELECT doc_id, sha256(replace(text, chr(13)||chr(10), chr(10))) AS digest FROM documents")
def source_digest(spark, d):
    """Half of the texts are written with the other line ending."""
    text = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return I.table(spark, d, "documents").select("doc_id", X.source_digest(text).alias("digest"))


@query("safe_text", f"""
SELECT doc_id, CASE WHEN regexp_matches(text, '{SENS}') THEN 'sensitive_requirements_not_supported' ELSE '' END AS reason,
  CASE WHEN regexp_matches(text, '{SENS}') THEN '' ELSE sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) END AS digest FROM documents""")
def safe_text(spark, d):
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit("\n "))
    safe = X.safe_text(padded)
    return I.table(spark, d, "documents").select(
        "doc_id", F.coalesce(X.safe_text_reason(padded), F.lit("")).alias("reason"),
        F.coalesce(F.sha2(safe, 256), F.lit("")).alias("digest"))


@query("sink_csv_safe", """
WITH t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '=' || text WHEN 1 THEN '  +' || text WHEN 2 THEN '@x' ELSE text END AS c FROM conversations)
SELECT conv_id, turn, sha256(CASE WHEN regexp_matches(c, '^\\s*[=+@-]') THEN chr(39) || c ELSE c END) AS cell FROM t""")
def sink_csv_safe(spark, d):
    t = F.col("turn") % 4
    cell = F.when(t == 0, F.concat(F.lit("="), "text")).when(t == 1, F.concat(F.lit("  +"), "text")).when(t == 2, "@x").otherwise(F.col("text"))
    rows = I.table(spark, d, "conversations").select("conv_id", "turn", cell.alias("text"))
    return S.csv_safe(rows).select("conv_id", "turn", F.sha2("text", 256).alias("cell"))


@query("sanitize_cells", """
SELECT doc_id, CAST(length(replace(text, chr(10), '')) AS BIGINT) AS kept, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS replaced FROM documents""")
def sanitize_cells(spark, d):
    marked = X.sanitize_cell(F.replace("text", F.lit("\n"), F.lit("\x0b")))
    plain = F.replace(marked, F.lit("�"), F.lit(""))
    return I.table(spark, d, "documents").select("doc_id", F.length(plain).cast("bigint").alias("kept"),
                                                 (F.length(marked) - F.length(plain)).cast("bigint").alias("replaced"))


@query("pointer_escape", "SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS token FROM pages")
def pointer_escape(spark, d):
    return I.table(spark, d, "pages").select("page_id", X.pointer_escape(F.col("url")).alias("token"))


@query("iso_seconds", """
SELECT event_id, CASE WHEN event_id%50=0 THEN -1.0 ELSE CAST(epoch_us(ts)//1000 - 1704067200000 AS DOUBLE)/1000 END AS seconds FROM events""")
def iso_seconds(spark, d):
    end = F.when(F.col("event_id") % 50 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    return I.table(spark, d, "events").select("event_id", F.coalesce(
        X.iso_seconds(F.lit("2024-01-01T00:00:00+00:00"), F.concat(end, F.lit("+00:00"))), F.lit(-1.0)).alias("seconds"))


@query("truncate_details", """
SELECT doc_id, sha256(left(text, 200)) AS field, CAST(1 AS BIGINT) AS kept FROM documents""")
def truncate_details(spark, d):
    details = F.create_map(F.lit("field"), F.col("text"), F.lit("body"), F.col("text"))
    cut = X.truncate_details(details, F.array(F.lit("page"), F.lit("field")))
    return I.table(spark, d, "documents").select("doc_id", F.sha2(cut["field"], 256).alias("field"),
                                                 F.size(cut).cast("bigint").alias("kept"))


@query("parse_decimal_text", """
WITH t AS (SELECT o_orderkey, CAST(round(o_totalprice*100) AS BIGINT) AS cents FROM orders)
SELECT o_orderkey, CASE o_orderkey%6 WHEN 0 THEN CAST(cents AS DOUBLE) WHEN 1 THEN -CAST(cents AS DOUBLE) WHEN 2 THEN cents + 0.5 ELSE -1.0 END AS number,
  CASE o_orderkey%6 WHEN 0 THEN cents WHEN 1 THEN -cents ELSE -1 END AS whole, o_orderkey%6 IN (3,4,5) AS mismatch FROM t""")
def parse_decimal_text(spark, d):
    cents, k = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string"), F.col("o_orderkey") % 6
    text = (F.when(k == 0, F.concat(F.lit(" +"), cents, F.lit("\t"))).when(k == 1, F.concat(F.lit("-"), cents))
            .when(k == 2, F.concat(cents, F.lit(".5"))).when(k == 3, "1e5").when(k == 4, F.concat(cents, F.lit("."))).otherwise("n/a"))
    number, wrong = V.normalize_html(text, "number")
    whole, _ = V.normalize_html(text, "integer")
    return I.table(spark, d, "orders").select(
        "o_orderkey", F.coalesce(number, F.lit(-1.0)).alias("number"), F.coalesce(whole, F.lit(-1)).alias("whole"),
        wrong.alias("mismatch"))


# ---------------------------------------------------------------- taxonomy

CODES_SQL = "CASE event_id%6 WHEN 0 THEN 'duplicate_id' WHEN 1 THEN 'pointer_not_found' WHEN 2 THEN 'page_location_mismatch' WHEN 3 THEN 'network_error' WHEN 4 THEN 'something_else' ELSE 'invalid_url' END"


def coded_events(spark, d):
    k = F.col("event_id") % 6
    return I.table(spark, d, "events").select("event_id", F.when(k == 0, "duplicate_id").when(k == 1, "pointer_not_found")
                                              .when(k == 2, "page_location_mismatch").when(k == 3, "network_error")
                                              .when(k == 4, "something_else").otherwise("invalid_url").alias("error_code"))


@query("error_lookup", f"""
SELECT event_id, CASE event_id%6 WHEN 0 THEN 'DATA_INTEGRITY' WHEN 1 THEN 'PLAN_SEMANTIC' WHEN 2 THEN 'PLAN_SEMANTIC' WHEN 3 THEN 'TRANSPORT'
  WHEN 4 THEN 'UNCLASSIFIED' ELSE 'SECURITY' END AS category, event_id%6 IN (1,2) AS repairable, event_id%6=3 AS retryable FROM events""")
def error_lookup(spark, d):
    return taxonomy.classify(coded_events(spark, d)).select("event_id", "category", "repairable", "retryable")


@query("failure_phase", """
SELECT event_id, CASE event_id%6 WHEN 0 THEN 'execution' WHEN 1 THEN 'planning' WHEN 2 THEN 'planning' WHEN 3 THEN 'execution'
  WHEN 4 THEN 'unknown' ELSE 'observation' END AS phase FROM events""")
def failure_phase(spark, d):
    return taxonomy.classify(coded_events(spark, d)).select("event_id", taxonomy.failure_phase(F.col("phase")).alias("phase"))


@query("project_repairability", """
SELECT event_id, CASE event_id%6 WHEN 1 THEN 'auto_applied' WHEN 2 THEN 'proposal_only' ELSE 'rejected' END AS disposition FROM events""")
def project_repairability(spark, d):
    return taxonomy.classify(coded_events(spark, d)).select("event_id", taxonomy.project_repairability(
        F.col("error_code"), F.col("phase"), F.col("repairable")).alias("disposition"))


@query("plan_hash", """
SELECT c_custkey, sha256('{"fields":{"amount":"/amount","id":"/id","state":"/state"},"has_next_pointer":' || CASE WHEN c_custkey%10=8 THEN 'null' ELSE '"/more"' END ||
  ',"items_pointer":"/rows","page_parameter":"page","pagination_location":"query","request_id":"req_' || c_custkey || '","total_pointer":' ||
  CASE WHEN c_custkey%10=7 THEN 'null' ELSE '"/total"' END || ',"unique_key":"id"}') AS plan_hash
FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)""")
def plan_hashes(spark, d):
    return I.order_plans(spark, d).select(F.col("source_id").alias("c_custkey"), plan_hash().alias("plan_hash"))
