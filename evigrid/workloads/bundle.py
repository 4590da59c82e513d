"""Queries: document bundles, manifests, contracts, sinks and streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import json_values as J
from ..functions.texts import source_digest, tokens
from ..operators import contracts as C, overlap as O
from ..session import cut_lineage, scratch_path
from ..sources import bundles as B, documents as D, sinks as S
from ..streaming import jobs as ST
from . import inputs as I
from .collection import SEQ, outcome
from .lifecycle import LIFE, requests
from .overlap import bundle_documents
from .registry import query


def fresh(spark, name):
    """A new output folder of this run in the shared folder."""
    return scratch_path(spark, name)


@query("read_strict_json", """
SELECT event_id, CASE WHEN event_id%9=4 THEN 'invalid_relative_reference' WHEN event_id%7 IN (1,2,3) THEN 'invalid_json' ELSE '' END AS code FROM events""")
def read_strict_json(spark, d):
    e = F.col("event_id")
    text = (F.when(e % 7 == 1, '{"k":1,"k":2}').when(e % 7 == 2, '{"k":NaN}').when(e % 7 == 3, F.substring("props", 1, 4)).otherwise(F.col("props")))
    ref = F.when(e % 9 == 4, F.concat(F.lit("evaluation/../"), e)).otherwise(F.concat(F.lit("evaluation/e/"), e, F.lit(".json")))
    docs = I.table(spark, d, "events").select("event_id", ref.alias("ref"), text.alias("text"))
    return D.strict_json(docs).select("event_id", F.coalesce("code", F.lit("")).alias("code"))


def documents(spark, d):
    """(ref, document) of every customer's case, oracle, fixture and labels.

    ``source_id % 12``: 1 oracle changed after the manifest, 2 fixture moved, 3 extra file, 4 case states a wrong
    hash, 5 unknown label, 6 unknown family, 7 family on the other split.
    """
    k = F.col("source_id") % 12
    ref = lambda kind: F.concat(F.lit(f"evaluation/{kind}/"), "source_id", F.lit(".json"))
    base = bundle_documents(spark, d).drop("case")
    labels = F.to_json(F.struct(F.array(F.when(k == 5, "no_such_case").otherwise("page_items")).alias("relevant_case_ids"),
                                F.array().cast("array<string>").alias("failure_relevant_case_ids"), F.lit("by rule").alias("rationale")))
    base = base.withColumn("labels", F.parse_json(labels))
    hashes = F.struct(J.digest(F.col("fixture")).alias("fixture"), F.when(k == 4, "0" * 64).otherwise(J.digest(F.col("oracle"))).alias("oracle"),
                      J.digest(F.col("labels")).alias("retrieval_labels"))
    case = F.parse_json(F.to_json(F.struct(
        F.format_string("case_%d", F.col("source_id")).alias("id"), F.when((F.col("source_id") % 2 == 0) != (k == 7), "development").otherwise("frozen_evaluation").alias("split"),
        F.when(k == 6, "nowhere").otherwise(F.format_string("family_%d", F.col("source_id"))).alias("family_id"),
        F.struct(ref("oracles").alias("ref")).alias("oracle"), F.struct(ref("inputs").alias("ref")).alias("fixture"),
        F.struct(ref("labels").alias("ref")).alias("retrieval_labels"), hashes.alias("hashes"))))
    # Written once: documents, manifest and families all read it.
    base = cut_lineage(base.withColumn("case", case))
    parts = F.array(*[F.struct(ref(kind).alias("ref"), F.col(c).alias("document")) for kind, c in (
        ("cases", "case"), ("oracles", "oracle"), ("inputs", "fixture"), ("labels", "labels"))])
    rows = base.select("source_id", F.inline(parts))
    manifest = rows.select("source_id", "ref", F.when((k == 1) & F.contains("ref", F.lit("/oracles/")), "f" * 64).otherwise(J.digest(F.col("document"))).alias("sha256"))
    lost = (k == 2) & F.contains("ref", F.lit("/inputs/"))
    actual = rows.withColumn("ref", F.when(lost, F.replace("ref", F.lit("/inputs/"), F.lit("/lost/"))).otherwise(F.col("ref")))
    extra = rows.filter((k == 3) & F.contains("ref", F.lit("/labels/"))).withColumn("ref", F.replace("ref", F.lit("/labels/"), F.lit("/extra/")))
    families = base.select(F.format_string("family_%d", F.col("source_id")).alias("id"),
                           F.when(F.col("source_id") % 2 == 0, "development").otherwise("frozen_evaluation").alias("split"),
                           F.col("family_signature").alias("signature"))
    return actual.unionByName(extra), manifest, families


def assembled(spark, d):
    docs, manifest, families = documents(spark, d)
    refs = manifest.filter(F.contains("ref", F.lit("/cases/"))).select("ref")
    return D.assemble_cases(docs.drop("source_id"), refs, families), docs, manifest


@query("case_assembly", SEQ + """
SELECT 'case_' || source_id AS case_id, source_id%12=2 AS fixture_missing, source_id%12=6 AS family_missing FROM sources""")
def case_assembly(spark, d):
    cases, _, _ = assembled(spark, d)
    return cases.select("case_id", F.col("fixture").isNull().alias("fixture_missing"), F.col("family_split").isNull().alias("family_missing"))


@query("load_bundle", SEQ + "SELECT CASE WHEN source_id%12=6 THEN 'unknown_family' WHEN source_id%12=2 THEN 'missing_or_escaping_reference' ELSE 'ok' END AS state, count(*) AS cases FROM sources GROUP BY 1")
def load_bundle(spark, d):
    """Documents written as files, read back by path and assembled from their references."""
    docs, manifest, families = documents(spark, d)
    root = fresh(spark, "bundle")
    docs.select("ref", F.to_json("document").alias("text")).write.parquet(root)
    read = D.strict_json(spark.read.parquet(root)).filter("code IS NULL").select("ref", "document")
    refs = manifest.filter(F.contains("ref", F.lit("/cases/"))).select("ref")
    cases = D.assemble_cases(read, refs, families)
    state = F.when(F.col("family_split").isNull(), "unknown_family").when(F.col("fixture").isNull(), "missing_or_escaping_reference").otherwise("ok")
    return cases.groupBy(state.alias("state")).agg(F.count("*").alias("cases"))


@query("bundle_verify", SEQ + """
SELECT 'evaluation/oracles/' || source_id || '.json' AS subject, 'file_hash_mismatch' AS code FROM sources WHERE source_id%12=1
UNION ALL SELECT 'evaluation/inputs/' || source_id || '.json', 'missing_or_escaping_reference' FROM sources WHERE source_id%12=2
UNION ALL SELECT 'evaluation/extra/' || source_id || '.json', 'unindexed_json_asset' FROM sources WHERE source_id%12=3
UNION ALL SELECT 'evaluation/lost/' || source_id || '.json', 'unindexed_json_asset' FROM sources WHERE source_id%12=2
UNION ALL SELECT 'case_' || source_id, CASE source_id%12 WHEN 2 THEN 'family_signature_mismatch' WHEN 4 THEN 'case_dependency_hash_mismatch' WHEN 5 THEN 'invalid_retrieval_labels'
  WHEN 6 THEN 'duplicate_case_or_unknown_family' ELSE 'family_signature_mismatch' END FROM sources WHERE source_id%12 IN (2,4,5,6,7)""")
def bundle_verify(spark, d):
    from ..plans.knowledge import runtime_cases
    cases, docs, manifest = assembled(spark, d)
    cases = cut_lineage(cases)  # read for references, repeats, labels and hashes
    signature = F.parse_json(F.coalesce(O.family_signature(J.as_array(J.pointer_get(F.col("fixture"), "/endpoints"))), F.lit("null")))
    files = D.inventory_errors(manifest, docs, D.referenced_paths(cases))
    found = D.case_errors(cases, runtime_cases(spark).select("case_id"), signature)
    return files.select(F.col("ref").alias("subject"), "code").unionByName(found.select(F.col("case_id").alias("subject"), "code"))


@query("unindexed_assets", SEQ + """
SELECT 'evaluation/extra/' || source_id || '.json' AS ref, 'unindexed' AS state FROM sources WHERE source_id%12=3
UNION ALL SELECT 'evaluation/lost/' || source_id || '.json', 'unindexed' FROM sources WHERE source_id%12=2
UNION ALL SELECT 'evaluation/inputs/' || source_id || '.json', 'missing' FROM sources WHERE source_id%12=2""")
def unindexed_assets(spark, d):
    docs, manifest, _ = documents(spark, d)
    docs, manifest = docs.select("ref").hint("merge"), manifest.select("ref").hint("merge")  # a row per file each, more than their estimates tell
    extra = docs.join(manifest, "ref", "left_anti").withColumn("state", F.lit("unindexed"))
    return extra.unionByName(manifest.join(docs, "ref", "left_anti").withColumn("state", F.lit("missing")))


@query("union_inventory", SEQ + """
SELECT 'evaluation/' || k || '/' || source_id || '.json' AS ref FROM sources, (VALUES ('cases'),('oracles'),('inputs'),('labels')) t(k)""")
def union_inventory(spark, d):
    return D.referenced_paths(assembled(spark, d)[0])


@query("public_input", SEQ + """
SELECT source_id, CASE source_id%12 WHEN 1 THEN 'invalid_public_input' WHEN 2 THEN 'invalid_fields' WHEN 3 THEN 'missing_endpoints' WHEN 4 THEN 'invalid_endpoint'
  WHEN 5 THEN 'only_literal_loopback_http_supported' WHEN 6 THEN 'sensitive_fixture_request' WHEN 7 THEN 'duplicate_request_id' WHEN 8 THEN 'cross_origin_fixture'
  WHEN 9 THEN 'scorer_metadata_in_public_input' WHEN 10 THEN 'invalid_request_body' ELSE '' END AS code FROM sources""")
def public_input(spark, d):
    k = F.col("source_id") % 12
    one = lambda i, host, query, body, extra="": (
        f'{{"request_id":"r{i}","method":"GET","url":"http://{host}/","query":{query},"request_body":{body},"responses":[{{"rows":[]{extra}}}]}}')
    good = one(1, "127.0.0.1", '{"page":"1"}', "null")
    pack = lambda fields, *e: f'{{"fields":{fields},"endpoints":[{",".join(e)}]}}'
    kinds = {1: '{"fields":["id"]}', 2: pack('["id","id"]', good), 3: pack('["id"]'), 4: pack('["id"]', '{"request_id":"r1"}'),
             5: pack('["id"]', one(1, "example.com", "{}", "null")), 6: pack('["id"]', one(1, "127.0.0.1", '{"token":"1"}', "null")),
             7: pack('["id"]', good, good), 8: pack('["id"]', good, one(2, "127.0.0.1:81", "{}", "null")),
             9: pack('["id"]', one(1, "127.0.0.1", "{}", "null", ',"oracle":1')), 10: pack('["id"]', one(1, "127.0.0.1", "{}", '{"page":1}'))}
    text = F.to_json(F.col("fixture"))
    for number, value in kinds.items():
        text = F.when(k == number, value).otherwise(text)
    return bundle_documents(spark, d).select("source_id", F.coalesce(C.public_input_error(F.parse_json(text)), F.lit("")).alias("code"))


def cases_v1(spark, d):
    """Version 1 cases of all customers, one broken rule each by ``source_id % 9``."""
    k = F.col("source_id") % 9
    none = F.lit(None).cast("string")
    rows = I.order_rows(spark, d).select("source_id").distinct()
    return rows.select(
        "source_id", F.when(k == 1, F.array(F.lit("get"), F.lit("get"))).otherwise(F.array(F.lit("get"))).alias("categories"),
        F.when(k == 3, F.lit(False)).otherwise(True).alias("supported"), F.lit("controlled_failure").alias("expected_outcome"),
        F.when(k == 2, F.array(F.lit("no_code"))).otherwise(F.array(F.lit("pointer_not_found"))).alias("allowed_codes"), F.lit(True).alias("classified"),
        F.when(k == 4, "executing").otherwise("analyzing").alias("phase"), F.when(k == 5, "ValueError").otherwise(none).alias("exception_type"),
        F.lit("pointer_not_found").alias("trigger_code"), F.when(k == 6, "rejected").otherwise("auto_applied").alias("disposition"),
        F.lit(True).alias("eligible"), (k != 7).alias("may_apply"), F.lit(False).alias("expected_applied"), F.when(k == 8, 0).otherwise(1).alias("max_attempts"),
        F.lit(True).alias("injected_failure"), F.lit("missing_items_pointer").alias("injection"))


@query("case_semantics", SEQ + """
SELECT source_id, CASE source_id%9 WHEN 1 THEN 'duplicate_category' WHEN 2 THEN 'invalid_error_code' WHEN 3 THEN 'unsupported_must_reject' WHEN 4 THEN 'failure_classification_mismatch'
  WHEN 5 THEN 'classified_exception_conflict' WHEN 6 THEN 'repair_policy_mismatch' WHEN 7 THEN 'repair_apply_mismatch' WHEN 8 THEN 'repair_budget_mismatch' ELSE '' END AS code FROM sources""")
def case_semantics(spark, d):
    return cases_v1(spark, d).select("source_id", F.coalesce(C.case_semantics(), F.lit("")).alias("code"))


@query("case_semantics_v2", SEQ + """
SELECT source_id, CASE source_id%9 WHEN 1 THEN 'duplicate_category' WHEN 2 THEN 'exposure_split_mismatch' WHEN 3 THEN 'unsupported_must_reject' WHEN 4 THEN 'failure_classification_mismatch'
  WHEN 5 THEN 'held_without_fill_event' WHEN 6 THEN 'repair_policy_mismatch' WHEN 7 THEN 'applied_requires_proposed' WHEN 8 THEN 'eligible_repair_mismatch' ELSE '' END AS code,
  CASE source_id%5 WHEN 1 THEN 'mixed_case_schema_version' WHEN 2 THEN 'unknown_case_version' ELSE '' END AS version_code FROM sources""")
def case_semantics_v2(spark, d):
    k = F.col("source_id") % 9
    none = F.lit(None).cast("string")
    v = F.col("source_id") % 5
    base = cases_v1(spark, d)
    df = base.withColumns({
        "allowed_codes": F.array(F.lit("pointer_not_found")), "exception_type": none, "may_apply": F.lit(True), "expected_applied": k == 7,
        "split": F.when(k == 5, "future_held_evaluation").otherwise("development"), "exposure": F.when(k.isin(2, 5), "held").otherwise("author_exposed"),
        "exposure_events": F.array(F.lit("created")), "occurs": F.lit(True), "category": F.lit("PLAN_SEMANTIC"), "rejection_reason": none,
        "proposal_outcome": F.when(k == 7, "rejected").otherwise("proposed"), "proposal_reason": F.lit("pointer_relocated"), "attempt_outcome": F.lit("deferred"),
        "document": F.parse_json(F.when(v == 1, '{"version":1}').when(v == 2, '{"version":true}').otherwise('{"version":2}'))})
    return df.select("source_id", F.coalesce(C.case_semantics_v2(), F.lit("")).alias("code"),
                     F.coalesce(C.dispatch_version(F.col("document"), F.lit(2)), F.lit("")).alias("version_code"))


@query("oracle_rules_v2", SEQ + """
SELECT source_id, CASE source_id%6 WHEN 1 THEN 'output_oracle_must_not_expect_error' WHEN 2 THEN 'incomplete_output_oracle' WHEN 3 THEN 'oracle_records_hash_mismatch'
  WHEN 4 THEN 'success_requires_terminal_completeness' WHEN 5 THEN 'partial_boundary_requires_partial' ELSE '' END AS code FROM sources""")
def oracle_rules_v2(spark, d):
    k, none = F.col("source_id") % 6, F.lit(None).cast("string")
    rows = I.order_rows(spark, d).groupBy("source_id").agg(F.min(F.struct("id", "amount", "state")).alias("r"))
    records = F.transform(F.array("r"), lambda r: F.parse_json(F.to_json(r)))
    df = rows.withColumns({
        "expected_outcome": F.when(k == 5, "partial_boundary").otherwise("success"), "classified": F.lit(False), "allowed_codes": F.array().cast("array<string>"),
        "phase": none, "exception_type": none, "o_records": records, "o_page_count": F.lit(1), "o_record_count": F.when(k == 3, 2).otherwise(1),
        "o_sha256": F.when(k != 2, F.sha2(F.to_json(F.parse_json(F.to_json(F.array("r")))), 256)), "o_schema": F.create_map(F.lit("id"), F.lit("integer")),
        "o_unique_key": F.lit("id"), "o_completeness": F.when(k == 4, "partial").otherwise("complete"),
        "o_error_code": F.when(k == 1, "duplicate_id"), "o_error_phase": none, "o_exception_type": none})
    actual = F.sha2(F.concat(F.lit("["), F.array_join(F.transform("o_records", J.canonical_json), ","), F.lit("]")), 256)
    return df.select("source_id", F.coalesce(C.oracle_rules_v2(actual == F.col("o_sha256"), F.lit(True)), F.lit("")).alias("code"))


@query("reservations", SEQ + """
SELECT source_id AS row_id, CASE source_id%8 WHEN 1 THEN 'forbidden_answer_data' WHEN 2 THEN 'invalid_reservation' WHEN 3 THEN 'unknown_capability_target'
  WHEN 4 THEN 'planned_family_not_future_held' ELSE 'duplicate_reservation_id' END AS code FROM sources WHERE source_id%8 IN (1,2,3,4)
  OR (source_id%8=5 AND source_id > (SELECT min(source_id) FROM sources WHERE source_id%8=5))""")
def reservations(spark, d):
    k, i = F.col("source_id") % 8, F.col("source_id")
    rid = F.when(k == 5, "m6r_same").otherwise(F.format_string("m6r_r%d", i))
    body = F.struct(rid.alias("reservation_id"), F.when(k == 4, "family_x").otherwise(F.format_string("family_%d", i)).alias("planned_family"),
                    F.when(k == 3, "magic").otherwise("duplicate_id").alias("capability_target"), F.lit("future_held_evaluation").alias("intended_split"),
                    F.when(k == 2, "open").otherwise("held_reserved").alias("exposure"), F.when(k == 1, "x").alias("expected_outcome"))
    sources = I.order_rows(spark, d).select("source_id").distinct()
    entries = sources.select(i.alias("row_id"), F.parse_json(F.to_json(body)).alias("document"))
    families = sources.select(F.format_string("family_%d", i).alias("id"), F.lit("future_held_evaluation").alias("split"))
    return C.reservation_errors(entries, families)


@query("name_disjointness", """
WITH w AS (SELECT 'held_out' AS split, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS name FROM benchmark
  UNION ALL SELECT 'dev', unnest(regexp_extract_all(lower(p_name), '[a-z0-9_]+')) FROM part),
corpus AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS name FROM documents)
SELECT name, 'both_splits' AS finding FROM w GROUP BY name HAVING count(DISTINCT split)>1
UNION ALL SELECT DISTINCT name, 'in_corpus' FROM w WHERE split='held_out' AND name IN (SELECT name FROM corpus)""")
def name_disjointness(spark, d):
    words = lambda t, c, s: I.table(spark, d, t).select(F.lit(s).alias("split"), F.lit("word").alias("kind"), F.explode(tokens(F.col(c))).alias("name"))
    held = words("benchmark", "text", "held_out")
    both = C.shared_names(held.unionByName(words("part", "p_name", "dev"))).select("name", F.lit("both_splits").alias("finding"))
    leaked = C.names_in_corpus(held, words("documents", "text", "corpus"))
    return both.unionByName(leaked.withColumn("finding", F.lit("in_corpus")))


# ---------------------------------------------------------------- digest trees, ablation, references

def frozen_entries(spark, d):
    """Manifest entries of one bundle per nation: a file per customer, a source of every third one."""
    c = I.table(spark, d, "customer").select(F.col("c_nationkey").alias("bundle_id"), F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    c = c.withColumn("document", F.parse_json(F.to_json(F.struct("k", "c_name"))))
    folder = F.when(F.col("k") % 40 == 3, "evaluation/../files/").otherwise("evaluation/files/")
    files = c.select("bundle_id", "k", F.lit("file").alias("kind"), F.concat(folder, "k", F.lit(".json")).alias("ref"), J.digest(F.col("document")).alias("sha256"), "document",
                     F.lit(None).cast("string").alias("text"))
    text = F.concat("c_name", F.lit("\n"), "c_mktsegment")
    sources = c.filter("k % 3 = 0").select("bundle_id", "k", F.lit("source").alias("kind"), F.concat(F.lit("evaluation/sources/"), "k", F.lit(".py")).alias("ref"),
                                           source_digest(text).alias("sha256"), F.lit(None).cast("variant").alias("document"), text.alias("text"))
    return files.unionByName(sources)


@query("bundle_digests", """
WITH c AS (SELECT c_nationkey AS bundle_id, c_custkey AS k FROM customer)
SELECT bundle_id, 'evaluation/files/' || k || '.json' AS subject, CASE k%40 WHEN 1 THEN 'file_hash_mismatch' ELSE 'missing_or_escaping_reference' END AS code FROM c WHERE k%40 IN (1,2)
UNION ALL SELECT bundle_id, 'evaluation/../files/' || k || '.json', 'missing_or_escaping_reference' FROM c WHERE k%40=3
UNION ALL SELECT bundle_id, 'evaluation/sources/' || k || '.py', 'source_hash_mismatch' FROM c WHERE k%40=6 AND k%3=0
UNION ALL SELECT bundle_id, 'evaluation/sources/' || k || '.py', 'incomplete_source_inventory' FROM c WHERE k%40=9 AND k%3=0
UNION ALL SELECT DISTINCT bundle_id, '', 'manifest_hash_mismatch' FROM c WHERE bundle_id%5=1
UNION ALL SELECT DISTINCT bundle_id, '', 'manifest_not_frozen' FROM c WHERE bundle_id%5 IN (1,2)""")
def bundle_digests(spark, d):
    """Files and sources changed, lost, outside the tree or not inventoried; records that do not fit the manifest or the pinned digest."""
    rows = cut_lineage(frozen_entries(spark, d))
    k, entries = F.col("k"), rows.select("bundle_id", "kind", "ref", "sha256")
    changed = F.parse_json(F.concat(F.lit('{"k":'), "k", F.lit("}")))
    docs = rows.filter((F.col("kind") == "file") & (k % 40 != 2)).select("bundle_id", "ref", F.when(k % 40 == 1, changed).otherwise(F.col("document")).alias("document"))
    sources = rows.filter("kind = 'source'")
    text = F.when(k % 40 == 6, F.concat("text", F.lit("#"))).otherwise(F.replace("text", F.lit("\n"), F.lit("\r\n")))  # line ends do not matter
    top = B.digest_tree(entries).filter("level = 0")
    n = F.col("bundle_id") % 5
    stated = top.select("bundle_id", F.when(n == 1, "0" * 64).otherwise(F.col("digest")).alias("recorded"),
                        F.when(n == 2, "f" * 64).when(n != 3, F.col("digest")).alias("pinned"))
    return B.bundle_errors(entries, docs, sources.select("bundle_id", "ref", text.alias("text")), stated, sources.filter(k % 40 != 9).select("bundle_id", "ref"))


@query("tree_changes", """
SELECT DISTINCT c_nationkey AS bundle_id, substr(sha256('["file","evaluation/files/' || c_custkey || '.json"]'), 1, 4) AS node FROM customer WHERE c_custkey%40=7""")
def tree_changes(spark, d):
    """Parts of the manifests that two versions do not share, found from the top of their trees."""
    entries = cut_lineage(frozen_entries(spark, d).select("bundle_id", "k", "kind", "ref", "sha256"))
    edited = entries.withColumn("sha256", F.when((F.col("k") % 40 == 7) & (F.col("kind") == "file"), "0" * 64).otherwise(F.col("sha256")))
    return B.tree_difference(B.digest_tree(entries), B.digest_tree(edited))


@query("ablation_identity", """
WITH c AS (SELECT c_custkey AS place, c_custkey%30 AS kind FROM customer)
SELECT place, '' AS corpus, CASE kind WHEN 3 THEN 'ablation_features_changed' ELSE 'ablation_identity_changed' END AS code FROM c WHERE kind IN (1,2,3,6)
UNION ALL SELECT place, 'e1', 'invalid_ablation_fields' FROM c WHERE kind=4
UNION ALL SELECT place, corpus, 'invalid_feature_metadata' FROM c, (VALUES ('e2'),('e3')) t(corpus) WHERE kind=5""")
def ablation_identity(spark, d):
    """Three corpora with a row per customer, told apart by added members; some rows differ in more."""
    k = F.col("c_custkey") % 30
    rows = I.table(spark, d, "customer").select("c_custkey", k.alias("kind"), "c_name", F.explode(F.array(*[F.lit(x) for x in B.ADDED])).alias("corpus"))
    at = lambda corpus, kind: (F.col("corpus") == corpus) & (F.col("kind") == kind)
    rows = rows.filter(~at("e3", 2)).withColumn("copies", F.when(at("e1", 6), 2).otherwise(1))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    method = F.when(F.col("kind") == 5, "PUT").when(at("e3", 3), "POST").otherwise("GET")
    title = F.when(at("e2", 1), F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))
    text = F.concat(F.lit('{"id":"case_'), "c_custkey", F.lit('","title":"'), title, F.lit('","terms":["page"],"guidance":"read"'),
                    F.when(F.col("corpus") != "e1", F.concat(F.lit(',"features":{"method":"'), method, F.lit('"}'))).when(F.col("kind") == 4, ',"more":1').otherwise(""),
                    F.when(F.col("corpus") == "e3", ',"failure_modes":[],"repairability":{}').otherwise(""), F.lit("}"))
    return B.ablation_errors(rows.select("corpus", F.col("c_custkey").alias("place"), F.parse_json(text).alias("document")))


@query("reference_closure", """
WITH c AS (SELECT c_custkey AS k, c_custkey%5 AS p, (c_custkey//5)%6 AS g FROM customer)
SELECT 'evaluation/n/' || k || '.json' AS ref, CASE WHEN g=2 THEN 'cyclic_reference' WHEN g=1 AND p=3 THEN 'missing_or_escaping_reference' WHEN g=3 AND p=2 THEN 'invalid_json' ELSE '' END AS code
FROM c WHERE p <= CASE g WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 1 END
UNION ALL SELECT 'evaluation/../' || k || '.json', 'missing_or_escaping_reference' FROM c WHERE g=4 AND p=1""")
def reference_closure(spark, d):
    """Chains of five documents each: whole, with a lost, an unreadable or an escaping one, leading into a cycle, or ending early."""
    k = F.col("c_custkey")
    p, g = k % 5, F.floor(k / 5) % 6
    ref = lambda key: F.concat(F.lit("evaluation/n/"), key.cast("string"), F.lit(".json"))
    to = (F.when((g == 2) & (p == 4), ref(k - 2)).when((g == 4) & (p == 1), F.concat(F.lit("evaluation/../"), "c_custkey", F.lit(".json")))
          .when((g == 5) & (p == 1) | (p == 4), F.lit(None)).otherwise(ref(k + 1)))
    text = F.when((g == 3) & (p == 2), '{"a":1,"a":2}').otherwise(F.to_json(F.struct(F.struct(to.alias("ref")).alias("next"))))
    docs = I.table(spark, d, "customer").filter(~((g == 1) & (p == 3))).select(ref(k).alias("ref"), text.alias("text"))
    roots = I.table(spark, d, "customer").filter(p == 0).select(ref(k).alias("ref"))
    return B.reference_closure(docs, roots, ["/next/ref"]).select("ref", F.coalesce("code", F.lit("")).alias("code"))


# ---------------------------------------------------------------- files and sinks

@query("file_manifest")
def file_manifest(spark, d):
    return D.file_manifest(spark, d, "*.parquet")


@query("verify_manifest")
def verify_manifest(spark, d):
    """The given files against a manifest that misses one, names a stranger and has one wrong hash."""
    actual = file_manifest(spark, d)
    name = F.col("filename")
    entries = actual.filter(name != "region.parquet").withColumn("sha256", F.when(name == "nation.parquet", "0" * 64).otherwise(F.col("sha256")))
    strange = actual.filter(name == "part.parquet").withColumn("filename", F.lit("gone.parquet"))
    return D.verify_manifest(entries.unionByName(strange), actual)


@query("sink_json", "SELECT o_orderkey, o_totalprice FROM orders")
def sink_json(spark, d):
    out = fresh(spark, "json")
    S.write_json(I.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), out)
    return spark.read.schema("o_orderkey bigint, o_totalprice double").json(out)


@query("sink_csv", """
SELECT o_orderkey, CASE WHEN o_orderkey%3=0 THEN '''' || '=' || o_orderstatus ELSE o_orderstatus END AS status FROM orders""")
def sink_csv(spark, d):
    """Every third status looks like a formula; the written parts are read back."""
    out = fresh(spark, "csv")
    k = F.col("o_orderkey")
    S.write_csv(I.table(spark, d, "orders").select(k, F.when(k % 3 == 0, F.concat(F.lit("="), "o_orderstatus")).otherwise(F.col("o_orderstatus")).alias("status")), out)
    return spark.read.schema("o_orderkey bigint, status string").option("header", True).option("lineSep", "\r\n").option("enforceSchema", True).csv(out)


# ---------------------------------------------------------------- streams

def event_stream(spark, d):
    schema = I.table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query("event_tail", "SELECT event_id, user_id FROM events WHERE event_id > 100")
def event_tail(spark, d):
    out = fresh(spark, "tail")
    ST.event_tail(event_stream(spark, d).select(F.col("event_id").alias("seq"), "user_id"), 100, f"{out}/rows", f"{out}/cursor")
    return spark.read.parquet(f"{out}/rows").select(F.col("seq").alias("event_id"), "user_id")


@query("lifecycle_state", LIFE + """
, fin AS (SELECT task_id, arg_max(status, rn) AS status, count(*) AS entries FROM log GROUP BY 1)
SELECT t.task_id, coalesce(status,'created') AS status, coalesce(entries,0) AS entries FROM (SELECT DISTINCT task_id FROM req) t LEFT JOIN fin USING (task_id)""")
def lifecycle_state(spark, d):
    """Requests arrive as a stream in several files; the result equals the batch state machine."""
    out = fresh(spark, "lifecycle")
    rows = requests(spark, d).select("task_id", "event_id", "ts", "status")
    rows.repartition("event_id").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/in")
    ST.lifecycle_stream(stream, ["ts", "event_id"], f"{out}/state", f"{out}/cursor")
    state = ST.latest(spark, f"{out}/state", "task_id")
    return state.select("task_id", "status", F.size("timeline").cast("bigint").alias("entries"))


@query("page_integrity_stream", outcome() + """
SELECT source_id, CASE WHEN code IS NULL THEN 'succeeded' ELSE 'failed' END AS status, coalesce(code,'') AS error_code,
  CAST(CASE WHEN code IS NOT NULL THEN 0 ELSE n END AS BIGINT) AS count FROM outcome""")
def page_integrity_stream(spark, d):
    """Pages arrive in no order; the newest state of a source equals the batch run."""
    out = fresh(spark, "pages")
    I.order_pages(spark, d).repartition("source_id", "page_no").write.parquet(f"{out}/in")
    stream = spark.readStream.schema("source_id bigint, page_no int, body string").option("maxFilesPerTrigger", 2).parquet(f"{out}/in")
    # Every batch joins the plans: stored, so that none of them reads the orders again.
    ST.page_integrity_stream(stream, cut_lineage(I.order_plans(spark, d)), list(I.FIELDS), f"{out}/state", f"{out}/cursor")
    state = ST.latest(spark, f"{out}/state", "source_id")
    return state.select("source_id", "status", F.coalesce("error_code", F.lit("")).alias("error_code"), "count")
