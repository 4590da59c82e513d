"""Evaluation contracts: case semantics, oracles, reservations, public inputs, name hygiene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json_values import as_array, as_object, as_text, pointer_get, type_tag
from ..functions.texts import is_sensitive
from ..functions.urls import local_origin, url_parts
from ..functions.walks import has_member, sensitive_keys
from ..plans.taxonomy import APPLICABLE_CODES, MAX_REPAIR_ATTEMPTS, SPECS, repairability_of
from .admission import observation_error
from .collect import first_match

# Outcomes, splits and exposures of version 2, capabilities a reservation may
# name beside error codes, keys that would give an answer away.
TERMINAL_FAILURES = ("expected_rejection", "controlled_failure")
SPLIT_EXPOSURE = {"development": ("author_exposed",), "author_exposed_evaluation": ("author_exposed",),
                  "future_held_evaluation": ("held", "author_exposed")}
CAPABILITIES = ("success_complete", "success_stop_condition_only", "partial_boundary", "proposal_only",
                "budget_exhausted", "unclassified_rejection")
ANSWER_KEYS = ("input", "inputs", "fixture", "oracle", "oracles", "labels", "label", "retrieval_labels", "request", "plan",
               "records", "record_count", "page_count", "result_sha256", "relevant_case_ids", "failure_relevant_case_ids",
               "hashes", "failure_expectation", "repair_expectation", "split", "expected_outcome", "expected_error_code",
               "filled_by_case", "case_id")
SCORER_KEYS = ("oracle", "relevant_case_ids", "result_sha256", "expected_outcome", "failure_expectation", "repair_expectation")
RESERVATION_KEYS = ("reservation_id", "planned_family", "capability_target", "intended_split", "exposure")
FUTURE_HELD = "future_held_evaluation"

# Case columns, version 1: categories, supported, expected_outcome, allowed_codes, classified, phase,
# exception_type, trigger_code, disposition, eligible, may_apply, expected_applied, max_attempts,
# injected_failure, injection. Version 2 adds exposure, exposure_events, occurs, category,
# rejection_reason, proposal_outcome, proposal_reason, attempt_outcome.


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def _phase_of() -> Column:
    return _map((c, r[2]) for c, r in SPECS.items())


def _category_of() -> Column:
    return _map((c, r[1]) for c, r in SPECS.items())


def _projected() -> Column:
    return _map((c, repairability_of(c)) for c in SPECS)


def _repeated(a: Column) -> Column:
    return F.size(F.array_distinct(a)) < F.size(a)


def _unregistered(codes: Column) -> Column:
    return F.size(F.array_except(codes, F.map_keys(_phase_of()))) > 0


def case_semantics() -> Column:
    """First broken consistency rule of a version 1 case."""
    c, codes = F.col, F.col("allowed_codes")
    some = F.size(codes) > 0
    phases = F.transform(codes, lambda x: F.element_at(_phase_of(), x))
    trigger = c("trigger_code")
    disposition = F.try_element_at(_projected(), trigger)
    none = trigger.isNull()
    return first_match(
        (_repeated(c("categories")), "duplicate_category"),
        (_repeated(codes) | _unregistered(codes), "invalid_error_code"),
        ((c("classified") != some) | F.exists(phases, lambda p: ~p.eqNullSafe(c("phase"))), "failure_classification_mismatch"),
        ((c("expected_outcome") == "success") != (~some & c("phase").isNull()), "outcome_mismatch"),
        (c("classified") & c("exception_type").isNotNull(), "classified_exception_conflict"),
        (~c("classified") & (c("expected_outcome") != "success")
         & (~c("phase").eqNullSafe(F.lit("unknown")) | c("exception_type").isNull()), "invalid_unclassified_expectation"),
        (~c("supported") & (c("expected_outcome") != "expected_rejection"), "unsupported_must_reject"),
        (c("injected_failure") != (c("injection") != "none"), "injection_provenance_mismatch"),
        (none & ((c("disposition") != "none") | c("eligible") | c("may_apply") | c("expected_applied") | (c("max_attempts") > 0)),
         "repair_without_trigger"),
        (~none & disposition.isNull(), "unknown_error_code"),
        (~none & (c("disposition") != disposition), "repair_policy_mismatch"),
        (~none & (c("eligible") != (disposition != "rejected")), "repair_eligibility_mismatch"),
        (~none & (c("may_apply") != trigger.isin(*APPLICABLE_CODES)), "repair_apply_mismatch"),
        (~none & c("expected_applied") & ~c("may_apply"), "forbidden_expected_application"),
        (~none & (c("max_attempts") != F.when(c("eligible"), MAX_REPAIR_ATTEMPTS).otherwise(0)), "repair_budget_mismatch"),
        (~none & (c("injection") == "none"), "missing_failure_provenance"))


def _refusal_rules(applies: Column) -> list[tuple[Column, str]]:
    """Shape of a refused repair: a real reason, and nothing of a proposal."""
    c = F.col
    return [
        (applies & c("rejection_reason").isNull(), "missing_rejection_reason"),
        (applies & (c("rejection_reason") == "repairable"), "rejection_reason_cannot_be_repairable"),
        (applies & (~c("attempt_outcome").eqNullSafe(F.lit("rejected")) | c("proposal_outcome").isNotNull()
                    | c("proposal_reason").isNotNull() | (c("max_attempts") > 0)), "ineligible_repair_mismatch")]


def case_semantics_v2() -> Column:
    """First broken consistency rule of a version 2 case."""
    c, codes, trigger = F.col, F.col("allowed_codes"), F.col("trigger_code")
    some, occurs = F.size(codes) > 0, c("occurs")
    none = trigger.isNull()
    event = lambda name: F.array_contains("exposure_events", name)
    allowed = F.create_map(*[x for k, v in SPLIT_EXPOSURE.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    other_spec = F.exists(codes, lambda x: (~F.element_at(_category_of(), x).eqNullSafe(c("category")))
                          | (~F.element_at(_phase_of(), x).eqNullSafe(c("phase"))))
    plain = occurs & ~c("classified")
    quiet = none & ~occurs
    named = ~none
    eligible = named & c("eligible")
    return first_match(
        (_repeated(c("categories")), "duplicate_category"),
        (~F.coalesce(F.array_contains(F.try_element_at(allowed, c("split")), c("exposure")), F.lit(False)), "exposure_split_mismatch"),
        ((c("exposure") == "held") & event("downgraded_from_held"), "forbidden_exposure_reversal"),
        ((c("exposure") == "author_exposed") & event("filled") & ~event("downgraded_from_held"), "unrecorded_held_downgrade"),
        ((c("exposure") == "held") & ~event("filled"), "held_without_fill_event"),
        (occurs != c("expected_outcome").isin(*TERMINAL_FAILURES), "occurs_mismatch"),
        (_repeated(codes) | _unregistered(codes), "invalid_error_code"),
        (c("classified") != some, "classified_codes_mismatch"),
        (~occurs & (c("classified") | c("category").isNotNull() | c("phase").isNotNull() | c("exception_type").isNotNull()),
         "normal_return_must_not_expect_failure"),
        (occurs & c("classified") & c("exception_type").isNotNull(), "classified_exception_conflict"),
        (occurs & c("classified") & other_spec, "failure_classification_mismatch"),
        (plain & (~c("category").eqNullSafe(F.lit("UNCLASSIFIED")) | ~c("phase").eqNullSafe(F.lit("unknown"))
                  | ~c("exception_type").eqNullSafe(F.lit("ValueError"))), "invalid_unclassified_expectation"),
        (~c("supported") & (c("expected_outcome") != "expected_rejection"), "unsupported_must_reject"),
        (c("injected_failure") != (c("injection") != "none"), "injection_provenance_mismatch"),
        (named & ~F.map_contains_key(_phase_of(), F.coalesce(trigger, F.lit(""))), "invalid_trigger_code"),
        (c("classified") & ~F.coalesce(F.array_contains(codes, trigger), F.lit(False)), "trigger_code_not_allowed"),
        (plain & named, "unclassified_must_not_have_trigger"),
        (named & (c("injection") == "none"), "missing_failure_provenance"),
        (~occurs & (c("expected_outcome") == "partial_boundary") & named, "repair_trigger_without_failure"),
        (none & ((c("disposition") != "none") | c("may_apply") | c("expected_applied")), "repair_without_trigger"),
        (quiet & (c("eligible") | c("rejection_reason").isNotNull() | c("attempt_outcome").isNotNull()
                  | c("proposal_outcome").isNotNull() | c("proposal_reason").isNotNull() | (c("max_attempts") > 0)),
         "repair_expectation_without_failure"),
        (none & occurs & c("eligible"), "unclassified_cannot_be_eligible"),
        *_refusal_rules(none & occurs),
        (named & ~occurs & ~(c("eligible") & c("expected_applied")), "unrepaired_trigger_cannot_succeed"),
        (named & (c("disposition") != F.try_element_at(_projected(), trigger)), "repair_policy_mismatch"),
        (named & (c("may_apply") != trigger.isin(*APPLICABLE_CODES)), "repair_apply_mismatch"),
        (named & c("expected_applied") & ~(c("may_apply") & c("eligible")), "forbidden_expected_application"),
        *_refusal_rules(named & ~c("eligible")),
        (eligible & (c("rejection_reason").isNotNull() | ~c("attempt_outcome").eqNullSafe(F.lit("deferred")) | c("proposal_outcome").isNull()
                     | c("proposal_reason").isNull() | (c("max_attempts") != MAX_REPAIR_ATTEMPTS)), "eligible_repair_mismatch"),
        (eligible & c("expected_applied") & (c("proposal_outcome") != "proposed"), "applied_requires_proposed"))


def oracle_rules_v2(digest_matches: Column, task_success: Column) -> Column:
    """First conflict between a version 2 case and its scorer-only answer.

    Oracle columns: o_records, o_page_count, o_record_count, o_sha256, o_schema, o_unique_key,
    o_completeness, o_error_code, o_error_phase, o_exception_type.
    """
    c = F.col
    failing = c("expected_outcome").isin(*TERMINAL_FAILURES)
    answers = ("o_records", "o_page_count", "o_record_count", "o_sha256", "o_completeness", "o_unique_key")
    filled = F.coalesce(F.size("o_schema"), F.lit(0)) > 0
    for name in answers:
        filled = filled | c(name).isNotNull()
    errors = c("o_error_code").isNotNull() | c("o_error_phase").isNotNull() | c("o_exception_type").isNotNull()
    lacking = (c("o_records").isNull() | c("o_sha256").isNull() | c("o_page_count").isNull() | c("o_record_count").isNull()
               | (F.coalesce(F.size("o_schema"), F.lit(0)) == 0)
               | ~F.coalesce(F.map_contains_key("o_schema", F.col("o_unique_key")), F.lit(False)))
    partial = c("expected_outcome") == "partial_boundary"
    return first_match(
        (failing & filled, "failure_oracle_must_be_empty"),
        (failing & c("classified") & ~F.coalesce(F.array_contains("allowed_codes", c("o_error_code")), F.lit(False)), "oracle_error_code_mismatch"),
        (failing & ~c("classified") & c("o_error_code").isNotNull(), "unclassified_oracle_must_not_name_code"),
        (failing & ~(c("o_error_phase").eqNullSafe(c("phase")) & c("o_exception_type").eqNullSafe(c("exception_type"))),
         "oracle_failure_expectation_mismatch"),
        (~failing & errors, "output_oracle_must_not_expect_error"), (~failing & lacking, "incomplete_output_oracle"),
        (~failing & ~((c("o_record_count") == F.size("o_records")) & digest_matches), "oracle_records_hash_mismatch"),
        (~failing & partial & ~c("o_completeness").eqNullSafe(F.lit("partial")), "partial_boundary_requires_partial"),
        (~failing & ~partial & ~F.coalesce(c("o_completeness").isin("complete", "stop_condition_only"), F.lit(False)),
         "success_requires_terminal_completeness"),
        (~failing & ~partial & ~task_success, "invalid_success_oracle"))


def dispatch_version(document: Column, declared: Column) -> Column:
    """Code of a case document whose version does not belong to the declared schema."""
    version = pointer_get(document, "/version")
    number = F.when(type_tag(version) == "integer", as_text(version).try_cast("int"))
    return first_match(
        (~F.coalesce(declared.isin(1, 2), F.lit(False)), "unknown_case_schema_version"),
        (~F.coalesce(number.isin(1, 2), F.lit(False)), "unknown_case_version"), (number != declared, "mixed_case_schema_version"))


def reservation_errors(reservations: DataFrame, families: DataFrame) -> DataFrame:
    """(row_id, code): five closed fields, unique ids, known capability, a future-held family, no answers.

    ``reservations``: row_id, document VARIANT. ``families``: id, split.
    """
    members = as_object(F.col("document"))
    keys = F.map_keys(members)
    text = lambda n: F.when(type_tag(pointer_get(F.col("document"), "/" + n)) == "string",
                            as_text(pointer_get(F.col("document"), "/" + n)))
    df = reservations.withColumn("reservation_id", text("reservation_id")).withColumn("planned_family", text("planned_family"))
    first = df.groupBy("reservation_id").agg(F.min("row_id").alias("_first"))
    held = families.filter(F.col("split") == FUTURE_HELD).select(F.col("id").alias("planned_family"), F.lit(True).alias("_held")).distinct()
    df = df.join(first, "reservation_id", "left").join(held, "planned_family", "left")
    answer = F.arrays_overlap(keys, F.array(*map(F.lit, ANSWER_KEYS))) | F.exists(keys, lambda k: k.startswith("expected_"))
    shape = ((F.sort_array(keys) != F.sort_array(F.array(*map(F.lit, RESERVATION_KEYS))))
             | ~F.coalesce(F.col("reservation_id").rlike("^m6r_[a-z][a-z0-9_]{1,63}$"), F.lit(False))
             | ~F.coalesce(F.col("planned_family").rlike("^[a-z][a-z0-9_]{1,63}$"), F.lit(False))
             | ~text("intended_split").eqNullSafe(F.lit(FUTURE_HELD)) | ~text("exposure").eqNullSafe(F.lit("held_reserved")))
    target = text("capability_target")
    known = F.coalesce(target.isin(*CAPABILITIES) | F.map_contains_key(_phase_of(), F.coalesce(target, F.lit(""))), F.lit(False))
    return df.withColumn("code", first_match(
        (members.isNull(), "invalid_reservation_entry"), (answer, "forbidden_answer_data"), (shape, "invalid_reservation"),
        (~known, "unknown_capability_target"), (F.col("row_id") != F.col("_first"), "duplicate_reservation_id"),
        (F.col("_held").isNull(), "planned_family_not_future_held"))).filter("code IS NOT NULL").select("row_id", "code")


def public_input_error(fixture: Column) -> Column:
    """First broken rule of a fixture that planners may see."""
    endpoints, fields = as_array(pointer_get(fixture, "/endpoints")), as_array(pointer_get(fixture, "/fields"))
    keys = F.sort_array(F.map_keys(as_object(fixture)))
    wanted = F.array(*map(F.lit, ("method", "query", "request_body", "request_id", "responses", "url")))
    names = F.transform(fields, as_text)

    def endpoint(e):
        body, query = pointer_get(e, "/request_body"), pointer_get(e, "/query")
        real_body = F.when(~F.is_variant_null(body), body)
        answers = as_array(pointer_get(e, "/responses"))
        return first_match(
            (~F.coalesce(F.sort_array(F.map_keys(as_object(e))) == wanted, F.lit(False)), "invalid_endpoint"),
            (answers.isNull() | ~F.size(answers).between(1, 10), "invalid_response_sequence"),
            (F.exists(answers, lambda b: as_array(b).isNull() & as_object(b).isNull()), "invalid_response_body"),
            (~as_text(pointer_get(e, "/method")).isin("GET", "POST"), "invalid_method"),
            (observation_error(as_text(pointer_get(e, "/method")), real_body).isNotNull(), "invalid_request_body"),
            (local_origin(as_text(pointer_get(e, "/url")))[1].isNotNull(), "only_literal_loopback_http_supported"),
            (F.exists(F.map_keys(as_object(query)), is_sensitive) | F.coalesce(sensitive_keys(real_body), F.lit(False)), "sensitive_fixture_request"))

    ids = F.transform(endpoints, lambda e: as_text(pointer_get(e, "/request_id")))
    origins = F.array_distinct(F.transform(endpoints, lambda e: url_parts(as_text(pointer_get(e, "/url"))).origin))
    bad = F.get(F.filter(F.transform(endpoints, endpoint), lambda c: c.isNotNull()), F.lit(0))
    before = first_match(
        (~F.coalesce(keys == F.array(F.lit("endpoints"), F.lit("fields")), F.lit(False)), "invalid_public_input"),
        (fields.isNull() | (F.size(fields) == 0) | F.exists(fields, lambda f: type_tag(f) != "string")
         | F.exists(names, lambda n: (n == "") | is_sensitive(n)) | _repeated(names), "invalid_fields"),
        (endpoints.isNull() | (F.size(endpoints) == 0), "missing_endpoints"))
    after = first_match((_repeated(ids), "duplicate_request_id"), (F.size(origins) != 1, "cross_origin_fixture"),
                        (has_member(fixture, list(SCORER_KEYS)), "scorer_metadata_in_public_input"))
    return F.coalesce(before, bad, after)


def shared_names(names: DataFrame) -> DataFrame:
    """(kind, name) used on more than one split. ``names``: split, kind, name."""
    return names.groupBy("kind", "name").agg(F.min("split").alias("a"), F.max("split").alias("b")).filter("a <> b").select("kind", "name")


def names_in_corpus(names: DataFrame, corpus_terms: DataFrame) -> DataFrame:
    """Held-out names that occur in the retrieval corpus. ``corpus_terms``: name."""
    return names.join(corpus_terms.select("name"), "name", "left_semi").select("name").distinct()
