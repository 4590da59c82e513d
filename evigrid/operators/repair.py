"""Bounded, evidence-only plan repair: candidates, policy, audit, one rerun."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json_values import as_array, as_object, as_text, pointer_get, type_tag
from ..functions.texts import is_sensitive, pointer_escape
from ..plans.specs import PLAN_COLUMNS, attach_plan, plan_hash
from ..plans.taxonomy import APPLICABLE_CODES, MAX_REPAIR_ATTEMPTS, PRE_COLLECTION_PHASES, classify, trusted_code
from ..session import cut_lineage
from .collect import run_collection
from .validate import validate_plans

STRUCTURAL = ("items_pointer", "total_pointer", "has_next_pointer")


def pointer_candidates(body: Column, attribute: str) -> Column:
    """Sorted pointers to direct members of the kind ``attribute`` needs; sensitive names never qualify."""
    def fits(v):
        if attribute == "items_pointer":
            return as_object(F.try_variant_get(v, "$[0]", "variant")).isNotNull()
        if attribute == "total_pointer":
            return (type_tag(v) == "integer") & (as_text(v).try_cast("bigint") >= 0)
        return type_tag(v) == "boolean"
    good = F.filter(F.map_entries(as_object(body)), lambda e: F.coalesce(fits(e["value"]), F.lit(False)) & ~is_sensitive(e["key"]))
    members = F.sort_array(F.transform(good, lambda e: F.concat(F.lit("/"), pointer_escape(e["key"]))))
    root = F.when(as_array(body).isNotNull() & fits(body), F.array(F.lit("")))
    return F.coalesce(members, root, F.array().cast("array<string>"))


def failed_attribute(body: Column) -> Column:
    """Which structural pointer of the plan columns does not resolve in ``body``."""
    out = F.lit(None).cast("string")
    for name in reversed(STRUCTURAL):
        out = F.when(F.col(name).isNotNull() & pointer_get(body, F.col(name)).isNull(), name).otherwise(out)
    return out


def relocate_pointer(df: DataFrame) -> dict[str, Column]:
    """New plan columns where exactly one other member fits the failed pointer."""
    body, failed = F.col("document"), F.col("failed_attribute")
    out = {}
    for name in STRUCTURAL:
        others = F.filter(pointer_candidates(body, name), lambda p: p != F.col(name))
        only = F.transform(F.array(others), lambda o: F.when(F.size(o) == 1, F.get(o, F.lit(0))))[0]
        out[name] = F.when((F.col("error_code") == "pointer_not_found") & (failed == name), only)
    return out


def relocate_page(df: DataFrame) -> dict[str, Column]:
    """Page location as the request shows it, where the parameter there is numeric."""
    parameter = F.col("page_parameter")
    in_query = F.try_element_at("query", parameter).rlike(r"(?U)^\d+$")
    in_body = type_tag(F.try_element_at(as_object(F.col("request_body")), parameter)) == "integer"
    target = F.when(F.col("method") == "GET", F.when(in_query, "query")).otherwise(F.when(in_body, "json_body"))
    return {"pagination_location": F.when((F.col("error_code") == "page_location_mismatch")
                                          & (target != F.col("pagination_location")), target)}


# Error code → (reason, rule). A rule returns replacement columns, NULL where it has none.
GENERATORS: dict[str, tuple[str, Callable[[DataFrame], dict[str, Column]]]] = {
    "pointer_not_found": ("pointer_relocated", relocate_pointer),
    "page_location_mismatch": ("page_location_from_evidence", relocate_page),
}


def repair_policy(failures: DataFrame, max_attempts: int = MAX_REPAIR_ATTEMPTS) -> DataFrame:
    """Add eligible and policy_reason. Reads error_code, attempts, original_plan_hash."""
    df = classify(failures)
    started = ~F.col("phase").isin(*PRE_COLLECTION_PHASES)
    reason = (F.when(F.col("category") == "UNCLASSIFIED", "unclassified").when(~F.col("repairable"), "not_repairable")
              .when(F.col("attempts") >= max_attempts, "repair_budget_exhausted").when(started, "collection_started")
              .when(F.coalesce("original_plan_hash", F.lit("")) == "", "missing_original_plan").otherwise("repairable"))
    return (df.withColumn("policy_reason", reason).withColumn("eligible", F.col("policy_reason") == "repairable")
            .withColumn("collection_started", started))


def repair_audit(failures: DataFrame, plans: DataFrame, observations: DataFrame, names: list[str], *,
                 generators=None, target_code: Column | None = None) -> DataFrame:
    """One audited attempt per failed source, with the candidate plan columns.

    ``failures``: source_id, error_code. ``observations``: source_id, request_id, method, url, query,
    request_body VARIANT, body. All joins are on ``source_id``.
    """
    generators = GENERATORS if generators is None else generators
    df = failures.select("source_id", trusted_code(F.col("error_code")).alias("error_code")).withColumn("attempts", F.lit(0))
    df = attach_plan(df, plans).withColumn("original_plan_hash", F.when(F.col("request_id").isNotNull(), plan_hash()))
    df = repair_policy(df)
    seen = observations.select("source_id", "method", "url", "query", "request_body", "body").withColumn(
        "document", F.try_parse_json("body"))
    df = df.join(seen, "source_id", "left").withColumn("failed_attribute", failed_attribute(F.col("document")))

    changes: dict[str, list[Column]] = {}
    reason = F.lit(None).cast("string")
    for code, (why, rule) in generators.items():
        for column, value in rule(df).items():
            changes.setdefault(column, []).append(F.when(F.col("eligible") & (F.col("error_code") == code), value))
        reason = F.when(F.col("error_code") == code, why).otherwise(reason)
    df = df.withColumns({f"_new_{c}": F.coalesce(*v) for c, v in changes.items()})
    modified = F.filter(F.array(*[F.when(F.col(f"_new_{c}").isNotNull(), F.lit(c)) for c in changes]), lambda c: c.isNotNull())
    df = df.withColumn("modified_fields", modified)
    changed = F.size("modified_fields") > 0
    df = df.withColumns({f"candidate_{c}": F.coalesce(f"_new_{c}", c) if c in changes else F.col(c) for c in PLAN_COLUMNS})
    df = df.withColumn("candidate_plan_hash", F.when(changed, plan_hash({c: F.col(f"candidate_{c}") for c in PLAN_COLUMNS})))

    # One narrow row per failure; the candidates are judged from it without working them out again.
    df = cut_lineage(df.drop("document", "body", "request_body", "query", "method", "url"))
    candidates = candidate_plans(df.filter(changed))
    checked = validate_plans(candidates, observations, names, target_code=target_code).filter("request_id IS NOT NULL").select(
        "source_id", F.coalesce(F.concat(F.lit("invalid:"), F.col("code")), F.lit("valid")).alias("validation_result"))
    df = df.join(checked, "source_id", "left")
    proposed = F.col("validation_result") == "valid"
    return df.select(
        "source_id", (F.col("attempts") + 1).alias("attempt"), "error_code", F.col("category").alias("error_category"),
        F.col("phase").alias("failure_phase"), "collection_started", "original_plan_hash", "candidate_plan_hash",
        "modified_fields", F.when(F.col("eligible"), "repairable").alias("reason_code"), "validation_result",
        F.when(~F.col("eligible"), F.col("policy_reason")).alias("rejection_code"),
        F.when(F.col("eligible"), "deferred").otherwise("rejected").alias("outcome"),
        F.when(F.col("eligible"), F.when(changed, reason).otherwise("no_deterministic_candidate")).alias("proposal_reason"),
        F.when(F.col("eligible"), F.when(proposed, "proposed").otherwise("rejected")).alias("proposal_outcome"),
        F.coalesce(proposed & F.col("error_code").isin(*APPLICABLE_CODES), F.lit(False)).alias("applicable"),
        *[f"candidate_{c}" for c in PLAN_COLUMNS])


def candidate_plans(audit: DataFrame) -> DataFrame:
    return audit.select("source_id", *[F.col(f"candidate_{c}").alias(c) for c in PLAN_COLUMNS])


def audit_violations(audit: DataFrame) -> DataFrame:
    """Rows that break an invariant of the audit record itself."""
    both = F.col("reason_code").isNull() == F.col("rejection_code").isNull()
    shown = (F.col("proposal_outcome") == "proposed") != (
        F.col("candidate_plan_hash").isNotNull() & (F.col("validation_result") == "valid"))
    code = F.when(both, "repair_decision_requires_exactly_one_code").when(
        F.coalesce(shown, F.lit(False)), "proposal_outcome_inconsistent")
    return audit.withColumn("code", code).filter("code IS NOT NULL").select("source_id", "code")


def repair_and_rerun(pages: DataFrame, plans: DataFrame, observations: DataFrame, names: list[str],
                     **options) -> tuple[DataFrame, DataFrame]:
    """(summary with repair lineage, audit): failed sources with an applicable candidate run once more.

    Only the pages of repaired sources are read again. The first summary and the audit are
    narrow (one row per source) and are checkpointed, so neither run is repeated.
    """
    first = cut_lineage(run_collection(pages, plans, names, **options).summary)
    failed = first.filter("status = 'failed'").select("source_id", "error_code")
    audit = cut_lineage(repair_audit(failed, plans, observations, names))
    repaired = candidate_plans(audit.filter("applicable"))
    again = run_collection(pages.join(repaired.select("source_id"), "source_id", "left_semi"), repaired, names, **options).summary
    kept = first.join(repaired.select("source_id"), "source_id", "left_anti")
    summary = kept.withColumn("repaired", F.lit(False)).unionByName(again.withColumn("repaired", F.lit(True)))
    notes = audit.select("source_id", "proposal_outcome", "original_plan_hash", "candidate_plan_hash", F.lit(True).alias("_audited"))
    out = summary.join(notes, "source_id", "left")
    outcome = (F.when(F.col("repaired"), F.when(F.col("status") == "succeeded", "applied").otherwise("applied_failed"))
               .when(F.col("proposal_outcome") == "proposed", "deferred").when(F.col("_audited"), "rejected"))
    return out.withColumn("repair_outcome", outcome).drop("_audited", "proposal_outcome"), audit
