"""Curated reference cases and their closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .taxonomy import SPECS, repairability_of

# The closed vocabulary of evidence features.
FEATURES = {
    "method": ("GET", "POST"),
    "page_location": ("query", "json_body"),
    "items_container": ("root_list", "nested"),
    "stop_signal": ("boolean_flag", "total_int_only", "total_pages_ambiguous", "none"),
    "continuation_flag": ("present", "absent"),
    "field_mapping": ("verbatim", "aliased_required"),
    "ambiguity": ("single_candidate", "multiple_candidates"),
}
# Key words that make an integer a page count rather than a record count.
PAGE_KEY_TOKENS = ("page", "pages", "pageno", "pagecount", "pageindex", "totalpages")
DISPOSITIONS = ("auto_applied", "proposal_only", "rejected")

# Ids and terms of the built-in corpus.
RUNTIME_CASES = (
    ("page_items", ["page", "items", "has_next", "total"]),
    ("nested_records", ["pageNo", "data", "records", "totalCount", "hasMore"]),
    ("rows_more", ["p", "rows", "sku", "title", "more", "total"]),
    ("total_only", ["pageIndex", "list", "count", "totalPages"]),
    ("cursor_unsupported", ["cursor", "next_cursor", "edges", "pageInfo", "endCursor"]),
    ("offset_unsupported", ["offset", "limit", "results", "nextOffset"]),
)

CASE_SCHEMA = ("case_id string, terms array<string>, features map<string,string>, "
               "failure_modes array<struct<code:string,category:string,phase:string,signal:string>>, "
               "repairability map<string,string>")


def runtime_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, t, None, None, None) for i, t in RUNTIME_CASES], CASE_SCHEMA)


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge corpus as JSON lines or a JSON array; version 2 where any structured part is given."""
    schema = "id string, title string, guidance string, scenario map<string,string>, " + CASE_SCHEMA.replace("case_id string, ", "")
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return with_version(raw.withColumnRenamed("id", "case_id"))


def with_version(cases: DataFrame) -> DataFrame:
    parts = [c for c in ("scenario", "failure_modes", "repairability") if c in cases.columns]
    structured = F.lit(False)
    for c in parts:
        structured = structured | F.col(c).isNotNull()
    return cases.withColumn("case_schema_version", F.when(structured, 2).otherwise(1))


def _lookup(index: int) -> Column:
    """Taxonomy column as a literal map (73 codes)."""
    return F.create_map(*[F.lit(x) for code, row in SPECS.items() for x in (code, row[index])])


def case_violation(cases: DataFrame) -> Column:
    """First broken rule of a knowledge case, NULL where it is sound."""
    category, phase = _lookup(1), _lookup(2)
    projected = F.create_map(*[F.lit(x) for code in SPECS for x in (code, repairability_of(code))])
    modes, declared = F.col("failure_modes"), F.col("repairability")
    codes = F.transform(modes, lambda m: m["code"])
    none = F.lit(None).cast("string")

    def bad_mode(m, i):
        return (F.when(~F.map_contains_key(category, m["code"]), "unknown_error_code")
                .when(F.array_position(codes, m["code"]) < i + 1, "duplicate_failure_mode")
                .when(F.element_at(category, m["code"]) != m["category"], "error_category_mismatch")
                .when(F.element_at(phase, m["code"]) != m["phase"], "error_phase_mismatch")
                .when(~F.coalesce(m["signal"].rlike("^[a-z][a-z0-9_]{0,63}$"), F.lit(False)), "invalid_signal"))

    def bad_entry(e):
        return (F.when(~F.map_contains_key(category, e["key"]), "unknown_error_code")
                .when(~e["value"].isin(*DISPOSITIONS), "invalid_repairability")
                .when(e["value"] != F.element_at(projected, e["key"]), "repairability_mismatch"))

    first = lambda a: F.get(F.filter(a, lambda c: c.isNotNull()), F.lit(0))
    rules = [F.when(F.coalesce(F.col("case_id"), F.lit("")) == "", "invalid_case_id"),
             F.when(F.col("terms").isNull() | F.exists("terms", lambda t: t.isNull()), "invalid_case_terms")]
    if "scenario" in cases.columns:
        allowed = F.create_map(*[x for k, v in FEATURES.items() for x in (
            F.lit(k), F.array(*map(F.lit, (*v, "unknown"))))])
        rules.append(first(F.transform(F.map_entries("scenario"), lambda e: F.when(
            ~F.map_contains_key(allowed, e["key"]), "scenario_key_not_allowed").when(
            ~F.array_contains(F.element_at(allowed, e["key"]), e["value"]), "scenario_value_not_allowed"))))
    rules.append(first(F.transform(modes, bad_mode)))
    rules.append(first(F.transform(F.map_entries(declared), bad_entry)))
    return F.coalesce(*rules, none)


def consistent_repairability(declared: Column) -> Column:
    """Whether every declared disposition is the one the taxonomy projects; unknown codes are not, nothing declared is."""
    projected = F.create_map(*[F.lit(x) for code in SPECS for x in (code, repairability_of(code))])
    return F.coalesce(F.forall(F.map_entries(declared), lambda e: F.coalesce(
        F.try_element_at(projected, e["key"]) == e["value"], F.lit(False))), F.lit(True))


def corpus_identity(cases: DataFrame, group: list[str] = []) -> DataFrame:
    """Per group: ``cases``, ``corpus_sha256`` and ``repairability_consistency`` (1.0, or 0.0 where one declared disposition is not the projected one).

    The digest names the multiset of cases: that of the number of cases and of the sums of their digests, taken 32 bits at a time, so it is
    a plain aggregate and the order of cases, map keys and partitions does not matter. It tells corpora apart; it is no seal against forgery.
    """
    entries = lambda c: F.sort_array(F.map_entries(c)).alias(c)
    words = F.col("tokens" if "tokens" in cases.columns else "terms").alias("terms")
    parts = [("features", entries), ("failure_modes", F.col), ("repairability", entries)]
    facts = [make(c) for c, make in parts if c in cases.columns]
    text = F.to_json(F.struct(F.col("case_id").cast("string").alias("case_id"), words, *facts))
    rows = cases.select(*group, F.sha2(text, 256).alias("d"), consistent_repairability(F.col("repairability")).alias("same"))
    sums = [F.sum(F.conv(F.substring("d", i + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(0, 64, 8)]
    whole = F.count("*").cast("string")
    return rows.groupBy(*group).agg(
        F.count("*").alias("cases"), F.sha2(F.concat_ws(",", whole, *sums), 256).alias("corpus_sha256"),
        F.coalesce(F.bool_and("same"), F.lit(True)).cast("double").alias("repairability_consistency"))


def repeated_case_ids(cases: DataFrame) -> DataFrame:
    return cases.groupBy("case_id").agg(F.count("*").alias("n")).filter("n > 1")
