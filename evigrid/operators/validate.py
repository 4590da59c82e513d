"""Declared types, finite numbers, plan and pagination rules, whole-row deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json_values import as_object, as_text, digest, pointer_get, type_tag
from ..functions.texts import is_sensitive, parse_boolean, parse_integer, parse_number
from ..functions.walks import sensitive_keys
from ..plans.specs import FIELD_TYPES, FieldSpec
from .collect import _sample_code, first_match, _read_body


def is_finite(value: Column) -> Column:
    return ~(F.isnan(value) | (F.abs(value) == float("inf")))


def field_violation(value: Column, spec: FieldSpec) -> Column:
    """Violation of one Variant value against its declaration; nothing is coerced."""
    tag = type_tag(value)
    empty = tag.isin("missing", "null")
    rules = [] if not spec.required else [(empty, "required_field_missing")]
    wrong = ~empty & (~tag.isin(*FIELD_TYPES[spec.type])
                      | ((tag == "number") & as_text(value).isin("Infinity", "-Infinity", "NaN")))
    return first_match(*rules, (wrong, "requested_field_type_mismatch"))


def verify_fields(rows: DataFrame, specs: list[FieldSpec], keys: list[str], document: str = "document") -> DataFrame:
    """One row per violated field of each Variant ``document``."""
    found = F.array(*[F.struct(F.lit(s.name).alias("field"), F.lit(i).alias("check"), field_violation(
        pointer_get(F.col(document), "/" + s.name), s).alias("code")) for i, s in enumerate(specs)])
    return rows.select(*keys, F.explode(F.filter(found, lambda x: x["code"].isNotNull())).alias("v")).select(
        *keys, "v.field", "v.check", "v.code")


def missing_counts(rows: DataFrame, optional: list[str]) -> DataFrame:
    """Nulls per optional column: one pass, one tiny result."""
    counted = rows.agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in optional])
    return counted.unpivot([], [F.col(n) for n in optional], "field", "missing")


def normalize_html(value: Column, kind: str) -> tuple[Column, Column]:
    """(typed value, mismatch flag) for a text taken from markup."""
    parse = {"integer": parse_integer, "number": parse_number, "boolean": parse_boolean}.get(kind)
    if parse is None:
        return value, F.lit(False)
    typed = parse(value)
    return typed, value.isNotNull() & typed.isNull()


def page_location_rules(location: Column, parameter: Column, method: Column, query: Column,
                        request_body: Column) -> Column:
    """Code where the page parameter is not where the request shows it."""
    in_query = F.try_element_at(query, parameter)
    member = F.try_element_at(as_object(request_body), parameter)
    return (F.when(location == "query", first_match(
        (method != "GET", "page_location_mismatch"),
        (in_query.isNull() | ~in_query.rlike(r"(?U)^\d+$"), "unobserved_page_parameter")))
        .otherwise(first_match(
            (method != "POST", "page_location_mismatch"),
            (member.isNull(), "unobserved_page_parameter"),
            (type_tag(member) != "integer", "invalid_page_field_type"))))


def validate_plans(plans: DataFrame, observations: DataFrame, names: list[str], *, optional: set[str] = frozenset(),
                   target_code: Column | None = None) -> DataFrame:
    """Every plan against its observed request: first failing rule, or NULL.

    ``observations`` is (source_id, request_id, method, url, query, request_body VARIANT, body).
    ``target_code`` is a Column giving the rejection code of ``url``.
    """
    obs = observations.withColumnRenamed("request_id", "observed_id")
    df = _read_body(obs, names, plans).withColumn(
        "_url_code", target_code if target_code is not None else F.lit(None).cast("string"))
    names_ok = F.transform(F.map_entries("fields"), lambda e: e["value"].startswith("/")
                           & ~is_sensitive(e["key"]) & ~is_sensitive(e["value"]))
    required = [i for i, n in enumerate(names) if n not in optional]
    before = first_match(
        (F.col("request_id").isNull() | (F.col("request_id") != F.col("observed_id")), "unknown_request_id"),
        (F.col("_url_code").isNotNull(), "?"),
        (F.exists(F.map_keys("query"), is_sensitive) | sensitive_keys(F.col("request_body")),
         "sensitive_request_not_supported"))
    paging = page_location_rules(F.col("pagination_location"), F.col("page_parameter"), F.col("method"),
                                 F.col("query"), F.col("request_body"))
    shape = first_match(
        (~F.map_contains_key("fields", F.col("unique_key")), "unique_key_not_in_fields"),
        (F.col("unique_key").isin(*optional) if optional else F.lit(False), "unique_key_must_be_required"),
        (F.exists(names_ok, lambda ok: ~ok), "invalid_or_sensitive_field"))
    sample = _sample_code(F.col("_node"), F.col("_items"), F.get(F.col("_items"), F.lit(0)), F.col("_total.t"),
                          F.col("_more.t"), F.col("total_pointer"), F.col("has_next_pointer"), required)
    before = F.when(before == "?", F.col("_url_code")).otherwise(before)
    return df.select("source_id", "request_id", F.coalesce(before, paging, shape, sample).alias("code"),
                     F.struct(*[F.get(F.col("_items"), F.lit(0))[i]["t"].alias(n) for i, n in enumerate(names)]).alias("sample_types"))


def row_digest(columns: list[str]) -> Column:
    """Content address of a row."""
    return digest(F.to_variant_object(F.struct(*columns)))


def keep_first(df: DataFrame, scope: list[str], content: list[str], order: list[str]) -> DataFrame:
    """Drop later copies of a row. ``scope + order`` identifies a row.

    Copies are reduced before the shuffle (one minimum per content), so a group of copies
    of any size costs one row per input partition.
    """
    tagged = df.withColumn("row_digest", row_digest(content))
    firsts = tagged.groupBy(*scope, "row_digest").agg(F.min(F.struct(*order)).alias("_f"))
    return tagged.join(firsts.select(*scope, "row_digest", "_f.*"), [*scope, "row_digest", *order], "left_semi")


def duplicates_removed(df: DataFrame, scope: list[str], content: list[str]) -> DataFrame:
    counted = df.withColumn("row_digest", row_digest(content)).groupBy(*scope, "row_digest").agg(F.count("*").alias("n"))
    return counted.groupBy(*scope).agg(F.sum(F.col("n") - 1).alias("duplicates_removed"))


def product_rules(product: Column) -> Column:
    """First broken rule of a fixed-schema product row (id, name, price_fen as Variant members)."""
    pid, name, price = (pointer_get(product, p) for p in ("/id", "/name", "/price_fen"))
    as_int = lambda v: as_text(v).try_cast("bigint")
    return first_match(
        ((type_tag(pid) != "integer") | (as_int(pid) <= 0), "invalid_id"),
        ((type_tag(name) != "string") | (as_text(name) == ""), "invalid_name"),
        ((type_tag(price) != "integer") | (as_int(price) < 0), "invalid_price"))
