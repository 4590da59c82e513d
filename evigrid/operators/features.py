"""Closed evidence features per query, from redacted summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json_values import as_array, as_object, as_text, type_tag
from ..functions.texts import is_sensitive, normalize_name, tokens
from ..functions.walks import structure_members
from ..plans.knowledge import FEATURES, PAGE_KEY_TOKENS


def _small_number(text: Column) -> Column:
    return text.rlike(r"(?U)^\d{1,3}$")


def query_tokens(summaries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Distinct key words of query and response structure: one row per (query, token).

    ``summaries``: query_id, query map, response_shape VARIANT. Copies of a token are
    merged before the shuffle.
    """
    keys = F.concat(F.map_keys("query"), F.transform(structure_members(F.col("response_shape")), lambda m: m["key"]))
    words = F.array_distinct(F.flatten(F.transform(keys, tokens)))
    return summaries.select(query_id, F.explode(words).alias("term")).distinct()


def evidence_features(summaries: DataFrame, fields: list[str], query_id: str = "query_id") -> DataFrame:
    """Seven closed features per query; ``unknown`` where the evidence cannot say.

    ``summaries``: query_id, method, query map, request_body_shape VARIANT, response_shape
    VARIANT. Every aggregate is a boolean or an extreme, so a query with very many summaries
    costs one row per task.
    """
    shape, body = F.col("response_shape"), as_object(F.col("request_body_shape"))
    page_key = lambda m: F.arrays_overlap(tokens(m["key"]), F.array(*map(F.lit, PAGE_KEY_TOKENS)))
    rows = summaries.withColumn("_m", structure_members(shape))
    lists = F.transform(F.filter("_m", lambda m: m["type"] == "array"), lambda m: m["path"])
    containers = F.when(as_array(shape).isNotNull(), F.concat(F.array(F.lit("")), lists)).otherwise(lists)
    visible = F.map_filter(body, lambda k, v: ~is_sensitive(k))
    names = F.transform("_m", lambda m: normalize_name(m["key"]))
    wanted = [f for f in fields if f.strip()]
    rows = rows.select(
        query_id, F.when(F.col("method").isin(*FEATURES["method"]), F.col("method")).alias("method"),
        F.array_min(containers).alias("c_min"), F.array_max(containers).alias("c_max"),
        F.exists(F.map_entries(F.map_filter("query", lambda k, v: ~is_sensitive(k))),
                 lambda e: _small_number(e["value"])).alias("in_query"),
        F.exists(F.map_values(visible), lambda v: _small_number(as_text(v)) & (
            (type_tag(v) == "string") | ((type_tag(v) == "integer") & (as_text(v).try_cast("int") > 0)))).alias("in_body"),
        F.exists("_m", lambda m: m["text"] == "<boolean>").alias("flag"),
        F.exists("_m", lambda m: (m["text"] == "<integer>") & page_key(m)).alias("pages"),
        F.exists("_m", lambda m: (m["text"] == "<integer>") & ~page_key(m)).alias("records"),
        (F.size(F.coalesce(F.map_values(as_object(shape)), as_array(shape))) > 0).alias("seen"),
        (F.size("_m") > 0).alias("named"),
        *[F.array_contains(names, F.array_join(tokens(F.lit(f)), "")).alias(f"has_{i}") for i, f in enumerate(wanted)])
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    g = rows.groupBy(query_id).agg(
        F.min("method").alias("m_min"), F.max("method").alias("m_max"), F.min("c_min").alias("c_min"),
        F.max("c_max").alias("c_max"), *[any_(c) for c in (
            "in_query", "in_body", "flag", "pages", "records", "seen", "named",
            *[f"has_{i}" for i in range(len(wanted))])])
    method = F.when(F.col("m_min") == F.col("m_max"), F.col("m_min")).otherwise("unknown")
    q, b = F.col("in_query"), F.col("in_body")
    location = (F.when(method == "POST", F.when(b, "json_body").when(q, "query"))
                .when(method == "GET", F.when(q, "query").when(b, "json_body"))
                .when(q & ~b, "query").when(b & ~q, "json_body"))
    stop = (F.when(F.col("flag"), "boolean_flag").when(F.col("pages"), "total_pages_ambiguous")
            .when(F.col("records"), "total_int_only").otherwise("none"))
    all_there = F.lit(True)
    for i in range(len(wanted)):
        all_there = all_there & F.col(f"has_{i}")
    comparable = bool(wanted) and all(re.search(r"[a-z0-9_]", f.lower()) for f in wanted)
    unknown = lambda c: F.coalesce(c, F.lit("unknown"))
    return g.select(
        query_id, method.alias("method"), unknown(location).alias("page_location"),
        unknown(F.when(F.col("c_min") == "", "root_list").when(F.col("c_min").isNotNull(), "nested")).alias("items_container"),
        stop.alias("stop_signal"),
        F.when(~F.col("seen"), "unknown").when(F.col("flag"), "present").otherwise("absent").alias("continuation_flag"),
        F.when(F.lit(not comparable) | ~F.col("named"), "unknown").when(all_there, "verbatim")
        .otherwise("aliased_required").alias("field_mapping"),
        unknown(F.when(F.col("c_min") == F.col("c_max"), "single_candidate").when(
            F.col("c_min").isNotNull(), "multiple_candidates")).alias("ambiguity"))


def feature_map() -> Column:
    """The feature columns as one map."""
    return F.create_map(*[x for k in FEATURES for x in (F.lit(k), F.col(k))])
