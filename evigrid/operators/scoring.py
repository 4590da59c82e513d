"""Scores of finished tasks against independent answers, and comparison of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.json_values import as_object, as_text, digest, type_tag
from ..session import cut_lineage

FLAGS = ("collector_exported", "collector_execution_success", "collector_matches_internal_result")


def same_rows(records: DataFrame, answers: DataFrame) -> DataFrame:
    """(task_id, same): whether a task's records are exactly the answers, in order.

    Rows meet by task, place and digest with opposite signs, so no task is gathered, whatever its size.
    """
    row = lambda df, sign: df.select("task_id", "ordinal", digest(F.col("document")).alias("d"), F.lit(sign).alias("s"))
    met = row(records, 1).unionByName(row(answers, -1)).groupBy("task_id", "ordinal", "d").agg(F.sum("s").alias("s"))
    return met.groupBy("task_id").agg(F.bool_and(F.col("s") == 0).alias("same"))


def matches_oracle(reports: DataFrame, records: DataFrame, oracles: DataFrame, answers: DataFrame) -> DataFrame:
    """(task_id, matches): counts, pages, completeness, schema, keys and the ordered rows all agree.

    ``reports``: task_id, pages, completeness. ``records`` and ``answers``: task_id, ordinal (from 1), document VARIANT.
    ``oracles``: task_id, record_count, page_count, completeness, schema map, unique_key.
    """
    o = oracles.select("task_id", "record_count", "page_count", F.col("completeness").alias("expected"),
                       "schema", "unique_key")
    members = as_object(F.col("document"))
    key = F.try_element_at(members, F.col("unique_key"))
    rows = records.join(o.select("task_id", "schema", "unique_key"), "task_id")
    typed = F.transform_values(members, lambda k, v: type_tag(v))
    rows = rows.select("task_id", (F.sort_array(F.map_entries(typed)) == F.sort_array(F.map_entries("schema"))).alias("schema_ok"),
                       (type_tag(key).isin("integer", "string") & (as_text(key) != "")).alias("key_ok"),
                       F.struct(type_tag(key).alias("t"), as_text(key).alias("s")).alias("key"))
    facts = rows.groupBy("task_id", "key").agg(F.count("*").alias("n"), F.bool_and("schema_ok").alias("schema_ok"),
                                               F.bool_and("key_ok").alias("key_ok"))
    facts = facts.groupBy("task_id").agg(F.sum("n").alias("n"), (F.max("n") == 1).alias("unique"),
                                         F.bool_and("schema_ok").alias("schema_ok"), F.bool_and("key_ok").alias("key_ok"))
    joined = (reports.select("task_id", "pages", "completeness").join(o, "task_id")
              .join(facts, "task_id", "left").join(same_rows(records, answers), "task_id", "left"))
    ok = ((F.col("pages") == F.col("page_count")) & (F.coalesce("n", F.lit(0)) == F.col("record_count"))
          & (F.col("completeness") == F.col("expected")) & F.coalesce("schema_ok", F.lit(True))
          & F.coalesce("key_ok", F.lit(True)) & F.coalesce("unique", F.lit(True))
          & F.coalesce("same", F.lit(True)))  # no rows on either side agree
    return joined.select("task_id", F.coalesce(ok, F.lit(False)).alias("matches"))


def score_tasks(reports: DataFrame, records: DataFrame, oracles: DataFrame, answers: DataFrame, collected: DataFrame | None = None,
                collected_records: DataFrame | None = None) -> DataFrame:
    """(task_id, task_success, delivery_success). Delivery also needs the three flags and an
    independently matching second result."""
    own = matches_oracle(reports, records, oracles, answers)
    out = reports.join(own, "task_id", "left").withColumn(
        "task_success", (F.col("status") == "succeeded") & F.coalesce("matches", F.lit(False))).drop("matches")
    if collected is None:
        return out.select("task_id", "task_success", F.lit(False).alias("delivery_success"))
    second = matches_oracle(collected, collected_records, oracles, answers).withColumnRenamed("matches", "second")
    flags = F.lit(True)
    for name in FLAGS:
        flags = flags & F.coalesce(F.col(name), F.lit(False))
    return out.join(second, "task_id", "left").select(
        "task_id", "task_success", (F.col("task_success") & flags & F.coalesce("second", F.lit(False))).alias("delivery_success"))


def expected_rejection(status: Column, code: Column, phase: Column, requests: Column, exception: Column,
                       allowed_codes: Column, expected_phase: Column, expected_exception: Column, ceiling: Column) -> Column:
    """A failure that was asked for; an unknown request count never passes."""
    by_code = F.array_contains(allowed_codes, code)
    plain = code.isNull() & expected_exception.isNotNull() & (exception == expected_exception)
    matched = F.when(F.size(allowed_codes) > 0, by_code).otherwise(plain)
    return F.coalesce((status == "failed") & matched & (phase == expected_phase) & (requests >= 0) & (requests <= ceiling),
                      F.lit(False))


def benchmark_grade(summary: DataFrame, expected: DataFrame) -> DataFrame:
    """Run summary against expected outcome per source. ``expected``: source_id, should_fail,
    failure_kind, record_count, page_count, expected_completeness."""
    joined = expected.join(summary, "source_id", "left")
    fine = ((F.col("status") == "succeeded") & (F.col("count") == F.col("record_count")) & (F.col("pages") == F.col("page_count"))
            & (F.col("completeness") == F.col("expected_completeness")))
    grade = F.when(F.col("should_fail"), F.col("error_code") == F.col("failure_kind")).otherwise(fine)
    return joined.select("source_id", F.coalesce(grade, F.lit(False)).alias("passed"))


def compare_results(left: DataFrame, right: DataFrame, left_rows: DataFrame, right_rows: DataFrame, unique_key: str) -> DataFrame:
    """Eight order-free checks per task between two result sets.

    ``left``/``right``: task_id, pages, completeness, expected_total. Rows: task_id, ordinal,
    document VARIANT. Row equality is a count per (task, row digest) with opposite signs, so no
    result set is collected.
    """
    def facts(rows, side):
        members = as_object(F.col("document"))
        key = F.try_element_at(members, F.lit(unique_key))
        types = F.sort_array(F.map_entries(F.transform_values(members, lambda k, v: type_tag(v))))
        # Numbers alone are added up over all rows, which needs no sorting; the types are read of first rows only.
        keys = rows.groupBy("task_id", F.concat_ws(":", type_tag(key), as_text(key)).alias("k")).agg(F.count("*").alias("c"), F.min("ordinal").alias("o"))
        sizes = cut_lineage(keys.groupBy("task_id").agg(F.sum("c").alias(f"{side}_n"), (F.max("c") == 1).alias(f"{side}_unique"), F.min("o").alias("ordinal")))
        heads = rows.join(sizes.select("task_id", "ordinal"), ["task_id", "ordinal"], "left_semi").select("task_id", types.alias("types"))
        heads = cut_lineage(heads.groupBy("task_id").agg(F.min("types").alias(f"{side}_types")))
        return sizes.drop("ordinal").join(heads, "task_id", "left")

    signed = left_rows.select("task_id", digest(F.col("document")).alias("d"), F.lit(1).alias("s")).unionByName(
        right_rows.select("task_id", digest(F.col("document")).alias("d"), F.lit(-1).alias("s")))
    # Stored like the facts, so that no task holds the tables of several of these steps at once.
    same = cut_lineage(signed.groupBy("task_id", "d").agg(F.sum("s").alias("s")).groupBy("task_id").agg(
        F.bool_and(F.col("s") == 0).alias("records")))
    a = left.select("task_id", *[F.col(c).alias(f"l_{c}") for c in ("pages", "completeness", "expected_total")])
    b = right.select("task_id", *[F.col(c).alias(f"r_{c}") for c in ("pages", "completeness", "expected_total")], F.lit(True).alias("_there"))
    df = a.join(b, "task_id", "left").join(facts(left_rows, "l"), "task_id", "left").join(
        facts(right_rows, "r"), "task_id", "left").join(same, "task_id", "left")
    names = lambda side: F.transform(f"{side}_types", lambda e: e["key"])
    checks = {c: F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in ("pages", "completeness", "expected_total")}
    checks["record_count"] = F.coalesce("l_n", F.lit(0)) == F.coalesce("r_n", F.lit(0))
    checks["field_names"] = names("l").eqNullSafe(names("r"))
    checks["field_types"] = F.col("l_types").eqNullSafe(F.col("r_types"))
    checks["unique_keys"] = F.coalesce("l_unique", F.lit(True)) & F.coalesce("r_unique", F.lit(True))
    checks["records"] = F.coalesce("records", F.lit(True))
    df = df.withColumns(checks)
    every = F.coalesce("_there", F.lit(False))
    for c in checks:
        every = every & F.col(c)
    return df.select("task_id", *checks, every.alias("matches"))
