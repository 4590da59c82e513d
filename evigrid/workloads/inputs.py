"""Operator inputs derived from the given tables, so that every query grows with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.windows import paginate

PAGE_SIZE = 5
FIELDS = {"id": "/id", "amount": "/amount", "state": "/state"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str, most: int = 1 << 17) -> DataFrame:
    """``rows`` dealt by ``keys`` over so many tasks that one holds about ``most`` of them."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    return rows.repartition(tasks, *keys)


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of a customer as the rows of one source."""
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("id"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("amount"),
        F.col("o_orderstatus").alias("state"))


def _order_chunk() -> Column:
    """Pieces of the key space: a hot customer is numbered piecewise."""
    return F.floor(F.col("id") / F.lit(1_000_000))


def order_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Paged JSON bodies of every customer; ``source_id % 10`` picks the kind of drift.

    0, 7, 8 are clean; 1 repeats a key; 2 changes the total; 3 changes a type; 4 has an empty
    page that promises more; 5 renames the list; 6 renames it and adds a second list; 9 promises one row
    more than it has.
    """
    drift = F.col("source_id") % 10
    rows = paginate(order_rows(spark, folder), ["source_id"], ["id"], PAGE_SIZE, _order_chunk())
    later = F.col("page_no") > 1
    pages = rows.groupBy("source_id", "page_no").agg(
        F.sort_array(F.collect_list(F.struct("pos", "id", "amount", "state"))).alias("items"),
        F.first("n_rows").alias("n_rows"), F.first("has_next").alias("has_next"))
    # The repeated key of drift 1 is the first row of the source, shown again on page 2.
    firsts = order_rows(spark, folder).filter(drift == 1).groupBy("source_id").agg(F.min("id").alias("first_id"))
    pages = pages.join(firsts, "source_id", "left")
    number = F.transform("items", lambda x, i: F.struct(
        F.when((drift == 1) & (F.col("page_no") == 2) & (i == 0), F.col("first_id")).otherwise(x["id"]).alias("id"),
        x["amount"].alias("amount"), x["state"].alias("state")))
    text = F.transform("items", lambda x: F.struct(
        x["id"].alias("id"), x["amount"].cast("string").alias("amount"), x["state"].alias("state")))
    total = (F.col("n_rows") + F.when((drift == 2) & later | (drift == 9), 1).otherwise(0)).alias("total")
    more = F.col("has_next").alias("more")
    none = F.array().cast("array<struct<id:bigint,amount:bigint,state:string>>")
    body = (F.when((drift == 3) & later, F.to_json(F.struct(text.alias("rows"), total, more)))
            .when((drift == 4) & (F.col("page_no") == 2), F.to_json(F.struct(none.alias("rows"), total, F.lit(True).alias("more"))))
            .when(drift == 5, F.to_json(F.struct(number.alias("entries"), total, more)))
            .when(drift == 6, F.to_json(F.struct(number.alias("entries"), number.alias("others"), total, more)))
            .otherwise(F.to_json(F.struct(number.alias("rows"), total, more))))
    return pages.select("source_id", "page_no", body.alias("body"))


def order_plans(spark: SparkSession, folder: str) -> DataFrame:
    """One plan per customer: 7 reads no total, 8 reads no continuation flag."""
    drift = F.col("source_id") % 10
    keys = order_rows(spark, folder).select("source_id").distinct()
    return keys.select(
        "source_id", F.format_string("req_%d", "source_id").alias("request_id"), F.lit("/rows").alias("items_pointer"),
        F.create_map(*[F.lit(x) for p in FIELDS.items() for x in p]).alias("fields"), F.lit("id").alias("unique_key"),
        F.lit("query").alias("pagination_location"), F.lit("page").alias("page_parameter"),
        F.when(drift != 8, "/more").alias("has_next_pointer"), F.when(drift != 7, "/total").alias("total_pointer"))
