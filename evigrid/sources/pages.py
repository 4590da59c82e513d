"""Page tables: caps and repeated captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def cap_page_numbers(pages: DataFrame, max_pages: int) -> DataFrame:
    if not 1 <= max_pages <= 10:
        raise ValueError("max_pages_out_of_range")
    return pages.filter(F.col("page_no").between(1, max_pages))


def cap_pages(items: DataFrame, max_records: int) -> DataFrame:
    """First ``max_records`` items per source, in page order. The window keeps at most that many
    rows per source and task before the shuffle (Spark's group limit)."""
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy("page_no", "pos"))
    return items.withColumn("_rank", rank).filter(F.col("_rank") <= max_records).drop("_rank")


def first_capture(pages: DataFrame, order: str) -> DataFrame:
    """One body per (source_id, page_no) where pages were captured more than once.

    A page captured very often is reduced map-side, before the shuffle.
    """
    return pages.groupBy("source_id", "page_no").agg(F.min_by("body", order).alias("body"))


def scan_html_pages(pages: DataFrame, limit: int | None = None, status: Column | None = None) -> DataFrame:
    """HTML documents with the reason they cannot be used, if any; with a ``limit`` longer ones are refused."""
    bad_status = ~status.between(200, 299) if status is not None else F.lit(False)
    return pages.withColumn("reject", F.when(bad_status, "request_rejected").when(
        F.octet_length("html") > limit if limit is not None else F.lit(False), "response_too_large"))
