"""Running state over keys of any size.

One key may hold a third of all rows, so no window here sees a whole key. Rows are split
into (key, chunk) pieces, where ``chunk`` grows with the order; each piece is handled on its
own and a second, chunk-level step carries the state from piece to piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sequence_numbers(df: DataFrame, keys: list[str], order: list, chunk: Column, name: str = "seq",
                     total: str | None = None) -> DataFrame:
    """``row_number()`` per key, and the row count per key as ``total`` if asked for."""
    df = df.withColumn("_chunk", chunk)
    sizes = df.groupBy(*keys, "_chunk").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys, "_chunk", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        *([F.sum("_size").over(Window.partitionBy(*keys)).alias(total)] if total else []))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = df.withColumn("_rn", F.row_number().over(inside))
    return (numbered.join(offsets, [*keys, "_chunk"])
            .withColumn(name, F.col("_before") + F.col("_rn")).drop("_chunk", "_rn", "_before"))


def previous_values(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                    values: dict[str, str]) -> DataFrame:
    """``lag`` per key: adds ``values[c]`` holding column ``c`` of the row before."""
    df = df.withColumn("_chunk", chunk)
    rank = F.struct(*order)
    lasts = df.groupBy(*keys, "_chunk").agg(F.max_by(F.struct(*values), rank).alias("_last"))
    by_chunk = Window.partitionBy(*keys).orderBy("_chunk")
    carry = lasts.select(*keys, "_chunk", F.lag("_last").over(by_chunk).alias("_carry"))
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(inside))
    for column, target in values.items():
        out = out.withColumn(target, F.lag(column).over(inside))
    out = out.join(carry, [*keys, "_chunk"])
    for column, target in values.items():
        out = out.withColumn(target, F.when(F.col("_rn") == 1, F.col("_carry")[column]).otherwise(F.col(target)))
    return out.drop("_chunk", "_rn", "_carry")


def paginate(df: DataFrame, keys: list[str], order: list, size: int, chunk: Column) -> DataFrame:
    """Slice each key's rows into pages: page_no, pos, n_rows, has_next."""
    out = sequence_numbers(df, keys, order, chunk, "_seq", "n_rows")
    page = F.floor((F.col("_seq") - 1) / size) + 1
    return (out.withColumn("page_no", page.cast("int"))
            .withColumn("pos", ((F.col("_seq") - 1) % size).cast("int"))
            .withColumn("has_next", F.col("page_no") * size < F.col("n_rows")).drop("_seq"))


def page_state(pages: DataFrame, chunk: int = 1000) -> DataFrame:
    """Adds ``running_count`` (items up to a page) and ``previous_total`` per source, and keeps the pages without a gap before them.

    ``pages``: source_id, page_no (from 1, unique per source), n_items, total and further narrow columns.
    """
    df = pages.withColumn("_chunk", F.floor((F.col("page_no") - 1) / chunk))
    inside = Window.partitionBy("source_id", "_chunk").orderBy("page_no")
    df = df.withColumns({"_rn": F.row_number().over(inside), "_items": F.sum("n_items").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "_lag": F.lag("total").over(inside)})
    sizes = df.groupBy("source_id", "_chunk").agg(F.count("*").alias("_size"), F.sum("n_items").alias("_sum"), F.max_by("total", "page_no").alias("_last"))
    by_chunk = Window.partitionBy("source_id").orderBy("_chunk")
    before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select("source_id", "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_pages"),
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_count"), F.lag("_last").over(by_chunk).alias("_carry"))
    out = df.join(carry, ["source_id", "_chunk"]).filter(F.col("_pages") + F.col("_rn") == F.col("page_no"))
    return out.withColumns({"running_count": F.col("_count") + F.col("_items"), "previous_total": F.when(
        F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))}).drop("_chunk", "_rn", "_items", "_lag", "_pages", "_count", "_carry")
