"""Pages of sorted results at any depth.

A result is sorted once into ranges, one stored file each, with every row's place inside its range; the number of rows per range tells
which ranges hold a page. Any page then reads the one range it lies in (two at a border), no matter how deep.
"""

from __future__ import annotations

import bisect
import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..session import scratch_path

PART, PLACE = "_range", "_place"
#: Bits of Spark's row numbers that count inside a task.
INSIDE = 33


@dataclass(frozen=True)
class PageIndex:
    """A sorted, stored result. ``upto``: rows up to and with each range; one number per range is all the driver holds."""

    spark: SparkSession
    path: str
    schema: T.StructType
    parts: tuple[int, ...]
    upto: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.upto[-1] if self.upto else 0

    def page(self, number: int, size: int) -> DataFrame:
        """The rows of page ``number`` (from 1) in their order; an empty table beyond the last page."""
        if number < 1 or not 1 <= size <= 100:
            raise ValueError("invalid_page")
        low, high = (number - 1) * size, number * size
        wanted, paths = F.lit(False), []
        for k in range(bisect.bisect_right(self.upto, low), len(self.parts)):
            start = self.upto[k - 1] if k else 0
            if start >= high:
                break
            wanted = wanted | ((F.col(PART) == self.parts[k]) & F.col(PLACE).between(low - start, high - start - 1))
            paths.append(f"{self.path}/{PART}={self.parts[k]}")
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField(PLACE, T.LongType()), T.StructField(PART, T.LongType())])
        rows = self.spark.read.schema(stored).option("basePath", self.path).parquet(*paths).where(wanted)
        return rows.orderBy(PART, PLACE).drop(PART, PLACE)


def page_index(rows: DataFrame, order: list) -> PageIndex:
    """Sort ``rows`` by ``order`` and store them by range. The order should tell all rows apart: rows that are equal in it share a range and
    have no fixed order among each other."""
    spark = rows.sparkSession
    path = scratch_path(spark, "page-index")
    number = F.monotonically_increasing_id()
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_number", number)
    placed = ranges.select(*rows.columns, F.col("_number").bitwiseAND(2**INSIDE - 1).alias(PLACE), F.shiftright("_number", INSIDE).alias(PART))
    placed.write.partitionBy(PART).parquet(path)
    stored = T.StructType([T.StructField(PLACE, T.LongType()), T.StructField(PART, T.LongType())])
    counts = spark.read.schema(stored).parquet(path).groupBy(PART).count().orderBy(PART).collect()  # one row per range
    return PageIndex(spark, path, rows.schema, tuple(r[0] for r in counts), tuple(itertools.accumulate(r[1] for r in counts)))
