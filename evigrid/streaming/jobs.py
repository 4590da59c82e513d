"""Structured Streaming forms of the event log, the page checks and the task state machine.

The state of a task is kept by Spark's own aggregation: one row of fixed width, independent of arrival order. That of a source is in
``integrity``. Each micro-batch writes only the keys it touched; ``latest`` reads the newest row per key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.trace import lifecycle_state
from .integrity import PROVIDER, page_integrity


def run_to_end(query_builder):
    """Process what is there, then stop; the checkpoint is the cursor of the next run."""
    query = query_builder.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def event_tail(events: DataFrame, after: int, out: str, checkpoint: str):
    """Append events past a cursor. A restart continues where the checkpoint ends."""
    rows = events.filter(F.col("seq") > after)
    return run_to_end(rows.writeStream.format("parquet").outputMode("append").option("path", out)
                      .option("checkpointLocation", checkpoint))


def _upsert(out: str, transform=None):
    """Write a batch under its own id; a repeated batch overwrites itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        result = transform(batch, batch_id) if transform else batch
        result.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")
    return write


def latest(spark, out: str, key: str) -> DataFrame:
    """Newest row per key over all batches."""
    rows = spark.read.option("basePath", out).parquet(f"{out}/part=*").drop("part")
    columns = [c for c in rows.columns if c not in (key, "batch_id")]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*columns), "batch_id").alias("r"))
    return best.select(key, "r.*")


def lifecycle_stream(requests: DataFrame, order: list[str], out: str, checkpoint: str):
    """The state machine over a stream of requests: ten minima per task in the state store."""
    state = lifecycle_state(requests, order)
    return run_to_end(state.writeStream.outputMode("update").foreachBatch(_upsert(out)).option("checkpointLocation", checkpoint))


def page_integrity_stream(pages: DataFrame, plan, names, out: str, checkpoint: str, **options):
    """Page and record checks as pages arrive, in any order; a batch writes the sources it touched. See ``integrity``."""
    spark = pages.sparkSession
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        state = page_integrity(pages, plan, names, **options)
        return run_to_end(state.writeStream.outputMode("update").foreachBatch(_upsert(out)).option("checkpointLocation", checkpoint))
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
