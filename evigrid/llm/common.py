"""Helpers shared by the operators: intermediate tables, labelled samples, Arrow passes."""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Characters that separate words.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``); the warehouse where none is named, as in tests on one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        # The default warehouse is a folder of each machine: tables written there come back incomplete.
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder, dropped when the application ends.

    Later stages read files, so a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evigrid-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def fold(key: Column) -> Column:
    """crc32 of a key as text; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def labelled_sample(labels: DataFrame, label: str, per_class: int, key: str = "doc_id") -> dict[int, int]:
    """At most ``per_class`` labelled keys of each class 0/1, the first by md5 of the key: bounded for the driver.

    Keys or labels that are null take no part; a key with several labels has the largest.
    """
    rows = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1))
            .groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y")))
    found: dict[int, int] = {}
    for y in (0, 1):
        top = rows.where(F.col("y") == y).orderBy(F.md5(F.col("k").cast("string").cast("binary")), "k").limit(per_class)
        found.update((r["k"], r["y"]) for r in top.collect())
    return found


def sample_rows(docs: DataFrame, sample: dict[int, int], key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose key is in the bounded sample, with its label ``y``."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    few = spark.createDataFrame(sorted(sample.items()) or [], f"`{key}` {kind}, y int")
    return docs.join(F.broadcast(few), key)  # bounded by the sample's parameter


def worker_memory(name: str, make):
    """An object that a Python worker keeps between its tasks, made on first use. Only for what any task may lose."""
    space = vars(sys.modules.setdefault("evigrid_worker_memory", types.ModuleType("evigrid_worker_memory")))
    if name not in space:
        space[name] = make()
    return space[name]


def slices(batches, rows: int = 512):
    """Arrow batches in small parts, so that what a task makes of them stays small beside them."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
