"""Session settings every job in this package relies on."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Python functions of this package travel to the workers by value: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

SETTINGS = {
    # JSON member names differ by case ("Id" and "id" are two fields).
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Plans here are long; call-site capture per expression costs more than it tells.
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def build_session(app: str = "evigrid", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir`` of the session; where none is named, on one machine, its warehouse."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        # The default warehouse is a folder of each machine: tables written there come back incomplete.
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return (folder or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that is removed when the application ends."""
    path = f"{shared_folder(spark)}/evigrid/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: later stages read files, so a lost executor costs no recomputation of what came before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """End the plan here, for results that several later branches read."""
    return store(df, "cut")
