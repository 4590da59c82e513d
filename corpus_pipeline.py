"""A corpus pipeline over ``documents``: toxicity, near duplicates, personal data, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept; ``run`` writes every stage as
Parquet and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evigrid.llm import bpe_monoid, jaccard_join, mixing, pii, toxicity
from evigrid.llm.common import store


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ordinal model, trained on the labelled ones among them, does not reject.

    Null and empty texts, repeated rows and null ids stay; without labels of both classes nothing is rejected.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.grade(docs, model, carry=True).where(~F.col("rejected")).select("row.*")


#: Near duplicates share at least SIMILAR percent of their runs of SHINGLE words.
SHINGLE, SIMILAR = 5, 80


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: one with the smallest id, null last. Repeated rows count once.

    Rows are told apart by the hash of id and text, so null and repeated ids do not bring rows of other classes along; of rows
    that differ in other columns alone one stays. Null and empty texts are a class of their own each. An empty table stays empty.
    """
    name = "row_no"
    while name in docs.columns:
        name += "_"
    rows = docs.withColumn(name, F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text"))
    classes = jaccard_join.jaccard_classes(rows, n=SHINGLE, percent=SIMILAR, key=name)
    classes = store(classes.select(F.col(name).alias("no"), "component_id").distinct(), "pipeline-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "no")).alias("first")
    kept = rows.select(F.col(name).alias("no"), "doc_id").join(classes, "no").groupBy("component_id").agg(first).select(F.col("first.no").alias("kept_no"))
    kept = store(kept, "pipeline-kept")
    return rows.join(kept, F.col(name) == F.col("kept_no"), "left_semi").drop(name).dropDuplicates(["doc_id", "text"])


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in the text replaced by its kind; ``n_chars``, where there is one, is that of the new text.

    Null and empty texts stay as they are, so do repeated rows and all other columns.
    """
    clean = pii.redact(pii.find(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; documents without words are not taken, a null source is a source."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of ids and of decoded bytes of every row; a null text counts as empty."""
    return bpe_monoid.round_trip(docs)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("pii", redact_personal_data), ("source_mix", mix_sources),
          ("byte_bpe", encode)]

#: No stage but the mix can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
