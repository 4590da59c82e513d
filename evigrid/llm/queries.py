"""The registered query of every operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe_monoid, conversation_repair, decontaminate, html_template, jaccard_join, language, mixing, permutation_index, pii, quality, resampling, token_counts, toxicity
from .common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op2_source_mix": mixing.ORACLE, "op7_jaccard_join": jaccard_join.ORACLE, "op11_importance_resampling": resampling.ORACLE,
                           "op12_decontamination": decontaminate.ORACLE, "op13_conversation_repair": conversation_repair.ORACLE}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op2_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op3_language_id(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"), fold(F.col("doc_id")) % 5 == 0)


@query
def op4_quality_rules(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_html_extraction(spark, sf_dir):
    return html_template.extract(table(spark, sf_dir, "pages"))


@query
def op6_nearest_neighbours(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    index, frame = permutation_index.build(rows)
    return permutation_index.search(index, frame, rows.where(F.col("vec_id") % 100 == 0))


@query
def op7_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


@query
def op8_pii(spark, sf_dir):
    rows = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", pii.of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.FORMS]
    return rows.select(F.col("row.doc_id").alias("doc_id"), *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
                       pii.listed(F.col("spans")).alias("spans"))


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op10_byte_bpe(spark, sf_dir):
    return bpe_monoid.round_trip(table(spark, sf_dir, "documents"))


@query
def op11_importance_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op12_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_conversation_repair(spark, sf_dir):
    return conversation_repair.repair(conversation_repair.damage(table(spark, sf_dir, "conversations")), times=F.col("times"))
