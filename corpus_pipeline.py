"""A training corpus from ``documents``: five stages, each stored as Parquet and read again as the next one's input.

Quality rules drop documents that they reject; of each group of near copies the document of least id
stays; personal data is masked; sources are mixed to target weights, which gives each document its
place; the last stage packs the texts into sequences in the order of these places and returns the
pieces. Sequences in the order of their numbers follow the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, mixing, packing, pii, quality_rules
from lodestone.session import work_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of their own component's id."""
    found = jaccard_join.jaccard_join(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("dropped_id"), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, position="mix_position")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, order="mix_position")


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("PII", personal_data), ("mixing sources", source_mix), ("best-fit packing", pack)]
#: tokenizer and signatures are beyond SQL; the stages are tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` below ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        path = work_path(spark, f"pipeline-{k}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
