"""A training-data pipeline over ``documents``: five stages, each calling one
operator of ``tripleselect.llm`` on all rows that its predecessor kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each result as Parquet under the shared checkpoint folder and reads it
back as the next stage's documents, so a lost executor costs one stage's
tasks at most.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripleselect.llm import decontaminate, mixing, near_dedup, token_planes, toxicity
from tripleselect.llm.common import documents, fold, shared_folder, ship_package
from tripleselect.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier does not reject."""
    ship_package(spark)
    model = toxicity.fit(docs, documents(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    return toxicity.not_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ship_package(spark)
    return near_dedup.near_deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship_package(spark)
    return decontaminate.decontaminated(docs, documents(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The stretches of documents that the mix takes, once per epoch."""
    return mixing.mixed_documents(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written to plane files; per document what is read back."""
    ship_package(spark)
    folder = shared_folder(spark, "pipeline-planes")
    token_planes.write_token_planes(docs, folder, tokenizer_path())
    return token_planes.read_token_planes(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("token_ids", write_ids),
]

#: Trained scores, sketches and a tokenizer are not SQL; tests hold run() against its parts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folder = shared_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
