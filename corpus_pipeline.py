"""From raw documents to a training mix: five stages, each of which reads what its predecessor wrote.

Stages, in order: language identification (documents in no known language go), quality rules (rejected documents go),
SimHash near-duplicates (one document of each group stays), benchmark decontamination (documents that hold a benchmark
window go), and the mix of sources. All but the last return the columns of documents; the last adds size,
source_size, target, copies and taken, and returns the documents taken at least once.

SQL can't express the fitted stages, so there is no ORACLE_SQL; the stages are tested against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import decontaminate, languageid, mixing, quality, simhash
from veldspar.llm.shared import materialize, release, tables_made


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return languageid.keep_known(docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_text),
    ("mixing", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; between them documents are written to the scratch folder and read again.

    Once a stage's documents are written, all that was written before goes. What the last stage reads stays until
    release(spark) is called or the folder is cleaned.
    """
    docs, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), tables_made()
    for k, (name, stage) in enumerate(STAGES):
        if k:
            docs = materialize(docs, f"pipeline-{name}")
            release(spark, began, spare_last=1)
        docs = stage(spark, docs, sf_dir)
    return docs
