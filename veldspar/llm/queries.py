"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, cotraining, decontaminate, htmltext, languageid, mixing, quality, simhash, toxicity, urlfilter
from .shared import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document (doc_id) and every page (page_id); evidence of both tables is gathered together."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = languageid.fit_text(docs)
    keys = ["_vs_declared", "_vs_host", "_vs_domain", "_vs_suffix", "_vs_segment"]
    a = languageid.with_text_evidence(languageid.address_of_documents(docs.select("doc_id", "text", "source")), model, "text", ["doc_id", *keys])
    b = languageid.with_text_evidence(languageid.address_of_pages(pages.select("page_id", "url", "html")), model, "html", ["page_id", *keys], markup=True)
    scored = materialize(a.withColumn("kind", F.lit("document")).unionByName(b.withColumn("kind", F.lit("page")), allowMissingColumns=True), "language")
    evidence = languageid.gather(scored, len(model.languages)) if model.languages else None
    return languageid.fuse(scored, model, evidence).select("kind", "doc_id", "page_id", "language", "confidence", "known", "kept")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    features = materialize(cotraining.with_features(docs, keep=["doc_id"]), "cotraining-features")
    return cotraining.score(features, cotraining.fit(features, table(spark, sf_dir, "labels")), keep=["doc_id"])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.digest(decontaminate.mark(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"]))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judge(pages, materialize(urlfilter.listed_hosts(pages), "urls-block-list"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, network, keep=["doc_id"])
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_quality_rules, op3_chat_formatting, op4_quality_classifier, op5_mixing, op6_decontamination, op7_url_filters, op8_toxicity, op9_html_extraction, op10_simhash)
}
ORACLES: dict[str, str] = {"op3_chat_formatting": chat.ORACLE, "op7_url_filters": urlfilter.ORACLE}
