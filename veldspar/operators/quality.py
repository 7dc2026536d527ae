"""Quality issues and scores over profiles and metadata. issues: table_name, column_name, issue_type, severity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import checked_broadcast

WARN, CRITICAL = 0.1, 0.5


def _issue(df: DataFrame, kind: str, severity: Column | str, column: Column | None = None) -> DataFrame:
    severity = F.lit(severity) if isinstance(severity, str) else severity
    return df.select("table_name", (F.col("column_name") if column is None else column).alias("column_name"), F.lit(kind).alias("issue_type"), severity.alias("severity"))


def missing_pk(tables: DataFrame, columns: DataFrame) -> DataFrame:
    bare = tables.join(columns.filter("is_pk"), "table_name", "left_anti")
    return _issue(bare, "missing_primary_key", "WARNING", F.lit(None).cast("string"))


def nulls_cli(profiles: DataFrame) -> DataFrame:
    return _issue(profiles.filter(F.col("null_ratio") >= WARN), "nulls", F.when(F.col("null_ratio") >= CRITICAL, "CRITICAL").otherwise("WARNING"))


def nulls_web(profiles: DataFrame) -> DataFrame:
    return _issue(profiles.filter(F.col("null_ratio") > 0.5), "high_nulls", F.when(F.col("null_ratio") > 0.8, "high").otherwise("medium"))


def single_value(profiles: DataFrame, least_rows: int = 100) -> DataFrame:
    return _issue(profiles.filter((F.col("distinct_count") == 1) & (F.col("total_count") > least_rows)), "single_value", "INFO")


def fk_nulls(profiles: DataFrame, columns: DataFrame) -> DataFrame:
    """Nulls in foreign keys that are declared present."""
    fk = columns.filter("is_fk and not nullable").select("table_name", "column_name")
    return _issue(profiles.filter("null_count > 0").join(checked_broadcast(fk), ["table_name", "column_name"], "left_semi"), "fk_nulls", "CRITICAL")


def low_cardinality(profiles: DataFrame) -> DataFrame:
    """Identifiers of which fewer than half of the rows are distinct. profiles: with semantic_type."""
    return _issue(profiles.filter((F.col("semantic_type") == "identifier") & (F.col("distinct_count") < 0.5 * F.col("total_count"))), "low_cardinality", "medium")


def empty_tables(counts: DataFrame) -> DataFrame:
    return _issue(counts.filter("row_count = 0"), "empty_table", "low", F.lit(None).cast("string"))


def all_issues(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def score_web(issues: DataFrame) -> DataFrame:
    """100 less 10, 5 and 2 for each high, medium and low issue, from 0 to 100, over all tables."""
    cost = F.when(F.col("severity") == "high", 10).when(F.col("severity") == "medium", 5).when(F.col("severity") == "low", 2).otherwise(0)
    return issues.agg(F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce(F.sum(cost), F.lit(0)))).cast("int").alias("score"))


def score_cli(issues: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per table 100 less 20, 10 and 2 for each critical, warning and info issue and 15 without a key, 0 at least."""
    cost = F.when(F.col("severity") == "CRITICAL", 20).when(F.col("severity") == "WARNING", 10).when(F.col("severity") == "INFO", 2).otherwise(0)
    by = issues.groupBy("table_name").agg(F.sum(cost).alias("cost"))
    keyed = columns.filter("is_pk").select("table_name").distinct().withColumn("k", F.lit(True))
    t = tables.select("table_name").join(checked_broadcast(by), "table_name", "left").join(checked_broadcast(keyed), "table_name", "left")
    return t.select("table_name", F.greatest(F.lit(0), 100 - F.coalesce("cost", F.lit(0)) - F.when(F.col("k"), 0).otherwise(15)).cast("int").alias("score"))


def band(score: Column, profile: str = "cli") -> Column:
    a, b, c = (90, 70, 50) if profile == "cli" else (80, 60, 40)
    return F.when(score >= a, "excellent").when(score >= b, "good").when(score >= c, "fair").otherwise("poor")


def null_report(profiles: DataFrame, k: int = 15, ratio: float = 0.05) -> DataFrame:
    """The k columns of most nulls among those of which more than ratio is null."""
    return profiles.filter(F.col("null_ratio") > ratio).orderBy(F.desc("null_ratio"), "column_name").limit(k).select("column_name", "null_ratio")
