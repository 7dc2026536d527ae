"""Column profiles: exact, in two levels per column; one shuffle of distinct values gives every statistic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import display_type, is_numeric
from ..scratch import materialize


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(v, n) of every value, null included: the first level, whose partial counts absorb frequent values before the shuffle."""
    return df.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))


def profile_column(df: DataFrame, column: str) -> DataFrame:
    kind = dict(df.dtypes)[column]
    v, n = F.col("v"), F.col("n")
    x = v.cast("double") if is_numeric(kind) else F.lit(None).cast("double")
    ordered = not is_numeric(kind) and not kind.startswith(("array", "map", "struct", "binary", "variant"))
    words = v.cast("string") if ordered else F.lit(None).cast("string")  # text, dates and booleans order as their text does
    got = value_counts(df, column).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_count"), F.coalesce(F.sum(F.when(v.isNull(), n)), F.lit(0)).alias("null_count"), F.count("v").alias("distinct_count"),
        F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.min(words).alias("min_text"), F.max(words).alias("max_text"), F.round(F.try_divide(F.sum(x * n), F.sum(F.when(v.isNotNull(), n))), 4).alias("avg_value"),
    )
    if not is_numeric(kind):
        got = got.withColumn("avg_value", F.lit(None).cast("double"))
    return got.select(
        F.lit(column).alias("column_name"), F.lit(display_type(kind)).alias("display_type"), "total_count", "null_count", "distinct_count", "min_value", "max_value", "min_text", "max_text", "avg_value",
        F.round(F.coalesce(F.try_divide("null_count", "total_count"), F.lit(0.0)), 6).alias("null_ratio"), F.round(F.coalesce(F.try_divide("distinct_count", "total_count"), F.lit(0.0)), 6).alias("uniqueness"),
    )


COLUMNAR = (".parquet", ".orc")


def columnar(df: DataFrame) -> DataFrame:
    """df, or what it reads written once as Parquet if it comes from rows (CSV, JSON, JDBC, ...): a profile scans each column apart."""
    files = df.inputFiles()
    return df if files and all(f.endswith(COLUMNAR) for f in files) else materialize(df, "profile-source")


def profile(df: DataFrame, columns: list[str] | None = None, stage: bool = False) -> DataFrame:
    """One row per column. Columns are scanned apart, so each job reads one column of a columnar source; stage: of another source, written as one first."""
    df = columnar(df) if stage else df
    return reduce(DataFrame.unionByName, [profile_column(df, c) for c in columns or df.columns])


def profile_approximate(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """(column_name, total_count, null_count, distinct_count) in a single scan, with approximate distinct counts."""
    aggs = [a for k, c in enumerate(df.columns) for a in (F.count(c).alias(f"n{k}"), F.approx_count_distinct(c, rsd).alias(f"d{k}"))]
    row = df.agg(F.count("*").alias("t"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col("t").alias("total_count"), (F.col("t") - F.col(f"n{k}")).alias("null_count"), F.col(f"d{k}").alias("distinct_count")) for k, c in enumerate(df.columns)])
    return row.select(F.inline(each))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k most frequent values, ties by value."""
    counts = value_counts(df, column).filter(F.col("v").isNotNull())
    return counts.orderBy(F.desc("n"), F.asc("v")).limit(k).select(F.lit(column).alias("column_name"), F.col("v").cast("string").alias("value"), F.col("n").alias("frequency"))


def sample_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k smallest distinct values."""
    return df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().orderBy("v").limit(k).select(F.lit(column).alias("column_name"), F.col("v").cast("string").alias("value"))


def sampled(df: DataFrame, rows: int = 10_000, seed: int = 42) -> DataFrame:
    """A seeded random sample of about rows rows, for an approximate profile."""
    total = df.count()
    return df if total <= rows else df.sample(rows / total, seed)


def null_percentages(profiles: DataFrame) -> DataFrame:
    return profiles.select("column_name", F.round(100.0 * F.try_divide("null_count", "total_count"), 1).alias("null_percentage"))


def key_candidates(profiles: DataFrame) -> DataFrame:
    """is_pk_candidate: an id-like name and all values distinct and present; is_fk_candidate: an id-like ending otherwise."""
    named = F.lower("column_name").rlike(r"^(id|pk)$|(_id|key)$")
    unique = (F.col("distinct_count") == F.col("total_count")) & (F.col("total_count") > 0)
    return profiles.select("column_name", (named & unique).alias("is_pk_candidate"), (F.lower("column_name").rlike(r"(_id|key)$") & ~unique).alias("is_fk_candidate"))


def sparse(profiles: DataFrame, ratio: float = 0.5) -> DataFrame:
    return profiles.filter(F.col("null_ratio") > ratio).select("column_name", "null_ratio")


def likely_identifiers(profiles: DataFrame, ratio: float = 0.95) -> DataFrame:
    return profiles.filter(F.col("uniqueness") > ratio).select("column_name", "uniqueness")


def summary(profiles: DataFrame) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return profiles.agg(F.count("*").alias("n_columns"), count(F.col("null_count") > 0).alias("with_nulls"), count(F.col("null_ratio") > 0.5).alias("mostly_null"), F.coalesce(F.sum("null_count"), F.lit(0)).alias("null_cells"))
