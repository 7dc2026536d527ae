"""Chart datasets: the rows behind each chart; drawing is left to clients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import checked_broadcast


def table_size(tables: DataFrame, k: int = 15) -> DataFrame:
    return tables.orderBy(F.desc("row_count"), "table_name").limit(k).select("table_name", "row_count")


def by_type(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Count and percent of each value."""
    counts = rows.groupBy(F.col(column).alias(name)).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*").alias("total"))
    return counts.join(F.broadcast(total)).select(name, "n", F.round(100.0 * F.col("n") / F.col("total"), 1).alias("percent"))


def table_share(tables: DataFrame, k: int = 20) -> DataFrame:
    few = tables.orderBy(F.desc("row_count"), "table_name").limit(k)
    total = few.agg(F.sum("row_count").alias("t"))
    return few.join(F.broadcast(total)).select("table_name", F.round(100.0 * F.col("row_count") / F.col("t"), 4).alias("share"))


def density(tables: DataFrame, k: int = 15) -> DataFrame:
    few = tables.orderBy(F.desc("row_count"), "table_name").limit(k)
    most = few.agg(F.max("row_count").alias("r"), F.max("n_columns").alias("c"))
    return few.join(F.broadcast(most)).select("table_name", F.round(F.col("row_count") / F.col("r"), 6).alias("rows_norm"), F.round(F.col("n_columns") / F.col("c"), 6).alias("columns_norm"))


def dna(columns: DataFrame, k: int = 12) -> DataFrame:
    widest = columns.groupBy("table_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "table_name").limit(k)
    return columns.join(F.broadcast(widest), "table_name", "left_semi").select("table_name", "ordinal", "display_type", "is_pk", "is_fk")


def null_by_table(profiles: DataFrame, k: int = 15, first: int = 10) -> DataFrame:
    few = profiles.filter(F.col("ordinal") < first).groupBy("table_name").agg(F.round(100 * F.avg("null_ratio"), 2).alias("avg_null_percent"))
    return few.orderBy("table_name").limit(k)


def null_by_column(profiles: DataFrame, k: int = 20) -> DataFrame:
    return profiles.filter("null_count > 0").orderBy(F.desc("null_ratio"), "column_name").limit(k).select("column_name", F.round(100 * F.col("null_ratio"), 2).alias("null_percent"))


def column_fingerprint(profiles: DataFrame) -> DataFrame:
    bubble = F.least(F.lit(300.0), F.greatest(F.lit(20.0), F.col("total_count") / 10.0))
    return profiles.select("column_name", F.round(100 * F.col("uniqueness"), 2).alias("unique_percent"), F.round(100 * F.col("null_ratio"), 2).alias("null_percent"), bubble.alias("bubble"))


def severities(issues: DataFrame, names: tuple[str, ...] = ("high", "medium", "low")) -> DataFrame:
    """Counts of each severity, zero where there is none."""
    every = issues.sparkSession.createDataFrame([(n,) for n in names], "severity string")
    return every.join(issues.groupBy("severity").agg(F.count("*").alias("k")), "severity", "left").select("severity", F.coalesce("k", F.lit(0)).alias("n"))


def completeness(tables: DataFrame, profiles: DataFrame, edges: DataFrame) -> DataFrame:
    """Percentages: tables with keys, columns without many nulls, tables in relationships, non-empty tables, described columns."""
    a = tables.agg(F.count("*").alias("n"), F.sum((F.col("n_pk") > 0).cast("long")).alias("pk"), F.sum((F.col("row_count") > 0).cast("long")).alias("full"))
    b = profiles.agg(F.count("*").alias("c"), F.sum((F.col("null_ratio") <= 0.1).cast("long")).alias("ok"))
    c = edges.select(F.explode(F.array("from_table", "to_table")).alias("t")).agg(F.countDistinct("t").alias("linked"))
    pct = lambda x, y: F.round(100.0 * F.col(x) / F.col(y), 2)
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select(pct("pk", "n").alias("primary_keys"), pct("ok", "c").alias("completeness"), pct("linked", "n").alias("relationships"), pct("full", "n").alias("non_empty"), F.lit(100.0).alias("documentation"))


def network(edges: DataFrame) -> DataFrame:
    return edges.groupBy("from_table", "to_table").agg(F.count("*").alias("n_links"))


def hierarchy(edges: DataFrame, most_levels: int = 5) -> DataFrame:
    """Level of each table below the roots, level by level."""
    links = edges.select(F.col("from_table").alias("child"), F.col("to_table").alias("parent")).distinct()
    level = links.select(F.col("parent").alias("table_name")).distinct().join(checked_broadcast(links.select(F.col("child").alias("table_name"))), "table_name", "left_anti").withColumn("level", F.lit(0))
    every = level
    for k in range(1, most_levels):
        level = links.join(checked_broadcast(level.filter(F.col("level") == k - 1)), links.parent == level.table_name).select(F.col("child").alias("table_name"), F.lit(k).alias("level")).distinct()
        every = every.unionByName(level)
    return every.groupBy("table_name").agg(F.min("level").alias("level"))


def flows(edges: DataFrame) -> DataFrame:
    """Weights of 80 where an edge has no confidence, 30 at least."""
    confidence = F.col("confidence") if "confidence" in edges.columns else F.lit(None).cast("double")
    return edges.select("from_table", "to_table", "from_column", F.greatest(F.coalesce(confidence, F.lit(80.0)), F.lit(30.0)).alias("weight"))


def node_sizes(tables: DataFrame) -> DataFrame:
    most = tables.agg(F.max("row_count").alias("m"))
    return tables.join(F.broadcast(most)).select("table_name", F.round(0.3 + 0.5 * F.col("row_count") / F.greatest("m", F.lit(1)), 6).alias("size"))


def fk_coverage(tables: DataFrame, edges: DataFrame) -> DataFrame:
    linked = edges.select(F.explode(F.array("from_table", "to_table")).alias("table_name")).distinct().withColumn("in_edge", F.lit(True))
    n = edges.groupBy(F.col("from_table").alias("table_name")).agg(F.count("*").alias("fks"))
    return tables.select("table_name").join(checked_broadcast(linked), "table_name", "left").join(checked_broadcast(n), "table_name", "left").select("table_name", F.coalesce("in_edge", F.lit(False)).alias("in_edge"), F.coalesce("fks", F.lit(0)).alias("n_fks"))


def sunburst(columns: DataFrame) -> DataFrame:
    return columns.groupBy("table_name", "display_type").agg(F.count("*").alias("n"))


def row_statistics(tables: DataFrame) -> DataFrame:
    r = "row_count"
    return tables.agg(F.round(F.avg(r), 4).alias("mean"), F.median(r).alias("median"), F.round(F.stddev_pop(r), 4).alias("std"), F.min(r).alias("smallest"), F.max(r).alias("largest"))


def gauge(score: DataFrame, issues: DataFrame) -> DataFrame:
    """Score and band, with the number of issues of each severity."""
    from .quality import band

    counts = issues.agg(*[F.coalesce(F.sum((F.lower("severity") == s).cast("long")), F.lit(0)).alias(s) for s in ("high", "medium", "low")])
    return score.join(F.broadcast(counts)).select("score", band(F.col("score"), "web").alias("band"), "high", "medium", "low")


def network_nodes(tables: DataFrame, edges: DataFrame, inferred: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Tables at the end of an edge; if there are fewer than three, the first k tables too."""
    ends = edges.select(F.explode(F.array("from_table", "to_table")).alias("table_name"))
    if inferred is not None:
        ends = ends.unionAll(best_inferred(inferred, k).select(F.explode(F.array("from_table", "to_table")).alias("table_name")))
    ends = ends.distinct()
    if ends.limit(3).count() < 3:
        ends = ends.unionAll(tables.select("table_name").orderBy("table_name").limit(k)).distinct()
    return ends


def best_inferred(inferred: DataFrame, k: int = 10) -> DataFrame:
    return inferred.orderBy(F.desc("score"), "from_table", "from_column", "to_table").limit(k)


def network_edges(edges: DataFrame, inferred: DataFrame, k: int = 10) -> DataFrame:
    """Declared edges, and the k best inferred ones that aren't declared; inferred: with score."""
    told = edges.select("from_table", "from_column", "to_table", "to_column")
    new = best_inferred(inferred.join(checked_broadcast(told.select("from_table", "from_column", "to_table")), ["from_table", "from_column", "to_table"], "left_anti"), k)
    return told.select("from_table", "from_column", "to_table", F.lit("declared").alias("kind"), F.lit(1.0).alias("strength")).unionAll(new.select("from_table", "from_column", "to_table", F.lit("inferred"), "score"))


def overview(tables: DataFrame, columns: DataFrame, issues: DataFrame, totals: DataFrame) -> DataFrame:
    """Four panels as (panel, label, value): table sizes, issues by severity, column types, totals (a row of numbers)."""
    panel = lambda df, name, label, value: df.select(F.lit(name).alias("panel"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
    numbers = F.explode(F.array(*[F.struct(F.lit(c).alias("l"), F.col(c).cast("double").alias("v")) for c in totals.columns])).alias("x")
    out = panel(table_size(tables), "table_size", "table_name", "row_count").unionAll(panel(severities(issues), "quality_issues", "severity", "n"))
    out = out.unionAll(panel(by_type(columns, "display_type", "display_type"), "column_types", "display_type", "n"))
    return out.unionAll(totals.select(numbers).select(F.lit("totals"), "x.l", "x.v"))
