"""Documentation chunks of analysed metadata: what a search over a schema finds. Every builder gives the same columns.

Columns: prefix, content, chunk_type, importance, keywords, source_table, source_column, and place, by which numbered()
orders chunks of one builder. Kinds and importance: the overview 2, tables and totals 1.5, relationships 1.3, issues 1.2,
columns 1, sample queries .8, and facts over all tables .7 to 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import checked_broadcast

ORDER = ("db_overview", "table_overview", "column_detail", "relationship", "quality", "query", "cross_table", "stat")


def _text(*parts) -> Column:
    """Parts in a row: strings as they are, columns as text (null: empty)."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def _chunk(df: DataFrame, prefix: str, kind: str, importance: float, content: Column, words: list, table: Column | None = None, column: Column | None = None, place: Column | None = None) -> DataFrame:
    """words: keywords, as strings, columns, or columns of arrays."""
    null = F.lit(None).cast("string")
    plain = [F.array(F.lit(w)) if isinstance(w, str) else w for w in words]
    return df.select(
        F.lit(prefix).alias("prefix"), content.alias("content"), F.lit(kind).alias("chunk_type"), F.lit(float(importance)).alias("importance"), F.concat(*plain).alias("keywords"),
        (null if table is None else table).alias("source_table"), (null if column is None else column).alias("source_column"), (null if place is None else place.cast("string")).alias("place"),
    )


def _one(c: Column | str) -> Column:
    return F.array(F.lower(c))


def totals(tables: DataFrame, columns: DataFrame, edges: DataFrame, score: int, n_issues: int) -> DataFrame:
    """One row: n_tables, n_rows, names, n_columns, n_edges, score, n_issues. tables: table_name, row_count."""
    t = tables.agg(F.count("*").alias("n_tables"), F.coalesce(F.sum("row_count"), F.lit(0)).alias("n_rows"), F.array_sort(F.collect_list("table_name")).alias("names"))
    c, e = columns.agg(F.count("*").alias("n_columns")), edges.agg(F.count("*").alias("n_edges"))
    return t.join(F.broadcast(c)).join(F.broadcast(e)).withColumns({"score": F.lit(score), "n_issues": F.lit(n_issues)})


def overview(total: DataFrame, name: str, file_type: str = "relational") -> DataFrame:
    content = _text(f"{name} is a {file_type} database of ", F.col("n_tables"), " tables, ", F.col("n_columns"), " columns and ", F.col("n_rows"), " rows. Tables: ", F.array_join("names", ", "), ". It has ", F.col("n_edges"), " relationships, a quality score of ", F.col("score"), " of 100 and ", F.col("n_issues"), " quality issues.")
    return _chunk(total, "db", "db_overview", 2.0, content, ["database", "overview", "summary", "tables", "schema", name.lower(), F.transform("names", F.lower)])


def tables(meta: DataFrame, columns: DataFrame, types: DataFrame) -> DataFrame:
    """meta: table_name, row_count; types: table_name, table_type."""
    named = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.struct("ordinal", "column_name"))))
    shape = columns.groupBy("table_name").agg(named(F.lit(True)).alias("all"), named(F.col("is_pk")).alias("pk"), named(F.col("is_fk")).alias("fk"))
    got = meta.select("table_name", "row_count").join(checked_broadcast(shape), "table_name").join(checked_broadcast(types.select("table_name", "table_type")), "table_name", "left")
    listed = lambda c: F.array_join(F.transform(c, lambda x: x["column_name"]), ", ")
    key = lambda c, what: F.when(F.size(c) > 0, F.concat(F.lit(what), listed(c), F.lit("."))).otherwise("")
    kind = F.coalesce("table_type", F.lit("unknown"))
    content = _text("Table ", F.col("table_name"), ", of type ", kind, ": ", F.col("row_count"), " rows, ", F.size("all"), " columns.", key("pk", " Primary key: "), key("fk", " Foreign keys: "), " Columns: ", listed("all"), ".")
    return _chunk(got, "tbl", "table_overview", 1.5, content, ["table", _one("table_name"), F.array(kind), "schema", "structure", F.transform("all", lambda x: F.lower(x["column_name"]))], F.col("table_name"), place=F.col("table_name"))


def columns(meta: DataFrame, profiles: DataFrame | None = None, types: DataFrame | None = None) -> DataFrame:
    """meta: catalog columns; profiles: table_name, column_name, null_ratio, distinct_count; types: table_name, column_name, web_type."""
    on = ["table_name", "column_name"]
    got = meta.join(checked_broadcast(profiles.select(*on, "null_ratio", "distinct_count")), on, "left") if profiles is not None else meta.withColumns({"null_ratio": F.lit(None).cast("double"), "distinct_count": F.lit(None).cast("long")})
    got = got.join(checked_broadcast(types.select(*on, "web_type")), on, "left") if types is not None else got.withColumn("web_type", F.lit(None).cast("string"))
    said = lambda c, *parts: F.when(c, _text(*parts)).otherwise("")
    semantic = F.col("web_type").isNotNull() & (F.col("web_type") != "unknown")
    content = _text(
        "Column ", F.col("column_name"), " of table ", F.col("table_name"), " has type ", F.col("display_type"), ".", said(F.col("is_pk"), " It is in the primary key."), said(F.col("is_fk"), " It is a foreign key to another table."),
        said(semantic, " It holds values of the kind ", F.col("web_type"), "."), said(F.col("null_ratio").isNotNull(), " Null: ", F.round(100 * F.col("null_ratio"), 1), " %. Distinct values: ", F.col("distinct_count"), "."),
    )
    none = F.array().cast("array<string>")
    more = [F.when(F.col("is_pk"), F.array(F.lit("primary key"), F.lit("pk"))).otherwise(none), F.when(F.col("is_fk"), F.array(F.lit("foreign key"), F.lit("fk"), F.lit("reference"))).otherwise(none), F.when(semantic, _one("web_type")).otherwise(none)]
    place = F.concat("table_name", F.lit("\x00"), F.lpad(F.col("ordinal").cast("string"), 6, "0"))
    return _chunk(got, "col", "column_detail", 1.0, content, [_one("column_name"), _one("table_name"), _one("display_type"), "column", "field", *more], F.col("table_name"), F.col("column_name"), place)


def relationships(edges: DataFrame) -> DataFrame:
    content = _text("Relationship: ", F.col("from_table"), ".", F.col("from_column"), " refers to ", F.col("to_table"), ".", F.col("to_column"), "; many rows of ", F.col("from_table"), " may refer to one of ", F.col("to_table"), ".")
    return _chunk(edges, "rel", "relationship", 1.3, content, ["relationship", "join", "foreign key", "link", "reference", *[_one(c) for c in ("from_table", "to_table", "from_column", "to_column")]], place=F.concat_ws("\x00", "from_table", "from_column"))


def issues(found: DataFrame) -> DataFrame:
    """found: table_name, column_name, issue_type, severity."""
    where = F.concat_ws(".", "table_name", "column_name")
    content = _text("Quality issue of ", where, ": ", F.translate("issue_type", "_", " "), ", severity ", F.col("severity"), ".")
    return _chunk(found, "qual", "quality", 1.2, content, ["quality", "issue", "problem", F.array("severity"), _one("issue_type"), _one("table_name"), _one(F.coalesce("column_name", F.lit("")))], F.col("table_name"), F.col("column_name"), F.concat_ws("\x00", "table_name", "column_name", "issue_type"))


def queries(samples: DataFrame) -> DataFrame:
    """samples: title, sql."""
    words = F.filter(F.regexp_extract_all(F.lower("sql"), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[a-z_]+$"))
    return _chunk(samples, "qry", "query", 0.8, _text("Sample query: ", F.col("title"), ". SQL: ", F.col("sql")), ["query", "sql", "select", "join", "example", words], place=F.col("title"))


def across_tables(meta: DataFrame, columns: DataFrame, edges: DataFrame, profiles: DataFrame, most_null: float = 0.2, k: int = 10) -> DataFrame:
    """Up to four facts: types over all columns, the largest and the smallest table, the most connected one, columns with many nulls."""
    counts = columns.groupBy("display_type").agg(F.count("*").alias("n"))
    kinds = counts.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "display_type", "n"))).alias("x")).filter(F.size("x") > 0)
    a = _chunk(kinds, "xref", "cross_table", 0.7, _text("Column types over all tables: ", F.array_join(F.transform("x", lambda v: F.concat(v["n"].cast("string"), F.lit(" "), v["display_type"])), ", "), "."), ["data type", "distribution", "schema", "column types"], place=F.lit("1"))
    ends = meta.agg(F.min(F.struct((-F.col("row_count")).alias("o"), "table_name", "row_count")).alias("x"), F.min(F.struct("row_count", "table_name")).alias("y")).filter("x is not null")
    b = _chunk(ends, "xref", "cross_table", 0.8, _text("Largest table: ", F.col("x.table_name"), " with ", F.col("x.row_count"), " rows. Smallest table: ", F.col("y.table_name"), " with ", F.col("y.row_count"), " rows."), ["largest", "smallest", "rows", "size", "table"], place=F.lit("2"))
    degree = edges.select(F.explode(F.array("from_table", "to_table")).alias("t")).groupBy("t").agg(F.count("*").alias("n")).agg(F.min(F.struct((-F.col("n")).alias("o"), "t", "n")).alias("x")).filter("x is not null")
    c = _chunk(degree, "xref", "cross_table", 0.9, _text("Most connected table: ", F.col("x.t"), " with ", F.col("x.n"), " relationships."), ["connected", "relationships", "hub", "central", _one(F.col("x.t"))], place=F.lit("3"))
    many = profiles.filter(F.col("null_ratio") > most_null).agg(F.slice(F.array_sort(F.collect_list(F.struct("table_name", "column_name", "null_ratio"))), 1, k).alias("x")).filter(F.size("x") > 0)
    said = F.transform("x", lambda v: F.concat(v["table_name"], F.lit("."), v["column_name"], F.lit(" "), F.round(100 * v["null_ratio"], 1).cast("string"), F.lit(" %")))
    d = _chunk(many, "xref", "cross_table", 1.0, _text("Columns with many nulls: ", F.array_join(said, ", "), "."), ["null", "missing", "empty", "incomplete", "data quality"], place=F.lit("4"))
    return a.unionByName(b).unionByName(c).unionByName(d)


def statistics(total: DataFrame) -> DataFrame:
    content = _text("Totals: ", F.col("n_tables"), " tables, ", F.col("n_columns"), " columns, ", F.col("n_rows"), " rows, ", F.col("n_edges"), " relationships, quality score ", F.col("score"), " of 100.")
    return _chunk(total, "stat", "stat", 1.5, content, ["statistics", "count", "total", "numbers", "how many"])


def numbered(parts: list[DataFrame]) -> DataFrame:
    """All chunks with chunk_id (prefix and one number over all) and doc_id (that number). A row a column of metadata, so one window does."""
    every = reduce(DataFrame.unionByName, parts)
    rank = F.array_position(F.array(*[F.lit(k) for k in ORDER]), F.col("chunk_type"))
    number = F.row_number().over(Window.orderBy(rank, "place", "content")).cast("long")
    return every.withColumn("doc_id", number).withColumn("chunk_id", F.concat("prefix", F.lit("_"), F.lpad(F.col("doc_id").cast("string"), 4, "0"))).drop("prefix", "place")
