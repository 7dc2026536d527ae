"""Tables, their declared constraints (Parquet has none of its own) and metadata DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import checked_broadcast

#: Columns of the test tables that metadata operators describe: (column, type).
SCHEMAS: dict[str, list[tuple[str, str]]] = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"), ("s_acctbal", "double")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")],
    "events": [("event_id", "bigint"), ("ts", "timestamp_ntz"), ("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")],
}
PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",),
    "events": ("event_id",), "documents": ("doc_id",), "pages": ("page_id",), "embeddings": ("vec_id",), "benchmark": ("item_id",), "conversations": ("conv_id", "turn"),
}
#: (table, column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"), ("events", "user_id", "customer", "c_custkey"), ("labels", "doc_id", "documents", "doc_id"),
]
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_all(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    return {n: load(spark, sf_dir, n) for n in names or SCHEMAS}


def is_numeric(kind: str) -> bool:
    return kind.startswith(NUMERIC)


def display_type(kind: str) -> str:
    """The six display types of a Spark type name."""
    kind = kind.lower()
    if kind.startswith(("tinyint", "smallint", "int", "bigint")):
        return "INTEGER"
    if kind.startswith(("float", "double", "decimal")):
        return "REAL"
    if kind.startswith(("date", "timestamp")):
        return "DATETIME"
    if kind.startswith("boolean"):
        return "BOOLEAN"
    return "BINARY" if kind.startswith("binary") else "TEXT"


def display_type_column(kind: Column) -> Column:
    kind = F.lower(kind)
    return (
        F.when(kind.rlike("^(tinyint|smallint|int|bigint)"), "INTEGER").when(kind.rlike("^(float|double|decimal)"), "REAL").when(kind.rlike("^(date|timestamp)"), "DATETIME")
        .when(kind.startswith("boolean"), "BOOLEAN").when(kind.startswith("binary"), "BINARY").otherwise("TEXT")
    )


def column_rows(schemas=None, primary=None, foreign=None) -> list[tuple]:
    """(table, ordinal, column, declared_type, display_type, is_pk, is_fk) of every column."""
    schemas, primary, foreign = schemas or SCHEMAS, PRIMARY_KEYS if primary is None else primary, FOREIGN_KEYS if foreign is None else foreign
    fks = {(t, c) for t, c, _, _ in foreign}
    return [(t, k, c, kind, display_type(kind), c in primary.get(t, ()), (t, c) in fks) for t, cols in schemas.items() for k, (c, kind) in enumerate(cols)]


COLUMN_DDL = "table_name string, ordinal int, column_name string, declared_type string, display_type string, is_pk boolean, is_fk boolean"
EDGE_DDL = "from_table string, from_column string, to_table string, to_column string"


def columns(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(column_rows(), COLUMN_DDL)


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([e for e in FOREIGN_KEYS if e[0] in SCHEMAS], EDGE_DDL)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of every table: one aggregate a table, united."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out


def tables_meta(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count, n_columns, n_pk, n_fk)."""
    spark = next(iter(tables.values())).sparkSession
    shape = columns(spark).groupBy("table_name").agg(F.count("*").alias("n_columns"), F.sum(F.col("is_pk").cast("long")).alias("n_pk"), F.sum(F.col("is_fk").cast("long")).alias("n_fk"))
    return row_counts(tables).join(checked_broadcast(shape), "table_name")


def catalog_tables(spark: SparkSession, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Temporary views and tables of the session, without system names, filtered and sorted."""
    system = ("sqlite_", "pg_", "sql_", "sys", "information_schema")
    names = sorted(t.name for t in spark.catalog.listTables() if not t.name.startswith(system))
    names = [n for n in names if (not include or n in include) and n not in (exclude or [])]
    return spark.createDataFrame([(n,) for n in names], "table_name string")


def views(spark: SparkSession) -> list[str]:
    """Names of the session's views, temporary or not, apart from its tables."""
    return sorted(t.name for t in spark.catalog.listTables() if t.isTemporary or t.tableType == "VIEW")


CONSTRAINT_DDL = "table_name string, kind string, name string, columns string, refers_to string"


def constraints(spark: SparkSession, primary=None, foreign=None, unique=None, checks=None) -> DataFrame:
    """Declared constraints: primary and foreign keys, unique column lists by table, and checks ((table, name, condition)). Files have none of their own."""
    primary, foreign = PRIMARY_KEYS if primary is None else primary, FOREIGN_KEYS if foreign is None else foreign
    rows = [(t, "primary key", f"pk_{t}", ", ".join(c), None) for t, c in primary.items()]
    rows += [(t, "foreign key", f"fk_{t}_{c}", c, f"{p}.{k}") for t, c, p, k in foreign]
    rows += [(t, "unique", f"uq_{t}_{'_'.join(c)}", ", ".join(c), None) for t, lists in (unique or {}).items() for c in lists]
    rows += [(t, "check", name, condition, None) for t, name, condition in checks or []]
    return spark.createDataFrame(sorted(rows), CONSTRAINT_DDL)


def values_sql(rows: list[tuple], names: str) -> str:
    """A VALUES list for SQL."""

    def one(v) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS t({names})"
