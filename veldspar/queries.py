"""Registered queries of the library and the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as fx
from .operators import charts, chunks, docs, identity, profile, quality, relations, retrieval, semantics
from .plans import catalog, nlq, sandbox
from .plans.catalog import COLUMN_DDL, EDGE_DDL, FOREIGN_KEYS, SCHEMAS, column_rows, is_numeric, load, load_all, values_sql
from .scratch import scratch_path
from .sources import demo, readers
from .streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


EDGES = [e for e in FOREIGN_KEYS if e[0] in SCHEMAS]
COLS_SQL = values_sql(column_rows(), "table_name, ordinal, column_name, declared_type, display_type, is_pk, is_fk")
EDGES_SQL = values_sql(EDGES, "from_table, from_column, to_table, to_column")
COUNTS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in sorted(SCHEMAS))
TABLES_SQL = f"SELECT c.table_name, c.row_count, s.n_columns, s.n_pk, s.n_fk FROM ({COUNTS_SQL}) c JOIN (SELECT table_name, count(*) AS n_columns, count(*) FILTER (is_pk) AS n_pk, count(*) FILTER (is_fk) AS n_fk FROM {COLS_SQL} GROUP BY 1) s USING (table_name)"


def _tables(spark, sf):
    return catalog.tables_meta(load_all(spark, sf))


def _profile_sql(source: str, columns: list[tuple[str, str]]) -> str:
    parts = []
    for c, kind in columns:
        num = is_numeric(kind)
        x = f"CAST({c} AS DOUBLE)"
        words = "CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR)" if num else f"CAST(min({c}) AS VARCHAR), CAST(max({c}) AS VARCHAR)"
        stats = f"min({x}), max({x}), {words}, round(avg({x}), 4)" if num else f"CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), {words}, CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT '{c}', '{catalog.display_type(kind)}', count(*), count(*) - count({c}), count(DISTINCT {c}), {stats}, round((count(*) - count({c})) / CAST(count(*) AS DOUBLE), 6), round(count(DISTINCT {c}) / CAST(count(*) AS DOUBLE), 6) FROM {source}")
    names = "column_name, display_type, total_count, null_count, distinct_count, min_value, max_value, min_text, max_text, avg_value, null_ratio, uniqueness"
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) AS t({names})"


#: orders with nulls, the same on both sides.
ORDERS_N = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey END AS o_custkey, CASE WHEN o_orderkey % 5 > 0 THEN NULL ELSE o_totalprice END AS o_totalprice, nullif(o_orderpriority, o_orderpriority) AS o_orderpriority FROM orders)"
ORDERS_N_COLS = [("o_orderkey", "bigint"), ("o_orderstatus", "string"), ("o_custkey", "bigint"), ("o_totalprice", "double"), ("o_orderpriority", "string")]
PROFILE_N_SQL = _profile_sql(ORDERS_N, ORDERS_N_COLS)


def _orders_n(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("orders")
    return spark.sql(f"SELECT * FROM {ORDERS_N}")


def _profile_n(spark, sf):
    return profile.profile(_orders_n(spark, sf))


# --- sources ---------------------------------------------------------------------------------------------------------

for _t in ("nation", "orders"):
    query(f"scan_parquet_{_t}" if _t != "orders" else "scan_parquet", f"SELECT {', '.join(c for c, _ in SCHEMAS[_t])} FROM {_t}")(lambda spark, sf, t=_t: load(spark, sf, t))


def _roundtrip(sep: str):
    def run(spark, sf):
        path = scratch_path(spark, "files")
        load(spark, sf, "customer").write.option("header", True).option("sep", sep).csv(path)
        return readers.read_delimited(spark, path, sep, schema=load(spark, sf, "customer").schema)

    return run


query("scan_csv_roundtrip", "SELECT * FROM customer")(_roundtrip(","))
query("scan_tsv_roundtrip", "SELECT * FROM customer")(_roundtrip("\t"))


def _inferred(sep: str, infer: bool, name: str = "supplier"):
    """Types as the reader finds them, by column, with the values' totals."""

    def run(spark, sf):
        path = scratch_path(spark, "files")
        load(spark, sf, name).write.option("header", True).option("sep", sep).csv(path)
        got = readers.read_delimited(spark, path, sep, infer=infer)
        kinds = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(catalog.display_type(kind)).alias("display_type"), F.count(F.col(c)).over(Window.partitionBy(F.lit(0))).alias("n")) for c, kind in got.dtypes])
        return got.select(kinds.alias("k")).limit(1).select(F.inline("k"))

    return run


def _inferred_sql(name: str, infer: bool) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{catalog.display_type(kind) if infer else 'TEXT'}' AS display_type, count({c}) AS n FROM {name}" for c, kind in SCHEMAS[name])


query("scan_csv_inferred", _inferred_sql("supplier", True))(_inferred(",", True))
query("scan_tsv_inferred", _inferred_sql("part", True))(_inferred("\t", True, "part"))
query("scan_csv_all_text", _inferred_sql("supplier", False))(_inferred(",", False))
_FILES = [("a.csv", "csv"), ("b.TSV", "tsv"), ("c.txt", "txt"), ("d.json", "json"), ("e.db", "sqlite"), ("f.sqlite3", "sqlite"), ("g.xlsx", "excel"), ("h.parquet", "parquet"), ("i.sql", "unknown"), ("j", "unknown")]
query("file_types", f"SELECT * FROM {values_sql(_FILES, 'name, kind')}")(lambda spark, sf: spark.createDataFrame([(f, readers.file_type(f)) for f, _ in _FILES], "name string, kind string"))
query("catalog_views", f"SELECT DISTINCT table_name AS view_name FROM {COLS_SQL}")(lambda spark, sf: (sandbox.register(load_all(spark, sf)), spark.createDataFrame([(v,) for v in catalog.views(spark) if v in SCHEMAS], "view_name string"))[1])
query("constraints", f"SELECT * FROM {values_sql(sorted([(t, 'primary key', 'pk_' + t, ', '.join(c), None) for t, c in catalog.PRIMARY_KEYS.items()] + [(t, 'foreign key', f'fk_{t}_{c}', c, f'{p}.{k}') for t, c, p, k in FOREIGN_KEYS]), 'table_name, kind, name, columns, refers_to')}")(lambda spark, sf: catalog.constraints(spark))
query("server_info", "SELECT 'Apache Spark' AS engine, true AS healthy")(lambda spark, sf: spark.createDataFrame([(readers.server_info(spark)["engine"], readers.health(spark))], "engine string, healthy boolean"))


@query("scan_json_array", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_json_array(spark, sf):
    path = scratch_path(spark, "files")
    rows = F.to_json(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey")))).alias("value")
    load(spark, sf, "nation").agg(rows).write.text(path)
    return next(iter(readers.read_json(spark, path).values())).select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@query("scan_json_multi_table", "SELECT 'nation' AS table_name, count(*) AS row_count FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def scan_json_multi_table(spark, sf):
    path = scratch_path(spark, "files")
    n = load(spark, sf, "nation").agg(F.collect_list(F.struct("*")).alias("nation"))
    r = load(spark, sf, "region").agg(F.collect_list(F.struct("*")).alias("region"))
    n.join(F.broadcast(r)).select(F.to_json(F.struct("nation", "region", F.lit(3).alias("m"), F.array().cast("array<int>").alias("e"))).alias("value")).write.text(path)
    return catalog.row_counts(readers.read_json(spark, path))


@query("catalog_tables", f"SELECT DISTINCT table_name FROM {COLS_SQL} WHERE table_name <> 'events'")
def catalog_tables(spark, sf):
    sandbox.register(load_all(spark, sf))
    return catalog.catalog_tables(spark, include=sorted(SCHEMAS), exclude=["events"])


query("rowcount_by_table", COUNTS_SQL)(lambda spark, sf: catalog.row_counts(load_all(spark, sf)))
query("table_preview", "SELECT * FROM nation")(lambda spark, sf: sandbox.preview(load(spark, sf, "nation")))
query("table_preview_cap", "SELECT 500 AS n")(lambda spark, sf: sandbox.preview(load(spark, sf, "orders"), 10_000).agg(F.count("*").cast("int").alias("n")))


# --- profiling -------------------------------------------------------------------------------------------------------

for _t in SCHEMAS:
    query(f"profile_columns_{_t}", _profile_sql(_t, SCHEMAS[_t]))(lambda spark, sf, t=_t: profile.profile(load(spark, sf, t).select(*[c for c, _ in SCHEMAS[t]])))
query("profile_columns_with_nulls", PROFILE_N_SQL)(_profile_n)
query("null_percentage", f"SELECT column_name, round(100.0 * CAST(null_count AS DOUBLE) / total_count, 1) AS null_percentage FROM ({PROFILE_N_SQL})")(lambda spark, sf: profile.null_percentages(_profile_n(spark, sf)))
query("sparse_columns", f"SELECT column_name, null_ratio FROM ({PROFILE_N_SQL}) WHERE null_ratio > 0.5")(lambda spark, sf: profile.sparse(_profile_n(spark, sf)))
query("null_report_fifth", f"SELECT column_name, null_ratio FROM ({PROFILE_N_SQL}) WHERE null_ratio > 0.2 ORDER BY null_ratio DESC, column_name LIMIT 10")(lambda spark, sf: quality.null_report(_profile_n(spark, sf), 10, 0.2))
query("null_report", f"SELECT column_name, null_ratio FROM ({PROFILE_N_SQL}) WHERE null_ratio > 0.05 ORDER BY null_ratio DESC, column_name LIMIT 15")(lambda spark, sf: quality.null_report(_profile_n(spark, sf)))
query("likely_identifiers", f"SELECT column_name, uniqueness FROM ({_profile_sql('customer', SCHEMAS['customer'])}) WHERE uniqueness > 0.95")(lambda spark, sf: profile.likely_identifiers(profile.profile(load(spark, sf, "customer"))))
query("profiling_summary", f"SELECT count(*) AS n_columns, count(*) FILTER (null_count > 0) AS with_nulls, count(*) FILTER (null_ratio > 0.5) AS mostly_null, CAST(sum(null_count) AS BIGINT) AS null_cells FROM ({PROFILE_N_SQL})")(lambda spark, sf: profile.summary(_profile_n(spark, sf)))
_KEYS_SQL = "SELECT column_name, regexp_matches(lower(column_name), '^(id|pk)$|(_id|key)$') AND distinct_count = total_count AND total_count > 0 AS is_pk_candidate, regexp_matches(lower(column_name), '(_id|key)$') AND NOT (distinct_count = total_count AND total_count > 0) AS is_fk_candidate FROM ({p})"
query("pk_candidates", _KEYS_SQL.format(p=_profile_sql("orders", SCHEMAS["orders"])))(lambda spark, sf: profile.key_candidates(profile.profile(load(spark, sf, "orders"))))
query("fk_candidates", _KEYS_SQL.format(p=_profile_sql("lineitem", SCHEMAS["lineitem"])))(lambda spark, sf: profile.key_candidates(profile.profile(load(spark, sf, "lineitem"))))
_TOP = [("orders", "o_orderpriority"), ("part", "p_brand"), ("lineitem", "l_linenumber")]
query("top_values", " UNION ALL ".join(f"(SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS frequency FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 10)" for t, c in _TOP))(
    lambda spark, sf: profile.top_values(load(spark, sf, "orders"), "o_orderpriority").unionByName(profile.top_values(load(spark, sf, "part"), "p_brand")).unionByName(profile.top_values(load(spark, sf, "lineitem"), "l_linenumber"))
)
query("profile_sample_values", "SELECT 'o_orderstatus' AS column_name, v AS value FROM (SELECT DISTINCT nullif(o_orderstatus, 'P') AS v FROM orders) WHERE v IS NOT NULL ORDER BY v LIMIT 10")(lambda spark, sf: profile.sample_values(_orders_n(spark, sf), "o_orderstatus"))
query("sampled_profile")(lambda spark, sf: profile.profile(profile.sampled(load(spark, sf, "orders").select("o_orderkey", "o_totalprice"))))
query("profile_approximate")(lambda spark, sf: profile.profile_approximate(load(spark, sf, "lineitem")))
query("schema_summary", f"SELECT count(*) AS n_tables, CAST(sum(n_columns) AS BIGINT) AS n_columns, count(*) FILTER (n_pk > 0) AS with_pk, count(*) FILTER (n_fk > 0) AS with_fk, round(avg(n_columns), 4) AS avg_columns FROM ({TABLES_SQL})")(
    lambda spark, sf: _tables(spark, sf).agg(F.count("*").alias("n_tables"), F.sum("n_columns").alias("n_columns"), F.sum((F.col("n_pk") > 0).cast("long")).alias("with_pk"), F.sum((F.col("n_fk") > 0).cast("long")).alias("with_fk"), F.round(F.avg("n_columns"), 4).alias("avg_columns"))
)
query("summary_totals", f"SELECT count(*) AS n_tables, CAST(sum(n_columns) AS BIGINT) AS n_columns, CAST(sum(row_count) AS BIGINT) AS n_rows, {len(EDGES)} AS n_relationships FROM ({TABLES_SQL})")(
    lambda spark, sf: _tables(spark, sf).agg(F.count("*").alias("n_tables"), F.sum("n_columns").alias("n_columns"), F.sum("row_count").alias("n_rows")).withColumn("n_relationships", F.lit(len(EDGES)))
)
query("insights_overview", f"SELECT table_name, row_count, CASE WHEN row_count > 10000 THEN 'large' WHEN row_count > 1000 THEN 'medium' ELSE 'small' END AS size_category FROM ({COUNTS_SQL})")(
    lambda spark, sf: catalog.row_counts(load_all(spark, sf)).withColumn("size_category", F.when(F.col("row_count") > 10000, "large").when(F.col("row_count") > 1000, "medium").otherwise("small"))
)


# --- semantic types --------------------------------------------------------------------------------------------------

_NAMES = "id customer_id order_key zip_code first_name product_title email_address mobile street region_name created_at order_date ts total_price cast_count duration is_active state notes website category_type rating latitude customer_uuid revenue qty has_flag fee ssn birth_year card_number full_name fax addr title body xyz country_code payment_value user_status weight_kg".split()
_KINDS = ["int", "string", "double", "timestamp_ntz", "boolean", "decimal(10,2)"]
FIXTURE = [(f"t{k % 4}", k, n, _KINDS[k % len(_KINDS)], catalog.display_type(_KINDS[k % len(_KINDS)]), False, False) for k, n in enumerate(_NAMES)] + column_rows()
FIX_SQL = values_sql(FIXTURE, "table_name, ordinal, column_name, declared_type, display_type, is_pk, is_fk")


def _fixture(spark):
    return spark.createDataFrame(FIXTURE, COLUMN_DDL)


_web = f"coalesce({semantics.rules_sql('lower(column_name)', semantics.WEB_TYPES)}, CASE WHEN regexp_matches(declared_type, 'date|time') THEN 'date' WHEN regexp_matches(declared_type, 'decimal|float') THEN CASE WHEN regexp_matches(lower(column_name), 'price|amount|cost|total') THEN 'amount' ELSE 'numeric' END WHEN regexp_matches(declared_type, 'char|text') THEN 'text' ELSE 'unknown' END)"
query("semantic_types_web", f"SELECT table_name, column_name, {_web} AS semantic_type FROM {FIX_SQL}")(lambda spark, sf: _fixture(spark).select("table_name", "column_name", semantics.web_type(F.col("column_name"), F.col("declared_type")).alias("semantic_type")))
_c, _k = "lower(column_name)", "declared_type"
_cli = f"""CASE WHEN regexp_matches({_k}, 'timestamp|datetime|date|time') THEN 'timestamp' WHEN regexp_matches({_k}, 'bool|bit') THEN 'boolean' WHEN regexp_matches({_c}, '{semantics.CLI_IDENTIFIER}') THEN 'identifier'
 WHEN regexp_matches({_k}, 'int|float|double|decimal|numeric|real|money') AND regexp_matches({_c}, '{semantics.CLI_METRIC}') THEN 'metric' WHEN regexp_matches({_c}, '{semantics.CLI_STATUS}') THEN 'dimension'
 WHEN regexp_matches({_c}, '{semantics.CLI_GEO}') THEN 'geographic' WHEN regexp_matches({_c}, '{semantics.CLI_MONEY}') AND regexp_matches({_k}, 'decimal|numeric|money') THEN 'financial'
 WHEN regexp_matches({_k}, 'char|text|string') AND regexp_matches({_c}, '{semantics.CLI_TEXT}') THEN 'text' ELSE 'unknown' END"""
query("semantic_types_cli", f"SELECT table_name, column_name, {_cli} AS semantic_type FROM {FIX_SQL}")(lambda spark, sf: _fixture(spark).select("table_name", "column_name", semantics.cli_type(F.col("column_name"), F.col("declared_type")).alias("semantic_type")))
query("pii_columns", f"SELECT table_name, column_name, {semantics.rules_sql(_c, semantics.PII)} AS pii_class FROM {FIX_SQL} WHERE {semantics.rules_sql(_c, semantics.PII)} IS NOT NULL")(
    lambda spark, sf: _fixture(spark).select("table_name", "column_name", semantics.pii_class(F.col("column_name")).alias("pii_class")).filter("pii_class is not null")
)
query("semantic_refine", f"SELECT column_name, CASE WHEN uniqueness > 0.95 THEN 'identifier' WHEN distinct_count > 0 AND distinct_count < 50 THEN 'dimension' ELSE 'unknown' END AS semantic_type FROM ({_profile_sql('part', SCHEMAS['part'])})")(
    lambda spark, sf: profile.profile(load(spark, sf, "part")).select("column_name", semantics.refine(F.lit("unknown"), F.col("uniqueness"), F.col("distinct_count")).alias("semantic_type"))
)
_TT = [("orders", 1, 1), ("order_items", 2, 0), ("customer", 0, 1), ("product_mapping", 2, 2), ("status_codes", 0, 1), ("abc", 2, 1), ("abd", 0, 1), ("abe", 3, 2), ("abf", 1, 1), ("audit_log", 0, 1)]
query("table_types_web", f"SELECT table_name, coalesce({semantics.rules_sql('lower(table_name)', semantics.TABLE_TYPES)}, CASE WHEN n_fk >= 2 AND n_pk <= 1 THEN 'fact' WHEN n_fk = 0 AND n_pk = 1 THEN 'dimension' WHEN n_fk >= 2 AND n_pk >= 2 THEN 'bridge' ELSE 'dimension' END) AS table_type FROM {values_sql(_TT, 'table_name, n_fk, n_pk')}")(
    lambda spark, sf: spark.createDataFrame(_TT, "table_name string, n_fk int, n_pk int").select("table_name", semantics.web_table_type(F.col("table_name"), F.col("n_fk"), F.col("n_pk")).alias("table_type"))
)
_SAMPLES = [(1, "a@b.co;c.d@e.org"), (2, "+49 (30) 1234567;030-555-1234"), (3, "123e4567-e89b-12d3-a456-426614174000"), (4, "active;Pending;CLOSED"), (5, "a@b.co;x"), (6, "abc;def"), (7, "1234567")]
_each = lambda test: f"(SELECT bool_and({test}) FROM (SELECT unnest(string_split(s, ';')) AS v))"
query("value_pattern_detect", f"SELECT id, CASE WHEN {_each(f'regexp_matches(lower(v), \'{fx.UUID}\')')} THEN 'uuid' WHEN {_each(f'regexp_matches(lower(v), \'{fx.EMAIL}\')')} THEN 'email' WHEN {_each(f'regexp_matches(lower(v), \'{fx.PHONE}\')')} THEN 'phone' WHEN {_each('lower(v) IN (' + ', '.join(repr(s) for s in fx.STATUSES) + ')')} THEN 'status' END AS pattern FROM {values_sql(_SAMPLES, 'id, s')}")(
    lambda spark, sf: spark.createDataFrame(_SAMPLES, "id int, s string").select("id", fx.value_pattern(F.split("s", ";")).alias("pattern"))
)
query("type_distribution", f"SELECT display_type, count(*) AS n FROM {COLS_SQL} GROUP BY 1")(lambda spark, sf: catalog.columns(spark).groupBy("display_type").agg(F.count("*").alias("n")))
query("display_types", f"SELECT table_name, column_name, display_type FROM {FIX_SQL}")(lambda spark, sf: _fixture(spark).select("table_name", "column_name", catalog.display_type_column(F.col("declared_type")).alias("display_type")))


# --- relationships ---------------------------------------------------------------------------------------------------

query("relationships_explicit", f"SELECT e.*, coalesce(c.is_pk, false) AS is_identifying, 'many-to-one' AS relationship_type FROM {EDGES_SQL.replace(' AS t(', ' AS e(')} LEFT JOIN {COLS_SQL.replace(' AS t(', ' AS c(')} ON c.table_name = e.from_table AND c.column_name = e.from_column")(
    lambda spark, sf: relations.explicit(catalog.edges(spark), catalog.columns(spark))
)
_IMPLICIT = [("orders", 0, "id", "int", "INTEGER", True, False), ("orders", 1, "customers_id", "int", "INTEGER", False, False), ("orders", 2, "product_id", "bigint", "INTEGER", False, False), ("orders", 3, "fk_sellers", "string", "TEXT", False, False), ("orders", 4, "id_regions", "int", "INTEGER", False, False), ("orders", 5, "ordersid", "int", "INTEGER", False, False), ("customers", 0, "id", "int", "INTEGER", True, False), ("products", 0, "id", "int", "INTEGER", True, False), ("sellers", 0, "id", "int", "INTEGER", True, False), ("regions", 0, "id", "int", "INTEGER", True, False)]
_IMP_ALL = _IMPLICIT + [(t, k, c, d, s, c in catalog.PRIMARY_KEYS.get(t, ()), False) for t, k, c, d, s, _, _ in column_rows() if t not in ("orders",)] + [("order2", 0, "o_custkey", "bigint", "INTEGER", False, False)]
_ISQL = values_sql(_IMP_ALL, "table_name, ordinal, column_name, declared_type, display_type, is_pk, is_fk")
query("relationships_implicit", f"""WITH m AS (SELECT * FROM {_ISQL}), p AS (SELECT table_name AS to_table, min(column_name) AS to_column, min(declared_type) AS to_type FROM m WHERE is_pk GROUP BY 1 HAVING count(*) = 1)
SELECT DISTINCT m.table_name AS from_table, m.column_name AS from_column, to_table, to_column FROM m JOIN p ON m.table_name <> to_table AND NOT m.is_pk WHERE (lower(m.column_name) IN (to_table || '_id', to_table || 'id', 'fk_' || to_table, regexp_replace(to_table, 's$', '') || '_id', 'id_' || to_table)
 OR (regexp_matches(m.column_name, '^[a-z]+_[a-z]+key$') AND regexp_matches(to_column, '^[a-z]+_[a-z]+key$') AND regexp_extract(m.column_name, '_([a-z]+key)$', 1) = regexp_extract(to_column, '_([a-z]+key)$', 1)))
 AND ((regexp_matches(m.declared_type, 'int') AND regexp_matches(to_type, 'int')) OR (regexp_matches(m.declared_type, 'char|text|string') AND regexp_matches(to_type, 'char|text|string')))""")(lambda spark, sf: relations.implicit(spark.createDataFrame(_IMP_ALL, COLUMN_DDL)))
_SC = [("orders", "id", "int", True, 1.0), ("orders", "customer_id", "int", False, 0.3), ("orders", "fk_product", "bigint", False, 0.97), ("orders", "sellerid", "string", False, 0.7), ("customer", "id", "int", True, 1.0), ("product", "id", "int", True, 0.96), ("seller", "id", "int", True, 1.0), ("orders", "items_id", "double", False, 0.1), ("items", "id", "int", True, 0.4)]
_SSQL = values_sql(_SC, "table_name, column_name, declared_type, is_pk, uniqueness")
query("relationship_scores", f"""WITH m AS (SELECT * FROM {_SSQL}), j AS (SELECT a.table_name AS from_table, a.column_name AS from_column, b.table_name AS to_table, b.column_name AS to_column, a.declared_type AS ta, b.declared_type AS tb,
 CASE WHEN a.column_name IN (b.table_name || '_id') THEN 0.98 WHEN a.column_name = 'fk_' || b.table_name THEN 0.97 WHEN a.column_name = b.table_name || 'id' THEN 0.95 WHEN b.table_name LIKE '%s' AND a.column_name = substr(b.table_name, 1, length(b.table_name) - 1) || '_id' THEN 0.92 ELSE 0 END AS pattern,
 CASE WHEN a.uniqueness > 0.95 AND b.uniqueness > 0.95 THEN '1:1' WHEN a.uniqueness < 0.5 AND b.uniqueness > 0.95 THEN 'N:1' WHEN a.uniqueness > 0.95 AND b.uniqueness < 0.5 THEN '1:N' ELSE 'N:M' END AS cardinality FROM m a JOIN m b ON NOT a.is_pk AND b.is_pk AND a.table_name <> b.table_name)
SELECT from_table, from_column, to_table, to_column, cardinality, round(CAST(0.5 * pattern + 0.3 * CASE WHEN ta = tb THEN 1.0 WHEN regexp_matches(ta, 'int') AND regexp_matches(tb, 'int') THEN 0.9 WHEN ta = 'double' OR tb = 'double' THEN 0.8 ELSE 0.6 END + 0.2 * CASE cardinality WHEN 'N:1' THEN 0.95 WHEN '1:1' THEN 0.9 WHEN '1:N' THEN 0.85 ELSE 0.7 END AS DOUBLE), 4) AS score FROM j WHERE pattern > 0.5""")(
    lambda spark, sf: relations.scored(spark.createDataFrame(_SC, "table_name string, column_name string, declared_type string, is_pk boolean, uniqueness double"))
)
_CARD = [(k, a, b) for k, (a, b) in enumerate([(1.0, 1.0), (0.2, 1.0), (1.0, 0.2), (0.2, 0.2), (0.6, 0.99), (0.96, 0.96), (0.95, 0.95)])]
query("cardinality_scored", f"SELECT id, CASE WHEN a > 0.95 AND b > 0.95 THEN '1:1' WHEN a < 0.5 AND b > 0.95 THEN 'N:1' WHEN a > 0.95 AND b < 0.5 THEN '1:N' ELSE 'N:M' END AS cardinality FROM {values_sql(_CARD, 'id, a, b')}")(
    lambda spark, sf: spark.createDataFrame(_CARD, "id int, a double, b double").select("id", relations.cardinality_scored(F.col("a"), F.col("b")).alias("cardinality"))
)


def _unique(t: str, c: str) -> str:
    return f"(SELECT count(DISTINCT {c}) > 0.99 * count(*) FROM {t})"


@query("cardinality_cli", " UNION ALL ".join(f"SELECT '{a}' AS from_table, '{ac}' AS from_column, '{b}' AS to_table, CASE WHEN {_unique(a, ac)} AND {_unique(b, bc)} THEN '1:1' WHEN {_unique(b, bc)} THEN 'N:1' WHEN {_unique(a, ac)} THEN '1:N' ELSE 'N:M' END AS cardinality" for a, ac, b, bc in EDGES))
def cardinality_cli(spark, sf):
    ratio = lambda t, c: profile.profile_column(load(spark, sf, t), c).select(F.lit(t).alias("t"), F.lit(c).alias("c"), ((F.col("uniqueness") > 0.99) | F.lit(c in catalog.PRIMARY_KEYS.get(t, ()))).alias("u"))
    every = None
    for t, c in sorted({(a, ac) for a, ac, _, _ in EDGES} | {(b, bc) for _, _, b, bc in EDGES}):
        every = ratio(t, c) if every is None else every.unionByName(ratio(t, c))
    every = F.broadcast(every)
    e = catalog.edges(spark)
    e = e.join(every.select(F.col("t").alias("from_table"), F.col("c").alias("from_column"), F.col("u").alias("ua")), ["from_table", "from_column"]).join(every.select(F.col("t").alias("to_table"), F.col("c").alias("to_column"), F.col("u").alias("ub")), ["to_table", "to_column"])
    return e.select("from_table", "from_column", "to_table", relations.cardinality_cli(F.col("ua"), F.col("ub"), F.lit(False)).alias("cardinality"))


_T = "(SELECT DISTINCT table_name FROM {c})".format(c=COLS_SQL)
@query("table_types_cli", f"""WITH e AS (SELECT * FROM {EDGES_SQL}), g AS (SELECT t.table_name, (SELECT count(DISTINCT to_table) FROM e WHERE from_table = t.table_name) AS n_out, (SELECT count(DISTINCT from_table) FROM e WHERE to_table = t.table_name) AS n_in FROM {_T} t)
SELECT table_name, n_out, n_in, CASE WHEN n_out >= 2 AND n_in = 0 THEN 'fact' WHEN n_in > 0 AND n_out = 0 THEN 'dimension' WHEN n_out > 0 THEN 'fact' ELSE 'unknown' END AS table_type FROM g""")
def table_types_cli(spark, sf):
    columns = catalog.columns(spark)
    return relations.table_types(catalog.edges(spark), columns.select("table_name").distinct(), columns)


query("table_roles", f"SELECT table_name, CASE WHEN table_name IN (SELECT from_table FROM {EDGES_SQL}) THEN 'transaction' WHEN table_name IN (SELECT to_table FROM {EDGES_SQL}) THEN 'core' ELSE 'isolated' END AS role FROM {_T}")(
    lambda spark, sf: relations.roles(catalog.edges(spark), catalog.columns(spark).select("table_name").distinct())
)
query("root_tables", f"SELECT DISTINCT to_table AS table_name FROM {EDGES_SQL} WHERE to_table NOT IN (SELECT from_table FROM {EDGES_SQL})")(lambda spark, sf: relations.roots(catalog.edges(spark)))
query("most_connected_table", f"SELECT table_name, count(*) AS degree FROM (SELECT from_table AS table_name FROM {EDGES_SQL} UNION ALL SELECT to_table FROM {EDGES_SQL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")(lambda spark, sf: relations.most_connected(catalog.edges(spark)))
query("relationship_text", f"SELECT DISTINCT from_table, to_table, 'Each ' || from_table || ' belongs to one ' || to_table || '; a ' || to_table || ' can have many ' || from_table AS sentence FROM {EDGES_SQL}")(lambda spark, sf: relations.sentences(catalog.edges(spark)))
query("relationship_matrix", f"SELECT a, b, max(s) AS strength FROM (SELECT from_table AS a, to_table AS b, CAST(1.0 AS DOUBLE) AS s FROM {EDGES_SQL} UNION ALL SELECT to_table, from_table, 0.5 FROM {EDGES_SQL}) GROUP BY 1, 2")(lambda spark, sf: relations.matrix(catalog.edges(spark)))
query("load_order", "SELECT * FROM (VALUES (0, 'part'), (1, 'region'), (2, 'nation'), (3, 'customer'), (4, 'supplier'), (5, 'events'), (6, 'orders'), (7, 'lineitem')) AS t(position, table_name)")(
    lambda spark, sf: spark.createDataFrame(list(enumerate(relations.load_order([(a, b) for a, _, b, _ in EDGES], sorted(SCHEMAS)))), "position int, table_name string")
)
_LOOPS = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "e"), ("f", "g"), ("g", "f"), ("g", "a")]
query("cycle_detection", f"WITH RECURSIVE e AS (SELECT * FROM {values_sql(_LOOPS, 'c, p')}), w AS (SELECT c AS start, p AS node, c || '>' || p AS path FROM e UNION ALL SELECT start, e.p, path || '>' || e.p FROM w JOIN e ON e.c = w.node AND w.node > w.start AND length(path) < 20) SELECT path FROM w WHERE node = start")(
    lambda spark, sf: spark.createDataFrame([(">".join(c),) for c in relations.cycles(_LOOPS)], "path string")
)
query("load_order_levels", f"WITH RECURSIVE e AS (SELECT DISTINCT from_table AS c, to_table AS p FROM {EDGES_SQL}), l AS (SELECT DISTINCT table_name AS t, 0 AS k FROM {COLS_SQL} UNION SELECT e.c, l.k + 1 FROM l JOIN e ON e.p = l.t) SELECT e.c AS child, e.p AS parent, max(a.k) > max(b.k) AS later FROM e JOIN l a ON a.t = e.c JOIN l b ON b.t = e.p GROUP BY 1, 2")(
    lambda spark, sf: (lambda at: spark.createDataFrame([(c, p, at[c] > at[p]) for c, p in sorted({(a, b) for a, _, b, _ in EDGES})], "child string, parent string, later boolean"))({t: k for k, t in enumerate(relations.load_order([(a, b) for a, _, b, _ in EDGES], sorted(SCHEMAS)))})
)
_SUFFIX = [("orders", 0, "id", "int", "INTEGER", True, False), ("orders", 1, "customer_id", "int", "INTEGER", False, False), ("orders", 2, "box_id", "int", "INTEGER", False, False), ("orders", 3, "news_id", "int", "INTEGER", False, False), ("orders", 4, "orders_id", "int", "INTEGER", False, True), ("orders", 5, "seller_id", "int", "INTEGER", False, True), ("customers", 0, "key", "int", "INTEGER", True, False), ("boxes", 0, "id", "int", "INTEGER", True, False), ("new", 0, "a", "int", "INTEGER", True, False), ("new", 1, "b", "int", "INTEGER", True, False), ("sellers", 0, "x", "int", "INTEGER", False, False)]
for _source, _where, _also, _self in (("database", "NOT m.is_fk", ", (3, regexp_replace(k, 's$', ''))", " AND t.table_name <> m.table_name"), ("files", "m.is_fk", "", "")):
    query(f"relationships_suffix_{_source}", f"""WITH m AS (SELECT *, substr(lower(column_name), 1, length(column_name) - 3) AS k FROM {values_sql(_SUFFIX, 'table_name, ordinal, column_name, declared_type, display_type, is_pk, is_fk')}),
 t AS (SELECT table_name, CASE WHEN count(*) FILTER (is_pk) = 1 THEN max(column_name) FILTER (is_pk) ELSE 'id' END AS to_column FROM m GROUP BY 1),
 x AS (SELECT m.table_name AS from_table, m.column_name AS from_column, t.table_name AS to_table, t.to_column, row_number() OVER (PARTITION BY m.table_name, m.column_name ORDER BY v.r) AS rn
 FROM m, LATERAL (VALUES (0, k), (1, k || 's'), (2, k || 'es'){_also}) AS v(r, name) JOIN t ON t.table_name = v.name WHERE ends_with(m.column_name, '_id') AND {_where}{_self})
SELECT from_table, from_column, to_table, to_column FROM x WHERE rn = 1""")(lambda spark, sf, source=_source: relations.implicit_by_suffix(spark.createDataFrame(_SUFFIX, COLUMN_DDL), source))
query("orphan_records", "SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, nullif(o_custkey, 7) AS o_custkey FROM orders) o WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer c WHERE c_custkey = o.o_custkey AND c_custkey % 7 <> 0)")(
    lambda spark, sf: relations.orphans(load(spark, sf, "orders").select("o_orderkey", F.nullif(F.col("o_custkey"), F.lit(7)).alias("o_custkey")), "o_custkey", load(spark, sf, "customer").filter("c_custkey % 7 <> 0"), "c_custkey")
)
_G = "list_transform(generate_series(1, length(p) - 1), lambda i: substr(p, i, 2))"


_NAMES_SQL = f"SELECT table_name, column_name, list_distinct(flatten(list(CASE WHEN length(p) < 2 THEN [p] ELSE {_G} END))) AS g FROM (SELECT DISTINCT table_name, column_name, unnest(list_filter(string_split(regexp_replace(lower(column_name), '[_.-]', ' ', 'g'), ' '), lambda x: x <> '')) AS p FROM {COLS_SQL}) GROUP BY 1, 2"


@query("name_similarity", f"WITH n AS ({_NAMES_SQL}) SELECT a.table_name AS a_table_name, a.column_name AS a_column_name, b.table_name AS b_table_name, b.column_name AS b_column_name, round(len(list_intersect(a.g, b.g)) / CAST(len(list_distinct(list_concat(a.g, b.g))) AS DOUBLE), 6) AS similarity FROM n a JOIN n b ON a.table_name < b.table_name AND len(list_intersect(a.g, b.g)) > 0")
def name_similarity(spark, sf):
    return relations.similar_names(catalog.columns(spark))


query("name_ngrams", f"SELECT column_name, array_to_string(list_sort(list_distinct(flatten(list(g)))), ',') AS grams FROM (SELECT column_name, CASE WHEN length(p) < 2 THEN [p] ELSE {_G} END AS g FROM (SELECT DISTINCT column_name, unnest(list_filter(string_split(regexp_replace(lower(column_name), '[_.-]', ' ', 'g'), ' '), lambda x: x <> '')) AS p FROM {FIX_SQL})) GROUP BY 1")(
    lambda spark, sf: _fixture(spark).select("column_name").distinct().select("column_name", F.array_join(F.array_sort(fx.char_grams(F.col("column_name"))), ",").alias("grams"))
)


# --- data quality ----------------------------------------------------------------------------------------------------

_ISSUE = "CAST(NULL AS VARCHAR) AS column_name"
query("quality_missing_pk", f"SELECT table_name, {_ISSUE}, 'missing_primary_key' AS issue_type, 'WARNING' AS severity FROM {_T} WHERE table_name NOT IN (SELECT table_name FROM {COLS_SQL} WHERE is_pk)")(lambda spark, sf: quality.missing_pk(catalog.columns(spark).select("table_name").distinct(), catalog.columns(spark)))


def _profiled(spark, sf):
    return _profile_n(spark, sf).withColumn("table_name", F.lit("orders"))


def _issue_sql(kind: str, severity: str, where: str, source: str | None = None) -> str:
    return f"SELECT 'orders' AS table_name, column_name, '{kind}' AS issue_type, {severity} AS severity FROM ({source or PROFILE_N_SQL}) WHERE {where}"


query("quality_nulls_cli", _issue_sql("nulls", "CASE WHEN null_ratio >= 0.5 THEN 'CRITICAL' ELSE 'WARNING' END", "null_ratio >= 0.1"))(lambda spark, sf: quality.nulls_cli(_profiled(spark, sf)))
query("quality_nulls_web", _issue_sql("high_nulls", "CASE WHEN null_ratio > 0.8 THEN 'high' ELSE 'medium' END", "null_ratio > 0.5"))(lambda spark, sf: quality.nulls_web(_profiled(spark, sf)))
_ONE = "(SELECT o_orderkey, 'x' AS constant FROM orders)"
_ONE_SQL = _profile_sql(_ONE, [("o_orderkey", "bigint"), ("constant", "string")])
query("quality_single_value", _issue_sql("single_value", "'INFO'", "distinct_count = 1 AND total_count > 100", _ONE_SQL))(
    lambda spark, sf: quality.single_value(profile.profile(load(spark, sf, "orders").select("o_orderkey", F.lit("x").alias("constant"))).withColumn("table_name", F.lit("orders")))
)
query("quality_fk_nulls", _issue_sql("fk_nulls", "'CRITICAL'", "column_name = 'o_custkey' AND null_count > 0"))(
    lambda spark, sf: quality.fk_nulls(_profiled(spark, sf), catalog.columns(spark).withColumn("nullable", F.lit(False)))
)
query("quality_low_cardinality", _issue_sql("low_cardinality", "'medium'", "column_name LIKE '%key' AND distinct_count < 0.5 * total_count", _profile_sql("orders", SCHEMAS["orders"])))(
    lambda spark, sf: quality.low_cardinality(profile.profile(load(spark, sf, "orders")).withColumn("table_name", F.lit("orders")).withColumn("semantic_type", F.when(F.col("column_name").endswith("key"), "identifier")))
)
query("quality_empty_table", "SELECT 'empty' AS table_name, CAST(NULL AS VARCHAR) AS column_name, 'empty_table' AS issue_type, 'low' AS severity")(lambda spark, sf: quality.empty_tables(catalog.row_counts({"region": load(spark, sf, "region"), "empty": load(spark, sf, "region").filter("r_regionkey < 0")})))
_IS = [("a", "x", "k", "high"), ("a", "y", "k", "medium"), ("b", "x", "k", "low"), ("b", "z", "k", "low"), ("a", "x", "q", "CRITICAL"), ("b", "x", "q", "WARNING"), ("c", "x", "q", "INFO")]
_IS_SQL = values_sql(_IS, "table_name, column_name, issue_type, severity")
_issues = lambda spark: spark.createDataFrame(_IS, "table_name string, column_name string, issue_type string, severity string")
query("quality_score_web", f"SELECT CAST(greatest(0, least(100, 100 - sum(CASE severity WHEN 'high' THEN 10 WHEN 'medium' THEN 5 WHEN 'low' THEN 2 ELSE 0 END))) AS INT) AS score FROM {_IS_SQL}")(lambda spark, sf: quality.score_web(_issues(spark)))
_PKS = [("a", "id", True), ("b", "id", False), ("c", "id", True), ("d", "id", False)]
query("quality_score_cli", f"SELECT t.table_name, CAST(greatest(0, 100 - coalesce((SELECT sum(CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'WARNING' THEN 10 WHEN 'INFO' THEN 2 ELSE 0 END) FROM {_IS_SQL.replace(' AS t(', ' AS i(')} WHERE i.table_name = t.table_name), 0) - CASE WHEN t.is_pk THEN 0 ELSE 15 END) AS INT) AS score FROM {values_sql(_PKS, 'table_name, column_name, is_pk')}")(
    lambda spark, sf: quality.score_cli(_issues(spark), spark.createDataFrame(_PKS, "table_name string, column_name string, is_pk boolean"), spark.createDataFrame(_PKS, "table_name string, column_name string, is_pk boolean"))
)
_SCORES = [(s,) for s in (100, 90, 89, 80, 70, 69, 60, 50, 49, 40, 39, 0)]
query("quality_band", f"SELECT score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'fair' ELSE 'poor' END AS cli, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS gauge FROM {values_sql(_SCORES, 'score')}")(
    lambda spark, sf: spark.createDataFrame(_SCORES, "score int").select("score", quality.band(F.col("score")).alias("cli"), quality.band(F.col("score"), "web").alias("gauge"))
)


# --- identity --------------------------------------------------------------------------------------------------------

_FP = {"nation": ["n_name", "n_nationkey", "n_regionkey"], "part": ["p_brand", "p_name", "p_partkey", "p_retailprice", "p_size", "p_type"]}


def _canon(c: str, kind: str) -> str:
    if kind == "string":
        return f"coalesce(CASE WHEN trim({c}) = '' THEN '__EMPTY__' ELSE trim({c}) END, '__NULL__')"
    return f"coalesce(CAST(CAST(round({c}, 6) AS DECIMAL(38,6)) AS VARCHAR), '__NULL__')" if kind == "double" else f"coalesce(CAST({c} AS VARCHAR), '__NULL__')"


def _fp_sql(t: str) -> str:
    kinds = dict(SCHEMAS[t])
    rows = "SELECT sha256(" + " || chr(31) || ".join(_canon(c, kinds[c]) for c in _FP[t]) + f") AS h FROM {t}"
    return identity.FINGERPRINT_SQL.format(rows=rows, names=",".join(_FP[t]))


query("content_fingerprint", _fp_sql("part"))(lambda spark, sf: identity.fingerprint(load(spark, sf, "part")))
query("content_fingerprint_nation", _fp_sql("nation"))(lambda spark, sf: identity.fingerprint(load(spark, sf, "nation")))
_VARIANTS = {"same": "nation", "other order": "(SELECT * FROM nation ORDER BY n_name DESC)", "a row less": "(SELECT * FROM nation WHERE n_nationkey > 0)", "a cell changed": "(SELECT n_nationkey, replace(n_name, 'A', 'B') AS n_name, n_regionkey FROM nation)", "a row twice": "(SELECT * FROM nation UNION ALL SELECT * FROM nation WHERE n_nationkey = 0)"}


def _verify(spark, sf):
    nation = load(spark, sf, "nation")
    nation.createOrReplaceTempView("nation")
    expected = identity.fingerprint(nation).first().content_hash[:12]
    out = None
    for name, source in _VARIANTS.items():
        one = identity.verify(spark.sql(f"SELECT * FROM {source}"), expected).select(F.lit(name).alias("variant"), "verified")
        out = one if out is None else out.unionByName(one)
    return out


query("fingerprint_verify", " UNION ALL ".join(f"SELECT '{name}' AS variant, starts_with((SELECT content_hash FROM ({_fp_sql('nation').replace('FROM nation', 'FROM ' + source)})), (SELECT substr(content_hash, 1, 12) FROM ({_fp_sql('nation')}))) AS verified" for name, source in _VARIANTS.items()))(_verify)
query("canonical_json", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation")(lambda spark, sf: load(spark, sf, "nation").select("n_nationkey", fx.canonical_json(["n_nationkey", "n_name", "n_regionkey"]).alias("json")))
query("strip_accents", "SELECT doc_id, md5(strip_accents(lower(text))) AS plain FROM documents WHERE text IS NOT NULL")(lambda spark, sf: load(spark, sf, "documents").filter("text is not null").select("doc_id", F.md5(fx.strip_accents(F.lower("text")).cast("binary")).alias("plain")))
query("canonical_values", f"SELECT o_orderkey, {_canon('o_orderstatus', 'string')} AS status, {_canon('o_totalprice', 'double')} AS price FROM {ORDERS_N}")(
    lambda spark, sf: _orders_n(spark, sf).select("o_orderkey", fx.canonical(F.col("o_orderstatus"), "string").alias("status"), fx.canonical(F.col("o_totalprice"), "double").alias("price"))
)
query("detect_year", "SELECT year, votes FROM (SELECT y AS year, count(*) AS votes FROM (SELECT unnest(regexp_extract_all(CAST(o_orderdate AS VARCHAR), '20[0-2][0-9]')) AS y FROM orders) GROUP BY 1) WHERE votes >= 3 ORDER BY votes DESC, year DESC LIMIT 1")(lambda spark, sf: identity.detect_year(load(spark, sf, "orders"), ["o_orderdate"]))
_TOPIC = values_sql(sorted(identity.TOPICS.items()), "part, topic")
query("topic_scores", f"SELECT topic, CAST(sum(points) AS BIGINT) AS score FROM (SELECT unnest(regexp_split_to_array(lower(table_name), '[_\\-\\s.]+')) AS part, 3 AS points FROM (SELECT DISTINCT table_name FROM {FIX_SQL}) UNION ALL SELECT unnest(regexp_split_to_array(lower(column_name), '[_\\-\\s.]+')), 1 FROM {FIX_SQL}) JOIN {_TOPIC} USING (part) GROUP BY 1")(
    lambda spark, sf: identity.topic_scores_frame(_fixture(spark))
)
query("semantic_id", "SELECT * FROM (VALUES ('netflix_titles.csv', 'NETFLIXMOVIEA5AC'), ('sales_data_2024.csv', 'SALESDATA2024A5AC'), ('my_orders.csv', 'MYORDERSA5AC')) AS t(filename, id)")(
    lambda spark, sf: spark.createDataFrame([(f, identity.semantic_id(f, t, "a5ac09", y)) for f, t, y in (("netflix_titles.csv", {"titles": ["title", "director"]}, ""), ("sales_data_2024.csv", {"d": ["x"]}, "2024"), ("my_orders.csv", {"x": ["y"]}, ""))], "filename string, id string")
)


# --- text functions and retrieval ------------------------------------------------------------------------------------

_QUERY = "the thatble erest and nation of erthin"


#: Items of the benchmark as a corpus: with importance, and two keywords each.
BENCH = "(SELECT item_id, text, 1.0 + (item_id % 3) / 2.0 AS importance, ['Item', 'kind_' || (item_id % 5)] AS words FROM benchmark)"


def _corpus(spark, sf):
    words = F.array(F.lit("Item"), F.concat(F.lit("kind_"), (F.col("item_id") % 5).cast("string")))
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("content"), words.alias("keywords"), (1.0 + (F.col("item_id") % 3) / 2.0).alias("importance"))


def _index(spark, sf, kinds="btk"):
    return retrieval.build(_corpus(spark, sf), kinds=kinds)


TOK = "list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')"
TERMS = "list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || '_' || w[i + 1]))"
POST = f"d AS (SELECT item_id AS doc_id, {TOK} AS w FROM (SELECT item_id, text || ' ' || array_to_string(words, ' ') AS text FROM {BENCH})), s AS (SELECT doc_id, {TERMS} AS t FROM d), z AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM s), p AS (SELECT doc_id, dl, term, count(*) AS tf FROM z GROUP BY ALL), st AS (SELECT count(*) AS n, greatest(1.0, avg(len(t))) AS avgdl FROM s), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1)"
ASK = f"q AS (SELECT unnest({TERMS}) AS term FROM (SELECT {TOK.replace('text', repr(_QUERY))} AS w)), qn AS (SELECT term, count(*) AS qn FROM q GROUP BY 1), im AS (SELECT item_id AS doc_id, importance FROM {BENCH})"
BM = f"WITH {POST}, {ASK}, bm AS (SELECT doc_id, sum(qn * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM p JOIN qn USING (term) JOIN df USING (term), st GROUP BY 1)"
_round = lambda df: df.select("doc_id", F.round("score", 6).alias("score"))
query("tokenize_terms", f"WITH {POST} SELECT doc_id, array_to_string(t, ' ') AS terms FROM s")(lambda spark, sf: _corpus(spark, sf).select("doc_id", F.array_join(fx.terms(F.concat_ws(" ", "content", "keywords")), " ").alias("terms")))
query("text_normalize", "SELECT p_partkey, regexp_replace(lower(trim(p_name)), '[\\s_\\-]+', '_', 'g') AS name FROM part")(lambda spark, sf: load(spark, sf, "part").select("p_partkey", fx.normalize(F.col("p_name")).alias("name")))
query("bm25_stats", f"WITH {POST} SELECT n AS n_docs, round(CAST(avgdl AS DOUBLE), 6) AS avgdl FROM st")(lambda spark, sf: retrieval.bm25_stats(_index(spark, sf, "b")).select("n_docs", F.round("avgdl", 6).alias("avgdl")))
query("bm25_idf", f"WITH {POST} SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, st")(lambda spark, sf: retrieval.bm25_idf(_index(spark, sf, "b")).select("term", "df", F.round("idf", 6).alias("idf")))
query("bm25_topk", f"{BM} SELECT doc_id, round(score * importance, 6) AS score FROM bm JOIN im USING (doc_id) WHERE score * importance > 0.01 ORDER BY score * importance DESC, doc_id LIMIT 10")(lambda spark, sf: _round(retrieval.top(retrieval.scores(_index(spark, sf, "b"), _QUERY, "bm25"))))
#: Words of a-z and underscores among the runs of letters and digits of any script.
KW = "list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z_]{3,}')))"
KWS_ALL = f"list_distinct(list_concat(list_transform(words, lambda x: lower(x)), {KW}))"
query("keyword_terms", f"SELECT item_id AS doc_id, array_to_string(list_sort({KW}), ' ') AS terms FROM benchmark")(lambda spark, sf: _corpus(spark, sf).select("doc_id", F.array_join(F.array_sort(fx.keywords(F.col("content"))), " ").alias("terms")))
query("keyword_index", f"SELECT item_id AS doc_id, unnest({KWS_ALL}) AS term FROM {BENCH}")(lambda spark, sf: retrieval.keyword_index(_index(spark, sf, "k")))
_ASKED = sorted({w for w in _QUERY.split() if len(w) >= 2})
KWS = f"SELECT item_id AS doc_id, len(list_intersect({KWS_ALL}, {_ASKED})) / {len(_ASKED)}.0 AS score, importance FROM {BENCH}"
query("keyword_topk", f"SELECT doc_id, round(CAST(score * importance AS DOUBLE), 6) AS score FROM ({KWS}) WHERE score > 0 ORDER BY score * importance DESC, doc_id LIMIT 10")(lambda spark, sf: _round(retrieval.top(retrieval.scores(_index(spark, sf, "k"), _QUERY, "keyword"), least=0.0)))
_STOPS = str(list(retrieval.STOP))
_NG = lambda n: f"list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
_WORD = "[\\p{L}\\p{N}_][\\p{L}\\p{N}_.]*[\\p{L}\\p{N}_]"
TFI = f"""td AS (SELECT item_id AS doc_id, list_filter(regexp_extract_all(strip_accents(lower(text || ' ' || array_to_string(words, ' ') || ' ' || array_to_string(words, ' '))), '{_WORD}'), lambda x: NOT list_contains({_STOPS}, x)) AS w FROM {BENCH}), tz AS (SELECT doc_id, unnest(list_concat(list_concat(w, {_NG(2)}), {_NG(3)})) AS term FROM td),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tz GROUP BY ALL), n AS (SELECT count(*) AS n FROM benchmark), tdf AS (SELECT term, count(*) AS df, sum(tf) AS total, any_value(n) AS n FROM tf, n GROUP BY 1 HAVING count(*) <= 0.95 * any_value(n) ORDER BY total DESC, term LIMIT 10000),
fe AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM tdf), r AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN fe USING (term)), wt AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM r)"""
query("tfidf_weights", f"WITH {TFI} SELECT doc_id, term, round(weight, 6) AS weight FROM wt")(lambda spark, sf: retrieval.weights(_index(spark, sf, "t")).select("doc_id", "term", F.round("weight", 6).alias("weight")))
query("tfidf_terms", f"WITH {TFI} SELECT term, df, round(idf, 6) AS idf FROM fe")(lambda spark, sf: _index(spark, sf, "t").features.select("term", "df", F.round("idf", 6).alias("idf")))
_QTF = sorted({t: retrieval.feature_terms(_QUERY).count(t) for t in retrieval.feature_terms(_QUERY)}.items())
TFS = f"qv AS (SELECT term, (1 + ln(qtf)) * idf AS w FROM {values_sql(_QTF, 'term, qtf')} JOIN fe USING (term)), ts AS (SELECT doc_id, sum(weight * w) / (SELECT sqrt(sum(w * w)) FROM qv) AS score FROM wt JOIN qv USING (term) GROUP BY 1)"
_IM = f"im AS (SELECT item_id AS doc_id, importance FROM {BENCH})"
query("tfidf_topk", f"WITH {TFI}, {TFS}, {_IM} SELECT doc_id, round(score * importance, 6) AS score FROM ts JOIN im USING (doc_id) WHERE score * importance > 0.01 ORDER BY score * importance DESC, doc_id LIMIT 10")(lambda spark, sf: _round(retrieval.top(retrieval.scores(_index(spark, sf, "t"), _QUERY, "tfidf"))))
_HYB = f"{BM}, {TFI}, {TFS}, kw AS (SELECT doc_id, score FROM ({KWS}) WHERE score > 0), h AS (SELECT doc_id, 0.40 * score / (SELECT max(score) FROM ts) AS s FROM ts UNION ALL SELECT doc_id, 0.35 * score / (SELECT max(score) FROM bm) FROM bm UNION ALL SELECT doc_id, 0.25 * score / (SELECT max(score) FROM kw) FROM kw), hy AS (SELECT doc_id, sum(s) * any_value(importance) AS score FROM h JOIN im USING (doc_id) GROUP BY 1)"
query("hybrid_scores", f"{_HYB} SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM hy")(lambda spark, sf: _round(retrieval.scores(_index(spark, sf), _QUERY, "hybrid")))
query("retrieval_confidence", f"{_HYB}, t AS (SELECT doc_id, score FROM hy ORDER BY score DESC, doc_id LIMIT 5) SELECT round(CAST(least(1.0, 0.4 * max(score) + 0.3 * avg(score) + 0.3 * least(count(*) / 5.0, 1.0)) AS DOUBLE), 3) AS confidence FROM t")(lambda spark, sf: retrieval.confidence(retrieval.scores(_index(spark, sf), _QUERY, "hybrid")))


#: Greedy choice by rounds: each adds the candidate of the highest worth, given the likeness of all pairs.
_MMR = f"""{_HYB}, c AS (SELECT doc_id, score FROM hy WHERE score >= 0.01), sim AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.weight * b.weight) AS s FROM wt a JOIN wt b USING (term) GROUP BY 1, 2)"""
for _k in range(1, 6):
    _before = " UNION ALL ".join(f"SELECT doc_id FROM m{i}" for i in range(1, _k)) or "SELECT NULL WHERE false"
    _MMR += f", m{_k} AS (SELECT {_k} AS rank, doc_id, score FROM (SELECT c.doc_id, c.score, round(0.7 * c.score - 0.3 * greatest(0, coalesce((SELECT max(s) FROM sim WHERE sim.a = c.doc_id AND sim.b IN ({_before})), 0)), 12) AS worth FROM c WHERE c.doc_id NOT IN ({_before})) ORDER BY worth DESC, doc_id LIMIT 1)"


@query("mmr_rerank", _MMR + " SELECT rank, doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, 6)) + ")")
def mmr_rerank(spark, sf):
    got = retrieval.search(_index(spark, sf), _QUERY, 5)
    return spark.createDataFrame([(k, i, round(s, 6)) for k, (i, s) in enumerate(got, 1)], "rank int, doc_id long, score double")


_QUESTIONS = [("How many tables are there?", "table_info"), ("Which columns are nullable?", "column_info"), ("How do I join orders and customers? Which link connects them?", "relationship"), ("Are there missing values or other problems?", "quality"), ("Show me an SQL query", "query_help"), ("What is the total size and count of records?", "stats"), ("hello", "general")]
query("answer_intents", f"SELECT * FROM {values_sql(_QUESTIONS, 'question, intent')}")(lambda spark, sf: spark.createDataFrame([(q, retrieval.answer_intent(q)) for q, _ in _QUESTIONS], "question string, intent string"))
query("vector_cosine_topk", "SELECT e.vec_id, round(CAST(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS DOUBLE), 4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id LIMIT 10")(
    lambda spark, sf: retrieval.vector_topk(load(spark, sf, "embeddings"), load(spark, sf, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))).select("vec_id", F.round("score", 4).alias("score"))
)
_CHUNK = "content, chunk_type, importance, array_to_string(keywords, ',') AS keywords"


def _chunk_sql(kind: str, importance: float, content: str, words: str, source: str) -> str:
    return f"SELECT {content} AS content, '{kind}' AS chunk_type, CAST({importance} AS DOUBLE) AS importance, {words} AS keywords FROM {source}"


def _chunk_rows(df):
    return df.select("content", "chunk_type", "importance", F.array_join("keywords", ",").alias("keywords"))


def _total(spark, sf):
    return chunks.totals(_tables(spark, sf), catalog.columns(spark), catalog.edges(spark), 80, 3)


_TOTAL_SQL = f"(SELECT count(*) AS t, sum(row_count) AS r, string_agg(table_name, ', ' ORDER BY table_name) AS names, string_agg(table_name, ',' ORDER BY table_name) AS words FROM ({COUNTS_SQL}))"
query("chunks_db_overview", _chunk_sql("db_overview", 2.0, f"'shop is a relational database of ' || t || ' tables, {len(column_rows())} columns and ' || r || ' rows. Tables: ' || names || '. It has {len(EDGES)} relationships, a quality score of 80 of 100 and 3 quality issues.'", "'database,overview,summary,tables,schema,shop,' || words", _TOTAL_SQL))(lambda spark, sf: _chunk_rows(chunks.overview(_total(spark, sf), "shop")))
query("chunks_stat", _chunk_sql("stat", 1.5, f"'Totals: ' || t || ' tables, {len(column_rows())} columns, ' || r || ' rows, {len(EDGES)} relationships, quality score 80 of 100.'", "'statistics,count,total,numbers,how many'", _TOTAL_SQL))(lambda spark, sf: _chunk_rows(chunks.statistics(_total(spark, sf))))
_LIST = lambda flag: f"string_agg(column_name, ', ' ORDER BY ordinal) FILTER ({flag})"
_SHAPE = f"(SELECT table_name, count(*) AS n, {_LIST('true')} AS every, {_LIST('is_pk')} AS pk, {_LIST('is_fk')} AS fk FROM {COLS_SQL} GROUP BY 1)"
query("chunks_table_overview", _chunk_sql("table_overview", 1.5, "'Table ' || table_name || ', of type ' || table_type || ': ' || row_count || ' rows, ' || n || ' columns.' || coalesce(' Primary key: ' || pk || '.', '') || coalesce(' Foreign keys: ' || fk || '.', '') || ' Columns: ' || every || '.'", "'table,' || table_name || ',' || table_type || ',schema,structure,' || replace(every, ', ', ',')", f"({COUNTS_SQL}) JOIN {_SHAPE} USING (table_name) JOIN (SELECT table_name, table_type FROM ({ORACLES['table_types_cli']})) USING (table_name)"))(
    lambda spark, sf: _chunk_rows(chunks.tables(_tables(spark, sf), catalog.columns(spark), table_types_cli(spark, sf)))
)
query("chunks_column_detail", _chunk_sql("column_detail", 1.0, "'Column ' || column_name || ' of table ' || table_name || ' has type ' || display_type || '.' || CASE WHEN is_pk THEN ' It is in the primary key.' ELSE '' END || CASE WHEN is_fk THEN ' It is a foreign key to another table.' ELSE '' END", "column_name || ',' || table_name || ',' || lower(display_type) || ',column,field' || CASE WHEN is_pk THEN ',primary key,pk' ELSE '' END || CASE WHEN is_fk THEN ',foreign key,fk,reference' ELSE '' END", COLS_SQL))(lambda spark, sf: _chunk_rows(chunks.columns(catalog.columns(spark))))
query("chunks_relationship", _chunk_sql("relationship", 1.3, "'Relationship: ' || from_table || '.' || from_column || ' refers to ' || to_table || '.' || to_column || '; many rows of ' || from_table || ' may refer to one of ' || to_table || '.'", "'relationship,join,foreign key,link,reference,' || from_table || ',' || to_table || ',' || from_column || ',' || to_column", EDGES_SQL))(lambda spark, sf: _chunk_rows(chunks.relationships(catalog.edges(spark))))
query("chunks_quality", _chunk_sql("quality", 1.2, "'Quality issue of ' || table_name || '.' || column_name || ': ' || issue_type || ', severity ' || severity || '.'", "'quality,issue,problem,' || severity || ',' || issue_type || ',' || table_name || ',' || column_name", _IS_SQL))(lambda spark, sf: _chunk_rows(chunks.issues(_issues(spark))))
_SAMPLES_SQL = docs.sample_queries(["region", "nation"], EDGES, facts=[("orders", "o_totalprice")])
query("chunks_query", _chunk_sql("query", 0.8, "'Sample query: ' || title || '. SQL: ' || sql", "array_to_string(list_concat(['query', 'sql', 'select', 'join', 'example'], list_filter(regexp_extract_all(lower(sql), '[\\p{L}\\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z_]+'))), ',')", values_sql(_SAMPLES_SQL, "title, sql")))(lambda spark, sf: _chunk_rows(chunks.queries(spark.createDataFrame(_SAMPLES_SQL, "title string, sql string"))))
_DEG = f"(SELECT x, count(*) AS n FROM (SELECT from_table AS x FROM {EDGES_SQL} UNION ALL SELECT to_table FROM {EDGES_SQL}) GROUP BY 1 ORDER BY n DESC, x LIMIT 1)"
query("chunks_cross_table", " UNION ALL ".join([
    _chunk_sql("cross_table", 0.7, "'Column types over all tables: ' || string_agg(n || ' ' || display_type, ', ' ORDER BY n DESC, display_type) || '.'", "'data type,distribution,schema,column types'", f"(SELECT display_type, count(*) AS n FROM {COLS_SQL} GROUP BY 1)"),
    _chunk_sql("cross_table", 0.8, "'Largest table: ' || (SELECT table_name || ' with ' || row_count FROM k ORDER BY row_count DESC, table_name LIMIT 1) || ' rows. Smallest table: ' || (SELECT table_name || ' with ' || row_count FROM k ORDER BY row_count, table_name LIMIT 1) || ' rows.'", "'largest,smallest,rows,size,table'", "(SELECT 1)").replace("FROM k ", f"FROM ({COUNTS_SQL}) "),
    _chunk_sql("cross_table", 0.9, "'Most connected table: ' || x || ' with ' || n || ' relationships.'", "'connected,relationships,hub,central,' || x", _DEG),
    _chunk_sql("cross_table", 1.0, "'Columns with many nulls: ' || string_agg('orders.' || column_name || ' ' || round(100 * null_ratio, 1) || ' %', ', ' ORDER BY column_name) || '.'", "'null,missing,empty,incomplete,data quality'", f"({PROFILE_N_SQL}) WHERE null_ratio > 0.2"),
]))(lambda spark, sf: _chunk_rows(chunks.across_tables(_tables(spark, sf), catalog.columns(spark), catalog.edges(spark), _profiled(spark, sf))))
query("chunk_ids", f"SELECT 'col_' || lpad(CAST(row_number() OVER (ORDER BY table_name, ordinal) AS VARCHAR), 4, '0') AS chunk_id, column_name FROM {COLS_SQL} UNION ALL SELECT 'rel_' || lpad(CAST({len(column_rows())} + row_number() OVER (ORDER BY from_table, from_column) AS VARCHAR), 4, '0'), NULL FROM {EDGES_SQL}")(
    lambda spark, sf: chunks.numbered([chunks.relationships(catalog.edges(spark)), chunks.columns(catalog.columns(spark))]).select("chunk_id", F.col("source_column").alias("column_name"))
)
query("index_stats", f"SELECT 'column_detail' AS chunk_type, count(*) AS n_chunks FROM {COLS_SQL} UNION ALL SELECT 'relationship', count(*) FROM {EDGES_SQL}")(
    lambda spark, sf: (lambda every: retrieval.index_stats(retrieval.build(every), every).select("chunk_type", "n_chunks"))(chunks.numbered([chunks.columns(catalog.columns(spark)), chunks.relationships(catalog.edges(spark))]))
)


# --- charts ----------------------------------------------------------------------------------------------------------

query("chart_table_size", f"SELECT table_name, row_count FROM ({COUNTS_SQL}) ORDER BY 2 DESC, 1 LIMIT 15")(lambda spark, sf: charts.table_size(_tables(spark, sf)))
_TYPES_SQL = ORACLES["table_types_cli"]
query("chart_table_type", f"SELECT table_type, count(*) AS n, round(100.0 * count(*) / {float(len(SCHEMAS))}, 1) AS percent FROM ({_TYPES_SQL}) GROUP BY 1")(lambda spark, sf: charts.by_type(table_types_cli(spark, sf), "table_type", "table_type"))
query("chart_table_share", f"SELECT table_name, round(100.0 * CAST(row_count AS DOUBLE) / (SELECT sum(row_count) FROM ({COUNTS_SQL})), 4) AS share FROM ({COUNTS_SQL})")(lambda spark, sf: charts.table_share(_tables(spark, sf)))
query("chart_density", f"SELECT table_name, round(CAST(row_count AS DOUBLE) / (SELECT max(row_count) FROM ({COUNTS_SQL})), 6) AS rows_norm, round(CAST(n_columns AS DOUBLE) / (SELECT max(n_columns) FROM ({TABLES_SQL})), 6) AS columns_norm FROM ({TABLES_SQL})")(lambda spark, sf: charts.density(_tables(spark, sf)))
query("chart_table_dna", f"SELECT table_name, ordinal, display_type, is_pk, is_fk FROM {COLS_SQL}")(lambda spark, sf: charts.dna(catalog.columns(spark)))
query("chart_column_types", f"SELECT display_type, count(*) AS n, round(100.0 * count(*) / {float(len(column_rows()))}, 1) AS percent FROM {COLS_SQL} GROUP BY 1")(lambda spark, sf: charts.by_type(catalog.columns(spark), "display_type", "display_type"))
query("chart_null_by_table", f"SELECT 'orders' AS table_name, round(100 * avg(null_ratio), 2) AS avg_null_percent FROM ({PROFILE_N_SQL})")(lambda spark, sf: charts.null_by_table(_profiled(spark, sf).withColumn("ordinal", F.lit(0))))
query("chart_null_by_column", f"SELECT column_name, round(100 * null_ratio, 2) AS null_percent FROM ({PROFILE_N_SQL}) WHERE null_count > 0 ORDER BY null_ratio DESC, column_name LIMIT 20")(lambda spark, sf: charts.null_by_column(_profile_n(spark, sf)))
query("chart_column_fingerprint", f"SELECT column_name, round(100 * uniqueness, 2) AS unique_percent, round(100 * null_ratio, 2) AS null_percent, CAST(least(300.0, greatest(20.0, total_count / 10.0)) AS DOUBLE) AS bubble FROM ({PROFILE_N_SQL})")(lambda spark, sf: charts.column_fingerprint(_profile_n(spark, sf)))
query("chart_quality_gauge", f"SELECT score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS band, " + ", ".join(f"(SELECT count(*) FROM {_IS_SQL} WHERE severity = '{x}') AS {x}" for x in ("high", "medium", "low")) + f" FROM ({ORACLES['quality_score_web']})")(lambda spark, sf: charts.gauge(quality.score_web(_issues(spark)), _issues(spark)))
query("chart_quality_issues", f"SELECT s.severity, (SELECT count(*) FROM {_IS_SQL.replace(' AS t(', ' AS i(')} WHERE i.severity = s.severity) AS n FROM (VALUES ('high'), ('medium'), ('low')) AS s(severity)")(lambda spark, sf: charts.severities(_issues(spark)))
query("chart_completeness", f"SELECT round(100.0 * CAST(count(*) FILTER (n_pk > 0) AS DOUBLE) / count(*), 2) AS primary_keys, (SELECT round(100.0 * CAST(count(*) FILTER (null_ratio <= 0.1) AS DOUBLE) / count(*), 2) FROM ({PROFILE_N_SQL})) AS completeness, round(100.0 * CAST((SELECT count(DISTINCT x) FROM (SELECT from_table AS x FROM {EDGES_SQL} UNION ALL SELECT to_table FROM {EDGES_SQL})) AS DOUBLE) / count(*), 2) AS relationships, round(100.0 * CAST(count(*) FILTER (row_count > 0) AS DOUBLE) / count(*), 2) AS non_empty, CAST(100.0 AS DOUBLE) AS documentation FROM ({TABLES_SQL})")(
    lambda spark, sf: charts.completeness(_tables(spark, sf), _profile_n(spark, sf), catalog.edges(spark))
)
query("chart_network_edges", f"SELECT from_table, to_table, count(*) AS n_links FROM {EDGES_SQL} GROUP BY 1, 2")(lambda spark, sf: charts.network(catalog.edges(spark)))
_NET = [("orders", "customer_id", "customer", "id")]
_NET_SQL = values_sql(_NET, "from_table, from_column, to_table, to_column")
_scored = lambda spark: relations.scored(spark.createDataFrame(_SC, "table_name string, column_name string, declared_type string, is_pk boolean, uniqueness double"))
query("chart_network", f"SELECT from_table, from_column, to_table, 'declared' AS kind, CAST(1.0 AS DOUBLE) AS strength FROM {_NET_SQL} UNION ALL (SELECT from_table, from_column, to_table, 'inferred', score FROM ({ORACLES['relationship_scores']}) WHERE NOT (from_table = 'orders' AND from_column = 'customer_id' AND to_table = 'customer') ORDER BY score DESC, from_table, from_column LIMIT 10)")(lambda spark, sf: charts.network_edges(spark.createDataFrame(_NET, EDGE_DDL), _scored(spark)))
query("chart_network_nodes", f"SELECT DISTINCT x AS table_name FROM (SELECT from_table AS x FROM {_NET_SQL} UNION ALL SELECT to_table FROM {_NET_SQL} UNION ALL SELECT from_table FROM ({ORACLES['relationship_scores']}) UNION ALL SELECT to_table FROM ({ORACLES['relationship_scores']}))")(lambda spark, sf: charts.network_nodes(_tables(spark, sf), spark.createDataFrame(_NET, EDGE_DDL), _scored(spark)))
query("chart_hierarchy", f"WITH RECURSIVE e AS (SELECT DISTINCT from_table AS c, to_table AS p FROM {EDGES_SQL}), h AS (SELECT DISTINCT p AS table_name, 0 AS level FROM e WHERE p NOT IN (SELECT c FROM e) UNION SELECT e.c, h.level + 1 FROM h JOIN e ON e.p = h.table_name WHERE h.level < 4) SELECT table_name, min(level) AS level FROM h GROUP BY 1")(lambda spark, sf: charts.hierarchy(catalog.edges(spark)))
query("chart_flows", f"SELECT from_table, to_table, from_column, CAST(80.0 AS DOUBLE) AS weight FROM {EDGES_SQL}")(lambda spark, sf: charts.flows(catalog.edges(spark)))
query("chart_node_sizes", f"SELECT table_name, round(0.3 + 0.5 * CAST(row_count AS DOUBLE) / (SELECT max(row_count) FROM ({COUNTS_SQL})), 6) AS size FROM ({COUNTS_SQL})")(lambda spark, sf: charts.node_sizes(_tables(spark, sf)))
query("chart_fk_coverage", f"SELECT t.table_name, t.table_name IN (SELECT from_table FROM {EDGES_SQL} UNION ALL SELECT to_table FROM {EDGES_SQL}) AS in_edge, (SELECT count(*) FROM {EDGES_SQL.replace(' AS t(', ' AS e(')} WHERE e.from_table = t.table_name) AS n_fks FROM {_T} t")(lambda spark, sf: charts.fk_coverage(catalog.columns(spark).select("table_name").distinct(), catalog.edges(spark)))
query("chart_sunburst", f"SELECT table_name, display_type, count(*) AS n FROM {COLS_SQL} GROUP BY 1, 2")(lambda spark, sf: charts.sunburst(catalog.columns(spark)))
query("chart_overview", " UNION ALL ".join([
    f"SELECT 'table_size' AS panel, table_name AS label, CAST(row_count AS DOUBLE) AS value FROM ({COUNTS_SQL})", f"SELECT 'quality_issues', severity, CAST(n AS DOUBLE) FROM ({ORACLES['chart_quality_issues']})",
    f"SELECT 'column_types', display_type, CAST(count(*) AS DOUBLE) FROM {COLS_SQL} GROUP BY 2", f"SELECT 'totals', 'n_rows', CAST(sum(row_count) AS DOUBLE) FROM ({COUNTS_SQL})", f"SELECT 'totals', 'n_tables', CAST(count(*) AS DOUBLE) FROM ({COUNTS_SQL})",
]))(lambda spark, sf: (lambda t: charts.overview(t, catalog.columns(spark), _issues(spark), t.agg(F.sum("row_count").alias("n_rows"), F.count("*").alias("n_tables"))))(_tables(spark, sf)))
query("rowcount_statistics", f"SELECT round(avg(row_count), 4) AS mean, CAST(median(row_count) AS DOUBLE) AS median, round(stddev_pop(row_count), 4) AS std, min(row_count) AS smallest, max(row_count) AS largest FROM ({COUNTS_SQL})")(lambda spark, sf: charts.row_statistics(_tables(spark, sf)))


# --- questions -------------------------------------------------------------------------------------------------------


def _ask(question: str, names: tuple[str, ...] = tuple(SCHEMAS)):
    def run(spark, sf):
        if set(names) <= set(SCHEMAS):
            schema = nlq.Schema.of(column_rows(), EDGES)
            tables = load_all(spark, sf)
        else:
            tables = {n: load(spark, sf, n) for n in names}
            schema = nlq.Schema.of(column_rows({n: df.dtypes for n, df in tables.items()}, foreign=[]), [])
        _, df = nlq.ask(question, schema, tables)
        return df.select(*[F.round(F.col(f"`{c}`"), 2).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])

    return run


_OC = "orders JOIN customer ON o_custkey = c_custkey"
NL = {
    "nl_count": ("How many orders?", "SELECT count(*) AS total_count FROM orders"),
    "nl_count_by_year": ("How many orders per year?", "SELECT strftime(o_orderdate, '%Y') AS year, count(*) AS count FROM orders GROUP BY 1"),
    "nl_count_by_month": ("How many orders per month?", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders GROUP BY 1"),
    "nl_count_by_week": ("How many orders per week?", "SELECT strftime(o_orderdate, '%Y-%W') AS week, count(*) AS count FROM orders GROUP BY 1"),
    "nl_count_by_day": ("How many orders per day?", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS count FROM orders GROUP BY 1"),
    "nl_count_by_group": ("How many customers by mktsegment?", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1"),
    "nl_avg": ("Average order price", "SELECT round(avg(o_totalprice), 2) AS avg_o_totalprice FROM orders"),
    "nl_sum": ("Total order price", "SELECT round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders"),
    "nl_max": ("Highest order price", "SELECT round(max(o_totalprice), 2) AS max_o_totalprice FROM orders"),
    "nl_min": ("Lowest order price", "SELECT round(min(o_totalprice), 2) AS min_o_totalprice FROM orders"),
    "nl_sum_by_group": ("Total order price by priority", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders GROUP BY 1"),
    "nl_avg_by_group": ("Average order price by status", "SELECT o_orderstatus, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM orders GROUP BY 1"),
    "nl_filter_gt": ("How many orders with price over 300000?", "SELECT count(*) AS total_count FROM orders WHERE o_totalprice > 300000"),
    "nl_filter_lt": ("How many orders with price under 5000?", "SELECT count(*) AS total_count FROM orders WHERE o_totalprice < 5000"),
    "nl_filter_ge": ("How many orders with price at least 100000?", "SELECT count(*) AS total_count FROM orders WHERE o_totalprice >= 100000"),
    "nl_filter_le": ("How many orders with price at most 100000?", "SELECT count(*) AS total_count FROM orders WHERE o_totalprice <= 100000"),
    "nl_filter_eq": ("How many lineitems with quantity exactly 10?", "SELECT count(*) AS total_count FROM lineitem WHERE l_quantity = 10"),
    "nl_filter_ne": ("How many lineitems with quantity not equal to 10?", "SELECT count(*) AS total_count FROM lineitem WHERE l_quantity <> 10"),
    "nl_filter_like": ("How many parts named anvil?", "SELECT count(*) AS total_count FROM part WHERE lower(p_name) LIKE '%anvil%'"),
    "nl_filter_conjunction": ("How many orders with price over 100000 and at most 200000?", "SELECT count(*) AS total_count FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000"),
    "nl_list_default": ("Show regions", "SELECT * FROM region"),
    "nl_list_columns": ("Show name of nations", "SELECT n_name FROM nation"),
    "nl_top_n": ("Show top 10 orders by price", "SELECT round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY orders.o_totalprice DESC LIMIT 10"),
    "nl_trend_month": ("Show monthly order price trend", "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS total_o_totalprice, count(*) AS record_count FROM orders GROUP BY 1"),
    "nl_trend_week": ("Show weekly order price trend", "SELECT strftime(o_orderdate, '%Y-%W') AS week, round(sum(o_totalprice), 2) AS total_o_totalprice, count(*) AS record_count FROM orders GROUP BY 1"),
    "nl_sum_by_joined_group": ("Total order price per mktsegment of customer", f"SELECT c_mktsegment, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM {_OC} GROUP BY 1"),
    "nl_cross_table_agg": ("Average order price per mktsegment of customer", f"SELECT c_mktsegment, round(avg(o_totalprice), 2) AS avg_o_totalprice FROM {_OC} GROUP BY 1"),
    "nl_cross_table_filter": ("How many customers with order price over 300000?", f"SELECT count(*) AS total_count FROM {_OC} WHERE o_totalprice > 300000"),
    "nl_join_one_hop": ("How many orders of customers by mktsegment?", f"SELECT c_mktsegment, count(*) AS count FROM {_OC} GROUP BY 1"),
    "nl_count_in_year": ("How many orders in 1997?", "SELECT count(*) AS total_count FROM orders WHERE year(o_orderdate) = 1997"),
    "nl_sum_in_year": ("Total order price in 1998", "SELECT round(sum(o_totalprice), 2) AS sum_o_totalprice FROM orders WHERE year(o_orderdate) = 1998"),
    "nl_months_of_year": ("How many orders per month in 1996?", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS count FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1"),
    "nl_compare_years": ("Compare orders between 1996 and 1999", "SELECT CAST(count(*) FILTER (year(o_orderdate) = 1996) AS BIGINT) AS count_1996, CAST(count(*) FILTER (year(o_orderdate) = 1999) AS BIGINT) AS count_1999, CAST(count(*) FILTER (year(o_orderdate) = 1999) - count(*) FILTER (year(o_orderdate) = 1996) AS BIGINT) AS difference FROM orders"),
    "nl_compare_totals": ("Compare the total price of orders in 1996 versus 1997", "SELECT round(sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 2) AS total_o_totalprice_1996, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1997), 2) AS total_o_totalprice_1997, round(sum(o_totalprice) FILTER (year(o_orderdate) = 1997) - sum(o_totalprice) FILTER (year(o_orderdate) = 1996), 2) AS difference FROM orders"),
    "nl_compare_groups": ("Compare customers of one mktsegment with another", "SELECT c_mktsegment, count(*) AS count FROM customer GROUP BY 1"),
    "nl_filter_only": ("Orders with price over 499990", "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_totalprice > 499990"),
    "nl_join_two_hop": ("Total order price per name of nation", f"SELECT n_name, round(sum(o_totalprice), 2) AS sum_o_totalprice FROM {_OC} JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
}
for _name, (_q, _sql) in NL.items():
    query(_name, _sql)(_ask(_q))
query("nl_join_shared_column", "SELECT quality, count(*) AS count FROM documents JOIN labels USING (doc_id) GROUP BY 1")(_ask("How many labels by quality of documents?", ("documents", "labels")))


def _plan_rows(spark, rows):
    return spark.createDataFrame(rows, "question string, intent string, tables string, measure string, grouping string, period string, filters string, limited int, joins int, confidence double, warned boolean")


#: Questions and their plans: intent, tables, measure, group, period, filters, limit, joins, confidence, whether it warns.
PLANS = [
    ("How many orders?", "count", "orders", None, None, None, "", None, 0, 0.8, False),
    ("kitne customers", "count", "customer", None, None, None, "", None, 0, 0.8, False),
    ("Show top 10 orders by price", "list", "orders", "o_totalprice", None, None, "", 10, 0, 0.75, False),
    ("Show regions", "list", "region", None, None, None, "", 25, 0, 0.6, True),
    ("Total order price per name of nation", "sum", "orders,nation", "o_totalprice", "n_name", None, "", None, 2, 0.95, False),
    ("How many orders with price over 100000 and at most 200000?", "count", "orders", None, None, None, "o_totalprice <= 200000,o_totalprice > 100000", None, 0, 0.8, False),
    ("How many parts named anvil?", "count", "part", None, None, None, "p_name like anvil", None, 0, 0.8, False),
    ("Show monthly order price trend", "list", "orders", "o_totalprice", None, "month", "", None, 0, 0.75, False),
    ("what is this", "list", "customer", None, None, None, "", 25, 0, 0.6, True),
]


@query("nl_plans", f"SELECT * FROM {values_sql(PLANS, 'question, intent, tables, measure, grouping, period, filters, limited, joins, confidence, warned')}".replace("0.6, ", "CAST(0.6 AS DOUBLE), ", 1))
def nl_plans(spark, sf):
    schema, rows = nlq.Schema.of(sorted(column_rows(), key=lambda r: (r[0], r[1])), EDGES), []
    for question, *_ in PLANS:
        p = nlq.plan(question, schema)
        filters = ",".join(sorted(f"{c.name} {op} {v:g}" if isinstance(v, float) and v < 1e5 else f"{c.name} {op} {v:.0f}" if isinstance(v, float) else f"{c.name} {op} {v}" for c, op, v in p.filters))
        rows.append((question, p.intent, ",".join(p.tables), p.measure and p.measure.name, p.group and p.group.name, p.period, filters, p.limit, len(p.joins), round(p.confidence, 2), bool(p.warnings)))
    return _plan_rows(spark, rows)


# --- SQL sandbox -----------------------------------------------------------------------------------------------------


def _sql(text: str, cap: int | None = None):
    def run(spark, sf):
        sandbox.register(load_all(spark, sf))
        return sandbox.guarded(spark, text, cap) if cap else spark.sql(sandbox.dialect(text))

    return run


SAME = {
    "sql_predicates": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'ok' END AS state FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal BETWEEN -500 AND 5000 AND c_name LIKE '%1%' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "sql_left_join": "SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    "sql_semi_join": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "sql_theta_join": "SELECT a.n_name AS a_name, b.r_name AS b_name FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey",
    "sql_having": "SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) + grouping(l_linestatus) AS lvl FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "sql_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "sql_window_rank": "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rnk, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quart FROM orders",
    "sql_window_lag": "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nxt FROM orders",
    "sql_window_running_sum": "SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM orders",
    "sql_union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "sql_intersect": "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events",
    "sql_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "sql_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "sql_window_percent": "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS cd FROM orders",
    "sql_window_values": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "sql_window_range": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS near FROM orders",
    "sql_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS square FROM t",
    "sql_range_join": "SELECT r.r_name, count(*) AS n FROM region r JOIN nation n ON n.n_nationkey BETWEEN r.r_regionkey * 5 AND r.r_regionkey * 5 + 4 GROUP BY r.r_name",
    "sql_interval_join": "SELECT count(*) AS n FROM orders o JOIN events e ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate AND e.ts < o.o_orderdate + INTERVAL 3650 DAY",
    "sql_anti_join": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "sql_full_join": "SELECT n_name, r_name FROM nation FULL OUTER JOIN region ON n_regionkey = r_regionkey AND n_nationkey > 20",
    "sql_cte": "WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), top AS (SELECT max(n) AS n FROM big) SELECT big.o_custkey, big.n FROM big JOIN top ON big.n = top.n",
    "sql_scalar_functions": "SELECT c_custkey, substr(c_name, 1, 8) AS s, instr(c_name, '#') AS i, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, abs(c_nationkey - 12) AS d, upper(c_mktsegment) AS u, length(c_name) AS len, replace(c_name, '#', '-') AS r FROM customer",
}
for _name, _text in SAME.items():
    ORACLES[_name] = _text.replace("sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)")
    QUERIES[_name] = _sql(_text)
query("sql_array_functions", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderstatus))), ',') AS kinds, len(list(o_orderkey)) AS n, list_max(list(o_orderkey)) AS most, list_contains(list(o_orderstatus), 'F') AS has_f FROM orders GROUP BY 1")(
    _sql("SELECT o_custkey, array_join(array_sort(array_distinct(collect_list(o_orderstatus))), ',') AS kinds, CAST(size(collect_list(o_orderkey)) AS BIGINT) AS n, array_max(collect_list(o_orderkey)) AS most, array_contains(collect_list(o_orderstatus), 'F') AS has_f FROM orders GROUP BY 1")
)
query("sql_as_of_join", "SELECT o_orderkey, e.event_id FROM orders o ASOF JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts")(
    _sql("SELECT o_orderkey, max_by(e.event_id, e.ts) AS event_id FROM orders o JOIN (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY 1, 2) e ON o.o_custkey = e.user_id AND o.o_orderdate >= e.ts GROUP BY o_orderkey")
)
query("sql_json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")(_sql("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events"))
query("sql_sandbox_select", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")(_sql("SELECT [n_name], r_name FROM nation JOIN region ON n_regionkey = r_regionkey;", sandbox.ROW_CAP))
query("sql_sandbox_cap", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 500")(_sql("SELECT o_orderkey FROM orders ORDER BY o_orderkey", sandbox.ROW_CAP))
_GUARD = [("SELECT replace(n_name, 'A', 'b') FROM nation", True), ("SELECT 'DROP TABLE x; --' AS t", True), ("WITH a AS (SELECT 1 AS x) SELECT * FROM a", True), ("DROP TABLE nation", False), ("SELECT 1; SELECT 2", False), ("INSERT INTO nation SELECT * FROM nation", False), ("CREATE TABLE z (a INT)", False), ("SET a = 1", False), ("not sql", False),
    ("WITH a AS (SELECT 7 AS x) INSERT INTO t SELECT * FROM a", False), ("WITH a AS (SELECT 7 AS x) DELETE FROM t WHERE x IN (SELECT x FROM a)", False), ("FROM nation INSERT INTO a SELECT * INSERT INTO b SELECT *", False),
    ("SELECT * FROM text.`/etc/hostname`", False), ("WITH a AS (SELECT * FROM parquet.`/x`) SELECT * FROM a", False), ("SELECT n_name FROM nation WHERE n_name IN (SELECT value FROM text.`/x`)", False), ("SELECT * FROM unregistered", False),
    ("SELECT java_method('java.util.UUID', 'randomUUID')", False), ("SELECT reflect('java.util.UUID', 'randomUUID')", False), ("SELECT (SELECT try_reflect('java.util.UUID', 'randomUUID'))", False), ("SELECT * FROM read_files('/x')", False),
    ("SELECT TRANSFORM(n_name) USING 'cat' FROM nation", False), ("EXPLAIN SELECT 1", False), ("CACHE TABLE nation", False), ("SELECT * FROM nation VERSION AS OF 1", False), ("SELECT * FROM b, (WITH b AS (SELECT 1) SELECT * FROM b)", False),
    ("WITH a AS (WITH b AS (SELECT n_name FROM nation) SELECT * FROM b) SELECT * FROM a", True), ("SELECT n_name FROM nation n WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey = n.n_regionkey)", True), ("SELECT * FROM range(3)", True),
    ("SELECT x FROM nation LATERAL VIEW explode(array(1, 2)) t AS x", True),
]
query("sql_guard", f"SELECT * FROM {values_sql(_GUARD, 'statement, allowed')}")(lambda spark, sf: (sandbox.register(load_all(spark, sf)), spark.createDataFrame([(s, sandbox.reason_against(spark, s) is None) for s, _ in _GUARD], "statement string, allowed boolean"))[1])
query("sample_query_join", f"SELECT o_orderkey, c_name FROM {_OC} ORDER BY o_orderkey LIMIT 100")(lambda spark, sf: load(spark, sf, "orders").join(load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name").orderBy("o_orderkey").limit(100))
query("sample_query_aggregate", "SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 2) AS average FROM orders GROUP BY 1")(lambda spark, sf: load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("average")))
query("sample_query_daily_trend", "SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 30")(lambda spark, sf: load(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("day")).limit(30))
query("sample_query_metric_summary", "SELECT count(o_totalprice) AS n, round(avg(o_totalprice), 2) AS average, round(sum(o_totalprice), 2) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")(
    lambda spark, sf: load(spark, sf, "orders").agg(F.count("o_totalprice").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("average"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))
)


query("demo_shops", "SELECT * FROM (VALUES ('a', 9, 100, 200, 0), ('b', 9, 500, 1000, 0)) AS t(shop, tables, customers, orders, orphan_items)")(
    lambda spark, sf: spark.createDataFrame([(k, len(t), t[p + "customers"].count(), t[p + "orders"].count(), t[p + "order_items"].join(t[p + "orders"], "order_id", "left_anti").count()) for k, p, t in (("a", "", demo.shop(spark, "a")), ("b", "shop_", demo.shop(spark, "b")))], "shop string, tables int, customers int, orders int, orphan_items int")
)


# --- extensions ------------------------------------------------------------------------------------------------------

query("extension_tumbling_windows", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")(lambda spark, sf: windows.tumbling(load(spark, sf, "events")))
query("extension_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM g GROUP BY user_id, k")(lambda spark, sf: windows.sessions(load(spark, sf, "events")))
