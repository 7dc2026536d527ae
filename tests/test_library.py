"""Rules, planner, sandbox, readers, registry and engine; queries against DuckDB on the smallest data."""

import json
import re
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tests.oracle import compare, connect
from veldspar import queries
from veldspar.engine import Engine
from veldspar.functions import text
from veldspar.operators import charts, docs, identity, profile, quality, relations, retrieval, semantics
from veldspar.plans import catalog, nlq, sandbox
from veldspar import config, scratch
from veldspar.__main__ import main
from veldspar.sources import demo, readers
from veldspar.sources.registry import Registry
from veldspar.streaming import windows

SLOW = {n for n in queries.ORACLES if n.startswith("profile_columns_")} - {"profile_columns_orders", "profile_columns_events"}


def test_queries_equal_duckdb(spark, sf_dir):
    db = connect(sf_dir)
    wrong = {}
    for name in sorted(set(queries.ORACLES) - SLOW):
        if said := compare(spark, db, name, queries.QUERIES[name], queries.ORACLES[name], sf_dir):
            wrong[name] = said[:300]
    assert not wrong


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["o_orderpriority", "sum_o_totalprice"] and got.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_sampled_and_approximate_profiles(spark, sf_dir):
    """The two queries that SQL can't express, against exact profiles."""
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"sampled_profile", "profile_approximate"}
    orders = catalog.load(spark, sf_dir, "orders")
    exact = {r.column_name: r for r in profile.profile(orders.select("o_orderkey", "o_totalprice")).collect()}
    got = {r.column_name: r for r in queries.QUERIES["sampled_profile"](spark, sf_dir).collect()}
    assert {k: r.total_count for k, r in got.items()} == {k: r.total_count for k, r in exact.items()}, "fewer rows than the sample are all profiled"
    few = profile.sampled(orders, 300)
    assert 200 < few.count() < 400 and few.count() == profile.sampled(orders, 300).count()
    lines = catalog.load(spark, sf_dir, "lineitem")
    exact = {r.column_name: r for r in profile.profile(lines.select("l_orderkey", "l_shipdate", "l_returnflag")).collect()}
    about = {r.column_name: r for r in queries.QUERIES["profile_approximate"](spark, sf_dir).collect()}
    for c, r in exact.items():
        assert (about[c].total_count, about[c].null_count) == (r.total_count, r.null_count) and abs(about[c].distinct_count - r.distinct_count) <= max(1, 0.1 * r.distinct_count)


@pytest.mark.parametrize(
    "name,kind,web,cli",
    [("l_discount", "double", "quantity", "metric"), ("o_orderkey", "bigint", "unknown", "unknown"), ("user_id", "bigint", "identifier", "identifier"), ("duration", "string", "percentage", "unknown"), ("l_shipdate", "timestamp_ntz", "date", "timestamp")],
)
def test_semantic_rules(spark, name, kind, web, cli):
    got = spark.createDataFrame([("t", 0, name, kind, catalog.display_type(kind), False, False)], catalog.COLUMN_DDL)
    row = semantics.describe(got).first()
    assert row.web_type == web
    assert row.cli_type == cli


SCHEMA = nlq.Schema.of(catalog.column_rows(), queries.EDGES)


def test_planner():
    p = nlq.plan("Show top 10 orders by price", SCHEMA)
    assert (p.intent, p.limit, p.measure.name, p.tables) == ("list", 10, "o_totalprice", ["orders"])
    assert [op for _, op, _ in nlq.plan("How many orders with price >= 5", SCHEMA).filters] == [">="]
    assert nlq.plan("How many orders with price != 5", SCHEMA).filters[0][1] == "!="
    assert nlq.plan("kitne customers", SCHEMA).intent == "count"
    p = nlq.plan("Total order price per name of nation", SCHEMA)
    assert len(p.joins) == 2 and p.confidence == 0.95 and "orders" in p.explanation and "n_name" in p.explanation
    p = nlq.plan("Compare orders between 1996 and 1997", SCHEMA)
    assert p.intent == "compare" and p.years == [1996, 1997] and not p.filters and "1996 against 1997" in p.explanation
    assert nlq.plan("How many nations in 1996?", SCHEMA).warnings and nlq.plan("How many orders in 1996", SCHEMA).years == [1996]
    assert nlq.plan("Average revenue of nations", SCHEMA).measure.semantic == "amount", "a table with amounts joins in"
    described = nlq.Schema.of(column_rows := catalog.column_rows(), queries.EDGES, {"part": "things that are sold in shops"})
    assert column_rows and nlq.bind_tables("what is sold in shops", described) == ["part"]
    p = nlq.plan("what is this", SCHEMA)
    assert p.confidence < 0.75 and p.warnings
    two = nlq.Schema.of(catalog.column_rows({"a_x": [("k", "int")], "b_y": [("v", "string")]}, {}, []), [])
    assert any("No join" in w for w in nlq.plan("average k of a_x per v of b_y", two).warnings)


def test_condition_without_a_verb_has_all_rows(spark):
    orders = spark.range(100).select(F.col("id").alias("o_orderkey"), F.col("id").cast("double").alias("o_totalprice"))
    p, got = nlq.ask("Orders with price over 59", SCHEMA, {"orders": orders})
    assert got.count() == 40 and p.limit is None and not p.warnings
    assert nlq.ask("Orders with price over 59, first 7", SCHEMA, {"orders": orders})[1].count() == 7
    p, got = nlq.ask("Show orders with price over 59", SCHEMA, {"orders": orders})
    assert got.count() == p.limit == nlq.DEFAULT_LIMIT and p.warnings, "a list has a limit, and says so"


def test_sandbox(spark, sf_dir):
    sandbox.register(catalog.load_all(spark, sf_dir))
    got = sandbox.execute(spark, "SELECT * FROM lineitem")
    assert got.success and got.row_count == 500
    assert not sandbox.execute(spark, "DELETE FROM lineitem").success
    assert not sandbox.execute(spark, "SELECT nothing FROM nation").success
    slow = sandbox.execute(spark, "SELECT sum(id % 7) FROM range(20000000000)", timeout_s=0.5)
    assert not slow.success
    target = str(scratch.scratch_path(spark, "guard"))
    spark.sql(f"CREATE TABLE IF NOT EXISTS guarded_t (x INT) USING parquet LOCATION '{target}'")
    spark.sql("INSERT INTO guarded_t VALUES (1)")
    for text in ("WITH a AS (SELECT 7 AS x) INSERT INTO guarded_t SELECT * FROM a", "FROM nation INSERT INTO guarded_t SELECT n_nationkey INSERT INTO guarded_t SELECT 2", "DELETE FROM guarded_t", "TRUNCATE TABLE guarded_t", "SELECT * FROM guarded_t", f"SELECT * FROM parquet.`{target}`", "SELECT java_method('java.lang.System', 'lineSeparator')"):
        assert not sandbox.execute(spark, text).success, text
    assert [r.x for r in spark.table("guarded_t").collect()] == [1], "nothing was written"
    spark.sql("DROP TABLE guarded_t")
    assert sandbox.dialect("SELECT [a], '[b]', x[1] FROM t;") == "SELECT `a`, '[b]', x[1] FROM t"


def test_readers(spark, tmp_path):
    (tmp_path / "people.csv").write_bytes("id,name,amount\n1,José,2.5\n2,,\n".encode("latin-1"))
    rows = readers.read(spark, str(tmp_path / "people.csv"))["people"].orderBy("id").collect()
    assert rows[0].name == "José" and rows[1].name is None and rows[0].amount == 2.5
    (tmp_path / "t.txt").write_text("a\tb\n1\t2\n")
    assert readers.read(spark, str(tmp_path / "t.txt"))["t"].columns == ["a", "b"]
    (tmp_path / "multi.json").write_text(json.dumps({"a": [{"x": 1}], "b": [{"y": 2}, {"y": 3}], "m": 3, "e": []}))
    got = readers.read(spark, str(tmp_path / "multi.json"))
    assert sorted(got) == ["a", "b"] and got["b"].count() == 2
    (tmp_path / "array.json").write_text(json.dumps([{"x": 1, "z": 2}, {"x": 2}]))
    assert readers.read(spark, str(tmp_path / "array.json"))["array"].filter("z is null").count() == 1
    with sqlite3.connect(tmp_path / "d.db") as db:
        db.execute("create table t (a integer, b text)")
        db.executemany("insert into t values (?, ?)", [(1, "x"), (None, None)])
    assert readers.read(spark, str(tmp_path / "d.db"))["t"].filter("a is null").count() == 1
    assert readers.file_type("x.SQL") == "unknown" and readers.jdbc_url("mysql", "h", 3306, "d") == "jdbc:mysql://h:3306/d"
    with pytest.raises(ValueError):
        readers.jdbc_url("oracle", "h", 1, "d")
    assert readers.health(spark) and readers.server_info(spark)["version"] == spark.version
    with sqlite3.connect(tmp_path / "big.db") as db:
        db.execute("create table n (k integer primary key, v real, w text)")
        db.executemany("insert into n values (?, ?, ?)", [(3 * i, i / 2 if i % 7 else "odd", None if i % 5 else f"x{i}") for i in range(1000)])
        db.execute("create table p (k text primary key, v integer) without rowid")
        db.execute("insert into p values ('a', 1)")
        db.execute("create table empty (k integer)")
    got = readers.read_sqlite(spark, str(tmp_path / "big.db"), rows=100)
    assert got["n"].count() == 1000 and got["n"].filter("v is null").count() == len(range(0, 1000, 7)) and got["n"].agg(F.sum("k")).first()[0] == 3 * 499_500 and got["n"].rdd.getNumPartitions() > 4
    assert got["p"].collect()[0].k == "a" and got["empty"].count() == 0
    assert [len(c) for c in readers.chunks(spark.range(25), 10)] == [10, 10, 5]


def test_excel(spark, tmp_path):
    cell = lambda r, v: f'<c r="{r}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{r}"><v>{v}</v></c>'
    sheet = lambda rows: '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join("<row>" + "".join(cell("ABCD"[c] + str(k), v) for c, v in enumerate(r) if v is not None) + "</row>" for k, r in enumerate(rows, 1)) + "</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="My Sheet" r:id="r1"/><sheet name="none" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", sheet([("id", "name", "price", "mix"), (1, "a", 1.5, 7), (2, None, 2, "x"), (3, "c", None, None)]))
        z.writestr("xl/worksheets/s2.xml", sheet([("id",)]))
    got = readers.read(spark, str(tmp_path / "b.xlsx"))
    assert list(got) == ["My_Sheet"] and dict(got["My_Sheet"].dtypes) == {"id": "bigint", "name": "string", "price": "double", "mix": "string"}
    assert [tuple(r) for r in got["My_Sheet"].orderBy("id").collect()] == [(1, "a", 1.5, "7"), (2, None, 2.0, "x"), (3, "c", None, None)]
    (tmp_path / "old.xls").write_bytes(b"x")
    with pytest.raises(ValueError):
        readers.read(spark, str(tmp_path / "old.xls"))


def test_upload_limits(tmp_path):
    (tmp_path / "a.exe").write_text("x")
    (tmp_path / "a.csv").write_text("a\n" * 600_000)
    with pytest.raises(ValueError, match="type"):
        readers.check_upload(str(tmp_path / "a.exe"))
    with pytest.raises(ValueError, match="MB"):
        readers.check_upload(str(tmp_path / "a.csv"), most_mb=1)
    readers.check_upload(str(tmp_path / "a.csv"))


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("database:\n  type: sqlite\n  path: x.db\n  password: secret\nllm:\n  model: m\nverbose: true\nprofiling:\n  sample_rows: 1\n")
    got = config.from_yaml(str(tmp_path / "c.yaml"))
    assert (got.database.path, got.llm.model, got.verbose, got.profiling.sample_rows) == ("x.db", "m", True, 10_000)
    assert got.as_dict()["database"]["password"] == "***" and config.from_dict(None).database.type == "sqlite"
    with pytest.raises(ValueError):
        config.from_dict({"database": {"type": "oracle"}})


def test_demo_shops(spark):
    a, b = demo.shop(spark, "a"), demo.shop(spark, "b")
    assert len(a) == len(b) == 9 and a["order_items"].join(a["products"], "product_id", "left_anti").count() == 0
    assert a["orders"].exceptAll(demo.shop(spark, "a")["orders"]).count() == 0 and a["orders"].exceptAll(demo.shop(spark, "a", seed=1)["orders"]).count() == 200
    assert b["shop_orders"].filter("order_delivered_customer_date is null").count() > 100 and b["shop_order_reviews"].filter("review_comment_message is null").count() > 100
    assert b["shop_orders"].filter("order_delivered_customer_date < order_delivered_carrier_date or order_approved_at < order_purchase_timestamp").count() == 0


def test_scratch_folder(spark, monkeypatch):
    assert scratch.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})()
        sparkContext = type("S", (), {"master": "local-cluster[2,1,1024]", "applicationId": "far"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_root(Far())
    Far.sparkContext.master = "local[2]"
    assert scratch.scratch_root(Far()) == scratch.scratch_root(Far())
    mark = scratch.tables_made()
    kept = [scratch.materialize(spark.range(k), "t") for k in (3, 4)]
    assert scratch.release(spark, mark, spare_last=1) == 1 and kept[1].count() == 4
    assert scratch.bytes_of(spark.createDataFrame([("a" * 1000, [1, 2])], "s string, a array<int>")) > 1000


def test_registry(tmp_path):
    r = Registry(tmp_path)
    assert r.put("A", "h1") == ("A", True) and r.put("A", "h1") == ("A", False) and r.put("A", "h2") == ("AV2", True)
    r.store("A", "analysis", {"x": 1})
    r.store("A", "manual", "# m")
    assert Registry(tmp_path).fetch("A", "analysis") == {"x": 1} and r.fetch("A", "manual") == "# m" and r.manifest("A") == ["analysis.json", "manual.md"]
    assert r.by_hash("h2") == "AV2" and r.put("B", "0123456789abcdef") and r.by_hash("01234567") == "B" and r.by_hash("0123") is None and r.delete("B")
    r.count_hit("A")
    assert r.stats()["hits"] == 1 and r.stats()["accesses"] == 1 and r.get("A")["hits"] == 1
    (tmp_path / "outputs" / "LOST").mkdir()
    assert r.drop_orphans() == ["LOST"]
    assert r.delete("A") and not r.delete("A") and r.list() == ["AV2"] and r.drop_orphans() == []
    (tmp_path / "index.json").write_text("{broken")
    assert Registry(tmp_path).list() == [] and (tmp_path / "index.bak").exists()


def test_fingerprint_equals_its_sql_at_any_number_of_rows(spark, tmp_path):
    many = spark.range(4096 * 256 + 1).select(F.col("id").cast("string").alias("v"))
    some = many.filter("v < 5000")
    for df in (many, some.unionAll(some)):
        path = tmp_path / str(len(list(tmp_path.iterdir())))
        df.write.parquet(str(path))
        sql = identity.FINGERPRINT_SQL.format(rows=f"SELECT sha256(v) AS h FROM '{path}/*.parquet'", names="v")
        assert tuple(identity.fingerprint(df).first()) == connect("").execute(sql).fetchone()


def test_fingerprint_ignores_order_and_sees_cells(spark):
    rows = [(1, "a", 1.5), (2, None, float("nan")), (3, "", 2.0), (3, "", 2.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    one = identity.fingerprint(df).first()
    assert identity.fingerprint(df.orderBy(F.desc("a")).select("c", "b", "a")).first() == one
    assert identity.fingerprint(df.withColumn("a", F.col("a") + F.when(F.col("a") == 2, 7).otherwise(0))).first() != one
    assert identity.fingerprint(df.dropDuplicates()).first() != one and identity.fingerprint(df.limit(0)).count() == 1
    many = spark.range(3000).select(F.col("id").cast("string").alias("v"))
    assert identity.prefix_digits(4096 * 256) == 2 and identity.prefix_digits(4096 * 256 + 1) == 4
    deep = identity.fingerprint(many, most=1).first()
    assert deep == identity.fingerprint(many.orderBy(F.rand(1)), most=1).first() != identity.fingerprint(many.filter("v <> '7'"), most=1).first() and deep.row_count == 3000
    assert identity.next_hash("a", "b") == identity.next_hash("a", "b") != identity.next_hash("b", "a")
    assert identity.detect_year(many, ["v"], filename="sales_2019.csv").first().year == "2019"
    assert identity.source_of("data_netflix_2020.csv") == "NETFLIX" and identity.semantic_id("x.csv", {}, "abcd") == "DATASETDATAABCD"


def test_profile_counts_add_up(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", None), ("a", 2.0)], "k string, v double")
    got = {r.column_name: r for r in profile.profile(df).collect()}
    assert (got["k"].null_count, got["k"].distinct_count, got["v"].avg_value) == (1, 1, 1.5)
    assert (got["k"].min_text, got["k"].max_text, got["v"].min_text, got["v"].max_value) == ("a", "a", None, 2.0)
    assert profile.profile(df.limit(0)).filter("total_count = 0").count() == 2
    assert not profile.columnar(df).filter("k is null").isEmpty() and profile.columnar(df).inputFiles() and profile.profile(df, stage=True).count() == 2


def test_quality_and_graph(spark):
    none = spark.createDataFrame([], "table_name string, column_name string, issue_type string, severity string")
    assert quality.score_web(none).first().score == 100
    assert relations.load_order([("a", "b"), ("b", "c")], ["a", "b", "c"]) == ["c", "b", "a"]
    assert "erDiagram" in docs.mermaid([("t", "c", "INTEGER", True, False)], [])


CORPUS = [(1, "Orders have prices. Orders have dates.", ["orders"], 1.0), (2, "Customers place orders.", ["customers", "orders"], 1.0), (3, "Nothing here", [], 2.0), (4, "Prices of parts", ["parts"], 3.0), (5, None, None, None)]


def corpus_of(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, content string, keywords array<string>, importance double")


def test_retrieval(spark):
    index = retrieval.build(corpus_of(spark))
    got = {s: retrieval.search(index, "orders prices", 10, s) for s in retrieval.STRATEGIES}
    assert got["semantic"] == got["tfidf"] and {i for i, _ in got["bm25"]} == {1, 2, 4} and got["keyword"][0] == (4, 1.5) and got["hybrid"][0][0] in (1, 4)
    plain = {i: s for i, s in retrieval.search(retrieval.build(corpus_of(spark).drop("importance")), "orders prices", 10, "bm25")}
    assert dict(got["bm25"])[4] == pytest.approx(3 * plain[4]) and dict(got["bm25"])[1] == pytest.approx(plain[1])
    assert retrieval.search(index, "unheard xyzzy", 5) == [] and retrieval.search(retrieval.build(corpus_of(spark).limit(0)), "orders") == []
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [0.02, 1.0])], "doc_id long, embedding array<double>")
    near = retrieval.search(retrieval.build(corpus_of(spark), vectors=vectors), "x", 5, "semantic", spark.createDataFrame([([1.0, 0.0],)], "q array<double>"))
    assert near == [(1, 1.0)], "below a cosine of .1 nothing is near"
    with pytest.raises(ValueError):
        retrieval.search(index, "x", 5, "magic")
    assert retrieval.answer_intent("Which columns are nullable?") == "column_info" and retrieval.answer_intent("hello") == "general"
    said = retrieval.answer("show me a query", [("a", "stat"), ("a", "stat"), ("Sample query: t. SQL: SELECT 1", "query")])
    assert said.startswith("a\n") and said.count("a\n") == 1 and "SELECT 1" in said.split("```sql")[1] and retrieval.answer("x", []).startswith("Nothing")
    assert retrieval.confidence_of([0.5, 0.25]) == round(0.4 * 0.5 + 0.3 * 0.375 + 0.3 * 0.4, 3) and retrieval.confidence_of([]) == 0.0


def test_engine(spark, sf_dir, tmp_path):
    engine = Engine(spark, str(tmp_path / "registry"))
    engine.add({t: catalog.load(spark, sf_dir, t) for t in ("region", "nation")}, catalog.PRIMARY_KEYS, [("nation", "n_regionkey", "region", "r_regionkey")])
    first = engine.analyze("demo_nations_2021.csv")
    name = first["id"]
    assert first["counts"] == {"nation": 25, "region": 5} and ("nation", "n_regionkey", "region", "r_regionkey") in first["edges"] and "2021" in name
    sections = re.findall(r"^## (.*)", first["manual"], re.M)
    assert sections == ["Contents", "Executive summary", "Overview", "Entities", "Relationships", "Data quality", "Use cases", "Sample queries", "Warnings", "Improvements", "Appendix"] and "Report by place." in first["manual"]
    assert engine.analyze("demo_nations_2021.csv")["id"] == name and engine.info(name)["hits"] == 1 and engine.info(name)["accesses"] == 1
    assert engine.ask("How many nations?")[1].first()[0] == 25 and engine.sql("SELECT 1 AS x").rows == [[1]]
    found = engine.search("Which column of nation is a foreign key?", strategy="bm25")
    assert found["results"] and found["intent"] == "column_info" and found["chunks_searched"] == len(engine.index()[1]) and re.fullmatch(r"[a-z]+_\d{4}", found["results"][0][0])
    assert set(engine.index_stats()["chunk_types"]) == {"db_overview", "table_overview", "column_detail", "relationship", "query", "cross_table", "stat"}
    assert "nation" in engine.er_diagram() and {e["dotted"] for e in engine.er_data()["edges"]} <= {True, False}
    made = engine.all_chart_data()
    assert len(made) == 21 and all(df.columns for df in made.values()) and made["table_size"].count() == 2 and made["quality_gauge"].count() == 1
    with pytest.raises(KeyError):
        engine.chart_data("pie")
    assert {"analysis.json", "schema.json", "insights.json", "stats.json", "manual.md", "chunks.json", "index_meta.json"} <= set(engine.info(name)["outputs"])
    assert first["insights"]["overview"]["rows"] == 30 and first["insights"]["relationships"]["declared"] == 1
    other = Engine(spark, str(tmp_path / "registry"))
    assert other.open(name) == ["nation", "region"] and other.preview("nation", 3).count() == 3 and other.verify(name)
    assert other.index(name)[1].keys() == engine.index()[1].keys() and other.manual(name) == engine.manual(name) and other.analysis(name)["id"] == name
    assert re.fullmatch(r".*/[\w.-]+\.md", other.export_manual(str(tmp_path), name)) and [d["id"] for d in other.datasets()] == [name]
    spark.range(1).write.mode("overwrite").parquet(other.registry.raw_tables(name)["region"])
    assert not other.verify(name) and other.stats()["datasets"] == 1 and other.delete(name) and other.datasets() == []
    with pytest.raises(KeyError):
        other.analysis(name)


def test_upload_and_command_line(spark, tmp_path, capsys):
    (tmp_path / "people.csv").write_text("id,name,city\n" + "".join(f"{k},n{k},c{k % 3}\n" for k in range(40)))
    engine = Engine(spark)
    a = engine.upload(str(tmp_path / "people.csv"))
    assert a["counts"] == {"people": 40} and engine.tables_list().first().row_count == 40
    assert main(["version"]) == 0 and main(["analyze", str(tmp_path / "people.csv"), "--output", str(tmp_path / "out")]) == 0
    assert main(["ask", str(tmp_path / "people.csv"), "How many people?"]) == 0 and main(["test-connection", str(tmp_path / "people.csv")]) == 0
    assert main(["analyze", str(tmp_path / "nothing.bin")]) == 1
    said = capsys.readouterr().out
    assert "people_csv.md" in said.replace("people.csv.md", "people_csv.md") and "40" in said and "1 tables: people" in said


def test_charts_of_few_tables(spark):
    tables = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "table_name string, row_count int")
    none = spark.createDataFrame([], catalog.EDGE_DDL)
    assert charts.network_nodes(tables, none).count() == 3


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    source = tmp_path / "in"
    events = catalog.load(spark, sf_dir, "events")
    events.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(events.schema).parquet(str(source))
    windows.profile_stream(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.schema("window_start timestamp, event_type string, n long, total double").parquet(str(tmp_path / "out"))
    assert got.count() <= windows.tumbling(events).count()
    batch, whole = windows.tumbling(events), spark.read.parquet(str(tmp_path / "out"))
    assert whole.schema["window_start"].dataType == batch.schema["window_start"].dataType
    closed = {tuple(r) for r in whole.collect()}
    every = {tuple(r) for r in batch.collect()}
    last = max(r[0] for r in every)
    assert closed and closed <= every
    assert {r for r in every if r[0] < last} <= closed  # only the newest window may still be open


def slow_mmr(scores, vectors, k):
    out = []
    like = lambda a, b: sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items())
    left = {i: s for i, s in scores.items() if s >= 0.01}
    while left and len(out) < k:
        best = max(left, key=lambda i: (round(0.7 * left[i] - 0.3 * max((like(i, j) for j, _ in out), default=0.0), 12), -i))
        out.append((best, left.pop(best)))
    return out


def test_mmr_ranks_all_candidates(spark):
    scores = {i: 1.0 for i in range(300)} | {300 + i: 0.9 - 0.01 * i for i in range(40)} | {400: 0.62, 401: 0.6, 402: 0.01, 403: 0.009}
    vectors = {i: {"a": 0.6, "b": 0.8} for i in range(300)} | {300 + i: {"a": 0.8, f"n{i % 3}": 0.6} for i in range(40)} | {400: {"c": 1.0}, 401: {"d": 1.0}, 402: {"e": 1.0}, 403: {"f": 1.0}}
    candidates = spark.createDataFrame(list(scores.items()), "doc_id long, score double")
    weights = spark.createDataFrame([(i, t, w) for i, v in vectors.items() for t, w in v.items()], "doc_id long, term string, weight double")
    got = retrieval.mmr(candidates, weights, 8)
    assert got == slow_mmr(scores, vectors, 8) and {0, 300, 400, 401} <= {i for i, _ in got}
    few = candidates.filter("doc_id > 399")
    assert retrieval.mmr(few, weights) == [(400, 0.62), (401, 0.6), (402, 0.01)] and retrieval.mmr(few.limit(0), weights) == []
    assert retrieval.mmr(few, weights.limit(0)) == [(400, 0.62), (401, 0.6), (402, 0.01)]


def test_keywords_of_whole_texts(spark):
    texts = ["“hello” she said—then the end—start…", "l'été caf\u00e9 caféteria naïve plain", "x9abc abc9 abc_def ab Ünder", "don’t “quoted”"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "doc_id long, content string")
    want = {(i, w) for i, t in enumerate(texts) for w in re.findall(r"\b[a-z_]{3,}\b", t.lower())}
    assert {tuple(r) for r in retrieval.keyword_index(retrieval.build(corpus)).collect()} == want and {(0, "hello"), (0, "start"), (1, "plain")} <= want


def test_keyword_queries_read_whole_texts(spark, tmp_path):
    from veldspar.queries import QUERIES

    spark.createDataFrame([(1, "“hello” world—again")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r.term for r in QUERIES["keyword_index"](spark, str(tmp_path)).collect()} == {"hello", "world", "again", "item", "kind_1"}


def test_vectors_without_length_and_numbers_without_bound(spark):
    pairs = spark.createDataFrame([(0, [0.0, 0.0], [1.0, 0.0]), (1, [3.0, 4.0], [3.0, 4.0]), (2, None, [1.0, 0.0])], "i int, a array<double>, b array<double>")
    assert [r.c for r in pairs.orderBy("i").select(text.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0, 0.0]
    numbers = [(1.5,), (float("inf"),), (float("-inf"),), (1e300,), (float("nan"),), (None,)]
    got = [r.t for r in spark.createDataFrame(numbers, "v double").select(text.canonical(F.col("v"), "double").alias("t")).collect()]
    assert got == ["1.500000", "Infinity", "-Infinity", "1.0E300", "__NAN__", "__NULL__"]
    assert identity.fingerprint(spark.createDataFrame(numbers, "v double")).first()["row_count"] == 6


def test_word_lists_are_evaluated_once(spark):
    one = spark.createDataFrame([("a b  c",), ("",), (None,), ("x",)], "t string")
    assert [r.t for r in one.select(text.terms(F.col("t")).alias("t")).collect()] == [["a", "b", "c", "a_b", "b_c"], [], None, ["x"]]
    many = spark.createDataFrame([(" ".join(f"w{i}" for i in range(20_000)),)], "t string").select(F.size(text.ngrams(F.split("t", " "))).alias("n"))
    assert many.first()["n"] == 20_000 + 19_999 + 19_998
