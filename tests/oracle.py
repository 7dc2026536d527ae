"""Run queries against their SQL on DuckDB: python -m tests.oracle SF_DIR [NAME...]."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def compare(spark, db, name: str, run, sql: str, sf_dir: str) -> str:
    """Empty if rows and columns agree; else what differs."""
    df = run(spark, sf_dir)
    got_columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in got_columns) for r in df.collect()), key=repr)
    cursor = db.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != got_columns:
        return f"columns {got_columns} and {sorted(names)}"
    at = [names.index(c) for c in got_columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in cursor.fetchall()), key=repr)
    if got != want:
        odd = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"{len(got)} and {len(want)} rows; {odd}"
    return ""


def main(sf_dir: str, names: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db, queries, oracles = connect(sf_dir), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or oracles:
        began = time.time()
        try:
            said = compare(spark, db, name, queries[name], oracles[name], sf_dir)
        except Exception:
            said = "\n".join(x for x in traceback.format_exc().splitlines()[-60:] if not x.strip().startswith("at "))[-700:]
        bad += bool(said)
        if said or time.time() - began > 10:
            print("DIFF" if said else "slow", name, round(time.time() - began, 1), said[:900], flush=True)
    print(f"{len(names or oracles)} compared, {bad} differ; {len(queries)} queries")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
