"""Command line: python -m veldspar analyze FILE | demo | ask FILE QUESTION | test-connection | version."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

VERSION = "0.2.0"


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("veldspar").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _write(engine, analysis: dict, folder: str) -> str:
    Path(folder).mkdir(parents=True, exist_ok=True)
    return engine.export_manual(folder, analysis["id"])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="veldspar", description="Documents, profiles and answers questions about tables.")
    todo = parser.add_subparsers(dest="command", required=True)
    analyze = todo.add_parser("analyze", help="write the manual of a file's or database's tables")
    analyze.add_argument("file", nargs="?", help="a CSV, TSV, TXT, JSON, Parquet, SQLite or .xlsx file")
    analyze.add_argument("--config", help="a YAML file that names the database")
    demo = todo.add_parser("demo", help="write the manual of a demo shop")
    demo.add_argument("--kind", choices=["a", "b"], default="a")
    for p in (analyze, demo):
        p.add_argument("--output", default="output")
        p.add_argument("--registry", help="a folder that keeps datasets and their analyses")
    ask = todo.add_parser("ask", help="answer a question about a file's tables")
    ask.add_argument("file")
    ask.add_argument("question")
    test = todo.add_parser("test-connection", help="read a file's or database's catalog")
    test.add_argument("file")
    todo.add_parser("version")
    args = parser.parse_args(argv)
    if args.command == "version":
        print(f"veldspar {VERSION}")
        return 0
    from .config import from_yaml
    from .engine import Engine
    from .sources import readers

    try:
        engine = Engine(_spark(), getattr(args, "registry", None))
        if args.command == "demo":
            print(_write(engine, engine.use_demo(args.kind), args.output))
        elif args.command == "analyze":
            path = args.file or (from_yaml(args.config).database.path if args.config else None)
            if not path:
                parser.error("name a file, or a configuration that names one")
            print(_write(engine, engine.upload(path), args.output))
        elif args.command == "ask":
            engine.register(args.file)
            plan, answer = engine.ask(args.question)
            print(plan.explanation)
            answer.show(25, truncate=False)
        else:
            found = readers.read(engine.spark, args.file)
            print(f"{readers.server_info(engine.spark)['engine']}: {len(found)} tables: {', '.join(sorted(found))}")
    except (ValueError, KeyError, RuntimeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
