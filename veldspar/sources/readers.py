"""File and database readers into named DataFrames."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from pathlib import PurePath
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {".db": "sqlite", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".csv": "csv", ".tsv": "tsv", ".txt": "txt", ".xlsx": "excel", ".xls": "excel", ".json": "json", ".parquet": "parquet"}
ALLOWED = {*TYPES, ".sql"}
MAX_UPLOAD_MB = 100
#: Rows of a SQLite table that one task reads.
SQLITE_ROWS = 200_000


def file_type(name: str) -> str:
    return TYPES.get(PurePath(name).suffix.lower(), "unknown")


def check_upload(path: str, most_mb: int = MAX_UPLOAD_MB) -> None:
    """ValueError for a local file whose type isn't allowed or that is larger than most_mb."""
    suffix = PurePath(path).suffix.lower()
    if suffix not in ALLOWED:
        raise ValueError(f"files of type {suffix or '(none)'} can't be uploaded; allowed: {', '.join(sorted(ALLOWED))}")
    if (size := os.path.getsize(path)) > most_mb << 20:
        raise ValueError(f"{path} has {size / (1 << 20):.1f} MB; at most {most_mb} MB can be uploaded")


def table_name(path: str) -> str:
    return re.sub(r"\W", "_", PurePath(path).stem)


def read_delimited(spark: SparkSession, path: str, sep: str = ",", infer: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """Delimited text with a header; read as Latin-1 where UTF-8 doesn't decode it. A schema spares the inference pass over the file."""
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1).count()
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "ISO-8859-1" if bad else "UTF-8").option("prefersDecimal", False)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", infer).csv(path)


def read_txt(spark: SparkSession, path: str, **options) -> DataFrame:
    """Tabs if the first line has one, else commas."""
    first = spark.read.text(path).limit(1).collect()
    return read_delimited(spark, path, "\t" if first and "\t" in first[0][0] else ",", **options)


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An array of objects is one table; an object's arrays of objects are one table each."""
    df = spark.read.option("multiLine", True).json(path)
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    text = spark.read.option("wholetext", True).text(path).select(F.substring(F.trim("value"), 1, 1)).first()
    if nested and text and text[0] == "{":
        return {n: df.select(F.inline(F.col(f"`{n}`"))) for n in nested}
    return {table_name(path): df}


def _sqlite_type(declared: str | None) -> T.DataType:
    kind = (declared or "").upper()
    return T.LongType() if "INT" in kind else T.DoubleType() if re.search("REAL|FLOA|DOUB|NUM|DEC", kind) else T.StringType()


def read_sqlite(spark: SparkSession, path: str, rows: int = SQLITE_ROWS) -> dict[str, DataFrame]:
    """Every table of a SQLite file, read-only, through the standard library (no JDBC driver is bundled).

    The driver reads the catalog and the range of row ids only; tasks read rows by ranges of ids. On a cluster the path
    must be one that all executors see. A table without row ids is read by one task, row by row. Values that don't fit
    their column's declared type are null in number columns and text in others.
    """
    import sqlite3

    out = {}
    uri = f"file:{path}?mode=ro"
    with sqlite3.connect(uri, uri=True) as db:
        found = db.execute("select name, sql from sqlite_master where type = 'table' and name not like 'sqlite_%'").fetchall()
        for name, made in found:
            quoted = '"' + name.replace('"', '""') + '"'
            info = db.execute(f"pragma table_info({quoted})").fetchall()
            schema = T.StructType([T.StructField(c[1], _sqlite_type(c[2])) for c in info])
            ranges = [(None, None)]
            if not re.search(r"without\s+rowid\s*;?\s*$", made or "", re.I):
                lo, hi = db.execute(f"select min(rowid), max(rowid) from {quoted}").fetchone()
                ranges = [] if lo is None else [(a, min(a + rows - 1, hi)) for a in range(lo, hi + 1, rows)]
            out[name] = _sqlite_rows(spark, uri, quoted, schema, ranges)
    return out


def _sqlite_rows(spark: SparkSession, uri: str, quoted: str, schema: T.StructType, ranges: list) -> DataFrame:
    def number(f):
        def cast(v):
            try:
                return f(v)
            except (TypeError, ValueError):
                return None

        return cast

    casts = [number(int) if isinstance(f.dataType, T.LongType) else number(float) if isinstance(f.dataType, T.DoubleType) else str for f in schema.fields]

    def read(batches: Iterator) -> Iterator:
        import sqlite3

        import pyarrow as pa

        kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() if isinstance(f.dataType, T.DoubleType) else pa.string() for f in schema.fields]
        with sqlite3.connect(uri, uri=True) as db:
            for batch in batches:
                for lo, hi in zip(*(batch.column(k).to_pylist() for k in (0, 1))):
                    cursor = db.execute(f"select * from {quoted}" + ("" if lo is None else " where rowid between ? and ?"), () if lo is None else (lo, hi))
                    while part := cursor.fetchmany(10_000):
                        columns = [pa.array([None if r[k] is None else f(r[k]) for r in part], kind) for k, (f, kind) in enumerate(zip(casts, kinds))]
                        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    asked = spark.createDataFrame(ranges, "lo long, hi long").repartition(max(1, len(ranges)))
    return asked.mapInArrow(read, schema)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _sheet_rows(book: zipfile.ZipFile, part: str, shared: list[str]) -> Iterator[list]:
    """Values of a sheet row by row; cells that a row lacks are None."""
    with book.open(part) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != _MAIN + "row":
                continue
            out: list = []
            for cell in row.iter(_MAIN + "c"):
                at = 0
                for letter in re.match("[A-Z]*", cell.get("r", "").upper())[0]:
                    at = at * 26 + ord(letter) - 64
                out += [None] * ((at or len(out) + 1) - 1 - len(out))
                value, kind = cell.findtext(_MAIN + "v"), cell.get("t", "n")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
                elif value is not None:
                    value = shared[int(value)] if kind == "s" else value == "1" if kind == "b" else float(value) if kind == "n" else value
                out.append(value)
            yield out
            row.clear()


def read_excel(spark: SparkSession, path: str, most_mb: int = MAX_UPLOAD_MB) -> dict[str, DataFrame]:
    """Every sheet of an .xlsx file that has rows below its header; numbers become long or double, mixed columns text.

    A workbook is one zip file of bounded size (most_mb) and at most 1,048,576 rows a sheet, so the driver reads it.
    """
    if os.path.getsize(path) > most_mb << 20:
        raise ValueError(f"{path} has more than {most_mb} MB")
    if not zipfile.is_zipfile(path):
        raise ValueError(f"{path} is no .xlsx workbook; save older .xls files as .xlsx")
    out = {}
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        shared = ["".join(t.text or "" for t in s.iter(_MAIN + "t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
            target = targets[sheet.get(_REL + "id")].lstrip("/")
            rows = list(_sheet_rows(book, target if target.startswith("xl/") else "xl/" + target, shared))
            if len(rows) < 2:
                continue
            header = [str(h) if h not in (None, "") else f"column_{k}" for k, h in enumerate(rows[0], 1)]
            body = [r[: len(header)] + [None] * (len(header) - len(r)) for r in rows[1:]]
            kinds = []
            for k in range(len(header)):
                held = [r[k] for r in body if r[k] is not None]
                number = held and all(isinstance(v, float) for v in held)
                kinds.append("boolean" if held and all(isinstance(v, bool) for v in held) else "long" if number and all(v == int(v) for v in held) else "double" if number else "string")
            cast = {"boolean": bool, "long": int, "double": float, "string": lambda v: f"{v:g}" if isinstance(v, float) else str(v)}
            body = [tuple(None if v is None else cast[kind](v) for v, kind in zip(r, kinds)) for r in body]
            schema = T.StructType([T.StructField(h, {"boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}[kind]) for h, kind in zip(header, kinds)])
            out[re.sub(r"\W", "_", sheet.get("name", "sheet"))] = spark.createDataFrame(body, schema)
    return out


def jdbc_url(kind: str, host: str, port: int, database: str) -> str:
    if kind not in ("postgresql", "mysql"):
        raise ValueError(f"unsupported database: {kind}")
    return f"jdbc:{kind}://{host}:{port}/{database}"


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 8, fetch: int = 10_000, **properties) -> DataFrame:
    """A table over JDBC, in parallel ranges of a numeric column where one is named."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).option("fetchsize", fetch).options(**properties)
    if column and bounds:
        reader = reader.option("partitionColumn", column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return reader.load()


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a file by its type."""
    kind, name = file_type(path), table_name(path)
    if kind == "csv":
        return {name: read_delimited(spark, path)}
    if kind == "tsv":
        return {name: read_delimited(spark, path, "\t")}
    if kind == "txt":
        return {name: read_txt(spark, path)}
    if kind == "parquet":
        return {name: spark.read.parquet(path)}
    if kind in ("json", "sqlite", "excel"):
        return {"json": read_json, "sqlite": read_sqlite, "excel": read_excel}[kind](spark, path)
    raise ValueError(f"unknown file type: {path}")


def health(spark: SparkSession) -> bool:
    return spark.range(1).count() == 1


def server_info(spark: SparkSession) -> dict[str, str]:
    return {"engine": "Apache Spark", "version": spark.version}


def chunks(df: DataFrame, size: int = 1000):
    """Rows in lists of size, fetched partition by partition."""
    part = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
