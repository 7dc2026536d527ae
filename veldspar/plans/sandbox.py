"""Guarded read-only SQL: every node of the parsed text must be one of a read, results are capped, and a timeout interrupts the job.

What is judged is the whole tree that Spark's parser builds: children, bodies of common table expressions, and subqueries
within expressions. A node that isn't on the list of reads refuses the text, so commands and writes do wherever they
stand. Relations must be registered views (temporary ones) or common table expressions in scope, by one name, so no
path and no table of a catalog can be named. Functions that run Java code are refused, and so are table functions
beyond a list.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

ROW_CAP, TIMEOUT_S, PREVIEW = 500, 10.0, 50
#: Nodes of a parsed read.
READS = frozenset(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Distinct Union Intersect Except UnresolvedWith UnresolvedRelation SubqueryAlias Offset UnresolvedInlineTable LocalRelation"
    " UnresolvedHaving WithWindowDefinition UnresolvedTableValuedFunction Join LateralJoin Pivot Unpivot UnresolvedPivot Sample OneRowRelation Tail Generate UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedHint UnionLoop".split()
)
#: Table functions and generators.
TABLE_FUNCTIONS = frozenset("range explode explode_outer posexplode posexplode_outer inline inline_outer stack json_tuple variant_explode variant_explode_outer".split())
#: Functions that run code of the class path, or read documents that may name files.
REFUSED_FUNCTIONS = re.compile(r"^(?:java_method|reflect|try_reflect|xpath.*|from_xml|schema_of_xml)$")


@dataclass
class Result:
    success: bool
    sql: str
    columns: list[str] = field(default_factory=list)
    rows: list[list] = field(default_factory=list)
    row_count: int = 0
    execution_time_ms: float = 0.0
    error: str | None = None


def dialect(sql: str) -> str:
    """[name] to `name` outside string literals, and a trailing semicolon off."""
    parts = re.split(r"('(?:[^']|'')*')", sql.strip().rstrip(";"))
    return "".join(p if k % 2 else re.sub(r"(?<![\w\])])\[([A-Za-z_]\w*)\]", r"`\1`", p) for k, p in enumerate(parts))


def _each(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def _names(parts) -> list[str]:
    return [str(p).lower() for p in _each(parts)]


def _expressions(plan) -> Iterator:
    """All expressions of a node, to the leaves."""
    todo = _each(plan.expressions())
    while todo:
        e = todo.pop()
        yield e
        todo += _each(e.children())


def _reason(plan, views: frozenset[str], scope: frozenset[str]) -> str | None:
    """Why a node or anything below it isn't a read; scope: names of common table expressions that it may use."""
    name = plan.nodeName()
    if name not in READS:
        return f"{name} is no read"
    if name == "UnresolvedRelation":
        parts = _names(plan.multipartIdentifier())
        if len(parts) != 1 or parts[0] not in scope | views:
            return f"{'.'.join(parts)} is no registered view"
    if name == "UnresolvedTableValuedFunction" and (parts := _names(plan.name())) and parts[-1] not in TABLE_FUNCTIONS:
        return f"the table function {'.'.join(parts)} isn't allowed"
    for e in _expressions(plan):
        kind = e.nodeName()
        if kind in ("UnresolvedFunction", "UnresolvedGenerator"):
            parts = _names(e.nameParts()) if kind == "UnresolvedFunction" else [str(e.name().funcName()).lower()]
            if any(REFUSED_FUNCTIONS.match(p) for p in parts) or kind == "UnresolvedGenerator" and parts[-1] not in TABLE_FUNCTIONS:
                return f"the function {'.'.join(parts)} isn't allowed"
        elif "Reflect" in kind or "StaticInvoke" in kind:
            return f"{kind} isn't allowed"
        elif is_instance_of(SparkContext._gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            if why := _reason(e.plan(), views, scope):
                return why
    if name == "UnresolvedWith":
        for relation in _each(plan.cteRelations()):
            own = frozenset([str(relation._1()).lower()])
            if why := _reason(relation._2(), views, scope | own if plan.allowRecursion() else scope):
                return why
            scope |= own
    return next((why for child in _each(plan.children()) if (why := _reason(child, views, scope))), None)


def reason_against(spark: SparkSession, sql: str) -> str | None:
    """Why a text isn't a single read of registered views; None if it is one."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(dialect(sql))
    except Exception as e:  # the parser's own errors come through the gateway in several classes
        return "it can't be parsed: " + str(e).splitlines()[0][:200]
    views = frozenset(t.name.lower() for t in spark.catalog.listTables() if t.isTemporary)
    return _reason(plan, views, frozenset())


def guarded(spark: SparkSession, sql: str, cap: int = ROW_CAP) -> DataFrame:
    """The capped DataFrame of a read; ValueError otherwise."""
    if why := reason_against(spark, sql):
        raise ValueError(why)
    return spark.sql(dialect(sql)).limit(cap)


def execute(spark: SparkSession, sql: str, cap: int = ROW_CAP, timeout_s: float = TIMEOUT_S) -> Result:
    began, tag = time.time(), f"sandbox-{uuid.uuid4().hex}"
    context = spark.sparkContext
    timer = threading.Timer(timeout_s, lambda: context.cancelJobsWithTag(tag))
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    timer.start()
    try:
        df = guarded(spark, sql, cap)
        rows = [[v if v is None or isinstance(v, (int, float, str, bool)) else str(v) for v in r] for r in df.collect()]
        return Result(True, sql, df.columns, rows, len(rows), 1000 * (time.time() - began))
    except (ValueError, PySparkException) as e:
        return Result(False, sql, error=str(e).splitlines()[0], execution_time_ms=1000 * (time.time() - began))
    except Exception as e:  # an interrupted job
        return Result(False, sql, error=f"stopped: {type(e).__name__}", execution_time_ms=1000 * (time.time() - began))
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def register(tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(re.sub(r"\W", "_", name))


def preview(df: DataFrame, n: int = PREVIEW) -> DataFrame:
    return df.limit(min(n, ROW_CAP))
