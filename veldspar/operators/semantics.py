"""Semantic types by ordered rules: the first rule that a name or type fits decides. Rules are tables, compiled to one CASE expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rule tables whose order and patterns decide results.
WEB_TYPES = [
    ("identifier", r"_id$|^id$|_pk$|_key$|_code$"), ("name", r"_name$|^name$|_title$|first_name|last_name|full_name"), ("email", r"email|e_mail|mail_address"),
    ("phone", r"phone|mobile|cell|tel_|telephone"), ("address", r"address|street|city|state|country|zip|postal|region"), ("date", r"_date$|_at$|created|updated|modified|timestamp|_time$"),
    ("amount", r"amount|price|cost|total|sum|value|fee|payment"), ("quantity", r"quantity|qty|count|number|num_"), ("percentage", r"percent|rate|ratio|pct"),
    ("status", r"status|state|is_|has_|flag|active|enabled"), ("description", r"description|desc|comment|note|remarks|text"), ("url", r"url|link|website|uri|href"),
    ("category", r"category|type|class|group|segment"), ("score", r"score|rating|rank|weight|priority"), ("coordinate", r"lat|lng|longitude|latitude|geo|coord"),
]
CLI_METRIC = r"amount|price|cost|total|count|qty|quantity|revenue|sales|score|rating|weight|height|length|sum|avg|value"
CLI_IDENTIFIER, CLI_STATUS = r"_id|id_|_key|_code|_uuid|id$", r"status|state|type|category|flag|is_|has_"
CLI_GEO = r"lat|lng|longitude|latitude|geo|zip|postal|city|state|country|address"
CLI_MONEY, CLI_TEXT = r"price|cost|amount|payment|fee|tax", r"name|title|description|comment|note|message"
TABLE_TYPES = [("fact", r"order|transaction|sale|payment|event|log|history"), ("dimension", r"customer|product|user|employee|store|vendor|seller"), ("bridge", r"_item|_line|_detail|_product|mapping"), ("lookup", r"status|type|category|translation|config|setting")]
PII = [
    ("email", r"email|e_mail|e-mail|mail"), ("phone", r"phone|mobile|cell|tel|fax"), ("ssn", r"ssn|social_security|social_sec"), ("address", r"address|street|addr"),
    ("name", r"first_name|last_name|full_name|firstname|lastname"), ("dob", r"birth|dob|birthday"), ("credit_card", r"card_number|credit_card|cc_num"),
]


def first_rule(subject: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first pattern found in subject; null if none is."""
    out = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        out = F.when(subject.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def rules_sql(subject: str, rules: list[tuple[str, str]]) -> str:
    """The same as a SQL CASE."""
    return "CASE " + " ".join(f"WHEN regexp_matches({subject}, '{p}') THEN '{label}'" for label, p in rules) + " END"


def web_type(name: Column, kind: Column) -> Column:
    name, kind = F.lower(name), F.lower(kind)
    money = name.rlike("price|amount|cost|total")
    fallback = F.when(kind.rlike("date|time"), "date").when(kind.rlike("decimal|float"), F.when(money, "amount").otherwise("numeric")).when(kind.rlike("char|text"), "text").otherwise("unknown")
    return F.coalesce(first_rule(name, WEB_TYPES), fallback)


def cli_type(name: Column, kind: Column) -> Column:
    name, kind = F.lower(name), F.lower(kind)
    number = kind.rlike("int|float|double|decimal|numeric|real|money")
    return (
        F.when(kind.rlike("timestamp|datetime|date|time"), "timestamp").when(kind.rlike("bool|bit"), "boolean").when(name.rlike(CLI_IDENTIFIER), "identifier")
        .when(number & name.rlike(CLI_METRIC), "metric").when(name.rlike(CLI_STATUS), "dimension").when(name.rlike(CLI_GEO), "geographic")
        .when(name.rlike(CLI_MONEY) & kind.rlike("decimal|numeric|money"), "financial").when(kind.rlike("char|text|string") & name.rlike(CLI_TEXT), "text").otherwise("unknown")
    )


def refine(semantic: Column, uniqueness: Column, distinct: Column) -> Column:
    """Unknown columns that are nearly unique are identifiers, those of few values dimensions."""
    return F.when((semantic == "unknown") & (uniqueness > 0.95), "identifier").when((semantic == "unknown") & (distinct > 0) & (distinct < 50), "dimension").otherwise(semantic)


def pii_class(name: Column) -> Column:
    return first_rule(F.lower(name), PII)


def web_table_type(name: Column, n_fk: Column, n_pk: Column) -> Column:
    heuristic = F.when((n_fk >= 2) & (n_pk <= 1), "fact").when((n_fk == 0) & (n_pk == 1), "dimension").when((n_fk >= 2) & (n_pk >= 2), "bridge").otherwise("dimension")
    return F.coalesce(first_rule(F.lower(name), TABLE_TYPES), heuristic)


def describe_column(name: str, semantic: str, kind: str, is_pk: bool = False, is_fk: bool = False, distinct: int | None = None, null_ratio: float | None = None) -> str:
    """A sentence from what is known of a column; the built-in description provider."""
    role = "Key" if is_pk else "Reference to another table" if is_fk else f"{semantic.capitalize()} column" if semantic and semantic != "unknown" else "Column"
    parts = [f"{role} of type {kind}"]
    if distinct is not None:
        parts.append("one value only" if distinct == 1 else f"{distinct} distinct values")
    if null_ratio:
        parts.append(f"{100 * null_ratio:.1f} % null")
    return ", ".join(parts)


def describe_table(name: str, table_type: str, columns: list[str], parents: list[str] = (), children: list[str] = ()) -> str:
    """A sentence from a table's type, columns and neighbours."""
    parts = [f"{table_type.capitalize() if table_type != 'unknown' else 'Plain'} table of {len(columns)} columns"]
    if parents:
        parts.append("refers to " + ", ".join(sorted(parents)))
    if children:
        parts.append("is referred to by " + ", ".join(sorted(children)))
    return "; ".join(parts)


class Descriptions:
    """A provider of descriptions. Another one, such as a language model behind a network, may take its place: it has these two methods."""

    def column(self, name: str, semantic: str, kind: str, **facts) -> str:
        return describe_column(name, semantic, kind, **facts)

    def table(self, name: str, table_type: str, columns: list[str], **facts) -> str:
        return describe_table(name, table_type, columns, **facts)


def describe(columns: DataFrame) -> DataFrame:
    """columns (metadata) with web, CLI and PII classes."""
    return columns.select("table_name", "column_name", web_type(F.col("column_name"), F.col("declared_type")).alias("web_type"), cli_type(F.col("column_name"), F.col("declared_type")).alias("cli_type"), pii_class(F.col("column_name")).alias("pii_class"))
