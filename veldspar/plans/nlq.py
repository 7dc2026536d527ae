"""Questions to DataFrame plans: a rule-based binder over a schema, whose result is a lazy DataFrame and never concatenated SQL."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import time_bucket

# The lexicon. Intents are tried in this order; the first that fits is the primary one.
INTENTS = {
    "count": r"\bhow many\b|\bcount\b|\bnumber of\b|\btotal\s+(?:number|count)\b|\bkitne\b|\bkitni\b", "average": r"\baverage\b|\bavg\b|\bmean\b|\btypical\b",
    "sum": r"\btotal\b|\bsum\b|\bcombined\b|\ball\s+together\b|\boverall\b|\bgross\b", "max": r"\bmaximum\b|\bmax\b|\bhighest\b|\blargest\b|\bbiggest\b|\bmost\s+expensive\b|\bbest\b",
    "min": r"\bminimum\b|\bmin\b|\blowest\b|\bsmallest\b|\bcheapest\b|\bleast\b|\bworst\b",
    "list": r"\bshow\b|\blist\b|\bdisplay\b|\bget\b|\bfetch\b|\bfind\b|\bsearch\b|\bselect\b|\bretrieve\b|\bgive\s+me\b|\bwhat\s+are\b|\bwhich\b",
    "group": r"\bper\b|\bby\b|\beach\b|\bgroup\b|\bbreakdown\b|\bdistribution\b|\bcategorize\b|\bsegment\b", "compare": r"\bcompare\b|\bversus\b|\bvs\b|\bdifference\b|\bbetween\b.*\band\b",
    "trend": r"\btrend\b|\bover\s+time\b|\bmonthly\b|\byearly\b|\bdaily\b|\bweekly\b|\bgrowth\b",
    "filter": r"\bwhere\b|\bwith\b|\bhaving\b|\bgreater\s+than\b|\bless\s+than\b|\bmore\s+than\b|\bover\b|\bunder\b|\babove\b|\bbelow\b|\bequal\b|\blike\b",
}
PERIODS = {"year": r"\byear\b|\byearly\b|\bannual\b", "month": r"\bmonth\b|\bmonthly\b", "week": r"\bweek\b|\bweekly\b", "day": r"\bday\b|\bdaily\b|\bdate\b"}
LIMIT = r"\btop\s+(\d+)\b|\bfirst\s+(\d+)\b|\blimit\s+(\d+)\b|\b(\d+)\s+(?:results?|records?|rows?)\b"
DESCENDING = r"\bdescending\b|\bdesc\b|\bhighest\b|\bmost\b|\btop\b|\blargest\b|\bbest\b"
_NUMBER = r"\s*[\"']?(\d+(?:\.\d+)?)"
#: Longest operators first; the span of one is not read again by another.
COMPARISONS = [
    (r"(?:at\s+least|>=)" + _NUMBER, ">="), (r"(?:at\s+most|<=)" + _NUMBER, "<="), (r"(?:\bnot|!=|<>)\s*(?:equal\s+)?(?:to\s+)?" + _NUMBER, "!="),
    (r"(?:greater|more|over|above|exceed|>)\s*(?:than\s+)?" + _NUMBER, ">"), (r"(?:less|under|below|fewer|<)\s*(?:than\s+)?" + _NUMBER, "<"), (r"(?:equal|exactly|=)\s*(?:to\s+)?" + _NUMBER, "="),
]
COLUMN_TYPES = [
    ("identifier", r"_id$|^id$"), ("amount", r"price|cost|amount|value|payment|revenue|freight|fee|profit|income|salary|budget|expense|discount|tax"),
    ("date", r"date|_at$|timestamp|_time$|created|updated|modified|delivered|approved|estimated|shipped|born|started|ended"), ("year", r"\byear\b|release_year|start_year|end_year|birth_year"),
    ("score", r"score|rating|rank|grade|level|priority|stars"), ("quantity", r"qty|quantity|count|number|num_|_num$|items|installment|sequential"),
    ("measurement", r"weight|length|height|width|size|area|volume|distance|duration|_cm$|_mm$|_kg$|_g$|_lb"), ("address", r"zip|postal|city|state|country|region|address|lat$|lng$|longitude|latitude|geo"),
    ("status", r"status"), ("category", r"category|type|kind|class|group|segment|tier"), ("name", r"name|title|label|display"), ("description", r"description|comment|message|note|text|body|content"),
    ("email", r"email"), ("phone", r"phone|mobile|tel"), ("url", r"url|link|image|photo|picture|avatar"),
]
HINTS = {
    "revenue": "amount", "sales": "amount", "income": "amount", "money": "amount", "spent": "amount", "cost": "amount", "price": "amount", "payment": "amount", "total": "amount", "profit": "amount", "expense": "amount",
    "name": "name", "customer": "name", "email": "email", "phone": "phone", "date": "date", "time": "date", "when": "date", "category": "category", "type": "category", "status": "status", "state": "status",
    "rating": "score", "score": "score", "rank": "score", "quantity": "quantity", "amount": "quantity", "city": "address", "country": "address", "location": "address",
}
MEASURES = [("amount", "price revenue sales cost payment amount income spent total money value fee profit".split()), ("quantity", "quantity qty count number items".split()), ("score", "score rating rank weight".split())]
GROUP_HINTS = {"category": "category", "type": "category", "status": "status", "customer": "name", "product": "name", "city": "address", "country": "address", "state": "address", "region": "address", "year": "date", "month": "date"}
NUMERIC_KINDS = {"amount", "score", "quantity", "measurement", "year"}
PREFIXES = ("olist_", "dim_", "fact_", "tbl_", "tb_")
AGGREGATES = {"average": ("avg", F.avg), "sum": ("sum", F.sum), "max": ("max", F.max), "min": ("min", F.min)}
DEFAULT_LIMIT = 25


@dataclass
class Col:
    table: str
    name: str
    kind: str  # display type
    key: bool = False
    semantic: str = ""

    def __post_init__(self):
        found = next((s for s, p in COLUMN_TYPES if re.search(p, self.name, re.I)), "")
        if self.kind == "TEXT" and found in NUMERIC_KINDS:
            found = "category" if found == "score" else "text"
        self.semantic = self.semantic or found


@dataclass
class Schema:
    columns: dict[str, list[Col]]
    edges: list[tuple[str, str, str, str]]
    aliases: dict[str, str] = field(default_factory=dict)
    descriptions: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        for t in self.columns:
            low = t.lower()
            stems = [low] + [low[len(p) :] for p in PREFIXES if low.startswith(p)]
            for s in stems:
                self.aliases |= {s: t, (s[:-1] if s.endswith("s") else s + "s"): t, s.replace("_", " "): t}
            for part in low.split("_") if "_" in low else []:
                if len(part) >= 4:
                    self.aliases.setdefault(part, t)

    @classmethod
    def of(cls, rows: list[tuple], edges: list[tuple[str, str, str, str]], descriptions: dict[str, str] | None = None) -> Schema:
        """From catalog.column_rows and foreign keys; descriptions by table help to find one that a question doesn't name."""
        columns: dict[str, list[Col]] = {}
        for t, _, c, _, kind, pk, fk in rows:
            columns.setdefault(t, []).append(Col(t, c, kind, pk or fk))
        return cls(columns, [e for e in edges if e[0] in columns and e[2] in columns], descriptions=descriptions or {})

    def has(self, c: str, table: str) -> bool:
        return any(x.name == c for x in self.columns[table])


@dataclass
class Plan:
    intent: str
    intents: list[str]
    tables: list[str]
    measure: Col | None = None
    group: Col | None = None
    period: str | None = None
    time: Col | None = None
    filters: list[tuple[Col, str, object]] = field(default_factory=list)
    columns: list[Col] = field(default_factory=list)
    limit: int | None = None
    descending: bool = False
    years: list[int] = field(default_factory=list)
    joins: list[tuple[str, str, str, str]] = field(default_factory=list)
    confidence: float = 0.5
    warnings: list[str] = field(default_factory=list)

    @property
    def explanation(self) -> str:
        """What is computed, of what, under which conditions, by what, and how much of it."""
        what = self.intent if self.measure is None else f"{self.intent} of {self.measure.table}.{self.measure.name}"
        lines = [what + (" over " + " joined with ".join(self.tables) if self.tables else "")]
        lines += [f"only where {c.table}.{c.name} {op} {v:g}" if isinstance(v, float) else f"only where {c.table}.{c.name} {op} {v}" for c, op, v in self.filters]
        if self.group or self.period:
            lines.append("one row for each " + " and ".join(x for x in (self.period, self.group and self.group.name) if x))
        if self.years:
            lines.append("years " + " against ".join(map(str, self.years)) if self.intent == "compare" else "year " + str(self.years[0]))
        if self.limit:
            lines.append(f"at most {self.limit} rows")
        return "; ".join(lines)


def _said(word: str, q: str) -> bool:
    return re.search(rf"\b{re.escape(word)}\b", q) is not None


def detect_intents(q: str) -> list[str]:
    found = [name for name, p in INTENTS.items() if re.search(p, q)]
    if re.search(r"\btop\s+\d+\b", q):
        found = ["list"] + [x for x in found if x not in ("max", "list")]
    return found or ["list"]


def bind_tables(q: str, schema: Schema) -> list[str]:
    hits = sorted((-len(a), k, t) for k, (a, t) in enumerate(schema.aliases.items()) if len(a) >= 3 and _said(a, q))
    return list(dict.fromkeys(t for _, _, t in hits)) or fuzzy_tables(q, schema)


def fuzzy_tables(q: str, schema: Schema) -> list[str]:
    """Tables that share words with the question: those of the name count 1, those of the description a half; the better of the two decides."""
    words = set(re.findall(r"\w{3,}", q))
    scored = []
    for t in schema.columns:
        in_name, in_text = words & set(t.lower().split("_")), words & set(re.findall(r"\w{3,}", schema.descriptions.get(t, "").lower()))
        scored.append((max(len(in_name), 0.5 * len(in_text)), t))
    return [t for n, t in sorted(scored, key=lambda x: -x[0]) if n]


#: Words of money, fixed values: a question with one needs a table that has amounts.
MONEY = "revenue sales income price cost payment spent total money profit".split()


def with_amounts(q: str, tables: list[str], schema: Schema) -> list[str]:
    """tables, and the first table that has amounts if the question is about money and none of them has any."""
    has = lambda t: any(c.semantic == "amount" for c in schema.columns[t])
    if not any(w in q for w in MONEY) or any(map(has, tables)):
        return tables
    return tables + [t for t in schema.columns if t not in tables and has(t)][:1]


def asked_years(q: str) -> list[int]:
    """Years that a question names after a preposition, or on both sides of a comparison."""
    found = [int(y) for y in re.findall(r"\b(?:in|from|of|during|for|year|between|and|versus|vs\.?|compare|with|to)\s+((?:19|20)\d\d)\b", q)]
    return list(dict.fromkeys(found))


def bind_columns(q: str, tables: list[str], schema: Schema) -> list[Col]:
    found: dict[tuple[str, str], Col] = {}
    for t, cols in schema.columns.items():
        for c in cols:
            low, stem = c.name.lower(), t.lower().rstrip("s")
            names = {low, re.sub(rf"^{stem}s?_", "", low), re.sub(r"^[a-z]{1,2}_", "", low)}
            if any(len(n) >= 2 and _said(n, q) for n in names):
                found[(t, c.name)] = c
    for word, semantic in HINTS.items():
        if _said(word, q):
            found |= {(t, c.name): c for t in tables or schema.columns for c in schema.columns[t] if c.semantic == semantic and (t, c.name) not in found}
    return list(found.values())


def bind_filters(q: str, columns: list[Col], tables: list[str], schema: Schema) -> list[tuple[Col, str, object]]:
    out, rest = [], q
    usual = ["amount", "quantity", "score", "measurement"]
    money = any(_said(w, q) for w in "price revenue cost payment amount value expensive cheap".split())
    for pattern, op in COMPARISONS:
        if m := re.search(pattern, rest):
            value = float(m[1])
            rest = rest[: m.start()] + " " * (m.end() - m.start()) + rest[m.end() :]
            wanted = ["amount"] if money or value > 50 else usual
            pools = [[c for c in columns if c.table in tables], columns, [c for t in tables for c in schema.columns[t]], [c for cs in schema.columns.values() for c in cs]]
            target = next((c for pool in pools for kinds in (wanted, usual) for c in pool if c.semantic in kinds and c.kind in ("INTEGER", "REAL")), None)
            if target:
                out.append((target, op, value))
    if m := re.search(r"\b(?:named|called|like)\s+[\"']?(\w[\w\s]*)", q):
        pool = [c for c in columns if c.table in tables] + [c for t in tables for c in schema.columns[t]]
        if target := next((c for c in pool if c.semantic in ("name", "text", "description")), None):
            out.append((target, "like", m[1].strip()))
    return out


def pick_measure(q: str, table: str, columns: list[Col], schema: Schema) -> Col | None:
    """By the question's kind of measure, else the usual order, else any number that is no key."""
    own = schema.columns[table]
    for semantic, words in MEASURES:
        if any(_said(w, q) for w in words):
            pool = [c for c in columns if c.table == table] + own
            return next((c for c in pool if c.semantic == semantic), None)
    for semantic in ("amount", "quantity", "score", "measurement", "year"):
        if c := next((c for c in own if c.semantic == semantic), None):
            return c
    return next((c for c in own if c.kind in ("INTEGER", "REAL") and not c.key), None)


def pick_group(q: str, table: str, columns: list[Col], schema: Schema) -> Col | None:
    own = schema.columns[table]
    for word in re.findall(r"\b(?:by|per|each|breakdown\s+by)\s+(\w+)", q):
        if c := next((c for c in own if word in c.name.lower() and c.semantic not in ("identifier", "date")), None):
            return c
    if c := next((c for c in columns if c.table == table and c.semantic in ("category", "status", "name", "address")), None):
        return c
    for word, semantic in GROUP_HINTS.items():
        if _said(word, q) and (c := next((c for c in own if c.semantic == semantic), None)):
            return c
    return next((c for c in own if c.kind == "TEXT" and not c.key), None)


def pick_group_of(q: str, tables: list[str], columns: list[Col], schema: Schema) -> Col | None:
    """A column that the question names in any bound table, else the first table's best."""
    for word in re.findall(r"\b(?:by|per|each|breakdown\s+by)\s+(\w+)", q):
        if c := next((c for t in tables for c in schema.columns[t] if word in c.name.lower() and c.semantic not in ("identifier", "date")), None):
            return c
    return next((c for t in tables if (c := pick_group(q, t, columns, schema))), None)


def join_path(tables: list[str], schema: Schema) -> tuple[list[tuple[str, str, str, str]], list[str]]:
    """Edges that connect tables to the first one, by shortest paths over declared edges, else by a shared _id, _name or _code column; and what stays unreached."""
    linked, edges, lost = [tables[0]], [], []
    for target in tables[1:]:
        if target in linked:
            continue
        seen, queue, path = {t: [] for t in linked}, deque(linked), None
        while queue and path is None:
            t = queue.popleft()
            for a, ac, b, bc in schema.edges:
                for x, xc, y, yc in ((a, ac, b, bc), (b, bc, a, ac)):
                    if x == t and y not in seen:
                        seen[y] = [*seen[t], (x, xc, y, yc)]
                        if y == target:
                            path = seen[y]
                        queue.append(y)
        if path is None:
            shared = [(t, c.name) for t in linked for c in schema.columns[t] if re.search(r"_(id|name|code)$", c.name) and schema.has(c.name, target)]
            path = [(shared[0][0], shared[0][1], target, shared[0][1])] if shared else None
        if path is None:
            lost.append(target)
            continue
        edges += [e for e in path if e[2] not in linked]
        linked += [e[2] for e in path if e[2] not in linked]
    return edges, lost


def plan(question: str, schema: Schema) -> Plan:
    q = question.lower()
    years = asked_years(q)
    whole, q = q, re.sub(r"\b(?:19|20)\d\d\b", " ", q) if years else q  # a year is no number to compare with
    intents = detect_intents(whole)
    tables = bind_tables(q, schema)
    if tables and (intents[0] in AGGREGATES or "trend" in intents):
        tables = with_amounts(q, tables, schema)
    p = Plan(intents[0], intents, tables, descending=re.search(DESCENDING, q) is not None)
    if not tables:
        tables = p.tables = [next(iter(schema.columns))]
        p.warnings.append("No table matched; the first one is used")
        p.confidence = 0.1
    columns = bind_columns(q, tables, schema)
    if m := re.search(LIMIT, q):
        p.limit = int(next(g for g in m.groups() if g))
    p.filters = bind_filters(q, columns, tables, schema)
    p.period = next((name for name, pattern in PERIODS.items() if re.search(pattern, q)), None)
    if p.period:
        pool = [c for c in columns if c.table in tables] + [c for t in tables for c in schema.columns[t]]
        p.time = next((c for c in pool if c.semantic == "date" or c.kind == "DATETIME"), None)
    if years:
        pool = [c for c in columns if c.table in tables] + [c for t in tables for c in schema.columns[t]]
        p.time = p.time or next((c for c in pool if c.semantic == "date" or c.kind == "DATETIME"), None)
        if p.time is None:
            p.warnings.append("There is no date column; years are ignored")
        else:
            p.years = years
    if len(p.years) > 1 and ("compare" in intents or len(years) == 2):
        # two years side by side: the measure if the question has one, else records
        p.intent, p.years, p.period = "compare", p.years[:2], None
        p.measure = pick_measure(q, p.time.table, columns, schema) if {"sum", "average", "max", "min"} & {*intents} or any(w in q for w in MONEY) else None
        p.confidence = 0.75
    elif p.intent == "compare" and "group" not in intents and not p.period and (c := pick_group_of(q, tables, columns, schema)):
        # values of one column side by side
        p.intent, p.group, p.confidence = "count", c, 0.7
    elif p.intent == "count":
        if not p.time and "group" in intents or p.years and not p.period and "group" in intents:
            p.group = pick_group_of(q, tables, columns, schema)
        p.confidence = 0.85 if p.group or p.time else 0.8
    elif p.intent in AGGREGATES:
        p.measure = pick_measure(q, tables[0], columns, schema)
        if p.measure is None:  # other bound tables first, then any that a join reaches
            rest = tables[1:] + [t for t in schema.columns if t not in tables and not join_path([tables[0], t], schema)[1]]
            p.measure = next((c for t in rest if (c := next((c for c in schema.columns[t] if c.semantic == "amount"), None))), None)
        if p.measure is None:
            p.measure = next((c for c in schema.columns[tables[0]] if c.kind in ("INTEGER", "REAL") and not c.key), None)
        if p.measure is None:
            p.warnings.append("There is no numeric column; records are counted")
        else:
            if "group" in intents:
                p.group = pick_group_of(q, tables, columns, schema)
            p.tables = list(dict.fromkeys([p.measure.table, *tables]))
            p.confidence = 0.8
    elif p.intent == "filter" and p.filters and not p.period:
        # a condition without a verb: the rows that meet it
        p.intent, p.columns, p.confidence = "list", [], 0.65
    elif "trend" in intents or p.period:
        if p.time:
            p.measure, p.confidence = pick_measure(q, tables[0], columns, schema), 0.75
        else:
            p.warnings.append("There is no date column")
            p.confidence = 0.4
    else:
        p.columns = [c for c in columns if c.table == tables[0]][:8]
        p.confidence = 0.7 if p.columns else 0.6
        if p.limit and p.descending and (m := pick_measure(q, tables[0], columns, schema)):
            p.measure, p.confidence = m, 0.75
    if p.limit is None and p.intent == intents[0] == "list" and not (p.period and p.time) and not p.group:  # a condition without a verb asks for all rows that meet it
        p.limit = DEFAULT_LIMIT
        p.warnings.append(f"Results are limited to {DEFAULT_LIMIT} rows")
    needed = {p.tables[0], *[c.table for c, _, _ in p.filters], *[c.table for c in (p.measure, p.group, p.time) if c]}
    p.tables = [t for t in p.tables if t in needed or t in tables] + [t for t in needed if t not in p.tables]
    p.joins, lost = join_path(p.tables, schema)
    if lost:
        p.warnings.append("No join reaches " + ", ".join(lost))
        p.tables = [t for t in p.tables if t not in lost]
        p.filters = [f for f in p.filters if f[0].table not in lost]
    if p.joins:
        p.confidence = min(0.95, p.confidence + 0.1 * len(p.joins))
    return p


def build(p: Plan, tables: dict[str, DataFrame]) -> DataFrame:
    """The plan as a DataFrame; columns are qualified by table, so equal names can't clash."""
    col = lambda c: F.col(f"`{c.table}`.`{c.name}`")
    df = tables[p.tables[0]].alias(p.tables[0])
    for a, ac, b, bc in p.joins:
        df = df.join(tables[b].alias(b), F.col(f"`{a}`.`{ac}`") == F.col(f"`{b}`.`{bc}`"))
    ops = {">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "like": lambda c, v: F.lower(c).contains(v.lower())}
    if p.filters:
        df = df.filter(reduce(lambda a, b: a & b, [ops[op](col(c), v) for c, op, v in p.filters]))
    if p.years:
        df = df.filter(F.year(col(p.time)).isin(p.years))
    if p.intent == "compare":
        side = lambda y: F.when(F.year(col(p.time)) == y, F.lit(1) if p.measure is None else col(p.measure))
        name = "count" if p.measure is None else f"total_{p.measure.name}"
        first, second = (F.coalesce(F.sum(side(y)), F.lit(0)) for y in p.years)
        return df.agg(first.alias(f"{name}_{p.years[0]}"), second.alias(f"{name}_{p.years[1]}"), (second - first).alias("difference"))
    bucket = time_bucket(col(p.time), p.period).alias(p.period) if p.time and p.period else None
    if p.intent == "count" or p.intent in AGGREGATES and p.measure is None:
        if bucket is not None:
            return df.groupBy(bucket).agg(F.count("*").alias("count")).orderBy(p.period)
        if p.group:
            return df.groupBy(col(p.group).alias(p.group.name)).agg(F.count("*").alias("count")).orderBy(F.desc("count"), p.group.name)
        return df.agg(F.count("*").alias("total_count"))
    if p.intent in AGGREGATES:
        name, f = AGGREGATES[p.intent]
        alias = f"{name}_{p.measure.name}"
        if p.group is None:
            return df.agg(f(col(p.measure)).alias(alias))
        out = df.groupBy(col(p.group).alias(p.group.name)).agg(f(col(p.measure)).alias(alias))
        return out.orderBy(F.desc(alias) if p.descending else F.asc(alias))
    if bucket is not None and ("trend" in p.intents or p.period):
        sums = [F.sum(col(p.measure)).alias(f"total_{p.measure.name}")] if p.measure else []
        return df.groupBy(bucket).agg(*sums, F.count("*").alias("record_count")).orderBy(p.period)
    if p.measure is not None and p.limit and p.descending:
        df = df.orderBy(F.desc(f"`{p.measure.table}`.`{p.measure.name}`"))
    out = df.select(*[col(c) for c in p.columns]) if p.columns else df.select(f"{p.tables[0]}.*")
    return out.limit(p.limit) if p.limit else out


def ask(question: str, schema: Schema, tables: dict[str, DataFrame]) -> tuple[Plan, DataFrame]:
    p = plan(question, schema)
    return p, build(p, tables)
