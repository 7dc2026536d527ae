"""Markdown manuals, entity diagrams and sample queries from an analysis (see engine.analyze)."""

from __future__ import annotations

import re

from .relations import load_order
from .semantics import Descriptions


def mermaid(columns: list, edges: list, most: int = 15, implicit: list = ()) -> str:
    """An entity diagram: columns are (table, column, type, is_pk, is_fk), edges (from_table, from_column, to_table, to_column); implicit edges are dotted."""
    lines, seen = ["erDiagram"], {}
    for t, c, kind, pk, fk in columns:
        seen.setdefault(t, []).append(f"        {kind} {c}" + (" PK" if pk else " FK" if fk else ""))
    for t, cols in seen.items():
        lines += [f"    {t} {{", *cols[:most], "    }"]
    lines += [f"    {p} ||--o{{ {t} : {c}" for t, c, p, _ in edges]
    lines += [f"    {p} ||..o{{ {t} : {c}" for t, c, p, _ in implicit]
    return "\n".join(lines)


def diagram_data(columns: list, edges: list, implicit: list = ()) -> dict:
    """The same as nodes and edges."""
    nodes: dict[str, dict] = {}
    for t, c, kind, pk, fk in columns:
        nodes.setdefault(t, {"id": t, "columns": []})["columns"].append({"name": c, "type": kind, "pk": bool(pk), "fk": bool(fk)})
    arrows = [{"from": t, "to": p, "column": c, "refers_to": k, "dotted": dotted} for part, dotted in ((edges, False), (implicit, True)) for t, c, p, k in part]
    return {"nodes": list(nodes.values()), "edges": arrows}


def text_diagram(types: dict[str, str]) -> str:
    """Dimensions, then facts, then the rest."""
    order = {"dimension": 0, "fact": 1}
    return "\n".join(f"[{kind}] {name}" for name, kind in sorted(types.items(), key=lambda x: (order.get(x[1], 2), x[0])))


def sample_queries(tables: list[str], edges: list, most_joins: int = 3, facts: list[tuple[str, str]] = ()) -> list[tuple[str, str]]:
    """(title, SQL): views of the first tables, joins along the first edges, and totals of up to two fact tables ((table, amount column))."""
    out = [(f"Rows of {t}", f"SELECT * FROM {t} LIMIT 10") for t in tables[:3]]
    out += [(f"{t} with {p}", f"SELECT a.*, b.* FROM {t} a JOIN {p} b ON a.{c} = b.{k} LIMIT 10") for t, c, p, k in edges[:most_joins]]
    return out + [(f"Totals of {t}", f"SELECT count(*) AS total_records, sum({c}) AS total_amount, avg({c}) AS avg_amount FROM {t}") for t, c in facts[:2]]


def report_queries(tables: list[str], edges: list, times: list[tuple[str, str]], metrics: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(title, SQL) of a report: a row count, the last 30 days of a fact table by its time, one join, and a summary of a metric. times, metrics: (table, column)."""
    out = [(f"Rows in {tables[0]}", f"SELECT '{tables[0]}' AS table_name, count(*) AS row_count FROM {tables[0]}")] if tables else []
    out += [(f"{t} by day", f"SELECT CAST({c} AS DATE) AS day, count(*) AS n FROM {t} GROUP BY 1 ORDER BY day DESC LIMIT 30") for t, c in times[:1]]
    out += [(f"{t} joined with {p}", f"SELECT s.*, t.* FROM {t} s JOIN {p} t ON s.{c} = t.{k} LIMIT 100") for t, c, p, k in edges[:1]]
    return out + [(f"{c} of {t}", f"SELECT count(*) AS n, avg({c}) AS average, sum({c}) AS total, min({c}) AS least, max({c}) AS most FROM {t}") for t, c in metrics[:1]]


#: Words of a table's name, and what such a table is used for.
_USES = [
    (r"order|sale|transaction|lineitem|item", "Follow sales over time and by what was sold."),
    (r"customer|client|user", "Group customers, and tell who buys how much."),
    (r"product|part|catalog", "Compare products and their prices."),
    (r"payment|invoice", "Check payments against what was ordered."),
    (r"review|rating|feedback", "Relate what customers say to what they bought."),
    (r"event|log", "Count events by kind and hour."),
    (r"region|nation|geo|city|country|address", "Report by place."),
    (r"supplier|seller|vendor", "Compare suppliers."),
]


def use_cases(tables: list[str]) -> list[str]:
    return [use for pattern, use in _USES if any(re.search(pattern, t, re.I) for t in tables)]


def improvements(names: list[str], keyed: set[str], profiles: dict[str, list[dict]]) -> list[str]:
    """Up to five tables without a key, the number of columns that are mostly null, and columns of one value."""
    out = [f"Declare a primary key for {t}." for t in [n for n in names if n not in keyed][:5]]
    sparse = sum(r["null_ratio"] > 0.5 for rows in profiles.values() for r in rows)
    if sparse:
        out.append(f"Look into {sparse} columns of which more than half is null.")
    single = [f"{t}.{r['column_name']}" for t, rows in profiles.items() for r in rows if r["distinct_count"] == 1 and r["total_count"] > 100]
    return out + ([f"Drop or explain columns of one value: {', '.join(single[:5])}."] if single else [])


class Manual:
    """Builds the manual of an analysis section by section; sections with nothing to say state it."""

    def __init__(self, title: str, analysis: dict, provider: Descriptions | None = None):
        self.title, self.a, self.provider = title, analysis, provider or Descriptions()
        self.counts, self.profiles, self.types = analysis["counts"], analysis["profiles"], analysis["types"]
        self.edges, self.issues = [tuple(e) for e in analysis["edges"]], [tuple(i) for i in analysis["issues"]]
        self.columns: dict[str, list[tuple]] = {}
        for t, c, kind, pk, fk in analysis["columns"]:
            self.columns.setdefault(t, []).append((c, kind, pk, fk))
        self.classes = {(r["table_name"], r["column_name"]): r for r in analysis["classes"]}
        self.names = load_order([(t, p) for t, _, p, _ in self.edges], sorted(self.counts))

    def summary(self) -> list[str]:
        n = sum(map(len, self.columns.values()))
        bad = sum(s.upper() in ("CRITICAL", "HIGH") for *_, s in self.issues)
        return [f"{len(self.counts)} tables, {n} columns, {sum(self.counts.values())} rows, {len(self.edges)} relationships; quality score {int(self.a['score'] or 0)} of 100, {len(self.issues)} issues of which {bad} are critical."]

    def overview(self) -> list[str]:
        largest = sorted(self.counts.items(), key=lambda x: (-x[1], x[0]))[:5]
        return [text_diagram(self.types), "", "Largest tables: " + ", ".join(f"{t} ({n} rows)" for t, n in largest) + "."]

    def entities(self) -> list[str]:
        out = []
        for t in self.names:
            cols, found = self.columns.get(t, []), {r["column_name"]: r for r in self.profiles.get(t, [])}
            parents, children = {p for a, _, p, _ in self.edges if a == t}, {a for a, _, p, _ in self.edges if p == t}
            out += ["", f"### {t}", self.provider.table(t, self.types.get(t, "unknown"), [c for c, *_ in cols], parents=sorted(parents), children=sorted(children)), f"Rows: {self.counts[t]}", "", "| Column | Type | Key | Null % | Distinct | Description |", "|---|---|---|---|---|---|"]
            for c, kind, pk, fk in cols:
                r = found.get(c, {})
                semantic = self.classes.get((t, c), {}).get("web_type") or ""
                said = self.provider.column(c, semantic, kind, is_pk=pk, is_fk=fk, distinct=r.get("distinct_count"), null_ratio=r.get("null_ratio"))
                out.append(f"| {c} | {kind} | {'PK' if pk else 'FK' if fk else ''} | {100 * r.get('null_ratio', 0):.1f} | {r.get('distinct_count', '')} | {said} |")
        return out or ["No tables."]

    def relationships(self) -> list[str]:
        if not self.edges:
            return ["None is declared or found."]
        told = [f"- Each row of {t} refers to one of {p}; one of {p} may have many of {t}." for t, p in dict.fromkeys((t, p) for t, _, p, _ in self.edges)]
        return ["| From | To |", "|---|---|", *[f"| {t}.{c} | {p}.{k} |" for t, c, p, k in self.edges], "", *told]

    def quality(self) -> list[str]:
        null = sorted(((r["null_ratio"], t, r["column_name"]) for t, rows in self.profiles.items() for r in rows if r["null_ratio"] > 0.05), reverse=True)[:15]
        out = [f"- {severity}: {t}{'.' + c if c else ''}: {kind.replace('_', ' ')}" for t, c, kind, severity in self.issues] or ["No issues."]
        return out + (["", "| Column | Null % |", "|---|---|", *[f"| {t}.{c} | {100 * x:.1f} |" for x, t, c in null]] if null else [])

    def uses(self) -> list[str]:
        return [f"- {u}" for u in use_cases(self.names)] or ["None follows from the tables' names."]

    def fact_columns(self, kinds: tuple[str, ...], which: str) -> list[tuple[str, str]]:
        facts = [t for t in self.names if self.types.get(t) == "fact"]
        return [(t, c) for t in facts for c, *_ in self.columns.get(t, [])[:] if self.classes.get((t, c), {}).get(which) in kinds]

    def queries(self) -> list[tuple[str, str]]:
        one = lambda pairs: list({t: (t, c) for t, c in reversed(pairs)}.values())[::-1]  # noqa: E731  the first column of each table
        amounts = one(self.fact_columns(("amount",), "web_type"))
        report = report_queries(self.names, self.edges, one(self.fact_columns(("timestamp",), "cli_type")), one(self.fact_columns(("metric", "financial"), "cli_type")))
        return sample_queries(self.names, self.edges, facts=amounts) + report

    def warnings(self) -> list[str]:
        bad = [f"- {t}{'.' + c if c else ''}: {kind.replace('_', ' ')} ({severity})" for t, c, kind, severity in self.issues if severity.upper() in ("CRITICAL", "HIGH", "WARNING", "MEDIUM")]
        personal = sorted(f"{t}.{c} ({r['pii_class']})" for (t, c), r in self.classes.items() if r.get("pii_class"))
        return (bad + ([f"- Personal data may be in {', '.join(personal)}."] if personal else [])) or ["None."]

    def improvements(self) -> list[str]:
        keyed = {t for t, cols in self.columns.items() if any(pk for _, _, pk, _ in cols)}
        return [f"- {x}" for x in improvements(self.names, keyed, self.profiles)] or ["None."]

    def appendix(self) -> list[str]:
        flat = [(t, *c) for t, cols in self.columns.items() for c in cols]
        return ["```mermaid", mermaid(flat, self.edges), "```", "", "Load order: " + " > ".join(self.names), "", "| Term | Meaning |", "|---|---|", "| fact | a table of events that refers to others |", "| dimension | a table that others refer to |", "| PK, FK | a key of its own table, of another one |"]

    def text(self) -> str:
        parts = {
            "Executive summary": self.summary(), "Overview": self.overview(), "Entities": self.entities(), "Relationships": self.relationships(), "Data quality": self.quality(), "Use cases": self.uses(),
            "Sample queries": [f"{title}:\n\n```sql\n{sql}\n```" for title, sql in self.queries()], "Warnings": self.warnings(), "Improvements": self.improvements(), "Appendix": self.appendix(),
        }
        out = [f"# {self.title}", "", "## Contents", *[f"{k}. [{s}](#{s.lower().replace(' ', '-')})" for k, s in enumerate(parts, 1)]]
        for name, lines in parts.items():
            out += ["", f"## {name}", "", *lines]
        return "\n".join([*out, ""])


def file_name(name: str) -> str:
    """A safe name for an exported manual."""
    return (re.sub(r"[^\w.-]+", "_", name).strip("._") or "manual") + ".md"
