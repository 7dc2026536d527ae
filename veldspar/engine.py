"""One object over the parts: upload, analyse, ask, search, document, and look up what was stored."""

from __future__ import annotations

from collections import OrderedDict
from pathlib import Path, PurePath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import charts, chunks, docs, identity, profile, quality, relations, retrieval, semantics
from .plans import catalog, nlq, sandbox
from .sources import demo, readers
from .sources.registry import Registry

#: Search indexes that stay open; the one that was used longest ago goes first.
MOST_INDEXES = 10


class Engine:
    def __init__(self, spark: SparkSession, registry: str | None = None, provider: semantics.Descriptions | None = None):
        self.spark, self.tables, self.primary, self.edges = spark, {}, {}, []
        self.registry = Registry(registry) if registry else None
        self.provider = provider or semantics.Descriptions()
        self.current: dict | None = None
        self._indexes: OrderedDict[str, tuple[retrieval.Index, dict]] = OrderedDict()

    # --- data -----------------------------------------------------------------------------------------------------

    def register(self, path: str, name: str | None = None) -> list[str]:
        found = readers.read(self.spark, path)
        if name and len(found) == 1:
            found = {name: next(iter(found.values()))}
        return self.add(found)

    def upload(self, path: str, most_mb: int = readers.MAX_UPLOAD_MB) -> dict:
        """The analysis of one file, whose tables become the engine's only ones."""
        readers.check_upload(path, most_mb)
        self.clear()
        self.register(path)
        return self.analyze(PurePath(path).name)

    def use_demo(self, kind: str = "a", seed: int = 42) -> dict:
        self.clear()
        self.add(demo.shop(self.spark, kind, seed), *demo.keys(kind))
        return self.analyze(f"demo_shop_{kind}.db")

    def load_testdata(self, sf_dir: str) -> list[str]:
        return self.add(catalog.load_all(self.spark, sf_dir), catalog.PRIMARY_KEYS, [e for e in catalog.FOREIGN_KEYS if e[0] in catalog.SCHEMAS])

    def add(self, tables: dict[str, DataFrame], primary: dict | None = None, edges: list | None = None) -> list[str]:
        self.tables |= tables
        self.primary |= {t: c for t, c in (primary or {}).items() if t in tables}
        self.edges += [tuple(e) for e in edges or []]
        self.current = None
        sandbox.register(tables)
        return sorted(tables)

    def clear(self) -> None:
        for t in self.tables:
            self.spark.catalog.dropTempView(t)
        self.tables, self.primary, self.edges, self.current = {}, {}, [], None

    def open(self, name: str) -> list[str]:
        """Make a stored dataset's tables the engine's only ones, from its raw copy."""
        stored = self._stored(name)
        self.clear()
        found = {t: self.spark.read.parquet(path) for t, path in self.registry.raw_tables(name).items()}
        out = self.add(found, {t: tuple(c) for t, c in stored["primary"].items()}, stored["declared"])
        self.current = stored
        return out

    def tables_list(self) -> DataFrame:
        return catalog.row_counts(self.tables)

    def preview(self, table: str, n: int = sandbox.PREVIEW) -> DataFrame:
        if table not in self.tables:
            raise KeyError(f"no table {table}")
        return sandbox.preview(self.tables[table], n)

    def _rows(self) -> list[tuple]:
        return catalog.column_rows({t: df.dtypes for t, df in self.tables.items()}, self.primary, self.edges)

    # --- analysis -------------------------------------------------------------------------------------------------

    def fingerprint(self) -> str:
        hashes = [identity.fingerprint(df).first().content_hash for _, df in sorted(self.tables.items())]
        return identity.next_hash("", "".join(hashes))

    def _year(self, title: str) -> str:
        """The year in the title, else the one that most dates of the tables have."""
        votes: dict[str, int] = {}
        for df in self.tables.values():
            dated = [c for c, kind in df.dtypes if any(w in c.lower() for w in ("date", "year", "time", "created", "updated", "released", "published", "added")) or kind.startswith(("date", "timestamp"))]
            if row := identity.detect_year(df, dated, filename=title).first():
                if row.votes == 0:
                    return row.year
                votes[row.year] = votes.get(row.year, 0) + row.votes
        return max(votes, key=lambda y: (votes[y], y)) if votes else ""

    def analyze(self, title: str = "dataset") -> dict:
        """Profiles, types, relationships, issues, score, insights and manual; taken from the registry if it knows the content."""
        name = whole = None
        if self.registry:
            whole = self.fingerprint()
            known = self.registry.by_hash(whole)
            wanted = known or identity.semantic_id(title, {t: df.columns for t, df in self.tables.items()}, whole, self._year(title))
            name, new = self.registry.put(wanted, whole, title=title)
            if not new and (kept := self.registry.fetch(name, "analysis")):
                self.registry.count_hit(name)
                self.current = kept
                return kept
        rows = self._rows()
        columns = self.spark.createDataFrame(rows, catalog.COLUMN_DDL)
        found = {t: [r.asDict() for r in profile.profile(df, stage=True).collect()] for t, df in self.tables.items()}
        counts = {t: p[0]["total_count"] if p else 0 for t, p in found.items()}
        flat = self._profiles(found)
        meta = self.spark.createDataFrame(sorted(counts.items()), "table_name string, row_count long")
        declared = self.spark.createDataFrame(self.edges, catalog.EDGE_DDL)
        edges = declared.unionByName(relations.implicit(columns)).unionByName(relations.implicit_by_suffix(columns)).distinct()
        issues = quality.all_issues([quality.missing_pk(meta, columns), quality.nulls_cli(flat), quality.single_value(flat)])
        score = quality.score_cli(issues, meta, columns).agg(F.round(F.avg("score"))).first()[0]
        types = {r.table_name: r.table_type for r in relations.table_types(edges, meta, columns).collect()}
        links, problems = sorted(tuple(r) for r in edges.collect()), sorted((tuple(r) for r in issues.collect()), key=str)
        out = {
            "id": name, "title": title, "content_hash": whole, "counts": counts, "profiles": found, "edges": links, "declared": [list(e) for e in self.edges], "primary": {t: list(c) for t, c in self.primary.items()}, "issues": problems,
            "types": types, "score": score, "classes": [r.asDict() for r in semantics.describe(columns).collect()], "columns": [(t, c, kind, pk, fk) for t, _, c, _, kind, pk, fk in rows],
        }
        out["insights"] = self.insights(out)
        out["manual"] = docs.Manual(title, out, self.provider).text()
        self.current = out
        if name:
            for t, df in self.tables.items():
                df.write.mode("overwrite").parquet(str(self.registry.raw_path(name) / f"{t}.parquet"))
            self.registry.store(name, "schema", {t: {"columns": df.dtypes, "primary_key": list(self.primary.get(t, ()))} for t, df in self.tables.items()})
            self.registry.store(name, "insights", out["insights"])
            self.registry.store(name, "stats", {"counts": counts, "score": score, "profiles": {t: len(p) for t, p in found.items()}})
            self.registry.store(name, "manual", out["manual"])
            self.registry.store(name, "analysis", out)
        return out

    def insights(self, a: dict) -> dict:
        """Totals, size classes, issues by severity, and relationships declared and inferred."""
        size = lambda n: "large" if n > 10_000 else "medium" if n > 1000 else "small"
        kinds = {t: sum(c[0] == t for c in a["columns"]) for t in a["counts"]}
        severe = [s.lower() for *_, s in a["issues"]]
        high, medium = sum(s in ("high", "critical") for s in severe), sum(s in ("medium", "warning") for s in severe)
        declared = {tuple(e) for e in a["declared"]}
        told = sum(tuple(e) in declared for e in a["edges"])
        return {
            "overview": {"tables": len(kinds), "columns": sum(kinds.values()), "rows": sum(a["counts"].values()), "quality_score": a["score"]},
            "tables": [{"name": t, "type": a["types"].get(t), "size": size(n), "rows": n, "columns": kinds[t]} for t, n in sorted(a["counts"].items())],
            "quality": {"high": high, "medium": medium, "total": len(severe), "first": [list(i) for i in a["issues"][:5]]},
            "relationships": {"total": len(a["edges"]), "declared": told, "inferred": len(a["edges"]) - told},
        }

    def _analysis(self) -> dict:
        return self.current or self.analyze()

    def _profiles(self, found: dict) -> DataFrame:
        rows = [(t, k, r["column_name"], r["total_count"], r["null_count"], r["distinct_count"], r["null_ratio"], r["uniqueness"]) for t, p in found.items() for k, r in enumerate(p)]
        return self.spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, total_count long, null_count long, distinct_count long, null_ratio double, uniqueness double")

    # --- what is stored -------------------------------------------------------------------------------------------

    def _stored(self, name: str) -> dict:
        if not self.registry or not (kept := self.registry.fetch(name, "analysis")):
            raise KeyError(f"no dataset {name}")
        return kept

    def datasets(self) -> list[dict]:
        return [{"id": n, **self.registry.get(n)} for n in self.registry.list()]

    def info(self, name: str) -> dict:
        if (found := self.registry.get(name)) is None:
            raise KeyError(f"no dataset {name}")
        return {"id": name, **found, "outputs": self.registry.manifest(name)}

    def analysis(self, name: str) -> dict:
        return self._stored(name)

    def manual(self, name: str | None = None) -> str:
        """The stored manual of a dataset, or the current one's; written anew if it isn't there."""
        a = self._stored(name) if name else self._analysis()
        return (self.registry.fetch(name, "manual") if name else a.get("manual")) or docs.Manual(a["title"], a, self.provider).text()

    def export_manual(self, folder: str, name: str | None = None) -> str:
        path = Path(folder) / docs.file_name(name or self._analysis()["title"])
        path.write_text(self.manual(name))
        return str(path)

    def delete(self, name: str) -> bool:
        self._indexes.pop(name, None)
        return self.registry.delete(name)

    def stats(self) -> dict:
        return self.registry.stats()

    def verify(self, name: str) -> bool:
        """Whether the stored copy still has the content that the dataset is known by."""
        stored = self._stored(name)
        hashes = [identity.fingerprint(self.spark.read.parquet(path)).first().content_hash for _, path in sorted(self.registry.raw_tables(name).items())]
        return identity.next_hash("", "".join(hashes)) == stored["content_hash"]

    # --- questions, SQL, search ------------------------------------------------------------------------------------

    def ask(self, question: str) -> tuple[nlq.Plan, DataFrame]:
        types = self.current["types"] if self.current else {}
        said = {t: self.provider.table(t, types.get(t, "unknown"), df.columns) for t, df in self.tables.items()}
        return nlq.ask(question, nlq.Schema.of(self._rows(), self.edges, said), self.tables)

    def sql(self, text: str) -> sandbox.Result:
        return sandbox.execute(self.spark, text)

    def frames(self, a: dict) -> dict[str, DataFrame]:
        """An analysis as metadata DataFrames."""
        make = self.spark.createDataFrame
        order = {t: [r["column_name"] for r in p] for t, p in a["profiles"].items()}
        columns = make([(t, order[t].index(c), c, kind, kind, bool(pk), bool(fk)) for t, c, kind, pk, fk in a["columns"]], catalog.COLUMN_DDL)
        shape: dict[str, list[int]] = {t: [0, 0, 0] for t in a["counts"]}
        for t, _, _, pk, fk in a["columns"]:
            shape[t] = [shape[t][0] + 1, shape[t][1] + bool(pk), shape[t][2] + bool(fk)]
        tables = make([(t, n, *shape[t]) for t, n in a["counts"].items()], "table_name string, row_count long, n_columns int, n_pk int, n_fk int")
        return {
            "columns": columns, "tables": tables, "profiles": self._profiles(a["profiles"]), "edges": make([tuple(e) for e in a["edges"]], catalog.EDGE_DDL),
            "issues": make([tuple(i) for i in a["issues"]], "table_name string, column_name string, issue_type string, severity string"), "types": make(list(a["types"].items()), "table_name string, table_type string"),
            "classes": make([(c["table_name"], c["column_name"], c["web_type"]) for c in a["classes"]], "table_name string, column_name string, web_type string"),
        }

    def chunks(self, a: dict | None = None) -> DataFrame:
        a = a or self._analysis()
        f = self.frames(a)
        total = chunks.totals(f["tables"], f["columns"], f["edges"], int(a["score"] or 0), len(a["issues"]))
        samples = self.spark.createDataFrame(docs.Manual(a["title"], a).queries(), "title string, sql string")
        return chunks.numbered([
            chunks.overview(total, a["title"]), chunks.tables(f["tables"], f["columns"], f["types"]), chunks.columns(f["columns"], f["profiles"], f["classes"]), chunks.relationships(f["edges"]), chunks.issues(f["issues"]),
            chunks.queries(samples), chunks.across_tables(f["tables"], f["columns"], f["edges"], f["profiles"]), chunks.statistics(total),
        ])

    def index(self, name: str | None = None) -> tuple[retrieval.Index, dict]:
        """The search index of a dataset (by default the current one) and its chunks by number; kept open, and made from stored chunks if there are any."""
        a = self._stored(name) if name else self._analysis()
        key = name or a["content_hash"] or f"{a['title']} {id(a)}"
        if key in self._indexes:
            self._indexes.move_to_end(key)
            return self._indexes[key]
        stored = self.registry.fetch(a["id"], "chunks") if self.registry and a["id"] else None
        rows = stored or [r.asDict() for r in self.chunks(a).orderBy("doc_id").collect()]
        corpus = self.spark.createDataFrame([(r["doc_id"], r["content"], r["keywords"], r["importance"]) for r in rows], "doc_id long, content string, keywords array<string>, importance double")
        made = retrieval.build(corpus)
        if self.registry and a["id"] and not stored:
            self.registry.store(a["id"], "chunks", rows)
            self.registry.store(a["id"], "index_meta", {"chunk_count": len(rows), "strategies": ["tfidf", "bm25", "keyword", "hybrid"], "features": made.features.count()})
        self._indexes[key] = made, {r["doc_id"]: r for r in rows}
        while len(self._indexes) > MOST_INDEXES:
            self._indexes.popitem(last=False)
        return self._indexes[key]

    def index_stats(self, name: str | None = None) -> dict:
        made, held = self.index(name)
        kinds: dict[str, int] = {}
        for r in held.values():
            kinds[r["chunk_type"]] = kinds.get(r["chunk_type"], 0) + 1
        return {"chunks": len(held), "chunk_types": kinds, "features": made.features.count(), "bm25_terms": made.postings.filter("kind = 'b'").select("term").distinct().count(), "semantic": made.vectors is not None}

    def search(self, question: str, k: int = 10, strategy: str = "hybrid", name: str | None = None) -> dict:
        """The answer to a question about a dataset, with its evidence; the dataset is indexed if it wasn't."""
        made, held = self.index(name)
        found = retrieval.search(made, question, min(max(k, 1), 20), strategy)
        rows = [(held[i], s) for i, s in found]
        return {
            "intent": retrieval.answer_intent(question), "answer": retrieval.answer(question, [(r["content"], r["chunk_type"]) for r, _ in rows]), "confidence": retrieval.confidence_of([s for _, s in rows]),
            "results": [(r["chunk_id"], s) for r, s in rows], "chunks_searched": len(held),
        }

    # --- charts ---------------------------------------------------------------------------------------------------

    def er_diagram(self) -> str:
        a = self._analysis()
        declared = [tuple(e) for e in a["declared"]]
        return docs.mermaid(a["columns"], declared, implicit=[tuple(e) for e in a["edges"] if tuple(e) not in declared])

    def er_data(self) -> dict:
        a = self._analysis()
        declared = [tuple(e) for e in a["declared"]]
        return docs.diagram_data(a["columns"], declared, [tuple(e) for e in a["edges"] if tuple(e) not in declared])

    def _charts(self, f: dict[str, DataFrame], score: int) -> dict:
        ratio = f["columns"].join(f["profiles"].select("table_name", "column_name", "uniqueness"), ["table_name", "column_name"])
        points = self.spark.createDataFrame([(score,)], "score int")
        return {
            "table_size": lambda: charts.table_size(f["tables"]), "table_type": lambda: charts.by_type(f["types"], "table_type", "table_type"), "table_share": lambda: charts.table_share(f["tables"]), "density": lambda: charts.density(f["tables"]),
            "table_dna": lambda: charts.dna(f["columns"]), "column_types": lambda: charts.by_type(f["columns"], "display_type", "display_type"), "null_by_table": lambda: charts.null_by_table(f["profiles"]),
            "null_by_column": lambda: charts.null_by_column(f["profiles"]), "column_fingerprint": lambda: charts.column_fingerprint(f["profiles"]), "quality_gauge": lambda: charts.gauge(points, f["issues"]),
            "quality_issues": lambda: charts.severities(f["issues"]), "completeness": lambda: charts.completeness(f["tables"], f["profiles"], f["edges"]), "network": lambda: charts.network_edges(f["edges"], relations.scored(ratio)),
            "matrix": lambda: relations.matrix(f["edges"]), "hierarchy": lambda: charts.hierarchy(f["edges"]), "flows": lambda: charts.flows(f["edges"]), "node_sizes": lambda: charts.node_sizes(f["tables"]),
            "fk_coverage": lambda: charts.fk_coverage(f["tables"], f["edges"]), "sunburst": lambda: charts.sunburst(f["columns"]), "row_statistics": lambda: charts.row_statistics(f["tables"]),
            "overview": lambda: charts.overview(f["tables"], f["columns"], f["issues"], f["tables"].agg(F.count("*").alias("tables"), F.sum("row_count").alias("rows"), F.sum("n_columns").alias("columns"))),
        }

    def chart_names(self) -> list[str]:
        return ["table_size", "table_type", "table_share", "density", "table_dna", "column_types", "null_by_table", "null_by_column", "column_fingerprint", "quality_gauge", "quality_issues", "completeness", "network", "matrix", "hierarchy", "flows", "node_sizes", "fk_coverage", "sunburst", "row_statistics", "overview"]

    def chart_data(self, name: str) -> DataFrame:
        if name not in self.chart_names():
            raise KeyError(f"no chart {name}")
        a = self._analysis()
        return self._charts(self.frames(a), int(a["score"] or 0))[name]()

    def all_chart_data(self) -> dict[str, DataFrame]:
        a = self._analysis()
        made = self._charts(self.frames(a), int(a["score"] or 0))
        return {n: made[n]() for n in self.chart_names()}
