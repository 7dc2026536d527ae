"""Relationships between tables, their cardinality and the dependency graph. Metadata is small; graph walks are driver-side."""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import checked_broadcast

# Type families and pattern scores.
FAMILIES = [r"int", r"float|double|real|decimal|numeric", r"char|text|string", r"date|time", r"bool|bit"]


def _family(kind: Column) -> Column:
    kind = F.lower(kind)
    out = F.lit(None).cast("int")
    for k, p in reversed(list(enumerate(FAMILIES))):
        out = F.when(kind.rlike(p), k).otherwise(out)
    return out


def type_score(a: Column, b: Column) -> Column:
    """1 for equal types, .9 in a family, .8 for whole and real numbers, .6 if either is text, else 0."""
    fa, fb = _family(a), _family(b)
    return F.when(F.lower(a) == F.lower(b), 1.0).when(fa == fb, 0.9).when(fa.isin(0, 1) & fb.isin(0, 1), 0.8).when((fa == 2) | (fb == 2), 0.6).otherwise(0.0)


def pattern_score(column: Column, table: Column) -> Column:
    """How much a column's name looks like a key of a table."""
    c, t = F.lower(column), F.lower(table)
    stem = F.when(t.endswith("s"), t.substr(F.lit(1), F.length(t) - 1))
    return (
        F.when(c == F.concat(t, F.lit("_id")), 0.98).when(c == F.concat(F.lit("fk_"), t), 0.97).when(c == F.concat(t, F.lit("id")), 0.95).when(c == F.concat(t, F.lit("_fk")), 0.95)
        .when(c == F.concat(stem, F.lit("_id")), 0.92).when(c == F.concat(F.lit("id_"), t), 0.9).when(c == F.concat(t, F.lit("_ref")), 0.9).when(c == F.concat(t, F.lit("_key")), 0.88)
        .when(c.startswith(t) & c.endswith("id"), 0.8).when(c.contains(t) & c.rlike("id|key|ref"), 0.75).otherwise(0.0)
    )


def cardinality_scored(source_ratio: Column, target_ratio: Column) -> Column:
    """By uniqueness ratios: a repeating source and a unique target make N:1."""
    return F.when((source_ratio > 0.95) & (target_ratio > 0.95), "1:1").when((source_ratio < 0.5) & (target_ratio > 0.95), "N:1").when((source_ratio > 0.95) & (target_ratio < 0.5), "1:N").otherwise("N:M")


def cardinality_confidence(cardinality: Column) -> Column:
    return F.when(cardinality == "N:1", 0.95).when(cardinality == "1:1", 0.9).when(cardinality == "1:N", 0.85).otherwise(0.7)


def cardinality_cli(source_unique: Column, target_unique: Column, composite: Column) -> Column:
    return F.when(composite, "N:M").when(source_unique & target_unique, "1:1").when(~source_unique & target_unique, "N:1").when(source_unique & ~target_unique, "1:N").otherwise("N:M")


def explicit(edges: DataFrame, columns: DataFrame) -> DataFrame:
    """Declared edges between known tables; identifying if the column is part of the source's key."""
    known = columns.select("table_name").distinct()
    pk = columns.filter("is_pk").select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), F.lit(True).alias("p"))
    inside = edges.join(checked_broadcast(known), edges.to_table == known.table_name, "left_semi")
    return inside.join(checked_broadcast(pk), ["from_table", "from_column"], "left").select("from_table", "from_column", "to_table", "to_column", F.coalesce("p", F.lit(False)).alias("is_identifying"), F.lit("many-to-one").alias("relationship_type"))


def implicit(columns: DataFrame) -> DataFrame:
    """Edges by name: <t>_id, <t>id, fk_<t>, <t without s>_id, id_<t>, and x_<stem>key where t's own key is y_<stem>key."""
    single = columns.filter("is_pk").groupBy("table_name").agg(F.count("*").alias("n"), F.first("column_name").alias("to_column"), F.first("declared_type").alias("to_type")).filter("n = 1")
    targets = single.select(F.col("table_name").alias("to_table"), "to_column", "to_type")
    t, stem = F.lower("to_table"), F.regexp_replace(F.lower("to_table"), "s$", "")
    names = F.array(F.concat(t, F.lit("_id")), F.concat(t, F.lit("id")), F.concat(F.lit("fk_"), t), F.concat(stem, F.lit("_id")), F.concat(F.lit("id_"), t))
    # one row a name, so that metadata meets by equality and not pair by pair
    by_name = targets.select("*", F.explode(F.array_distinct(names)).alias("k"))
    by_key = targets.filter(F.lower("to_column").rlike("^[a-z]+_[a-z]+key$")).select("*", F.regexp_extract(F.lower("to_column"), "^[a-z]+_([a-z]+key)$", 1).alias("k"))
    source = columns.filter("not is_pk")
    a = source.withColumn("k", F.lower("column_name")).join(checked_broadcast(by_name), "k")
    b = source.withColumn("k", F.regexp_extract(F.lower("column_name"), "^[a-z]+_([a-z]+key)$", 1)).join(checked_broadcast(by_key), "k")
    both = a.unionByName(b).filter(F.col("table_name") != F.col("to_table"))
    alike = (_family(F.col("declared_type")) == _family(F.col("to_type"))) & _family(F.col("to_type")).isin(0, 2)
    return both.filter(alike).select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), "to_table", "to_column").distinct()


def implicit_by_suffix(columns: DataFrame, source: str = "database") -> DataFrame:
    """Edges of <x>_id columns to the tables x, xs and xes, the first of them that exists.

    database: columns that aren't declared keys, also to x without its s, never to their own table. files: columns that
    are marked as keys, and their own table counts. The target's single key column, or id where it has none.
    """
    stem = F.substring(F.lower("column_name"), 1, F.length("column_name") - 3)
    tries = [stem, F.concat(stem, F.lit("s")), F.concat(stem, F.lit("es"))] + ([F.regexp_replace(stem, "s$", "")] if source == "database" else [])
    asking = columns.filter(F.lower("column_name").endswith("_id") & (~F.col("is_fk") if source == "database" else F.col("is_fk")))
    each = asking.select("table_name", "column_name", F.posexplode(F.array(*tries)).alias("rank", "k"))
    keyed = F.when(F.sum(F.col("is_pk").cast("int")) == 1, F.max(F.when(F.col("is_pk"), F.col("column_name"))))
    targets = columns.groupBy(F.col("table_name").alias("to_table")).agg(F.coalesce(keyed, F.lit("id")).alias("to_column")).withColumn("k", F.lower("to_table"))
    met = each.join(checked_broadcast(targets), "k")
    if source == "database":
        met = met.filter(F.col("table_name") != F.col("to_table"))
    best = met.groupBy("table_name", "column_name").agg(F.min(F.struct("rank", "to_table", "to_column")).alias("b"))
    return best.select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), "b.to_table", "b.to_column")


def scored(columns: DataFrame) -> DataFrame:
    """Candidate edges by .5 pattern + .3 type + .2 cardinality confidence. columns: metadata with uniqueness; pattern above .5."""
    pk = columns.filter("is_pk").select(F.col("table_name").alias("to_table"), F.col("column_name").alias("to_column"), F.col("declared_type").alias("to_type"), F.col("uniqueness").alias("to_ratio"))
    # every pattern has the table's name, or its name without s, in the column's: pairs meet by the runs of letters of the column
    c = F.lower("column_name")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.transform(F.sequence(F.lit(1), F.length(c) - i + 1), lambda n: c.substr(i, n))))
    stem = F.regexp_replace(F.lower("to_table"), "s$", "")
    asking = columns.filter("not is_pk").withColumn("k", F.explode(F.array_distinct(runs)))
    named = pk.withColumn("k", F.explode(F.array_distinct(F.array(F.lower("to_table"), stem))))
    pairs = asking.join(checked_broadcast(named), "k").filter(F.col("table_name") != F.col("to_table")).drop("k").distinct()
    pattern = pattern_score(F.col("column_name"), F.col("to_table"))
    out = pairs.withColumn("pattern", pattern).filter("pattern > 0.5").withColumn("cardinality", cardinality_scored(F.col("uniqueness"), F.col("to_ratio")))
    score = 0.5 * F.col("pattern") + 0.3 * type_score(F.col("declared_type"), F.col("to_type")) + 0.2 * cardinality_confidence(F.col("cardinality"))
    return out.select(F.col("table_name").alias("from_table"), F.col("column_name").alias("from_column"), "to_table", "to_column", "cardinality", F.round(score, 4).alias("score"))


def similar_names(columns: DataFrame) -> DataFrame:
    """Jaccard similarity of the bigrams of column names across tables that share one: names meet by bigram."""
    from ..functions.text import char_grams, jaccard

    one = columns.select("table_name", "column_name", char_grams(F.col("column_name")).alias("grams"))
    each = one.withColumn("g", F.explode("grams"))
    a, b = (each.select(F.col("g"), *[F.col(c).alias(f"{side}_{c}") for c in ("table_name", "column_name", "grams")]) for side in ("a", "b"))
    met = a.join(checked_broadcast(b), "g").filter(F.col("a_table_name") < F.col("b_table_name")).drop("g").distinct()
    return met.select("a_table_name", "a_column_name", "b_table_name", "b_column_name", F.round(jaccard(F.col("a_grams"), F.col("b_grams")), 6).alias("similarity"))


def table_types(edges: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Types by degree: many out and none in are facts, or bridges if their key lies within foreign keys; and so on."""
    out = edges.groupBy(F.col("from_table").alias("table_name")).agg(F.countDistinct("to_table").alias("n_out"))
    into = edges.groupBy(F.col("to_table").alias("table_name")).agg(F.countDistinct("from_table").alias("n_in"))
    keys = columns.filter("is_pk").groupBy("table_name").agg(F.min(F.col("is_fk").cast("int")).alias("pk_in_fk"))
    t = tables.select("table_name").join(out, "table_name", "left").join(into, "table_name", "left").join(keys, "table_name", "left").fillna(0)
    name = F.lower("table_name")
    alone = F.when(name.rlike("log|audit|history"), "audit").when(name.rlike("config|setting|param"), "configuration").when(name.rlike("tmp|temp|staging|stg"), "staging").otherwise("unknown")
    kind = F.when((F.col("n_out") >= 2) & (F.col("n_in") == 0), F.when(F.col("pk_in_fk") == 1, "bridge").otherwise("fact")).when((F.col("n_in") > 0) & (F.col("n_out") == 0), "dimension").when(F.col("n_out") > 0, "fact").otherwise(alone)
    return t.select("table_name", "n_out", "n_in", kind.alias("table_type"))


def roles(edges: DataFrame, tables: DataFrame) -> DataFrame:
    """core: only referenced; transaction: references others; isolated: neither."""
    out = edges.select(F.col("from_table").alias("table_name")).distinct().withColumn("o", F.lit(True))
    into = edges.select(F.col("to_table").alias("table_name")).distinct().withColumn("i", F.lit(True))
    t = tables.select("table_name").join(checked_broadcast(out), "table_name", "left").join(checked_broadcast(into), "table_name", "left")
    return t.select("table_name", F.when(F.col("o"), "transaction").when(F.col("i"), "core").otherwise("isolated").alias("role"))


def roots(edges: DataFrame) -> DataFrame:
    """Tables that are referenced and reference none."""
    return edges.select(F.col("to_table").alias("table_name")).distinct().join(checked_broadcast(edges.select(F.col("from_table").alias("table_name"))), "table_name", "left_anti")


def most_connected(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("from_table").alias("table_name")).unionAll(edges.select(F.col("to_table").alias("table_name")))
    return both.groupBy("table_name").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "table_name").limit(1)


def sentences(edges: DataFrame) -> DataFrame:
    text = F.concat(F.lit("Each "), "from_table", F.lit(" belongs to one "), "to_table", F.lit("; a "), "to_table", F.lit(" can have many "), "from_table")
    return edges.select("from_table", "to_table", text.alias("sentence")).distinct()


def matrix(edges: DataFrame) -> DataFrame:
    """Strength of each ordered pair: 1 along a declared edge, .5 against it."""
    ahead = edges.select(F.col("from_table").alias("a"), F.col("to_table").alias("b"), F.lit(1.0).alias("s"))
    return ahead.unionAll(ahead.select("b", "a", F.lit(0.5))).groupBy("a", "b").agg(F.max("s").alias("strength"))


def load_order(pairs: list[tuple[str, str]], names: list[str]) -> list[str]:
    """Parents before children, first in first out; tables on cycles come last."""
    parents, children = defaultdict(set), defaultdict(set)
    for child, parent in pairs:
        parents[child].add(parent)
        children[parent].add(child)
    ready, out = deque(n for n in names if not parents[n]), []
    while ready:
        n = ready.popleft()
        out.append(n)
        for c in sorted(children[n]):
            parents[c].discard(n)
            if not parents[c]:
                ready.append(c)
    return out + [n for n in names if n not in out]


def cycles(pairs: list[tuple[str, str]]) -> list[list[str]]:
    """Each cycle that a depth-first walk closes."""
    graph, found, done = defaultdict(list), [], set()
    for a, b in pairs:
        graph[a].append(b)

    def walk(node: str, path: list[str]) -> None:
        if node in path:
            found.append(path[path.index(node) :] + [node])
        elif node not in done:
            for nxt in graph[node]:
                walk(nxt, [*path, node])
            done.add(node)

    for node in list(graph):
        walk(node, [])
    return found


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose present key has no parent: an anti-join, which repeated parents can't inflate."""
    have = parent.select(F.col(key).alias("_key")).filter("_key is not null").distinct()
    return child.filter(F.col(column).isNotNull()).join(have, F.col(column) == F.col("_key"), "left_anti")
