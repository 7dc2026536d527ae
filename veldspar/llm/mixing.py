"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each document has a key E / quality with E exponential from a hash of its id and text; ascending keys are a weighted
random order without replacement. Quality falls with symbols per word, repeated lines and odd word lengths, statistics
of the quality rules that are counted here natively. A source whose target is t times its size takes every document
floor(t) times, and then documents in key order until the words of the rest are reached. The order is that of ranges of
(source, key), over which sizes are summed in two levels: ranges first, and single rows within the one range per source
that holds the cut. So no source is sorted or gathered in one task, however large, and neither are the sources.

Targets: sources in code-point order, null last, have the weights 3, 1, 2, repeating, and share `share` times all
words; a target stops at `most` times its source's words, and the excess is shared again by weight until none is above.

Defined cases: null texts have no words; texts of any length are counted whole; null is a source of its own; rows of
equal keys (equal id and text) are taken one by one, in the order in which they were written; the row at the cut is taken
if half of it or more lies before the cut; sources without words have target 0; an empty table gives an empty mix; extra columns whose names clash
with result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, checked_broadcast, hash_uniform, lookup, materialize, plain_names, ranged, running

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
RESULT = ("size", "source_size", "target", "taken")
#: The lowest quality weight.
LEAST_QUALITY = 0.05


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A weight from LEAST_QUALITY to 1; size: the text's words. It is 1 over 1 + 10 symbols a word + 2 repeated lines a line + the distance of the mean word from 3 to 10 characters."""
    text = F.coalesce(text, F.lit(""))
    n = F.greatest(size, F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    mean = F.length(F.translate(text, " \t\n\x0b\x0c\r", "")) / n
    lines = F.split(text, "\n")
    repeated = (F.size(lines) - F.size(F.array_distinct(lines))) / F.size(lines)
    odd = F.greatest(mean - 10.0, 3.0 - mean, F.lit(0.0))
    return F.greatest(F.lit(LEAST_QUALITY), 1.0 / (1.0 + 10.0 * symbols / n + 2.0 * repeated + odd))


def key_of(doc_id: Column, text: Column, weight: Column, seed: int = 0) -> Column:
    """The Efraimidis-Spirakis key: an exponential variate over the weight."""
    u = hash_uniform(F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit("")), F.lit(seed))
    return -F.log1p(-u) / weight


def keyed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """docs with _vs_source (never null: sources under s, null as n), _vs_size, _vs_weight, _vs_key and _vs_row, a number that tells equal rows apart once it is written."""
    t = F.col(text)
    out = docs.withColumns({"_vs_size": words(t), "_vs_source": F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))})
    out = out.withColumn("_vs_weight", quality(t, F.col("_vs_size")))
    return out.withColumns({"_vs_key": key_of(F.col(doc_id), t, F.col("_vs_weight"), seed), "_vs_row": F.monotonically_increasing_id()})


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """_vs_source, source_size and target of a table of _vs_source and source_size.

    With sources in order of size to weight, the final level is that of the first one whose level, if all before it
    stand at their stops, lies below its own stop; that is what resharing round by round ends at. Ranks and sums come in
    two levels over ranges, so there may be any number of sources; sizes are summed as whole numbers.
    """
    by_name = [(F.col("_vs_source") == "n").asc(), F.col("_vs_source").asc()]
    named = running(ranged(sources, by_name, "mix-names"), {"rank": F.lit(1)}, by_name, [])
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = materialize(named.select("_vs_source", "source_size", w.alias("w")).withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("w")), "mix-weights")
    every = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    order = [F.col("ratio").asc(), F.col("_vs_source").asc()]
    summed = running(ranged(weighed, order, "mix-levels"), {"sizes": F.col("source_size"), "ws": F.col("w")}, order, [])
    left = F.lit(share * every[0]) - F.lit(float(most)) * (F.col("sizes") - F.col("source_size"))
    level = left / (F.lit(every[1]) - F.col("ws") + F.col("w"))
    first = summed.withColumn("level", level).filter(F.col("level") <= F.col("ratio")).agg(F.max(F.struct((-F.col("ratio")).alias("r"), "level"))).first()[0]
    final = F.lit(None if first is None else float(first["level"])).cast("double")
    return weighed.select("_vs_source", "source_size", F.least(final * F.col("w"), F.lit(float(most)) * F.col("source_size")).alias("target"))


def plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: _vs_source, source_size, target, epochs, cut and to: rows whose key and number lie below cut (with to: also at it) are taken once more.

    rows: _vs_source, _vs_size, _vs_key and _vs_row of every document, a written table.
    """
    sources = materialize(rows.groupBy("_vs_source").agg(F.sum("_vs_size").alias("source_size")), "mix-sources")
    aims = targets(sources, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aims = materialize(aims.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-targets")
    placed = ranged(rows.select("_vs_source", "_vs_key", "_vs_row", "_vs_size"), [F.col("_vs_source"), F.col("_vs_key"), F.col("_vs_row")], "mix-ranges")
    sums = ranged_sums(placed)
    met = lookup(sums, aims.select("_vs_source", "rest"), "_vs_source", "inner")
    edge = met.filter((F.col("after") > F.col("rest")) & (F.col("rest") > 0)).groupBy("_vs_source").agg(F.min(F.struct("range", "after", "s", "rest")).alias("e"))
    edge = materialize(edge.select("_vs_source", F.col("e.range").alias("range"), (F.col("e.after") - F.col("e.s")).alias("ahead"), F.col("e.rest").alias("rest")), "mix-edges")
    upto = running_in_range(placed.join(checked_broadcast(edge), ["_vs_source", "range"]))
    place = F.struct("_vs_key", "_vs_row")
    cut = upto.groupBy("_vs_source").agg(F.min(F.when(F.col("ahead") + F.col("upto") - F.col("_vs_size") / 2.0 > F.col("rest"), place)).alias("cut"), F.max(place).alias("last"))
    cut = materialize(cut.select("_vs_source", F.coalesce("cut", "last").alias("cut"), F.col("cut").isNull().alias("to")), "mix-cuts")
    return materialize(lookup(aims, cut, "_vs_source").select("_vs_source", "source_size", "target", "epochs", "cut", "to"), "mix-plan")


def ranged_sums(placed: DataFrame) -> DataFrame:
    """_vs_source, range, s and after: the words of a source in a range, and up to its end; a row for each range of a source."""
    sums = placed.groupBy("_vs_source", "range").agg(F.sum("_vs_size").alias("s"))
    return materialize(sums.withColumn("after", F.sum("s").over(Window.partitionBy("_vs_source").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))), "mix-sums")


def running_in_range(inside: DataFrame) -> DataFrame:
    """inside with upto, the words up to each row within its source's range."""
    return inside.withColumn("upto", F.sum("_vs_size").over(Window.partitionBy("_vs_source", "range").orderBy("_vs_key", "_vs_row").rowsBetween(Window.unboundedPreceding, 0)))


def taken(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows, a written table, with source_size, target, copies and taken."""
    out = lookup(rows, plan, "_vs_source", "inner")
    place = F.struct("_vs_key", "_vs_row")
    early = F.coalesce((place < F.col("cut")) | (F.col("to") & (place == F.col("cut"))), F.lit(False))
    out = out.withColumn("copies", F.col("epochs") + early.cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("_vs_size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """One row per document: its id, size, source_size, target, taken and copies."""
    narrow = keyed(docs.select(F.col(doc_id).alias("id"), F.col(source).alias("source"), F.col(text).alias("text")), "id", "source", "text", seed)
    rows = materialize(narrow.select("id", "_vs_source", "_vs_size", "_vs_key", "_vs_row"), "mix-rows")
    return taken(rows, plan(rows)).select(F.col("id").alias(doc_id), F.col("_vs_size").alias("size"), "source_size", "target", "taken", "copies")


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = 0) -> DataFrame:
    """The documents of the mix: all columns of those taken at least once, with size, source_size, target, copies and taken.

    Texts are read and counted once and written with their keys.
    """
    renamed, names = plain_names(docs)
    rows = materialize(keyed(renamed, names[doc_id], names[source], names[text], seed), "mix-documents")
    out = taken(rows, plan(rows)).filter(F.col("copies") > 0)
    clash = {"size", "source_size", "target", "copies", "taken"}
    stay = [F.col(new).alias(old) for old, new in names.items() if old.lower() not in clash]
    return out.select(*stay, F.col("_vs_size").alias("size"), "source_size", "target", "copies", "taken")
