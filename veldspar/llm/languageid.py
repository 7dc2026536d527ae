"""Language of texts by Bayesian fusion of four kinds of evidence.

1. Text: naive Bayes over hashed 4-byte grams of whole texts, learned from a bounded sample of labelled documents.
   The mean log-likelihood of a gram counts as EFFECTIVE grams at most, for neighbouring grams aren't independent.
2. Declared markup language: how often each language declares each value.
3. Address: the host's suffix (its last label), and a language-like first path segment.
4. Host prior: language shares of a host, smoothed towards its registered domain, and that towards the whole corpus.

Shares for 2 to 4 are grouped sums of text posteriors over all rows, from each of which a row's own posterior is taken
out before the row is judged by them, so that no row confirms itself. Each kind of evidence counts once: the suffix is
no level of the prior. A text whose grams are likelier under a flat model than under each known language and under the
mixture of all is in none of them: language `und`, not kept. (The mixture alone would ask more of a text the more
languages there are; it stands for texts in several languages.) The `MOST_LANGUAGES` languages of most labelled rows
are known; those are the columns of the model.

Defined cases: null texts and texts without letters are `und` unless a declaration, address or host names a language
with a posterior of 0.5 or more, and are never kept; texts of any length are scored whole; null evidence is no evidence;
a port is no part of a host; equal posteriors go to the first language in code-point order, as do equal numbers of
labelled rows; repeated rows count as often as they occur; with no labelled rows everything is `und`; an empty table
has no results; extra columns whose names clash with result columns are replaced.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, bounded_sample, drop_rows, lookup, map_columns, materialize, named_back, plain_names, without

BITS, GRAM, ALPHA = 16, 4, 0.5
EFFECTIVE = 40.0
#: Labelled documents of each language that the text model is fitted on, about.
SAMPLE_ROWS = 400
#: Languages of the model; a corpus may have labels in any number of languages.
MOST_LANGUAGES = 100
#: Pseudo-rows of each parent level in a host prior, and of each cell in the declaration and address tables.
SMOOTHING, CELL = 5.0, 0.5
UND = "und"
RESULT = ("language", "confidence", "known", "kept")
#: A-Z to lower case, every other ASCII byte that is no letter to a space.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MARKUP = re.compile(rb"<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all 4-byte windows of the texts in a row, and where each text's own grams start and end.

    Letters only, words apart by one space, each text fenced by spaces; windows that run from one text into the next
    lie outside of the ranges.
    """
    parts = [b" ".join((t or b"").translate(_TABLE).split()) for t in texts]
    data = b"".join(b" " + p + b" " for p in parts) + b"    "
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes + 2) - sizes - 2
    wide = np.ndarray((len(data) - GRAM + 1,), np.dtype("<u4"), data, strides=(1,))
    h = wide * np.uint32(2654435761)
    h >>= np.uint32(32 - BITS)
    return h, starts, starts + np.where(sizes > 0, np.maximum(sizes + 2 - GRAM + 1, 0), 0)


@dataclass
class TextModel:
    """languages, and log-probabilities of each hashed gram: a column a language, then their mixture."""

    languages: list[str]
    table: np.ndarray

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By text: tempered log-likelihoods a language, whether the text is in a known language, the number of grams."""
        h, starts, ends = grams(texts)
        n = ends - starts
        rows = np.add.reduceat(self.table.take(h, axis=0), np.stack([starts, ends], axis=1).ravel(), axis=0)[::2]
        sums = np.where(n[:, None] > 0, rows, 0.0)  # an empty range has a row of its own
        mean = sums / np.maximum(n, 1)[:, None]
        known = (n > 0) & (mean.max(axis=1) > -BITS * np.log(2.0)) if self.languages else np.zeros(len(texts), bool)
        return mean[:, :-1] * np.minimum(n, EFFECTIVE)[:, None], known, n


def fit_text(labelled: DataFrame, text: str = "text", language: str = "lang", key: str = "doc_id", rows: int = SAMPLE_ROWS, most_languages: int = MOST_LANGUAGES) -> TextModel:
    """Gram counts a language over a bounded sample of labelled rows, summed on the executors; the table's size is fixed."""
    tag = F.lower(F.trim(F.col(language)))
    told = labelled.filter(F.col(text).isNotNull() & (tag != ""))
    counts = {r[0]: r[1] for r in told.groupBy(tag.alias("s")).count().orderBy(F.desc("count"), "s").limit(most_languages).collect()}
    sample = bounded_sample(told, tag, F.col(key), rows, counts).select(tag.alias("lang"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            table = batch.column(0).to_pylist()
            names = sorted(set(table))
            of = {v: k for k, v in enumerate(names)}
            texts = as_bytes(batch.column(1))
            totals = np.zeros((len(names), 1 << BITS), np.int64)
            for k, t in enumerate(texts):
                h, starts, ends = grams([t])
                totals[of[table[k]]] += np.bincount(h[starts[0] : ends[0]], minlength=1 << BITS)
            for k, name in enumerate(names):
                at = np.flatnonzero(totals[k])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(totals[k][at])], names=["lang", "h", "n"])

    got = sample.mapInArrow(count, "lang string, h int, n long").groupBy("lang", "h").agg(F.sum("n").alias("n")).toArrow()
    lang, h, n = got.column("lang").to_pylist(), np.asarray(got.column("h")), np.asarray(got.column("n"))
    languages = sorted(set(lang))
    of = {v: k for k, v in enumerate(languages)}
    counts = np.full((len(languages), 1 << BITS), ALPHA)
    np.add.at(counts, (np.array([of[x] for x in lang], np.int64), h), n)
    p = counts / counts.sum(axis=1, keepdims=True)
    mixture = p.mean(axis=0, keepdims=True) if len(languages) else np.full((1, 1 << BITS), 2.0**-BITS)
    return TextModel(languages, np.log(np.concatenate([p, mixture])).T.astype(np.float32).copy())


def _text_of(page: bytes) -> bytes:
    """A page's text without tags, character references decoded."""
    text = _MARKUP.sub(b" ", page)
    return entities.unescape(text.decode("utf-8", "replace")).encode() if b"&" in text else text


_ADDED = T.StructType([T.StructField("_vs_ll", T.ArrayType(T.DoubleType())), T.StructField("_vs_known", T.BooleanType()), T.StructField("_vs_grams", T.LongType())])


def with_text_evidence(df: DataFrame, model: TextModel, text: str = "text", keep: list[str] | None = None, markup: bool = False) -> DataFrame:
    """df with log-likelihoods a language; a map without a shuffle. markup: the text is HTML, whose tags don't count."""
    held = df.sparkSession.sparkContext.broadcast(model)

    def make():
        def f(part: pa.RecordBatch) -> dict:
            texts = as_bytes(part.column(part.schema.get_field_index(text)))
            if markup:
                texts = [t and _text_of(t) for t in texts]
            ll, known, n = held.value.score(texts)
            return {"_vs_ll": pa.array(ll.tolist(), pa.list_(pa.float64())), "_vs_known": pa.array(known), "_vs_grams": pa.array(n, pa.int64())}

        return f

    return map_columns(df, make, _ADDED, [text], keep)


def primary(tag: Column) -> Column:
    """The primary language subtag of a declared value; null if it has none."""
    return F.nullif(F.regexp_extract(F.lower(tag), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1), F.lit(""))


def with_address(df: DataFrame, declared: Column, host: Column, path: Column | None = None, domain: bool = True) -> DataFrame:
    """df with the evidence keys _vs_declared, _vs_host, _vs_domain, _vs_suffix and _vs_segment. domain: the host has dots."""
    null = F.lit(None).cast("string")
    host = F.nullif(F.regexp_replace(F.lower(host), r":\d*$", "") if domain else F.lower(host), F.lit(""))
    suffix = F.nullif(F.substring_index(host, ".", -1), F.lit("")) if domain else null
    return df.withColumns({
        "_vs_declared": primary(declared), "_vs_host": host,
        "_vs_domain": F.substring_index(host, ".", -2) if domain else null, "_vs_suffix": suffix,
        "_vs_segment": F.nullif(F.regexp_extract(path, r"^/([a-zA-Z]{2})(?:[-_/]|$)", 1), F.lit("")) if path is not None else null,
    })


def _most(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def _posterior(scores: list[Column]) -> list[Column]:
    """Shares of exp(score), a column a language: plain arithmetic that compiles, where array functions would repeat it by element."""
    top = _most(scores)
    raw = [F.exp(x - top) for x in scores]
    total = sum(raw[1:], raw[0])
    return [x / total for x in raw]


def _items(array: str, n: int) -> list[Column]:
    return [F.element_at(array, k + 1) for k in range(n)]


def _sums(df: DataFrame, key: str, n: int) -> DataFrame:
    """k and s, the sums of the posteriors of each value of a key; written, for it is read often."""
    out = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(*[F.sum(f"_vs_p{k}").alias(f"p{k}") for k in range(n)])
    return materialize(out.select("k", F.array(*[F.col(f"p{k}") for k in range(n)]).alias("s")), "language-sums")


@dataclass
class Evidence:
    """Grouped sums of text posteriors (columns k and s) by declared value, suffix and segment; by host, with those of its domain as d; and over all rows."""

    declared: DataFrame
    suffix: DataFrame
    segment: DataFrame
    host: DataFrame
    overall: list[float]


def gather(scored: DataFrame, n: int) -> Evidence:
    """Evidence tables over all rows of scored, which has the keys and _vs_ll; only keys and sums are shuffled."""
    narrow = scored.select("_vs_known", "_vs_declared", "_vs_host", "_vs_domain", "_vs_suffix", "_vs_segment", *[x.alias(f"_vs_l{k}") for k, x in enumerate(_items("_vs_ll", n))])
    own = _posterior([F.col(f"_vs_l{k}") for k in range(n)])
    narrow = narrow.withColumns({f"_vs_p{k}": F.when(F.col("_vs_known"), x).otherwise(0.0) for k, x in enumerate(own)})
    total = narrow.agg(*[F.coalesce(F.sum(f"_vs_p{k}"), F.lit(0.0)) for k in range(n)]).first()
    none = F.array(*[F.lit(0.0)] * n)
    hosts, domains = _sums(narrow, "_vs_host", n), _sums(narrow, "_vs_domain", n)
    above = materialize(hosts.withColumn("domain", F.substring_index("k", ".", -2)), "language-hosts")
    above = lookup(above, domains.select(F.col("k").alias("domain"), F.col("s").alias("d")), "domain").select("k", "s", F.coalesce("d", none).alias("d"))
    return Evidence(_sums(narrow, "_vs_declared", n), _sums(narrow, "_vs_suffix", n), _sums(narrow, "_vs_segment", n), materialize(above, "language-hosts"), [float(x) for x in total])


def fuse(scored: DataFrame, model: TextModel, evidence: Evidence | None) -> DataFrame:
    """scored, a written table, with language, confidence (its posterior), known (by text) and kept; internal columns are gone."""
    n = len(model.languages)
    columns = [c for c in scored.columns if not c.startswith("_vs_") and c.lower() not in RESULT]
    if not n or evidence is None:
        return scored.select(*[F.col(f"`{c}`") for c in columns], F.lit(UND).alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("known"), F.lit(False).alias("kept"))
    out, languages, totals, cells = without(scored, *RESULT), range(n), {}, {}
    for key, table in (("declared", evidence.declared), ("suffix", evidence.suffix), ("segment", evidence.segment)):
        got = table.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(F.element_at("s", k + 1)), F.lit(0.0)).alias(f"t{k}") for k in languages]).first()
        totals[key], cells[key] = [float(x) for x in got[1:]], got[0] + 1
        out = lookup(out, table.select(F.col("k").alias(f"_vs_{key}"), F.col("s").alias(f"_vs_n_{key}")), f"_vs_{key}")
    out = lookup(out, evidence.host.select(F.col("k").alias("_vs_host"), F.col("s").alias("_vs_n_host"), F.col("d").alias("_vs_n_domain")), "_vs_host")
    out = out.withColumns({f"_vs_l{k}": x for k, x in enumerate(_items("_vs_ll", n))})
    out = out.withColumns({f"_vs_own{k}": F.when(F.col("_vs_known"), x).otherwise(0.0) for k, x in enumerate(_posterior([F.col(f"_vs_l{k}") for k in languages]))})
    own = [F.col(f"_vs_own{k}") for k in languages]

    def others(name: str, k: int) -> Column:
        """The sum of a value's rows for a language, without this row; null where the row has no such value."""
        return F.when(F.col(name).isNotNull(), F.greatest(F.element_at(name, k + 1) - own[k], F.lit(0.0)))

    def summed(xs: list[Column]) -> Column:
        return sum(xs[1:], xs[0])

    # whole corpus, domain, host: each level's shares are smoothed by those of the level above
    all_rows = sum(evidence.overall)
    taken = summed(own)
    base = [(F.lit(evidence.overall[k] + 1.0) - own[k]) / (F.lit(all_rows + n) - taken) for k in languages]
    domain = _smoothed([others("_vs_n_domain", k) for k in languages], base)
    prior = _smoothed([others("_vs_n_host", k) for k in languages], [F.coalesce(d, b) for d, b in zip(domain, base)])
    prior = [F.coalesce(p, b) for p, b in zip(prior, base)]
    told = [F.lit(0.0)] * n
    for key in totals:
        chance = [F.log((others(f"_vs_n_{key}", k) + CELL) / (F.lit(totals[key][k] + CELL * cells[key]) - own[k])) for k in languages]
        told = [t + F.coalesce(c, F.lit(0.0)) for t, c in zip(told, chance)]
    out = out.withColumns({f"_vs_s{k}": F.col(f"_vs_l{k}") + F.log(prior[k]) + told[k] for k in languages})
    out = out.withColumns({f"_vs_f{k}": x for k, x in enumerate(_posterior([F.col(f"_vs_s{k}") for k in languages]))})
    out = out.withColumn("confidence", _most([F.col(f"_vs_f{k}") for k in languages]))
    best = F.lit(None).cast("string")
    for k in reversed(languages):
        best = F.when(F.col(f"_vs_f{k}") == F.col("confidence"), F.lit(model.languages[k])).otherwise(best)
    named = (F.col("_vs_known") | (F.col("_vs_grams") == 0)) & (F.col("confidence") >= 0.5)
    return out.select(*[F.col(f"`{c}`") for c in columns], F.when(named, best).otherwise(F.lit(UND)).alias("language"), "confidence", F.col("_vs_known").alias("known"), (named & F.col("_vs_known")).alias("kept"))


def _smoothed(own: list[Column], parent: list[Column]) -> list[Column]:
    """Shares of own sums, smoothed by SMOOTHING pseudo-rows of the parent's shares; null where own sums are."""
    total = sum(own, F.lit(SMOOTHING))
    return [(x + SMOOTHING * p) / total for x, p in zip(own, parent)]


def address_of_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Evidence keys of web pages: the html tag's lang attribute, host and path of the URL."""
    declared = F.regexp_extract(F.col(html), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z][a-z0-9_-]*)", 1)
    host = F.regexp_extract(F.col(url), r"(?s)^.*?://(?:[^/?#@]*@)?([^/?#]*)", 1)
    path = F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return with_address(pages, declared, host, path)


def address_of_documents(docs: DataFrame, source: str = "source") -> DataFrame:
    """Documents have no markup or address; their source stands for the host."""
    return with_address(docs, F.lit(None).cast("string"), F.col(source).cast("string"), None, domain=False)


def keep_known(docs: DataFrame, text: str = "text", language: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """docs whose language is one of those that labelled documents have.

    Texts are read and scored once and written with their scores and a row number; what is judged after that is narrow,
    and only the numbers of rejected rows meet the texts again.
    """
    model = fit_text(docs, text, language, key)
    if not model.languages:
        return docs.limit(0)
    plain, names = plain_names(docs)
    scored = with_text_evidence(address_of_documents(plain.withColumn("row", F.monotonically_increasing_id()), names[source]), model, names[text])
    held = materialize(scored, "language-documents")
    narrow = held.select("row", *[c for c in held.columns if c.startswith("_vs_")])
    # written before it is filtered: pushed through the projections of fuse, a filter would repeat their expressions
    judged = materialize(fuse(narrow, model, gather(narrow, len(model.languages))).select("row", "kept"), "language-judged")
    return named_back(drop_rows(held, judged.filter(~F.col("kept")), "row"), names)
