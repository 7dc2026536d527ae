"""Lexical, keyword and vector retrieval over documents or documentation chunks.

A corpus has doc_id and content, and may have keywords (an array) and importance. An Index holds one written table of
postings for all strategies and one of documents, so a corpus is cut to terms once; a query reads the postings of its
own few terms only. Scores of a strategy are weighed by importance.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import RUN, cosine, keywords, ngrams, strip_accents, terms
from ..scratch import checked_broadcast, materialize

K1, B = 1.5, 0.75
#: Shares of the weighting scheme, BM25 and keywords in the hybrid score.
HYBRID = (0.40, 0.35, 0.25)
LAMBDA, FLOOR, SEMANTIC_FLOOR = 0.7, 0.01, 0.1
MAX_FEATURES, MAX_DF = 10_000, 0.95
#: English stop words of the weighting scheme by default; another list may be passed.
STOP = tuple("a about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your".split())
#: Strategies and the kinds of postings that they read: BM25 terms (b), features' terms (t) and keywords (k).
STRATEGIES = {"hybrid": "btk", "tfidf": "t", "bm25": "b", "keyword": "k", "semantic": "t"}
#: Best candidates that a re-ranking gathers; where they can't decide a round, all candidates are ranked by an aggregate.
POOL = 200


# --- the terms of a query, as those of a corpus ---------------------------------------------------------------------


def bm25_terms(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9_\s]", " ", text.lower()).split()
    return words + [f"{a}_{b}" for a, b in zip(words, words[1:])]


def feature_terms(text: str, stop=STOP) -> list[str]:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))
    words = [w for w in re.findall(r"\w[\w.]*\w", plain) if w not in {*stop}]
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def asked_keywords(text: str) -> list[str]:
    return sorted(set(re.findall(r"\b[a-z_]{2,}\b", text.lower())))


# --- the index -------------------------------------------------------------------------------------------------------


@dataclass
class Index:
    """docs: doc_id, importance, dl (BM25 terms) and norm (of feature weights). postings: kind (b, t or k), doc_id, term, tf. features: term, df, idf."""

    docs: DataFrame
    postings: DataFrame
    features: DataFrame
    n_docs: int
    avgdl: float
    stop: tuple[str, ...] = STOP
    vectors: DataFrame | None = None


def _filled(corpus: DataFrame) -> DataFrame:
    has = set(corpus.columns)
    words = F.coalesce(F.col("keywords"), F.array().cast("array<string>")) if "keywords" in has else F.array().cast("array<string>")
    weight = F.coalesce(F.col("importance").cast("double"), F.lit(1.0)) if "importance" in has else F.lit(1.0)
    return corpus.select("doc_id", F.coalesce("content", F.lit("")).alias("content"), words.alias("keywords"), weight.alias("importance"))


def _enriched(times: int):
    """Content followed by its keywords, so many times."""
    return F.concat_ws(" ", "content", *["keywords"] * times)


def _feature_words(stop):
    return ngrams(F.filter(F.regexp_extract_all(strip_accents(F.lower(_enriched(2))), F.lit(rf"({RUN}(?:[\p{{L}}\p{{N}}_.]*{RUN}))"), 1), lambda w: ~w.isin([*stop])))


def postings_of(corpus: DataFrame, stop=STOP, kinds: str = "btk") -> DataFrame:
    """kind, doc_id, term and tf of every document: BM25 terms (b), features' terms (t) and keywords (k)."""
    words_of = {"b": terms(_enriched(1)), "t": _feature_words(stop), "k": F.array_distinct(F.concat(F.transform("keywords", F.lower), keywords(F.col("content"))))}

    def told(kind: str):
        return lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("term"))

    each = F.concat(*[F.transform(words_of[kind], told(kind)) for kind in kinds])
    cut = _filled(corpus).select("doc_id", F.explode(each).alias("x"))
    return cut.groupBy("x.kind", "doc_id", "x.term").agg(F.count("*").alias("tf"))


def build(corpus: DataFrame, max_features: int = MAX_FEATURES, max_df: float = MAX_DF, stop=STOP, vectors: DataFrame | None = None, kinds: str = "btk") -> Index:
    """The index of a corpus, of some kinds of postings if not all strategies are asked. Postings are sorted by term within files, so a query's terms skip most of them."""
    postings = materialize(postings_of(corpus, stop, kinds).sortWithinPartitions("kind", "term"), "search-postings")
    docs = _filled(corpus).select("doc_id", "importance")
    n = corpus.count()
    if "b" in kinds:
        docs = docs.join(postings.filter("kind = 'b'").groupBy("doc_id").agg(F.sum("tf").alias("dl")), "doc_id", "left")
    else:
        docs = docs.withColumn("dl", F.lit(0).cast("long"))
    features = corpus.sparkSession.createDataFrame([], "term string, df long, idf double")
    if "t" in kinds:
        features, norms = _weighing(postings, n, max_features, max_df)
        docs = docs.join(norms, "doc_id", "left")
    else:
        docs = docs.withColumn("norm", F.lit(1.0))
    docs = materialize(docs.fillna({"dl": 0, "norm": 1.0}), "search-documents")
    total = docs.agg(F.sum("dl")).first()[0] or 0
    return Index(docs, postings, features, n, max(1.0, total / max(n, 1)), tuple(stop), vectors)


def _weighing(postings: DataFrame, n: int, max_features: int, max_df: float) -> tuple[DataFrame, DataFrame]:
    """The features chosen of the postings of n documents, written, and the norm of each document's weights."""
    by_term = postings.filter("kind = 't'").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).filter(F.col("df") <= max_df * n)
    chosen = by_term.orderBy(F.desc("total"), "term").limit(max_features)
    features = materialize(chosen.select("term", "df", (F.log((1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")), "search-features")
    weighed = postings.filter("kind = 't'").join(checked_broadcast(features), "term")
    norms = weighed.groupBy("doc_id").agg(F.sqrt(F.sum(F.pow((1 + F.log("tf")) * F.col("idf"), 2))).alias("norm"))
    return features, norms


def weights(index: Index) -> DataFrame:
    """doc_id, term, weight: (1 + ln tf) idf with smoothed idf, normalised by document, of the most frequent features."""
    held = index.postings.filter("kind = 't'").join(checked_broadcast(index.features), "term").join(index.docs.select("doc_id", "norm"), "doc_id")
    return held.select("doc_id", "term", ((1 + F.log("tf")) * F.col("idf") / F.col("norm")).alias("weight"))


def bm25_stats(index: Index) -> DataFrame:
    """n_docs and avgdl over words and word pairs."""
    return index.docs.agg(F.count("*").alias("n_docs"), F.greatest(F.lit(1.0), F.coalesce(F.avg("dl"), F.lit(0.0))).alias("avgdl"))


def bm25_idf(index: Index) -> DataFrame:
    """term, df, idf."""
    df = index.postings.filter("kind = 'b'").groupBy("term").agg(F.count("*").alias("df"))
    return df.select("term", "df", F.log((index.n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


def keyword_index(index: Index) -> DataFrame:
    return index.postings.filter("kind = 'k'").select("doc_id", "term")


# --- scores ----------------------------------------------------------------------------------------------------------


def all_scores(index: Index, query: str, kinds: str = "btk") -> DataFrame:
    """doc_id, importance, tfidf (cosine), bm25 and keyword (share of the query's keywords held) of every document that has a term of the query; 0 for kinds that aren't asked."""
    spark = index.docs.sparkSession
    b, t = (Counter(cut if kind in kinds else []) for kind, cut in (("b", bm25_terms(query)), ("t", feature_terms(query, index.stop))))
    k = asked_keywords(query) if "k" in kinds else []
    near = index.postings.filter(F.col("kind").isin([*kinds]) & F.col("term").isin([*{*b, *t, *k}]))
    df = {r.term: r["count"] for r in near.filter("kind = 'b'").groupBy("term").count().collect() if r.term in b} if b else {}  # as many at most as the query has terms
    idf = {r.term: r.idf for r in index.features.filter(F.col("term").isin([*t])).collect()} if t else {}
    own = {term: (1 + math.log(n)) * idf[term] for term, n in t.items() if term in idf}
    norm = math.sqrt(sum(w * w for w in own.values())) or 1.0
    asked = [("b", term, n * math.log((index.n_docs - df[term] + 0.5) / (df[term] + 0.5) + 1)) for term, n in b.items() if term in df]
    asked += [("t", term, w / norm * idf[term]) for term, w in own.items()] + [("k", term, 1.0 / len(k)) for term in k]
    hits = near.join(F.broadcast(spark.createDataFrame(asked, "kind string, term string, asked double")), ["kind", "term"]).join(index.docs, "doc_id")
    tf = F.col("tf")
    part = {
        "tfidf": F.col("asked") * (1 + F.log("tf")) / F.col("norm"),
        "bm25": F.col("asked") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / index.avgdl)),
        "keyword": F.col("asked"),
    }
    summed = [F.sum(F.when(F.col("kind") == name, score).otherwise(0.0)).alias(column) for name, (column, score) in zip("tbk", part.items())]
    return hits.groupBy("doc_id", "importance").agg(*summed)


def scores(index: Index, query: str, strategy: str) -> DataFrame:
    """doc_id and score of one strategy, weighed by importance; hybrid: each score over its highest, in the shares of HYBRID."""
    if strategy == "semantic" and index.vectors is not None:
        raise ValueError("the semantic strategy needs the query's vector: semantic()")
    every = all_scores(index, query, STRATEGIES[strategy])
    if strategy != "hybrid":
        column = "tfidf" if strategy == "semantic" else strategy
        return every.select("doc_id", (F.col(column) * F.col("importance")).alias("score")).filter("score > 0")
    every = materialize(every, "search-scores")
    names = ("tfidf", "bm25", "keyword")
    top = every.agg(*[F.max(c).alias(c) for c in names]).first()
    share = [part * F.col(c) / (top[c] if top[c] else 1.0) for part, c in zip(HYBRID, names)]
    return every.select("doc_id", ((share[0] + share[1] + share[2]) * F.col("importance")).alias("score"))


def semantic(index: Index, query_vector: DataFrame) -> DataFrame:
    """doc_id and score: cosine of each document's vector (vectors: doc_id, embedding) with the one of query_vector (column q), weighed by importance."""
    near = index.vectors.join(F.broadcast(query_vector.limit(1))).select("doc_id", cosine(F.col("embedding"), F.col("q")).alias("like"))
    return near.join(index.docs, "doc_id").select("doc_id", (F.col("like") * F.col("importance")).alias("score"))


def top(scores: DataFrame, k: int = 10, least: float = FLOOR) -> DataFrame:
    return scores.filter(F.col("score") > least).orderBy(F.desc("score"), "doc_id").limit(k)


def search(index: Index, query: str, k: int = 10, strategy: str = "hybrid", query_vector: DataFrame | None = None) -> list[tuple[object, float]]:
    """The best (doc_id, score) by a strategy, best first. Hybrid results are re-ranked for variety; semantic search without vectors is that of the weighting scheme."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}: one of {', '.join(STRATEGIES)}")
    if strategy == "hybrid":
        return mmr(scores(index, query, strategy), weights(index), k)
    if strategy == "semantic" and index.vectors is not None and query_vector is not None:
        return [tuple(r) for r in top(semantic(index, query_vector), k, SEMANTIC_FLOOR).collect()]
    found = scores(index, query, "tfidf" if strategy == "semantic" else strategy)
    return [tuple(r) for r in top(found, k, 0.0 if strategy == "keyword" else FLOOR).collect()]


def vector_topk(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest by cosine to the single vector of query (column q); a top-k per partition, then one of k rows each."""
    scored = vectors.join(F.broadcast(query.limit(1))).select("vec_id", cosine(F.col("embedding"), F.col("q")).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(k)


def mmr(candidates: DataFrame, weights: DataFrame, k: int = 5, pool: int = POOL) -> list[tuple[int, float]]:
    """Greedy re-ranking of all candidates by relevance less similarity to what is chosen.

    No candidate is worth more than LAMBDA times its score. So the pool of best candidates, gathered with their vectors,
    decides a round as long as its best is worth more than any candidate beyond it can be; else the round ranks all
    candidates by a distributed aggregate. Worth is rounded to 12 places, so that copies tie whatever the order of sums;
    ties go to the smaller doc_id.
    """
    left = candidates.filter(F.col("score") >= FLOOR).select("doc_id", "score")
    first = left.orderBy(F.desc("score"), "doc_id").limit(pool + 1).collect()
    near = {r.doc_id: (r.score, defaultdict(float)) for r in first[:pool]}
    held: defaultdict[object, dict[str, float]] = defaultdict(dict)
    if near:
        for r in weights.filter(F.col("doc_id").isin([*near])).select("doc_id", "term", "weight").collect():
            held[r.doc_id][r.term] = r.weight
    beyond = round(LAMBDA * first[pool].score, 12) if len(first) > pool else None
    every = None  # all candidates and their vectors, written once a round needs them
    out: list[tuple[int, float]] = []
    while len(out) < k:
        gone = {i for i, _ in out}
        worth = {i: round(LAMBDA * score - (1 - LAMBDA) * max([0.0, *like.values()]), 12) for i, (score, like) in near.items() if i not in gone}
        best = min(worth, key=lambda i: (-worth[i], i), default=None)
        if beyond is not None and (best is None or worth[best] <= beyond):
            every = every or _written(left, weights)
            found = _best_of_all(*every, out, [(i, term, w) for i in gone for term, w in held[i].items()])
            if found is None:
                break
            best, score = found
            held[best] = held[best] or {r.term: r.weight for r in every[1].filter(F.col("doc_id") == best).collect()}
        elif best is None:
            break
        else:
            score = near[best][0]
        out.append((best, score))
        for i, (_, like) in near.items():
            like[best] = sum(w * held[best].get(term, 0.0) for term, w in held[i].items())
    return out


def _written(left: DataFrame, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = materialize(left, "search-candidates")
    return left, materialize(weights.select("doc_id", "term", "weight").join(checked_broadcast(left.select("doc_id")), "doc_id", "left_semi"), "search-weights")


def _best_of_all(left: DataFrame, weights: DataFrame, out: list, chosen: list) -> tuple[object, float] | None:
    """The candidate of most worth beside those of out, whose vectors are chosen, over all candidates."""
    asked = F.broadcast(weights.sparkSession.createDataFrame(chosen, f"chosen {dict(left.dtypes)['doc_id']}, term string, held double"))
    like = weights.join(asked, "term").groupBy("doc_id", "chosen").agg(F.sum(F.col("weight") * F.col("held")).alias("like"))
    near = like.groupBy("doc_id").agg(F.max("like").alias("near"))
    worth = F.round(LAMBDA * F.col("score") - (1 - LAMBDA) * F.greatest(F.coalesce("near", F.lit(0.0)), F.lit(0.0)), 12)
    best = left.filter(~F.col("doc_id").isin([i for i, _ in out])).join(near, "doc_id", "left").orderBy(worth.desc(), "doc_id").first()
    return (best.doc_id, best.score) if best is not None else None


def confidence(ranked: DataFrame) -> DataFrame:
    """.4 of the best score, .3 of the mean of the top five, .3 of how full the top five are; 1 at most."""
    five = ranked.orderBy(F.desc("score"), "doc_id").limit(5)
    value = 0.4 * F.max("score") + 0.3 * F.avg("score") + 0.3 * F.least(F.count("*") / 5.0, F.lit(1.0))
    return five.agg(F.round(F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))), 3).alias("confidence"))


def confidence_of(ranked: list[float]) -> float:
    """The same of scores in the order of their ranks."""
    if not ranked:
        return 0.0
    five = ranked[:5]
    return round(min(1.0, 0.4 * ranked[0] + 0.3 * sum(five) / len(five) + 0.3 * min(len(ranked) / 5, 1.0)), 3)


def index_stats(index: Index, chunks: DataFrame) -> DataFrame:
    """n_chunks by chunk_type, with the sizes of both vocabularies."""
    sizes = index.postings.agg(F.countDistinct(F.when(F.col("kind") == "b", F.col("term"))).alias("bm25_terms")).first()[0]
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n_chunks")).withColumns({"features": F.lit(index.features.count()), "bm25_terms": F.lit(sizes)})


# --- answers ---------------------------------------------------------------------------------------------------------

# Kinds of questions and the patterns that count for them.
ANSWERS = {
    "table_info": [r"\b(table|tables)\b", r"\bschema\b", r"\bstructure\b", r"\bwhat\s+(is|are)\s+the\s+table", r"\bhow\s+many\s+table"],
    "column_info": [r"\bcolumn", r"\bfield", r"\bdata\s*type", r"\bnullable", r"\bprimary\s+key", r"\bforeign\s+key"],
    "relationship": [r"\brelation", r"\bjoin", r"\bconnect", r"\blink", r"\breference", r"\bforeign\s+key"],
    "quality": [r"\bquality", r"\bissue", r"\bproblem", r"\bnull", r"\bmissing", r"\bincomplete", r"\berror"],
    "query_help": [r"\bquery", r"\bsql", r"\bselect", r"\bhow\s+to\s+get", r"\bhow\s+to\s+find", r"\bshow\s+me"],
    "stats": [r"\bhow\s+many", r"\bcount", r"\btotal", r"\bsize", r"\brows?\b", r"\brecord"],
}


def answer_intent(question: str) -> str:
    """The kind of question that most patterns speak for; the first of equals."""
    hits = {kind: sum(re.search(p, question.lower()) is not None for p in patterns) for kind, patterns in ANSWERS.items()}
    best = max(hits, key=hits.__getitem__)
    return best if hits[best] else "general"


def answer(question: str, found: list[tuple[str, str]]) -> str:
    """Text from (content, chunk type) of what was found, best first: of the seven best, the first distinct one, up to four more, and SQL if the question asks for it."""
    distinct = list({content: kind for content, kind in reversed(found[:7])}.items())[::-1]
    if not distinct:
        return "Nothing was found. Name a table, a column, a relationship or a quality issue."
    lines = [distinct[0][0]]
    if len(distinct) > 1:
        lines += ["", "See also:", *[f"- {kind.replace('_', ' ')}: {content}" for content, kind in distinct[1:5]]]
    if answer_intent(question) == "query_help" and (sql := next((c.partition("SQL: ")[2] for c, kind in distinct if kind == "query"), "")):
        lines += ["", "```sql", sql, "```"]
    return "\n".join(lines)
