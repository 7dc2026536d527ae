"""Quality rules whose cutoffs are certified on labelled holdouts.

Statistics of every whole text feed simple rules (a statistic above or below a cutoff). Trials are distinct labelled
texts: a repeated document id counts once, and so does a text under several ids, within its stratum (language). Half of
the texts, by a hash of the text, so that copies never lie on both sides, ranks cutoffs greedily by the bad documents that
they newly reject less ten times the good ones: all texts of that half, in ranges of each statistic's values, so that no
task and no driver gathers them. All texts of the other half certify them: per
stratum, the ranked rules are tried in that order, and a prefix of them is accepted while an exact binomial test shows,
for all rules of the prefix together, that good texts are rejected at a rate below `ALPHA`. Strata share the error
probability `DELTA` by Bonferroni; within a stratum the order is fixed beforehand and testing stops at the first
failure, so no further correction is needed. A stratum with too few labelled texts accepts no rule. The `MOST_STRATA`
strata of most good trials are certified each; if there are more, all others are one stratum, certified as a whole.

Defined cases: null and empty texts have no words and fail the base rule; texts of any length are counted whole; a null
stratum is one of its own; documents with contradicting labels, and texts that have both labels in a stratum, are no
trials; of a repeated id with several texts the one of the smallest hash is; ties between cutoffs go to the rule that
stands first and its highest cutoff; with no labels at all only the base rule rejects; repeated rows have equal results;
an empty table has none; extra columns whose names clash with result columns are replaced.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import WHITE, as_bytes, map_columns, materialize, named_back, plain_names

ALPHA, DELTA, STEPS = 0.05, 0.05, 12
#: Strata that are certified apart; all others are one.
MOST_STRATA = 64
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_letters", "n_bangs", "n_echoes")
#: (rule, statistic as a function of columns, sense)
RULES = (
    ("symbols", lambda c: c("n_symbols") / _at_least_one(c("n_words")), ">"),
    ("upper", lambda c: c("n_upper") / _at_least_one(c("n_letters")), ">"),
    ("bangs", lambda c: c("n_bangs") / _at_least_one(c("n_words")), ">"),
    ("echoes", lambda c: c("n_echoes") / _at_least_one(c("n_words")), ">"),
    ("repeats", lambda c: c("n_repeat_words") / _at_least_one(c("n_words")), ">"),
    ("dup_lines", lambda c: c("n_dup_lines") / _at_least_one(c("n_lines")), ">"),
    ("long_words", lambda c: c("word_chars") / _at_least_one(c("n_words")), ">"),
    ("short_words", lambda c: c("word_chars") / _at_least_one(c("n_words")), "<"),
)


def _at_least_one(x: Column) -> Column:
    return F.greatest(x, F.lit(1))


_TO_SPACE_CONT = WHITE + bytes(range(128, 192))
_SYMBOLS, _UPPER = b"#*$%&|<>", bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Ids of pairs, equal for equal pairs."""
    return pd.factorize(a * (int(b.max(initial=0)) + 1) + b)[0]


def repeated_words(ids: np.ndarray, doc: np.ndarray, n_docs: int, window: int = REPEAT_WINDOW) -> np.ndarray:
    """By document: words inside windows of `window` (a power of two) consecutive words that occur twice or more in it."""
    n = len(ids) - window + 1
    if n <= 0:
        return np.zeros(n_docs, np.int64)
    w, step = ids, 1
    while step < window:  # ids of twice as long runs, exactly
        w, step = _pairs(w[: len(w) - step], w[step:]), step * 2
    at = np.flatnonzero(doc[:n] == doc[window - 1 :])
    if not len(at):
        return np.zeros(n_docs, np.int64)
    key = pd.factorize(doc[at] * (int(w.max()) + 1) + w[at])[0]
    at = at[np.bincount(key)[key] > 1]
    cover = np.zeros(len(ids) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)


def count_texts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """Exact counts of whole texts; words are cut at ASCII white space."""
    n = len(texts)
    out = {c: np.zeros(n, np.int64) for c in COUNTS + _MORE}
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts = []
    for k, text in enumerate(texts):
        if not text:
            continue
        words = text.split()
        size = len(text)
        out["n_words"][k] = len(words)
        out["word_chars"][k] = len(text.translate(None, _TO_SPACE_CONT))
        out["n_symbols"][k] = size - len(text.translate(None, _SYMBOLS))
        out["n_upper"][k] = size - len(text.translate(None, _UPPER))
        out["n_letters"][k] = size - len(text.translate(None, _LETTERS))
        out["n_bangs"][k] = text.count(b"!")
        lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
        out["n_lines"][k] = len(lines)
        out["n_dup_lines"][k] = len(lines) - len(set(lines))
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    if parts:
        ids = np.concatenate(parts)
        doc = np.repeat(np.arange(n), out["n_words"])
        out["n_repeat_words"] = repeated_words(ids, doc, n)
        same = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
        out["n_echoes"] = np.bincount(doc[1:][same], minlength=n)
    return out


def with_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """docs with the counts of each whole text; a map without a shuffle."""
    names = COUNTS + _MORE

    def make():
        def f(part: pa.RecordBatch) -> dict:
            got = count_texts(as_bytes(part.column(part.schema.get_field_index(text))))
            return {prefix + c: pa.array(got[c], pa.int64()) for c in names}

        return f

    return map_columns(docs, make, T.StructType([T.StructField(prefix + c, T.LongType()) for c in names]), [text], keep)


def base_failed(prefix: str = "") -> Column:
    return (F.col(prefix + "n_words") < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > REPEAT_PERCENT * F.col(prefix + "n_words"))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of Bin(n, p), exactly up to rounding."""
    total = 0.0
    for i in range(k + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
        if total > 1:
            return 1.0
    return total


def _stratum_key(stratum: Column) -> Column:
    """Never null: a null stratum has a key that no value has."""
    return F.coalesce(F.concat(F.lit("="), stratum.cast("string")), F.lit("null"))


@dataclass
class Policy:
    """Ranked (rule, cutoff) pairs; how many of them are certified by stratum key, and for all other strata."""

    ranked: list[tuple[int, float]]
    accepted: dict[str, int]
    others: int = 0

    def first_failure(self, prefix: str = "") -> Column:
        """1 for the first ranked rule that a document fails, and so on; null if it fails none."""
        out = F.lit(None).cast("int")
        for step in range(len(self.ranked), 0, -1):
            rule, cutoff = self.ranked[step - 1]
            _, stat, sense = RULES[rule]
            value = stat(lambda c: F.col(prefix + c))
            fails = value > cutoff if sense == ">" else value < cutoff
            out = F.when((F.col(prefix + "n_words") > 0) & fails, F.lit(step)).otherwise(out)
        return out

    def kept(self, stratum: Column, prefix: str = "") -> Column:
        """Base rule and certified rules; a stratum without labels has none."""
        limit = F.lit(self.others)
        if self.accepted:
            known = F.create_map(*[F.lit(x) for pair in self.accepted.items() for x in pair])
            limit = F.coalesce(F.try_element_at(known, _stratum_key(stratum)), limit)
        return ~base_failed(prefix) & F.coalesce(self.first_failure(prefix) > limit, F.lit(True))


def certify(tallies: dict[str, dict[int, int]], steps: int, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, int]:
    """By stratum, how many rules of the ranked ones are accepted. tallies: good trials by the first rule that rejects them (0: none does)."""
    out = {}
    for stratum, tally in tallies.items():
        n, rejected, accepted = sum(tally.values()), 0, 0
        for step in range(1, steps + 1):
            rejected += tally.get(step, 0)
            if binomial_tail(rejected, n, alpha) > delta / len(tallies):
                break
            accepted = step
        out[stratum] = accepted
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of levels (rule, v, gain) by rule and falling v: per rule of a task its first and last v, the sum of its gains, and its best cut: the gain above it and the values on both sides."""
    names = ("rule", "first", "last", "total", "best", "above", "below")
    seg = None
    for batch in batches:
        rules, v, gain = (batch.column(c).to_numpy() for c in ("rule", "v", "gain"))
        for rule in np.unique(rules):
            own = rules == rule
            values, sums = v[own], np.cumsum(gain[own])
            if seg is None or seg["rule"] != rule:
                if seg is not None:
                    yield pa.RecordBatch.from_pylist([seg], _SEGMENT)
                seg = dict(zip(names, (int(rule), float(values[0]), None, 0, None, None, None)))
            else:
                values, sums = np.append(seg["last"], values), np.append(0, sums)
            if len(values) > 1:
                k = int(np.argmax(sums[:-1]))
                if seg["best"] is None or seg["total"] + int(sums[k]) > seg["best"]:
                    seg |= {"best": seg["total"] + int(sums[k]), "above": float(values[k]), "below": float(values[k + 1])}
            seg |= {"last": float(values[-1]), "total": seg["total"] + int(sums[-1])}
    if seg is not None:
        yield pa.RecordBatch.from_pylist([seg], _SEGMENT)


_SEGMENT = pa.schema([("rule", pa.int32()), ("first", pa.float64()), ("last", pa.float64()), ("total", pa.int64()), ("best", pa.int64()), ("above", pa.float64()), ("below", pa.float64())])


def best_cut(rows: DataFrame, least: float) -> tuple[int, float] | None:
    """The rule and cutoff of most gain above the cutoff, if it is more than least. rows: gain, and v0, v1 and so on by rule.

    Equal values are summed first; the levels are dealt to tasks by ranges, and each task gives one row a rule.
    """
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"v{r}").alias("v")) for r in range(len(RULES))]))
    levels = rows.select(each.alias("e"), "gain").groupBy("e.rule", "e.v").agg(F.sum("gain").alias("gain"))
    order = [F.col("rule"), F.desc("v")]
    found = levels.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_segments, "rule int, first double, last double, total long, best long, above double, below double").collect()
    best, cut, ahead, last = least, None, 0, None
    for s in sorted(found, key=lambda s: (s.rule, -s.first)):
        if last is None or last.rule != s.rule:
            ahead = 0
        elif ahead > best:
            best, cut = ahead, (s.rule, (last.last + s.first) / 2)
        if s.best is not None and ahead + s.best > best:
            best, cut = ahead + s.best, (s.rule, (s.above + s.below) / 2)
        ahead, last = ahead + s.total, s
    return cut


def rank_rules(rows: DataFrame, prefix: str = "", steps: int = STEPS) -> list[tuple[int, float]]:
    """Greedy (rule, cutoff) pairs by newly rejected bad documents less ten times newly rejected good ones, over all rows, a written table."""
    stats = [stat(lambda c: F.col(prefix + c)) * F.lit(1.0 if sense == ">" else -1.0) for _, stat, sense in RULES]
    left = rows.filter(F.col(prefix + "n_words") > 0).select(F.when(F.col("quality") == 1, -10).otherwise(1).cast("long").alias("gain"), *[v.alias(f"v{r}") for r, v in enumerate(stats)])
    n_bad, out = left.filter("gain > 0").count(), []
    while n_bad and len(out) < steps and (cut := best_cut(left, 0.005 * n_bad)):
        rule, value = cut
        left = left.filter(F.col(f"v{rule}") <= value)
        out.append((rule, value if RULES[rule][2] == ">" else -value))
    return out


def trials(labelled: DataFrame, stratum: str, id_column: str, text_hash: str, prefix: str = "") -> DataFrame:
    """One row a stratum and distinct text: _vs_s (the stratum's key), quality, the counts, and _vs_fold (0 ranks, 1 certifies)."""
    counts = [prefix + c for c in COUNTS + _MORE]
    usable = labelled.filter(F.col("quality").isin(0, 1) & ~base_failed(prefix))
    one = usable.groupBy(id_column).agg(F.min(F.struct(F.col(text_hash), _stratum_key(F.col(stratum)).alias("_vs_s"), "quality", *counts)).alias("t")).select("t.*")
    texts = one.groupBy("_vs_s", text_hash).agg(F.min("quality").alias("quality"), F.max("quality").alias("_vs_most"), *[F.min(c).alias(c) for c in counts])
    return texts.filter("quality = _vs_most").withColumn("_vs_fold", F.pmod(F.col(text_hash), F.lit(2))).drop("_vs_most")


def fit(labelled: DataFrame, stratum: str, id_column: str, text_hash: str, prefix: str = "", alpha: float = ALPHA, delta: float = DELTA, most_strata: int = MOST_STRATA) -> Policy:
    """The certified policy. labelled: id, stratum, text hash, quality (0 or 1) and the counts."""
    usable = materialize(trials(labelled, stratum, id_column, text_hash, prefix), "quality-trials")
    ranked = rank_rules(usable.filter("_vs_fold = 0"), prefix)
    policy = Policy(ranked, {})
    test = usable.filter("_vs_fold = 1 and quality = 1")
    largest = [r[0] for r in test.groupBy("_vs_s").count().orderBy(F.desc("count"), "_vs_s").limit(most_strata + 1).collect()]
    own, pooled = largest[:most_strata], len(largest) > most_strata
    name = F.when(F.col("_vs_s").isin(own), F.col("_vs_s")).otherwise("*") if pooled else F.col("_vs_s")
    tallies: dict[str, dict[int, int]] = {}
    for s, step, n in test.groupBy(name.alias("s"), policy.first_failure(prefix).alias("step")).count().collect():
        tallies.setdefault(s, {})[step or 0] = n
    policy.accepted = certify(tallies, len(ranked), alpha, delta)
    policy.others = policy.accepted.pop("*", 0)
    return policy


def clear_labels(labels: DataFrame, id_column: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per id whose labels agree."""
    one = labels.filter(F.col(id_column).isNotNull() & F.col(label).isNotNull()).groupBy(id_column).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    return one.filter("lo = hi").select(id_column, F.col("lo").cast("int").alias(label))


def _counted(docs: DataFrame, text: str, keep: list[str], prefix: str, tag: str) -> DataFrame:
    """The kept columns with counts and the text's hash, written: texts are counted once."""
    name = prefix + "text_hash"
    return materialize(with_counts(docs.withColumn(name, F.xxhash64(F.col(text))), text, [*keep, name], prefix), tag)


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """One row per document: its id, counts, base_failed, kept, and the first ranked rule that it fails."""
    counted = _counted(docs.select(id_column, text, F.col(stratum).alias("_vs_stratum")), text, [id_column, "_vs_stratum"], "_vs_", "quality-counts")
    policy = fit(counted.join(clear_labels(labels, id_column), id_column), "_vs_stratum", id_column, "_vs_text_hash", "_vs_")
    failing = F.array(*[F.lit(RULES[r][0]) for r, _ in policy.ranked]) if policy.ranked else F.array(F.lit(None).cast("string"))
    step = policy.first_failure("_vs_")
    return counted.select(id_column, *[F.col("_vs_" + c).alias(c) for c in COUNTS], base_failed("_vs_").alias("base_failed"), policy.kept(F.col("_vs_stratum"), "_vs_").alias("kept"), F.when(step.isNotNull(), F.element_at(failing, step)).alias("failed_rule"))


def keep_good(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """docs without those that the base rule or a certified rule rejects; texts are read and counted once, written with their counts, and not shuffled."""
    plain, names = plain_names(docs)
    counted = _counted(plain, names[text], plain.columns, "_vs_", "quality-documents")
    narrow = counted.select(F.col(names[id_column]).alias(id_column), F.col(names[stratum]).alias("_vs_stratum"), *[c for c in counted.columns if c.startswith("_vs_")])
    policy = fit(narrow.join(clear_labels(labels, id_column), id_column), "_vs_stratum", id_column, "_vs_text_hash", "_vs_")
    return named_back(counted.filter(policy.kept(F.col(names[stratum]), "_vs_")), names)
