"""Quality scores by co-training two views of a document.

View A is the text's content: shares of symbols, capitals, repeats and the like, and of pairs of character classes; it
knows no length. View B is the page's metadata, what a crawler's log has without reading the text: source, declared
language, size, lines, bytes a character and how well the page compressed on the wire (`zlib`, level 1). Each view has a
logistic classifier. In every round each names the unlabelled documents that it is surest of, `ADDED` at most by the
shares of the labels, and the other one learns from them too; how sure it must be differs by label (`SURE`), for one
label may be rare. Both views are then calibrated on labelled documents that neither has learned from, and a logistic
combination fitted on the same documents scores every document.

Texts are read once, for a table of features; every unlabelled document of it is a candidate in every round, ranked
on the executors. Only the labelled sample is bounded (`LABELLED`); pool_rows bounds the candidates where that is wanted.

Defined cases: null texts count as empty, and texts of any length are read whole; null metadata is a value of its own;
documents with contradicting labels don't count as labelled and are candidates; null ids are candidates; a repeated id
teaches once; candidates that are equally sure are ranked by a hash of their features; without labels of both kinds every
score is 0.5 and every document is kept; repeated rows have equal results; an empty table has none; extra columns stay
out of the result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import clear_labels, count_texts
from .shared import as_bytes, bounded_sample, checked_broadcast, hash_uniform, map_columns, materialize

LABELLED, ROUNDS, ADDED = 3000, 5, 300
#: A pseudo-label (good, bad) needs this probability from the view that gives it.
SURE = {1: 0.95, 0: 0.85}
_CLASSES, _HASHED = 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[:] = 5  # punctuation and controls
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 0, 1, 2
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[128:] = 3, 4, 6
_CLASS[[35, 36, 37, 38, 42, 60, 62, 124]] = 7
_TEXT, _META = 8 + _CLASSES**2, 2 * _HASHED + 6


def text_view(texts: list[bytes | None], counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of content features a text; all are shares."""
    n = len(texts)
    w, letters, lines = (np.maximum(counts[c], 1) for c in ("n_words", "n_letters", "n_lines"))
    basic = np.stack([counts["word_chars"] / w, counts["n_symbols"] / w, counts["n_bangs"] / w, counts["n_echoes"] / w, counts["n_repeat_words"] / w, counts["n_upper"] / letters, counts["n_dup_lines"] / lines, counts["n_words"] == 0], axis=1)
    sizes = [len(t or b"") + 1 for t in texts]
    kind = _CLASS[np.frombuffer(b"".join((t or b"") + b" " for t in texts) + b" ", np.uint8)].astype(np.int64)  # no pair runs from one text into the next
    pair = kind[:-1] * _CLASSES + kind[1:]
    pair[np.cumsum(sizes) - 1] = _CLASS[32] * (_CLASSES + 1)
    pairs = np.bincount(np.repeat(np.arange(n), sizes) * _CLASSES**2 + pair, minlength=n * _CLASSES**2).reshape(n, -1)
    return np.concatenate([basic, np.sqrt(pairs / np.array(sizes)[:, None])], axis=1).astype(np.float32)


def meta_view(texts: list[bytes | None], source: list, language: list, lines: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """One row of metadata features a document."""
    out = np.zeros((len(source), _META), np.float32)
    for k, (s, lang) in enumerate(zip(source, language)):
        out[k, xxhash.xxh32_intdigest(f"s{s}") % _HASHED] = 1
        out[k, _HASHED + xxhash.xxh32_intdigest(f"l{lang}") % _HASHED] = 1
    size = np.array([len(t or b"") for t in texts], float)
    packed = np.array([len(zlib.compress(t or b"", 1)) for t in texts], float)
    at_least = np.maximum(size, 1)
    ratio = packed / (at_least + 50)
    out[:, -6:] = np.stack([np.log1p(size), np.log1p(lines), np.log1p(size / np.maximum(lines, 1)), at_least / np.maximum(chars, 1), ratio, ratio * np.log1p(size)], axis=1)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _widened(x: np.ndarray, kinks: np.ndarray) -> np.ndarray:
    """Features with, for each, its distances beyond some of its quantiles: a logistic unit over them bends."""
    return np.concatenate([x, *[np.maximum(x - q, 0) for q in kinks]], axis=1)


@dataclass
class Logistic:
    kinks: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, start: Logistic | None = None, steps: int = 60, l2: float = 1e-3, rate: float = 0.1) -> Logistic:
        """Adam on the weighted mean log-loss of standardised features."""
        kinks = start.kinks if start else np.quantile(x, [0.25, 0.5, 0.75], axis=0).astype(np.float32)
        x = _widened(x, kinks)
        mean, scale = (start.mean, start.scale) if start else (x.mean(axis=0), x.std(axis=0) + 1e-3)
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1), np.float32)], axis=1).astype(np.float32)
        w = start.w.copy() if start else np.zeros(z.shape[1], np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        share = (weight / weight.sum()).astype(np.float32)
        for t in range(1, steps + 1):
            grad = z.T @ (share * (_sigmoid(z @ w) - y).astype(np.float32)) + l2 * w
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        return cls(kinks, mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((_widened(x, self.kinks) - self.mean) / self.scale) @ self.w[:-1] + self.w[-1], -15, 15)


@dataclass
class CoModel:
    """Two views' classifiers, their calibrations (slope, shift), the combination's weights, and what was taught: (round, view, label, documents)."""

    text: Logistic
    meta: Logistic
    platt: np.ndarray
    combine: np.ndarray
    taught: list[tuple[int, str, int, int]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of feature rows: both views' probabilities and the combined one."""
        a = self.platt[0, 0] * self.text.logit(x[:, :_TEXT]) + self.platt[0, 1]
        b = self.platt[1, 0] * self.meta.logit(x[:, _TEXT:]) + self.platt[1, 1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.combine[0] * a + self.combine[1] * b + self.combine[2])


def _newton(x: np.ndarray, y: np.ndarray, ridge: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The least log-loss with a ridge around start: Newton steps, halved until the loss falls, as it is convex and saturates."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + 0.5 * (ridge * (w - start) ** 2).sum())

    w = start.astype(float)
    now = loss(w)
    for _ in range(100):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * (w - start)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), grad)
        size = 1.0
        while size > 1e-8 and (new := loss(w - size * step)) > now - 1e-4 * size * float(grad @ step):
            size /= 2
        if size <= 1e-8 or now - new < 1e-10:
            break
        w, now = w - size * step, new
    return w


def with_features(docs: DataFrame, text: str = "text", source: str = "source", language: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """docs with _vs_x, the features of both views; a map without a shuffle."""

    def make():
        def f(part: pa.RecordBatch) -> dict:
            at = part.schema.get_field_index
            column = part.column(at(text))
            texts, chars = as_bytes(column), np.asarray(pc.fill_null(pc.utf8_length(column), 0))
            counts = count_texts(texts)
            meta = meta_view(texts, part.column(at(source)).to_pylist(), part.column(at(language)).to_pylist(), counts["n_lines"], chars)
            x = np.concatenate([text_view(texts, counts), meta], axis=1)
            return {"_vs_x": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))}

        return f

    return map_columns(docs, make, T.StructType([T.StructField("_vs_x", T.ArrayType(T.FloatType()))]), [text], keep)


def _matrix(column) -> np.ndarray:
    return np.asarray(pc.list_flatten(column)).reshape(len(column), _TEXT + _META)


_PICKED = T.StructType([T.StructField("view", T.IntegerType()), T.StructField("label", T.IntegerType()), T.StructField("p", T.DoubleType()), T.StructField("h", T.LongType()), T.StructField("row", T.LongType()), T.StructField("x", T.ArrayType(T.FloatType()))])


def surest(pool: DataFrame, models: list[Logistic], gone: list[set[int]], many: dict[int, int]) -> dict[tuple[int, int], list]:
    """By (view, label), the up to many rows of the pool that the view is surest of and that the other view wasn't taught yet (gone, by learner).

    Each task keeps the best of its rows only; the best of all are taken from those.
    """
    held = pool.sparkSession.sparkContext.broadcast((models, [np.fromiter(g, np.int64, len(g)) for g in gone]))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views, taught = held.value
        best: dict[tuple[int, int], list] = {(k, label): [] for k in (0, 1) for label in many}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, rows = _matrix(batch.column(1)), np.asarray(batch.column(0))
            for k, part in ((0, x[:, :_TEXT]), (1, x[:, _TEXT:])):
                p = np.round(_sigmoid(views[k].logit(part)), 6)
                for label, n in many.items():
                    sure, found = p if label else np.round(1 - p, 6), best[k, label]
                    least = max(SURE[label], -found[-1][0]) if len(found) == n else SURE[label]
                    at = np.flatnonzero((sure >= least) & ~np.isin(rows, taught[1 - k]))
                    if len(at) > n:  # the n-th best of the batch and all that are as sure
                        at = at[sure[at] >= np.partition(sure[at], -n)[-n]]
                    found += [(-float(sure[i]), xxhash.xxh64_intdigest(x[i].tobytes()) >> 1, int(rows[i]), x[i]) for i in at]
                    best[k, label] = sorted(found, key=lambda b: b[:3])[:n]
        out = [(k, label, *b) for (k, label), found in best.items() for b in found]
        yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.float32())))], names=_PICKED.names)

    found = materialize(pool.select("row", "_vs_x").mapInArrow(pick, _PICKED), "cotraining-surest")
    return {(k, label): found.filter((F.col("view") == k) & (F.col("label") == label)).orderBy("p", "h", "row").limit(n).collect() for k in (0, 1) for label, n in many.items()}


def co_train(x: np.ndarray, y: np.ndarray, holdout: np.ndarray, pool: DataFrame, rounds: int = ROUNDS, added: int = ADDED) -> CoModel:
    """x, y: features and labels (0 or 1) of the labelled sample; holdout: those of its rows that are kept for calibration; pool: row and _vs_x of unlabelled documents."""
    views = [x[:, :_TEXT], x[:, _TEXT:]]
    learn, target = [[v[~holdout]] for v in views], [[y[~holdout]] for _ in views]
    weight = [[np.ones(int((~holdout).sum()))] for _ in views]
    rate = float(y[~holdout].mean())
    many = {1: max(1, round(added * rate)), 0: max(1, round(added * (1 - rate)))}
    models: list[Logistic] = [None, None]  # type: ignore[list-item]
    gone: list[set[int]] = [set(), set()]
    taught = []
    for turn in range(rounds + 1):
        for k in (0, 1):
            models[k] = Logistic.fit(np.concatenate(learn[k]), np.concatenate(target[k]), np.concatenate(weight[k]), models[k], steps=150 if turn == 0 else 40)
        if turn == rounds:
            break
        for (k, label), found in surest(pool, models, gone, many).items():  # view k teaches the other one
            taught.append((turn, ("text", "meta")[k], label, len(found)))
            if not found:
                continue
            other = 1 - k
            rows = np.array([r["x"] for r in found], np.float32)
            gone[other] |= {r["row"] for r in found}
            learn[other].append(rows[:, _TEXT:] if other else rows[:, :_TEXT])
            target[other].append(np.full(len(found), label))
            weight[other].append(np.full(len(found), 0.3))
    t = y[holdout].astype(float)
    logits = [m.logit(v[holdout]) for m, v in zip(models, views)]
    platt = np.stack([_newton(np.stack([z, np.ones_like(z)], axis=1), t, np.array([1.0, 1e-3]), np.array([1.0, 0.0])) for z in logits])
    ab = np.stack([platt[k, 0] * logits[k] + platt[k, 1] for k in (0, 1)] + [np.ones(len(t))], axis=1)
    prior = np.log((t.mean() + 1e-3) / (1 - t.mean() + 1e-3))
    combine = _newton(ab, t, np.array([1.0, 1.0, 1.0]), np.array([1.0, 1.0, -prior]))
    return CoModel(models[0], models[1], platt, combine, taught)


def fit(features: DataFrame, labels: DataFrame, id_column: str = "doc_id", labelled_rows: int = LABELLED, pool_rows: int | None = None) -> CoModel | None:
    """The model from features, a written table of id_column and _vs_x; None without labels of both kinds.

    It learns from a bounded sample of labelled documents, and from all other documents, or about pool_rows of them.
    """
    clear = clear_labels(labels, id_column).filter("quality in (0, 1)")
    chosen = bounded_sample(clear, F.col("quality").cast("string"), F.col(id_column), labelled_rows // 2)
    fold = (F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(4)) == 0).alias("hold")
    sample = features.join(F.broadcast(chosen), id_column).dropDuplicates([id_column])  # a repeated id teaches once; at most about labelled_rows rows
    got = sample.select(F.col(id_column).cast("string").alias("id"), F.col("quality").alias("y"), fold, "_vs_x").orderBy("id").toArrow()
    y, hold = np.asarray(got.column("y")).astype(np.int64), np.array(got.column("hold").to_pylist(), bool)
    if {*y[~hold].tolist()} != {0, 1} or {*y[hold].tolist()} != {0, 1}:
        return None
    named = checked_broadcast(materialize(clear.select(F.col(id_column).alias("_vs_id")), "cotraining-labelled"))
    pool = features.select(F.col(id_column).alias("id"), "_vs_x").withColumn("row", F.monotonically_increasing_id())
    if pool_rows is not None:
        pool = pool.filter(hash_uniform(F.col("_vs_x"), F.lit("pool")) < F.lit(min(1.0, pool_rows / max(1, features.count()))))
    pool = materialize(pool.join(named, F.col("id") == F.col("_vs_id"), "left_anti").select("row", "_vs_x"), "cotraining-pool")
    return co_train(_matrix(got.column("_vs_x").combine_chunks()), y, hold, pool)


_SCORES = T.StructType([T.StructField("text_score", T.DoubleType()), T.StructField("meta_score", T.DoubleType()), T.StructField("score", T.DoubleType())])


def score(features: DataFrame, model: CoModel | None, keep: list[str] | None = None) -> DataFrame:
    """features (with _vs_x) with text_score, meta_score, score (of good quality) and kept (score of 0.5 or more); a map without a shuffle."""
    held = features.sparkSession.sparkContext.broadcast(model)
    stay = [c for c in (features.columns if keep is None else keep) if c != "_vs_x"]

    def make():
        def f(part: pa.RecordBatch) -> dict:
            if held.value is None:
                half = pa.array(np.full(part.num_rows, 0.5))
                return {"text_score": half, "meta_score": half, "score": half}
            got = held.value.score(_matrix(part.column(part.schema.get_field_index("_vs_x"))))
            return {n: pa.array(v.astype(np.float64)) for n, v in zip(("text_score", "meta_score", "score"), got)}

        return f

    return map_columns(features, make, _SCORES, [], stay).withColumn("kept", F.col("score") >= 0.5)
