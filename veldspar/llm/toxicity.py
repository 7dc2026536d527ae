"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as a word vector (a hashed table) and a character vector (the mean of hashed vectors of its 3- and
5-grams, with word fences); both tables start at random and are learned with the rest. Two gated recurrent layers read
a window of `WINDOW` words in both directions; attention pools their states; a logistic unit scores the window. All
overlapping windows of a whole text are scored, and the highest score is the document's.

Training is multiple-instance: a document's label says that one of its windows at least is toxic, not which. In the
first `WARM` epochs every window of a toxic document counts as toxic with the document's weight shared among them;
after that only the window that the network finds most toxic does, against the clean windows that look most toxic to
it and others at random. There is no word list and no other statistic of words.

What is learned from is bounded: `POSITIVE` and `NEGATIVE` labelled documents, whose crc32(id) mod 5 is not 0, and of
each `WINDOWS_A_DOC` windows of up to `WINDOW_BYTES` bytes, which the executors cut and pick.

Defined cases: null and empty texts, and texts without words, get the score of an empty window; texts of any length
are scored whole, a word of more than `WORD_BYTES` bytes enters as several; null ids aren't held out; a repeated id
teaches once, with the smallest of its texts; documents with contradicting labels don't train; without labels of both
kinds every score is 0; equal texts have equal scores, which ties among windows don't change; an empty table has no
scores; extra columns named score or predicted are replaced.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .quality import clear_labels
from .shared import as_bytes, bounded_sample, map_columns

WINDOW, STRIDE = 64, 52
POSITIVE, NEGATIVE = 1200, 1600
WINDOWS_A_DOC, WINDOW_BYTES, WORD_BYTES = 24, 2048, 64
HIDDEN, WORD_DIMS, CHAR_DIMS, ATTENTION = 8, 8, 8, 8
_WORD_BITS, _CHAR_BITS = 15, 15
_DIMS = WORD_DIMS + CHAR_DIMS
#: Sizes of character grams.
GRAMS = (3, 5)
FOLDS, EPOCHS, WARM, BATCH, LEAST_STEPS = 5, 12, 3, 192, 400
#: Windows to one of a single repeated word in training.
ECHOES = 3
_INNER = b"#$%&*@+-_|'<>=~^/\\"
#: A-Z to lower case; letters, digits, signs that stand in for letters and bytes from 128 up stay, the rest parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c in _INNER else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    words = (text or b"").translate(_TABLE).split()
    if words and max(map(len, words)) > WORD_BYTES:
        words = [w[a : a + WORD_BYTES] for w in words for a in range(0, len(w), WORD_BYTES)]
    return words


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


#: Powers of an odd number: a word's hash is a polynomial in it, whose terms are summed at once for all words.
_POWERS = np.cumprod(np.r_[np.uint64(1), np.full(WORD_BYTES + 8, 0xD6E8FEB86659FD93, np.uint64)])


def spell(words: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Word hashes; for each size in GRAMS, gram hashes and the words that they belong to, in order; words lose signs at their ends and are fenced by < and >."""
    fenced = [b"<" + (w.strip(_INNER) or w) + b">" for w in words]
    data = np.frombuffer(b"".join(fenced), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, fenced), np.int64, len(fenced))
    owner = np.repeat(np.arange(len(fenced), dtype=np.int64), sizes)
    ends = np.cumsum(sizes)
    room = ends[owner] - np.arange(len(data))
    grams = []
    for n in GRAMS:
        at = np.flatnonzero(room >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _POWERS[1] + data[at + k]
        grams.append((_mixed(h), owner[at]))
    whole = np.add.reduceat((data + np.uint64(1)) * _POWERS[room], ends - sizes) if len(fenced) else np.zeros(0, np.uint64)
    return _mixed(whole), grams


def windows(n: int, window: int = WINDOW, stride: int = STRIDE) -> list[tuple[int, int]]:
    """Overlapping (start, end) that cover n words; the last one ends at the last word."""
    if n <= window:
        return [(0, n)] if n else []
    out = [(a, a + window) for a in range(0, n - window, stride)]
    return [*out, (n - window, n)]


def _unit(rng, *shape, scale=None):
    return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)


#: A gate is (1 + tanh(x / 2)) / 2: halves go into the inputs of the two gates, not of the new state.
_HALF = np.r_[np.full(2 * HIDDEN, 0.5, np.float32), np.ones(HIDDEN, np.float32)]


def _gates(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights; every table is float32."""

    word: np.ndarray
    char: np.ndarray
    dense: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        h = HIDDEN
        dense = {
            "in": _unit(rng, _DIMS, 6 * h), "in0": np.zeros(6 * h, np.float32), "uf": _unit(rng, h, 3 * h), "ub": _unit(rng, h, 3 * h),
            "a": _unit(rng, 2 * h, ATTENTION), "a0": np.zeros(ATTENTION, np.float32), "v": _unit(rng, ATTENTION), "w": _unit(rng, 2 * h), "b": np.full(1, -1.0, np.float32),
        }
        return cls(_unit(rng, 1 << _WORD_BITS, WORD_DIMS, scale=0.02), _unit(rng, 1 << _CHAR_BITS, CHAR_DIMS, scale=0.2), dense)

    def inputs(self, spelled: tuple) -> tuple[np.ndarray, tuple]:
        """Input vectors of spelled words."""
        whole, grams = spelled
        n = np.maximum(sum(np.bincount(of, minlength=len(whole)) for _, of in grams), 1).astype(np.float32)
        chars, cells = np.zeros((len(whole), CHAR_DIMS), np.float32), []
        for hashes, of in grams:
            cell = (hashes & np.uint64((1 << _CHAR_BITS) - 1)).astype(np.int64)
            cells.append((cell, of))
            if len(of):
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                chars[of[starts]] += np.add.reduceat(self.char[cell], starts, axis=0)
        chars /= n[:, None]
        row = (whole & np.uint64((1 << _WORD_BITS) - 1)).astype(np.int64)
        return np.concatenate([self.word[row], chars], axis=1), (row, cells, n)

    def project(self, x: np.ndarray) -> np.ndarray:
        return x @ self.dense["in"] + self.dense["in0"]

    def _read(self, part: np.ndarray, ids: np.ndarray, live: np.ndarray, u: np.ndarray, out: np.ndarray, backward: bool) -> None:
        """States of one direction, features first. Windows are sorted by falling size, so each step works on the first live[t]."""
        h, (steps, n) = HIDDEN, ids.shape
        state = np.zeros((h, n), np.float32)
        u = np.ascontiguousarray((u * _HALF).T)
        for t in reversed(range(steps)) if backward else range(steps):
            m = int(live[t])
            s = state if m == n else np.ascontiguousarray(state[:, :m])
            x, y = part.take(ids[t, :m], axis=1), u @ s
            gate, new = x[: 2 * h], y[2 * h :]
            gate += y[: 2 * h]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            new *= gate[h:]
            new += x[2 * h :]
            np.tanh(new, out=new)
            s -= new
            s *= gate[:h]
            s += new
            if m < n:
                state[:, :m] = s
            out[:, t, :m] = s

    def score_windows(self, parts: list[np.ndarray], ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logits of windows of word ids (a column each, padded at the end, sorted by falling size). parts: each direction's inputs, features first."""
        d, h = self.dense, HIDDEN
        steps, n = ids.shape
        live = np.searchsorted(-sizes, -np.arange(steps), side="left")
        states = np.zeros((2 * h, steps, n), np.float32)
        self._read(parts[0], ids, live, d["uf"], states[:h], False)
        self._read(parts[1], ids, live, d["ub"], states[h:], True)
        e = d["a"].T @ states.reshape(2 * h, -1)
        e += d["a0"][:, None]
        np.tanh(e, out=e)
        e = (d["v"] @ e).reshape(steps, n)
        e[np.arange(steps)[:, None] >= sizes[None, :]] = -1e9
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        score = (d["w"] @ states.reshape(2 * h, -1)).reshape(steps, n)  # the unit is linear: pool its scores
        score *= e
        return score.sum(axis=0) + d["b"][0]

    def score_spans(self, table: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Logits of the spans of a flat array of word ids."""
        out = np.empty(len(starts), np.float32)
        parts = [np.ascontiguousarray((x * _HALF).T) for x in (table[:, : 3 * HIDDEN], table[:, 3 * HIDDEN :])]
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), 2048):
            some = order[at : at + 2048]
            size = sizes[some]
            within = np.minimum(np.arange(int(size[0]))[:, None], size[None, :] - 1)
            out[some] = self.score_windows(parts, flat[starts[some][None, :] + within], size)
        return out

    def empty(self) -> float:
        return float(1 / (1 + np.exp(-self.dense["b"][0])))

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        """By text: the highest score of its windows."""
        out = np.full(len(texts), self.empty())
        flat, first, known = code([words_of(t) for t in texts])
        if not len(flat):
            return out
        owner, starts, sizes = spans_of(first)
        logits = self.score_spans(self.project(self.inputs(spell(known))[0]), flat, starts, sizes)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, logits)
        has = np.isfinite(best)
        out[has] = 1 / (1 + np.exp(-np.clip(best[has], -30, 30)))
        return out


def code(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word ids of all documents in a row, where each document starts (and the end), and the distinct words."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    first = np.cumsum([0, *map(len, docs)])
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(docs)), np.int64, int(first[-1]))
    return flat, first, list(known)


def spans_of(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and size of every window, in document order."""
    spans = [(k, int(first[k]) + a, b - a) for k in range(len(first) - 1) for a, b in windows(int(first[k + 1] - first[k]))]
    return tuple(np.array(x, np.int64) for x in zip(*spans))  # type: ignore[return-value]


class Trainer:
    """Adam for dense weights, and for the rows of the tables that a batch touches."""

    def __init__(self, net: Network, spelled: tuple, rate: float = 0.01, table_rate: float = 0.02):
        self.net, self.rate, self.table_rate, self.t = net, rate, table_rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.rows = {name: (np.zeros_like(getattr(net, name)), np.zeros(len(getattr(net, name)), np.float32)) for name in ("word", "char")}
        self.whole, self.grams = spelled
        self.begins = [np.searchsorted(of, np.arange(len(self.whole) + 1)) for _, of in self.grams]

    def spelled(self, words: np.ndarray) -> tuple:
        """The spelling of some of the words, renumbered."""
        grams = []
        for (hashes, _), begin in zip(self.grams, self.begins):
            many = begin[words + 1] - begin[words]
            offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            grams.append((hashes[np.repeat(begin[words], many) + offset], np.repeat(np.arange(len(words)), many)))
        return self.whole[words], grams

    def _direction(self, x, u, mask, backward):
        h = HIDDEN
        n, steps, _ = x.shape
        s, kept = np.zeros((n, h), np.float32), {}
        out = np.zeros((n, steps, h), np.float32)
        for t in reversed(range(steps)) if backward else range(steps):
            y = s @ u
            gate = _gates(x[:, t, : 2 * h] + y[:, : 2 * h])
            z, r = gate[:, :h], gate[:, h:]
            new = np.tanh(x[:, t, 2 * h :] + r * y[:, 2 * h :])
            kept[t] = (s, z, r, new, y[:, 2 * h :])
            s = out[:, t] = np.where(mask[:, t, None], new + z * (s - new), s)
        return out, kept

    def _undirection(self, grad, u, mask, kept, backward):
        h = HIDDEN
        n, steps, _ = grad.shape
        dx, du, carry = np.zeros((n, steps, 3 * h), np.float32), np.zeros_like(u), np.zeros((n, h), np.float32)
        for t in range(steps) if backward else reversed(range(steps)):
            s, z, r, new, yn = kept[t]
            total = grad[:, t] + carry
            on = total * mask[:, t, None]
            dnew = on * (1 - z) * (1 - new * new)
            dz = on * (s - new) * z * (1 - z)
            dr = dnew * yn * r * (1 - r)
            dx[:, t] = np.concatenate([dz, dr, dnew], axis=1)
            dy = np.concatenate([dz, dr, dnew * r], axis=1)
            du += s.T @ dy
            carry = dy @ u.T + on * z + (total - on)
        return dx, du

    def step(self, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
        """One update on a batch of windows, a row of word ids each; returns the mean loss."""
        net, d, h = self.net, self.net.dense, HIDDEN
        mask = np.arange(ids.shape[1])[None, :] < sizes[:, None]
        words, ids = np.unique(ids, return_inverse=True)
        ids = ids.reshape(mask.shape)
        x, (row, cells, n) = net.inputs(self.spelled(words))
        table = net.project(x)
        read = table[ids]
        hf, kf = self._direction(read[:, :, : 3 * h], d["uf"], mask, False)
        hb, kb = self._direction(read[:, :, 3 * h :], d["ub"], mask, True)
        states = np.concatenate([hf, hb], axis=2) * mask[:, :, None]
        flat = states.reshape(-1, 2 * h)
        tan = np.tanh(flat @ d["a"] + d["a0"])
        e = np.where(mask, (tan @ d["v"]).reshape(mask.shape), -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True))
        att = (e / e.sum(axis=1, keepdims=True)).astype(np.float32)
        pooled = np.einsum("nt,nth->nh", att, states)
        logit = pooled @ d["w"] + d["b"][0]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        dl = ((p - y) * weight / weight.sum()).astype(np.float32)
        g = {"w": pooled.T @ dl, "b": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * d["w"][None, :]
        da = np.einsum("nth,nh->nt", states, dp)
        ds = att[:, :, None] * dp[:, None, :]
        de = att * (da - (att * da).sum(axis=1, keepdims=True))
        dtan = de.reshape(-1, 1) * d["v"][None, :] * (1 - tan * tan)
        g |= {"v": tan.T @ de.reshape(-1), "a": flat.T @ dtan, "a0": dtan.sum(axis=0)}
        ds += (dtan @ d["a"].T).reshape(ds.shape)
        ds *= mask[:, :, None]
        dxf, g["uf"] = self._undirection(ds[:, :, :h], d["uf"], mask, kf, False)
        dxb, g["ub"] = self._undirection(ds[:, :, h:], d["ub"], mask, kb, True)
        dt = np.zeros_like(table)
        np.add.at(dt, ids[mask], np.concatenate([dxf, dxb], axis=2)[mask])
        g |= {"in": x.T @ dt, "in0": dt.sum(axis=0)}
        dx = dt @ d["in"].T
        self.t += 1
        self._sparse("word", row, dx[:, :WORD_DIMS])
        share = dx[:, WORD_DIMS:] / n[:, None]
        self._sparse("char", np.concatenate([c for c, _ in cells]), np.concatenate([share[of] for _, of in cells]))
        for k, grad in g.items():
            grad = np.clip(grad, -1, 1)
            self.m[k] = 0.9 * self.m[k] + 0.1 * grad
            self.v[k] = 0.999 * self.v[k] + 0.001 * grad * grad
            d[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-7)).astype(np.float32)
        return float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / weight.sum())

    def _sparse(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        """Adam with one second moment a row; rows that the batch doesn't touch stay."""
        table, (m, v) = getattr(self.net, name), self.rows[name]
        which, inverse = np.unique(rows, return_inverse=True)
        total = np.zeros((len(which), grad.shape[1]), np.float32)
        np.add.at(total, inverse, grad)
        m[which] = 0.8 * m[which] + 0.2 * total
        v[which] = 0.99 * v[which] + 0.01 * (total * total).mean(axis=1)
        late = np.sqrt(1 - 0.99 ** min(self.t, 2000))
        table[which] -= self.table_rate * m[which] / (np.sqrt(v[which])[:, None] / late + 1e-6)


def train(texts: list[list[bytes]], owner: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Network:
    """The network from windows (lists of words), the document of each (in rising order) and the documents' labels."""
    rng = np.random.default_rng(seed)
    flat, first, known = code(texts)
    starts, sizes = first[:-1], np.diff(first)
    spelled = spell(known)
    net = Network.start()
    trainer = Trainer(net, spelled)
    clean = np.concatenate([flat[starts[k] : starts[k] + sizes[k]] for k in np.flatnonzero(labels[owner] == 0)])
    share = 1 / np.bincount(owner, minlength=len(labels))[owner]
    toxic, good = np.flatnonzero(labels[owner] == 1), np.flatnonzero(labels[owner] == 0)
    n_toxic = int(labels.sum())
    size = max(16, min(BATCH, 3 * n_toxic * epochs // LEAST_STEPS))
    for epoch in range(epochs):
        if epoch < WARM:
            chosen = np.concatenate([toxic, rng.permutation(good)[: max(2 * len(toxic), 64)]])
            weight = np.where(labels[owner[chosen]] == 1, share[chosen], len(toxic) / (2 * len(toxic)) * share[toxic].mean())
        else:
            heat = net.score_spans(net.project(net.inputs(spelled)[0]), flat, starts, sizes)
            order = np.lexsort((-heat[toxic], owner[toxic]))
            bad = toxic[order[np.r_[True, np.diff(owner[toxic][order]) > 0]]]
            hard = good[np.argsort(-heat[good], kind="stable")]
            chosen = np.concatenate([bad, hard[: len(bad)], rng.permutation(hard[len(bad) :])[: max(2 * len(bad), 64)]])
            weight = np.ones(len(chosen))
            trainer.rate, trainer.table_rate = trainer.rate * 0.8, trainer.table_rate * 0.8
        for at in np.array_split(rng.permutation(len(chosen)), max(1, len(chosen) // size)):
            picked = chosen[at]
            width = int(sizes[picked].max())
            ids = flat[starts[picked][:, None] + np.minimum(np.arange(width)[None, :], sizes[picked][:, None] - 1)]
            # some windows more of one clean word over and over, which tell a word that is rare from one that is toxic
            echo = np.repeat(rng.choice(clean, len(at) // ECHOES + 1)[:, None], width, axis=1)
            y = np.r_[(labels[owner[picked]] == 1).astype(np.float32), np.zeros(len(echo), np.float32)]
            trainer.step(np.concatenate([ids, echo]), np.r_[sizes[picked], np.full(len(echo), width)], y, np.r_[weight[at], np.full(len(echo), weight[at].mean())].astype(np.float32))
    return net


def held_out(id_column: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def cut_windows(text: bytes | None, name: bytes, most: int = WINDOWS_A_DOC, most_bytes: int = WINDOW_BYTES) -> list[bytes]:
    """Up to most windows of a text, each as its words with spaces between them; a name chooses among more, and the same name the same ones."""
    words = words_of(text)
    spans = windows(len(words))
    if len(spans) > most:
        picked = np.random.default_rng(zlib.crc32(name)).permutation(len(spans))[:most]
        spans = [spans[k] for k in sorted(picked.tolist())]
    return [w for w in (b" ".join(words[a:b]) for a, b in spans) if len(w) <= most_bytes]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", positive: int = POSITIVE, negative: int = NEGATIVE) -> Network | None:
    """The network from windows of a bounded sample of labelled documents outside the held-out fold; None without labels of both kinds."""
    clear = clear_labels(labels, id_column, "toxic").filter(F.col("toxic").isin(0, 1) & ~held_out(F.col(id_column)))
    counts = {r[0]: r[1] for r in clear.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return None
    picks = [bounded_sample(clear.filter(F.col("toxic") == v), F.col("toxic"), F.col(id_column), n, {v: counts[v]}) for v, n in ((1, positive), (0, negative))]
    chosen = F.broadcast(picks[0].unionByName(picks[1]).select(F.col(id_column).alias("_vs_id"), F.col("toxic").alias("_vs_y")))  # at most about positive + negative rows
    sample = docs.select(F.col(id_column).alias("_vs_id"), F.col(text).alias("_vs_text")).join(chosen, "_vs_id")
    sample = sample.groupBy("_vs_id", "_vs_y").agg(F.min("_vs_text").alias("_vs_text")).select(F.col("_vs_id").cast("string").alias("id"), F.col("_vs_y").alias("y"), F.col("_vs_text").alias("text"))

    def cut(batches):
        for batch in batches:
            names, kinds, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
            out = [(n, k, w) for n, k, t in zip(names, kinds, rows) for w in cut_windows(t, n.encode())]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, kind in enumerate((pa.string(), pa.int32(), pa.binary()))], names=["id", "y", "words"])

    got = sample.mapInArrow(cut, "id string, y int, words binary").orderBy("id", "words").toArrow()
    names, inverse = np.unique(np.array(got.column("id").to_pylist(), dtype=object), return_inverse=True)
    y = np.zeros(len(names), np.int64)
    y[inverse] = np.asarray(got.column("y"))
    if {*y.tolist()} != {0, 1}:
        return None
    return train([w.split() for w in got.column("words").to_pylist()], inverse, y)


def score(docs: DataFrame, network: Network | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 up); a map without a shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(network)

    def make():
        def f(part: pa.RecordBatch) -> dict:
            texts = as_bytes(part.column(part.schema.get_field_index(text)))
            got = np.zeros(len(texts)) if held.value is None else held.value.score(texts)
            return {"score": pa.array(got.astype(np.float64))}

        return f

    out = map_columns(docs, make, T.StructType([T.StructField("score", T.DoubleType())]), [text], keep, limit=4 << 20)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
