"""Benchmark passages in documents, found by winnowing.

Both sides are cut to words; of every `GUARD` consecutive k-grams the one with the smallest hash (the rightmost of
equals) is a fingerprint. A shared span of k + GUARD - 1 = WINDOW words holds one full window of k-grams, whose
choice depends on the span alone, so training and test fingerprints meet in every shared span of that length: none
is missed. Hits are extended to every window of WINDOW words that holds the shared k-gram, and each is compared word
by word with the item's. Items of fewer words are one window of their own length: every k-gram is kept for them.

Only the benchmark is indexed, in blocks of bounded size that go to every worker; documents are mapped in place, so
no document is shuffled, however many share a passage. Each block joins its fingerprints, by a sorted array, with those
of all documents in one pass. A benchmark beyond one block takes one pass a block over the documents, which are numbered
and written once for that; a pass leaves a row's number, hits and items, for documents that have any, and no text.

Defined cases: null and empty texts, and texts without words, have no words and hits; texts of any length are searched
whole; items without words occur nowhere; of equal hashes in a guard the rightmost is kept; equal items count by their
ids, a null item_id is left out of the ids but its windows still hit; an empty benchmark hits nothing, an empty table has
no results; repeated rows have equal results; extra columns whose names clash with result columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import as_bytes, drop_rows, map_columns, materialize, named_back, plain_names

WINDOW, GRAM = 10, 5
GUARD = WINDOW - GRAM + 1
#: Benchmark text bytes to a block; a block is collected, indexed (some 30 bytes a byte while that is done) and sent to the workers.
BLOCK_BYTES = 8 << 20
#: Lower-cases A-Z and turns every byte that is no word byte into a space: words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive ids."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = _mix(h * _ODD + ids[k : k + count].astype(np.uint64) + np.uint64(1))
    return h


def winnow(hashes: np.ndarray, guard: int) -> np.ndarray:
    """Positions of the smallest hash, the rightmost of equals, of every guard consecutive ones."""
    n = len(hashes) - guard + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for k in range(1, guard):
        here = hashes[k : k + n]
        less = here <= best
        best[less] = here[less]
        at[less] = np.flatnonzero(less) + k
    return np.unique(at)


class Index:
    """The words, fingerprints and windows of a block of items."""

    def __init__(self, items: list[tuple[int | None, bytes | None]]):
        self.vocabulary: dict[bytes, int] = {}
        coded = []
        for _, text in items:
            coded.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32))
        known = sorted({str(i) for i, _ in items if i is not None})
        rank = {name: k for k, name in enumerate(known)}
        self.item_names = known
        #: by window length: (sorted fingerprints, sorted window hashes, window ids by row, item ranks by window)
        self.by_length: dict[int, tuple] = {}
        for length in sorted({min(len(c), WINDOW) for c in coded if len(c)}):
            gram = GRAM if length == WINDOW else length
            prints, windows, owners = [], [], []
            for (item, _), ids in zip(items, coded):
                if min(len(ids), WINDOW) != length:
                    continue
                hashes = _grams(ids, gram)
                prints.append(hashes[winnow(hashes, length - gram + 1)])
                own = np.lib.stride_tricks.sliding_window_view(ids, length)
                windows.append(own)
                owners += [rank.get(str(item), -1) if item is not None else -1] * len(own)
            rows, inverse = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
            keys = _row_hash(rows)
            order = np.argsort(keys, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pairs = np.unique(np.stack([place[inverse.ravel()], np.array(owners, np.int64)], axis=1), axis=0)
            starts = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1))
            self.by_length[length] = (gram, np.unique(np.concatenate(prints)), keys[order], rows[order], starts, pairs[:, 1])


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = _mix(h * _ODD + rows[:, k].astype(np.uint64) + np.uint64(1))
    return h


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, x)
    at[at == len(ordered)] = 0
    return ordered[at] == x


def scan(index: Index, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """For each text: the number of words, the positions of hit words, the ranks of items with an occurring window."""
    get = index.vocabulary.get
    coded, counts = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = words_of(text)
        counts[k] = len(words)
        coded += [get(w, 0) for w in words]
        coded.append(0)  # no gram runs from one text into the next
    ids = np.array(coded, np.int32)
    starts = np.cumsum(counts + 1) - counts - 1
    hit = np.zeros(len(ids) + 1, np.int64)
    found_at, found_item = [], []
    for length, (gram, prints, keys, rows, firsts, owners) in index.by_length.items():
        hashes = _grams(ids, gram)
        guard = length - gram + 1
        picked = winnow(hashes, guard) if guard > 1 else np.arange(len(hashes))
        shared = picked[_among(hashes[picked], prints)] if len(picked) else picked
        if not len(shared):
            continue
        begins = np.unique((shared[:, None] - np.arange(guard)[None, :]).ravel())
        begins = begins[(begins >= 0) & (begins + length <= len(ids))]
        if not len(begins):
            continue
        found = ids[begins[:, None] + np.arange(length)[None, :]]
        key = _row_hash(found)
        lo = np.searchsorted(keys, key)
        hi = np.searchsorted(keys, key, side="right")
        for step in range(int((hi - lo).max())):  # more than one only where hashes of different windows are equal
            live = np.flatnonzero(lo + step < hi)
            same = live[(rows[lo[live] + step] == found[live]).all(axis=1)]
            at = begins[same]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + length, -1)
            window = lo[same] + step
            many = firsts[window + 1] - firsts[window]
            doc = np.searchsorted(starts, at, side="right") - 1
            # a window that recurs in a text adds its items once
            pair, take = np.unique(np.stack([doc, window], axis=1), axis=0, return_index=True)
            many = many[take]
            found_at.append(np.repeat(pair[:, 0], many))
            offsets = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found_item.append(owners[np.repeat(firsts[pair[:, 1]], many) + offsets])
    covered = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
    doc = np.searchsorted(starts, covered, side="right") - 1
    words = np.split(covered - starts[doc], np.searchsorted(doc, np.arange(1, len(texts))))
    if found_at:
        both = np.unique(np.stack([np.concatenate(found_at), np.concatenate(found_item)], axis=1), axis=0)
        both = both[both[:, 1] >= 0]
        items = np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, len(texts))))
    else:
        items = [np.zeros(0, np.int64)] * len(texts)
    return counts, words, items


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int) -> list[DataFrame]:
    items = benchmark.select(F.col(item_id).alias("item"), F.col(text).alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    n = max(1, -(-2 * total // limit) if total > limit else 1)
    return [items if n == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) for k in range(n)]


_RAW = T.StructType([T.StructField("_vs_words", T.LongType()), T.StructField("_vs_hit", T.ArrayType(T.LongType())), T.StructField("_vs_items", T.ArrayType(T.StringType()))])


def _one_pass(docs: DataFrame, block: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns with _vs_words, _vs_hit and _vs_items of one block of the benchmark; a map without a shuffle."""
    index = docs.sparkSession.sparkContext.broadcast(Index([(r[0], r[1].encode()) for r in block.toLocalIterator()]))

    def make():
        def f(part: pa.RecordBatch) -> dict:
            of = index.value
            counts, words, items = scan(of, as_bytes(part.column(part.schema.get_field_index(text))))
            held = [[of.item_names[i] for i in x] for x in items]
            return {"_vs_words": pa.array(counts), "_vs_hit": pa.array([x.tolist() for x in words], pa.list_(pa.int64())), "_vs_items": pa.array([sorted(x) for x in held], pa.list_(pa.string()))}

        return f

    return map_columns(docs, make, _RAW, [text], keep)


def _passes(held: DataFrame, blocks: list[DataFrame], text: str) -> DataFrame:
    """row, _vs_hit and _vs_items, over all blocks, of the rows of a written table that have a hit."""
    narrow = None
    for block in blocks:
        one = materialize(_one_pass(held.select("row", text), block, text, ["row"]).filter(F.size("_vs_hit") > 0).select("row", "_vs_hit", "_vs_items"), "decontaminate-pass")
        narrow = one if narrow is None else narrow.unionByName(one)
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return narrow.groupBy("row").agg(united("_vs_hit"), united("_vs_items"))


def _numbered(docs: DataFrame) -> DataFrame:
    return materialize(docs.withColumn("row", F.monotonically_increasing_id()), "decontaminate-documents")


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, hit_words (positions of hit words), items (sorted ids) and contaminated."""
    stay = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_words", "hit_words", "items", "contaminated")]
    plain, names = plain_names(docs)
    own, blocks = [names[c] for c in stay], _blocks(benchmark, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        out = _one_pass(plain, blocks[0], names[text], own)
    else:
        held = _numbered(plain.select(*{*own, names[text]}))
        hits = _passes(held, blocks, names[text])
        counted = _one_pass(held, blocks[0].limit(0), names[text], [*own, "row"]).drop("_vs_hit", "_vs_items")
        none = F.array().cast("array<long>"), F.array().cast("array<string>")
        out = counted.join(hits, "row", "left").withColumns({"_vs_hit": F.coalesce("_vs_hit", none[0]), "_vs_items": F.coalesce("_vs_items", none[1])})
    return out.select(*[F.col(names[c]).alias(c) for c in stay], F.col("_vs_words").alias("n_words"), F.col("_vs_hit").alias("hit_words"), F.col("_vs_items").alias("items"), (F.size("_vs_hit") > 0).alias("contaminated"))


def digest(marked: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's columns of marked documents."""
    return marked.select(
        id_column, "n_words", F.size("hit_words").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without those that hold a window of an item."""
    plain, names = plain_names(docs)
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        return named_back(_one_pass(plain, blocks[0], names[text], plain.columns).filter(F.size("_vs_hit") == 0), names)
    held = _numbered(plain)
    return named_back(drop_rows(held, materialize(_passes(held, blocks, names[text]).select("row"), "decontaminate-hits"), "row"), names)
