"""Near-duplicate documents by SimHash fingerprints, compared bit-sliced.

A fingerprint has 64 bits. Two texts link if theirs differ in at most `radius` bits. Every pair within the radius
agrees on at least (blocks - radius) of `blocks` bit blocks, so rows are grouped by each such choice of blocks and
compared within groups only; no pair is missed. Within a group the fingerprints' bits are stored as vertical planes,
64 candidates to a machine word; distances are counted by carry-save adders, and words in which every candidate is
beyond the radius are abandoned. A group of more than `tile` fingerprints is grouped anew, by choices of blocks of the
bits that it doesn't agree on yet, which again miss no pair; what is still larger after that is split into chunks that
are compared chunk against chunk. Each group gives the edges of a spanning forest, and components are found by
contraction over those edges. Only distinct fingerprints are compared, and only those that have a link or several rows
are looked up again; the many rows of one fingerprint or component meet it by a broadcast, never in one task.

Defined cases: null and empty texts, and texts without words, have fingerprint 0 and link like any other; a text of
fewer words than a shingle is one shingle, and texts of any length are hashed whole; a bit set in exactly half of the
hashes is not set; equal rows have equal results; null ids never become a component's id (a component of null ids only
has a null id); an empty table has no components; extra columns stay out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import LOWER, as_bytes, checked_broadcast, drop_rows, lookup, map_columns, materialize, named_back, plain_names

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Rows of a group that are compared in one task; above it a group is formed anew by finer blocks, and then split into chunks.
TILE = 2048
#: Blocks of a large group's free bits beyond the radius: pairs agree on that many of them.
FINER = 2
#: Mean rows of a group above which more, narrower groups are formed.
MEAN_GROUP = 1024
_QUERIES, _LANES = 256, 1 << 14
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: n - shingle + 1].tolist()
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], dtype=np.uint64).astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, name: str = "fp") -> DataFrame:
    """docs with a long column of fingerprints; a map without a shuffle."""

    def make():
        def f(part: pa.RecordBatch) -> dict:
            return {name: pa.array([fingerprint(t) for t in as_bytes(part.column(part.schema.get_field_index(text)))], pa.int64())}

        return f

    return map_columns(docs, make, T.StructType([T.StructField(name, T.LongType())]), [text], keep)


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes: row p holds bit p of every fingerprint, packed 64 to a word."""
    n = len(fps)
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    wide = np.zeros((64, -(-n // 64) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def _beyond(s0, s1, s2, over, radius: int):
    """Lanes whose saturating three-bit count is above the radius."""
    more, equal = np.zeros_like(over), np.full_like(over, _ALL)
    for s, bit in ((s2, 4), (s1, 2), (s0, 1)):
        if radius & bit:
            equal &= s
        else:
            more |= equal & s
            equal &= ~s
    return over | more


def close_pairs(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j), i < j, of equal group whose fingerprints differ in at most radius (up to 7) bits. Rows are sorted by group."""
    n = len(fps)
    last = np.searchsorted(group, group, side="right")
    for a in range(0, n, _QUERIES):
        b = min(a + _QUERIES, n)
        upto = int(last[b - 1])
        if upto - a < 2:
            continue
        asked = np.unpackbits(fps[a:b].astype(">u8").view(np.uint8).reshape(b - a, 8), axis=1).astype(bool)
        flip = np.where(asked, _ALL, np.uint64(0))
        for lo in range(a, upto, _LANES):
            hi = min(lo + _LANES, upto)
            planes = _planes(fps[lo:hi])
            words = planes.shape[1]
            rows = np.repeat(np.arange(b - a), words)
            lanes = np.tile(np.arange(words), b - a)
            s0, s1, s2, over = (np.zeros(len(rows), np.uint64) for _ in range(4))
            for p in range(0, 64, 2):
                if p <= 12:  # nothing is abandoned yet: all words of all queries
                    x, y = ((planes[q][None, :] ^ flip[:, q][:, None]).ravel() for q in (p, p + 1))
                else:
                    x, y = (planes[q][lanes] ^ flip[rows, q] for q in (p, p + 1))
                odd = x ^ y
                two = (x & y) | (odd & s0)
                s0 ^= odd
                four = two & s1
                s1 ^= two
                over |= four & s2
                s2 ^= four
                if p in (12, 20, 28, 40):
                    alive = np.flatnonzero(_beyond(s0, s1, s2, over, radius) != _ALL)
                    if p == 12 or len(alive) < len(rows):
                        rows, lanes, s0, s1, s2, over = rows[alive], lanes[alive], s0[alive], s1[alive], s2[alive], over[alive]
                    if not len(rows):
                        break
            if not len(rows):
                continue
            near = ~_beyond(s0, s1, s2, over, radius)
            hit = np.flatnonzero(near)
            if not len(hit):
                continue
            lit = np.unpackbits(near[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, lane = np.nonzero(lit)
            i = a + rows[hit][w]
            j = lo + lanes[hit][w] * 64 + lane
            ok = (j > i) & (j < hi)
            i, j = i[ok], j[ok]
            ok = group[i] == group[j]
            if ok.any():
                yield i[ok], j[ok]


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of n rows reaches over the pairs."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _cut(bits: list[int], blocks: int) -> list[int]:
    """Masks of consecutive parts of some bits."""
    at = [round(len(bits) * k / blocks) for k in range(blocks + 1)]
    return [sum(1 << b for b in bits[lo:hi]) for lo, hi in zip(at, at[1:])]


def _masks(blocks: int, radius: int) -> list[int]:
    """Bit masks of every choice of (blocks - radius) blocks."""
    return [sum(c) for c in combinations(_cut(list(range(64)), blocks), blocks - radius)]


def _finer(mask: int, radius: int, agreed: int = FINER) -> list[int]:
    """Masks of every choice of agreed blocks among radius + agreed blocks of the bits that mask leaves free.

    Two fingerprints within the radius that agree under mask differ in at most radius of these blocks, so they agree on
    one of the choices at least.
    """
    return [sum(c) for c in combinations(_cut([b for b in range(64) if not mask >> b & 1], radius + agreed), agreed)]


def blocks_for(n: int, radius: int = RADIUS, mean_group: int = MEAN_GROUP) -> int:
    """The fewest blocks whose groups have mean_group rows at most on the average; more blocks only narrow the search, no pair is lost."""
    blocks = radius + 1
    while blocks < radius + 4 and n / 2 ** (64 * (blocks - radius) / blocks) > mean_group:
        blocks += 1
    return blocks


def near_edges(fps: DataFrame, radius: int = RADIUS, tile: int = TILE, rows: int | None = None, blocks: int | None = None) -> DataFrame:
    """Edges (u, v) of spanning forests over all groups of distinct fingerprints (column fp) that share a choice of blocks."""
    masks = _masks(blocks or blocks_for(fps.count() if rows is None else rows, radius), radius)
    literal = lambda ms: F.array(*[F.lit(_signed(m)).cast("long") for m in ms])
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")) for m in masks])).alias("t", "key"))
    keyed = keyed.select(F.col("t").cast("long").alias("t"), "key", F.lit(0).cast("long").alias("key2"), "fp")

    def hot_groups(of: DataFrame) -> DataFrame:
        sizes = of.groupBy("t", "key", "key2").agg(F.count("*").alias("n")).filter(F.col("n") > tile)
        return materialize(sizes.select("t", "key", "key2", F.ceil(F.col("n") / F.lit(tile)).cast("int").alias("chunks")), "simhash-hot")

    def apart(of: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows of groups that aren't hot, and of those that are, of which there are few."""
        few = checked_broadcast(hot)
        return of.join(few, ["t", "key", "key2"], "left_anti"), of.join(few, ["t", "key", "key2"])

    dealt = keyed
    hot = hot_groups(keyed)
    if not hot.isEmpty():
        dealt, large = apart(keyed, hot)
        choices = F.array(*[literal(_finer(m, radius)) for m in masks])
        finer = large.select("t", "key", "fp", F.posexplode(F.transform(F.element_at(choices, F.col("t").cast("int") + 1), lambda m: F.col("fp").bitwiseAND(m))).alias("t2", "key2"))
        finer = finer.select((F.col("t") * 1024 + F.col("t2") + 1).cast("long").alias("t"), F.xxhash64("key", "t2").alias("key"), "key2", "fp")
        still = hot_groups(finer)
        dealt = dealt.withColumn("tile", F.lit(0).cast("long"))
        if still.isEmpty():
            dealt = dealt.unionByName(finer.withColumn("tile", F.lit(0).cast("long")))
        else:
            small, large = apart(finer, still)
            own = F.pmod(F.xxhash64("fp", "t"), F.col("chunks")).cast("int")
            large = large.withColumn("c", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            large = large.withColumn("tile", (1 + F.least("c", "o").cast("long") * (1 << 31) + F.greatest("c", "o")).cast("long"))
            dealt = dealt.unionByName(small.withColumn("tile", F.lit(0).cast("long"))).unionByName(large.select(*dealt.columns))
    else:
        dealt = dealt.withColumn("tile", F.lit(0).cast("long"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush(final: bool):
            nonlocal kept, size
            cols = [np.concatenate([k[c] for k in kept]) for c in range(5)]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            cut = len(cols[0]) if final else (int(change[-1]) if len(change) else 0)
            group = np.zeros(len(cols[0]), np.int64)
            group[change] = 1
            group = np.cumsum(group)[:cut]
            fp = cols[4][:cut]
            kept, size = [[c[cut:] for c in cols]], len(cols[0]) - cut
            if cut:
                root = forest(cut, close_pairs(fp.view(np.uint64), group, radius))
                at = np.flatnonzero(root != np.arange(cut))
                return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[root[at]])], names=["u", "v"])
            return None

        for batch in batches:
            if batch.num_rows:
                kept.append([np.asarray(batch.column(c)) for c in range(5)])
                size += batch.num_rows
                if size >= 1 << 16 and (out := flush(False)) is not None:
                    yield out
        if size and (out := flush(True)) is not None:
            yield out

    group = ["t", "key", "key2", "tile"]
    return dealt.repartition(*group).sortWithinPartitions(*group).select(*group, "fp").mapInArrow(compare, "u long, v long")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) of every node that has an edge (long columns u and v), by contraction.

    Each round every node points to its smallest neighbour, pointers are doubled until each tree is flat, and edges
    are renamed by tree. Two rounds at least halve the nodes that still have edges: those left after one are the nodes
    without a smaller neighbour, and each of them that no other pointed to has a smaller one in the next. Rounds are
    written to the scratch folder, so lineage stays short.
    """

    def pointed(up: DataFrame, at: DataFrame) -> DataFrame:
        further = at.select(F.col("node").alias("root"), F.col("root").alias("top"))
        return lookup(up, further, "root").select("node", F.coalesce("top", "root").alias("root"))

    spark = edges.sparkSession
    edges = materialize(edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), tag)
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        up = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), tag)
        while True:
            moving = up.filter("node <> root")
            if up.join(moving.select(F.col("node").alias("root")).distinct(), "root", "left_semi").isEmpty():
                break
            up = materialize(pointed(up, moving), tag)
        steps.append(up)
        half = lookup(edges, up.select(F.col("node").alias("u"), F.col("root").alias("a")), "u", "inner")
        half = lookup(half, up.select(F.col("node").alias("v"), F.col("root").alias("b")), "v", "inner")
        edges = materialize(half.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), tag)
    if not steps:
        return spark.createDataFrame([], "node long, root long")
    found = steps[-1]
    for up in reversed(steps[:-1]):
        found = materialize(pointed(up, found), tag)
    return found


def link(narrow: DataFrame, id_column: str = "doc_id", radius: int = RADIUS, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """fp, root and component_id of every fingerprint that has a link or several rows in narrow, a written table of fp and id_column.

    The rows of any other fingerprint are components of their own.
    """
    fps = materialize(narrow.groupBy("fp").agg(F.min(id_column).alias("least_id"), F.count("*").alias("n")), "simhash-fps")
    found = components(near_edges(fps.select("fp"), radius, tile, blocks=blocks), "simhash-cc").withColumnRenamed("node", "fp")
    linked = materialize(fps.join(checked_broadcast(found), "fp").select("fp", "root", "least_id"), "simhash-linked")
    least = materialize(linked.groupBy("root").agg(F.min("least_id").alias("component_id")), "simhash-least")
    copies = fps.filter("n > 1").join(checked_broadcast(found.select("fp")), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("least_id").alias("component_id"))
    return materialize(lookup(linked, least, "root", "inner").select("fp", "root", "component_id").unionByName(copies), "simhash-classes")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, its fingerprint as 16 hex digits and the smallest id that it reaches over links."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    narrow = materialize(with_fingerprints(rows, "text", ["id"]), "simhash-docs")
    classes = link(narrow, "id").select("fp", "component_id")
    return lookup(narrow, classes, "fp").select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each group of near-duplicates: the first row that has the group's smallest id.

    Texts are hashed once and written with a row number; only the numbers of dropped rows meet them again.
    """
    plain, names = plain_names(docs)
    held = materialize(with_fingerprints(plain.withColumn("row", F.monotonically_increasing_id()), names[text]), "simhash-rows")
    narrow = held.select("row", F.col(names[id_column]).alias("id"), "fp")
    grouped = materialize(lookup(narrow, link(narrow, "id"), "fp", "inner"), "simhash-grouped")
    first = grouped.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("row").alias("row"))
    gone = materialize(grouped.select("row").join(first.select("row"), "row", "left_anti"), "simhash-dropped")
    return named_back(drop_rows(held, gone, "row"), names)
