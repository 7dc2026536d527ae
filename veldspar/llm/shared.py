"""What the operators of this subpackage share: Arrow maps that pass rows through, joins that hot keys don't gather in one task, prefix sums in ranges, and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import BROADCAST_BYTES, bytes_of, checked_broadcast, materialize, release, scratch_path, tables_made

__all__ = [
    "BROADCAST_BYTES", "LOWER", "WHITE", "WORD", "as_bytes", "bounded_sample", "bytes_of", "checked_broadcast", "drop_rows", "hash_uniform", "lookup", "map_columns", "materialize",
    "named_back", "plain_names", "ranged", "release", "running", "scratch_path", "slices", "tables_made", "without",
]

#: Text bytes that one call of a mapped function gets at most (a longer single row comes alone).
SLICE_BYTES = 2 << 20
#: Rows of one key above which a shuffled join treats the key apart.
HOT_ROWS = 100_000


def plain_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named c0, c1 and so on, and the new name of each: a caller's names can't clash with internal ones."""
    names = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named_back(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that have one of these names in any case: results replace extra columns whose names clash."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "left", hot_rows: int = HOT_ROWS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """rows with the columns of table, which has one row a key; how: left or inner. Both are read several times: written tables.

    A table of few bytes is broadcast. For a larger one only keys of more than hot_rows rows are, of which there are at
    most a hot_rows-th of the rows; the rest meet by a shuffle, in which no key has more rows than that.
    """
    if bytes_of(table) <= limit:
        return rows.join(F.broadcast(table), key, how)
    keyed, absent = rows.filter(F.col(key).isNotNull()), rows.filter(F.col(key).isNull())
    hot = materialize(keyed.groupBy(key).count().filter(F.col("count") > hot_rows).select(key), "hot-keys")
    few = F.broadcast(hot)
    apart = keyed.join(few, key, "left_semi").join(F.broadcast(table.join(few, key, "left_semi")), key, how)
    others = keyed.join(few, key, "left_anti").join(table.join(few, key, "left_anti"), key, how)
    met = apart.unionByName(others)
    return met.unionByName(absent, allowMissingColumns=True) if how == "left" else met


def drop_rows(held: DataFrame, gone: DataFrame, row: str) -> DataFrame:
    """held, a written table, without the rows of gone, a written table of the unique column row.

    The numbers of the dropped rows are broadcast if they have few bytes; else rows meet by a shuffle on their unique number.
    """
    return held.join(checked_broadcast(gone.select(row)), row, "left_anti")


def ranged(df: DataFrame, order: list[Column], tag: str, name: str = "range") -> DataFrame:
    """df dealt to tasks by ranges of order, and written, with the number of the row's range: numbers rise with the order, and equal rows share one."""
    return materialize(df.repartitionByRange(*order).withColumn(name, F.spark_partition_id()), tag)


def running(table: DataFrame, sums: dict[str, Column], order: list[Column], by: list[str], name: str = "range") -> DataFrame:
    """A ranged table with running sums, the row itself and its peers included, of the columns named by sums, within groups of by.

    Two levels: sums within a group and range, and sums of the ranges ahead. The second level has a row for each range
    of a group, as many at most as the shuffle has partitions.
    """
    within = Window.partitionBy(*by, name).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow) if len(order) == 1 else Window.partitionBy(*by, name).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    ranges = table.groupBy(*by, name).agg(*[F.sum(c).alias(f"{n}_s") for n, c in sums.items()])
    ranges = ranges.select(*by, name, *[F.coalesce(F.sum(f"{n}_s").over(ahead), F.lit(0)).alias(f"{n}_a") for n in sums])
    inside = table.withColumns({n: F.sum(c).over(within) for n, c in sums.items()})
    met = inside.join(checked_broadcast(materialize(ranges, "ranges-ahead")), [*by, name])
    return met.withColumns({n: F.col(n) + F.col(f"{n}_a") for n in sums}).drop(*[f"{n}_a" for n in sums])


def as_bytes(column: pa.Array) -> list[bytes | None]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def slices(batch: pa.RecordBatch, measured: list[str], limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose measured columns hold about limit bytes at most."""
    if not batch.num_rows:
        return
    sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(c))), 0), dtype=np.int64) for c in measured) + np.full(batch.num_rows, 16)
    at, ends = 0, np.cumsum(sizes)
    while at < batch.num_rows:
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
        upto = max(upto, at + 1)
        yield batch.slice(at, upto - at)
        at = upto


def map_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], added: T.StructType, measured: list[str], keep: list[str] | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """df's rows, in place, with columns computed from Arrow slices.

    make runs once a task and gives the function that maps a slice to arrays by name. keep: the input columns
    that stay (all by default); those whose names clash with an added column are replaced. No shuffle.
    """
    new = {f.name.lower() for f in added.fields}
    stay = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in new]
    schema = T.StructType([*stay, *added.fields])
    stay_names, new_names = [f.name for f in stay], [f.name for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for part in slices(batch, measured, limit):
                out = f(part)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)) for c in stay_names] + [out[c] for c in new_names], names=stay_names + new_names)

    return df.mapInArrow(run, schema)


def hash_uniform(*columns: Column | str) -> Column:
    """A double in [0, 1) that depends on the values only."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11)).cast("double") * F.lit(2.0**-53)


def bounded_sample(df: DataFrame, stratum: Column, key: Column, per_stratum: int, counts: dict | None = None) -> DataFrame:
    """About per_stratum rows of each stratum, or all where there are fewer, chosen by a hash of key.

    Rates come from a count of each stratum over all rows, so the sample's size doesn't grow with the input and
    no rows are shuffled but the counts. Strata that counts lacks give no rows.
    """
    if counts is None:
        counts = {r[0]: r[1] for r in df.groupBy(stratum.alias("s")).count().collect()}
    pick = F.lit(False)
    u = hash_uniform(key, F.lit("sample"))
    for value, n in counts.items():
        here = stratum.isNull() if value is None else stratum.eqNullSafe(F.lit(value))
        pick = pick | (here & (u < F.lit(min(1.0, per_stratum / max(n, 1)))))
    return df.filter(pick)


#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+; bytes.split() splits at the same bytes.
WHITE = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: SQL's word pattern.
WORD = r"[^\x20\x09-\x0D]+"
