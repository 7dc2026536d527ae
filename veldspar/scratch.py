"""Scratch tables in the folder that driver and executors share, and broadcasts of sides whose bytes were counted."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a side's rows up to which it is broadcast.
BROADCAST_BYTES = 32 << 20

_own: dict[str, str] = {}
_made: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; without one a local folder, but only where driver and executors are one process."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share: intermediate tables are written there")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="veldspar-")
    return _own[app]


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{scratch_root(spark)}/veldspar-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors cost nothing that was written."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_made() -> int:
    """How many scratch tables stand; a mark for release."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, spare_last: int = 0) -> int:
    """Delete the scratch tables made after the mark since, but for the last ones. Call it once no result that reads them is needed."""
    jvm, conf, n = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf(), 0
    upto = len(_made) - spare_last
    gone = _made[since:upto]
    del _made[since:upto]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def _field_bytes(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        if isinstance(field.dataType.elementType, T.StringType):
            return F.coalesce(F.octet_length(F.array_join(c, "")) + 16 * F.size(c), F.lit(0)) + 16
        return 16 * F.greatest(F.size(c), F.lit(0)) + 16
    return F.lit(16)


def bytes_of(df: DataFrame) -> int:
    """About the bytes of all rows of df, by an aggregate over them."""
    return df.agg(F.sum(reduce(lambda a, b: a + b, [_field_bytes(f) for f in df.schema.fields], F.lit(16)).cast("long"))).first()[0] or 0


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its rows, which are counted first, have at most limit bytes; else as it is, for a shuffled join."""
    return F.broadcast(df) if bytes_of(df) <= limit else df
