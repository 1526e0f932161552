"""Intermediate tables in the folder that the driver and all executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir``: the files
outlive a lost executor, are column-prunable and compressed, and can be read by
any later job.  The setting is read from the session; only where it is unset and
Spark runs in one process (tests) a temporary folder is made.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}
_LISTS: ContextVar[tuple[list[str], ...]] = ContextVar("recorded", default=())

#: Most bytes of a table that is broadcast, as its rows take in memory, and what a
#: row takes besides its values.
BROADCAST_BYTES, ROW_BYTES = 48 << 20, 32


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-scratch-")
    return _LOCAL[app]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    for written in _LISTS.get():
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The tables that ``stage`` writes in this thread while the block lasts; other runs
    of the same application have lists of their own."""
    lists, mine = _LISTS.get(), []
    token = _LISTS.set((*lists, mine))
    try:
        yield mine
    finally:
        _LISTS.reset(token)


def drop(spark: SparkSession, written: list[str], keep: int = 0) -> int:
    """Delete the tables of a recorded list but for the last ``keep``; results that
    still read them must have been written before.  Returns how many went."""
    paths = written[: len(written) - keep]
    del written[: len(written) - keep]
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)


def _bytes(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value, nested ones included."""
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StringType | T.BinaryType | T.ArrayType | T.MapType):
            return F.coalesce(F.aggregate(c, F.lit(0), lambda n, x: n + _bytes(x, kind.elementType).cast("int")), F.lit(0)) + 16
        return F.coalesce(F.size(c), F.lit(0)) * _fixed(kind.elementType) + 16
    if isinstance(kind, T.StructType):
        return sum((_bytes(c[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def _fixed(kind: T.DataType) -> int:
    return 16 + sum(_fixed(f.dataType) for f in kind.fields) if isinstance(kind, T.StructType) else 8


def size_bytes(df: DataFrame) -> int:
    """Bytes that the rows of ``df`` (a staged table) take in memory, about."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` (a staged table) for broadcast if its rows take at most ``most``
    bytes; beyond that Spark shuffles both sides."""
    return F.broadcast(df) if size_bytes(df) <= most else df
