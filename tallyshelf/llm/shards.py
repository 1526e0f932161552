"""Token sequences in training order, as binary shard files of fixed stride.

Every document's ids and an end id are cut into sequences of ``stride`` ids, the
last padded.  Sequences are numbered without gaps, a keyed Feistel permutation
with cycle-walking turns the number into a slot, and slots are dealt by range:
file ``shard=s`` holds slots s * per_shard and on, in order.  A record is the ids
in little-endian order and one line feed, so slot k starts at byte
(k % per_shard) * record of its shard; a reader opens that one file (1 MB as set
here), goes to the place and resumes.  Files may be compressed as wholes: padded
ids take twice the space otherwise.

Files are written by Spark's text sink, so a lost task or job leaves none in
part, in any store that Spark writes.  Beside them, ``slots`` says which document
piece each slot holds, and ``manifest`` first slot, slots, bytes and checksum of
every shard.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from math import ceil
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.llm.batches import byte_slices
from tallyshelf.llm.tokens import COLUMN_BYTES, END, default_path, encoder
from tallyshelf.scratch import broadcast_if_small, scratch_dir, stage

STRIDE, PER_SHARD, KEY = 1024, 512, 0x5EED
#: Codec of shard files ("none": raw, so that a seek in the file finds a slot).
CODEC = "gzip"
#: A task writes whole shards, of about this many bytes in all.
TASK_BYTES = 1 << 26
_ROUNDS = 6


def id_bytes(tokenizer: str | None = None) -> int:
    """Bytes of a stored id: two if all ids of the vocabulary fit, else four."""
    with open(tokenizer or default_path(), encoding="utf-8") as f:
        held = json.load(f)
    most = max([*held["model"]["vocab"].values(), *(t["id"] for t in held["added_tokens"]), END])
    return 2 if most < 1 << 16 else 4


def _round_keys(key: int) -> list[np.uint64]:
    return [np.uint64(x) for x in np.random.Generator(np.random.PCG64(key)).integers(0, 2**63, _ROUNDS, dtype=np.uint64)]


def feistel(x: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """The slots of numbers ``x`` < n: a bijection of 0 .. n - 1 chosen by ``key``.

    A balanced Feistel network over the next even number of bits; values that
    land at n or above are sent through again until they fall below.
    """
    half = np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = _round_keys(key)
    out = x.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & low
        for k in keys:
            f = (right ^ k) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(32)
            f *= np.uint64(0xD6E8FEB86659FD93)
            f ^= f >> np.uint64(29)
            left, right = right, left ^ (f & low)
        out[walking] = (left << half) | right
        walking = walking[out[walking] >= np.uint64(n)]
    return out.astype(np.int64)


def slot_of(number: Column, n: int, key: int = KEY) -> Column:
    """The slot of a sequence number; only the number goes to Python."""

    @F.pandas_udf("long")
    def slots(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), n, key))

    return slots(number)


def _sequences(path: str | None, stride: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, nth = encoder(path).encode_all, TaskContext.get().partitionId(), 0
        for batch in byte_slices(batches, "text", COLUMN_BYTES):
            ids, n = encode(batch.column("text"))
            ids, n = np.insert(ids.astype(f"<u{width}"), np.cumsum(n), END), n + 1
            pieces = -(-n // stride)
            row, first = np.repeat(np.arange(len(n)), pieces), np.cumsum(pieces) - pieces
            piece = np.arange(len(row)) - first[row]
            sizes = np.minimum(stride, n[row] - piece * stride)
            cuts = np.append(0, np.cumsum(sizes * width)).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), pa.py_buffer(ids)])  # slices of one buffer
            numbers = [pa.array(x, k) for x, k in ((piece, pa.int32()), (sizes, pa.int32()), (np.full(len(row), task), pa.int32()), (nth + np.arange(len(row)), pa.int64()))]
            nth += len(row)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), *numbers, packed], names=["doc_id", "piece", "n_tokens", "task", "nth", "ids"])

    return run


class Shards:
    """Shards that were written to ``path``."""

    def __init__(self, spark: SparkSession, path: str, stride: int, per_shard: int, width: int):
        self.spark, self.path, self.per_shard = spark, path, per_shard
        self.record, self.ids = stride * width + 1, stride * width

    def files(self) -> DataFrame:
        """shard and content of every shard file, a row each."""
        text = self.spark.read.schema("value string, shard long").text(f"{self.path}/shards", wholetext=True)
        return text.select("shard", F.col("value").cast("binary").alias("content"))

    def records(self, first: int = 0, last: int | None = None, digest: bool = False) -> DataFrame:
        """shard, slot and ids of the records of slots ``first`` to ``last``, cut from
        the shard files by arithmetic; or n_bytes and ids_crc32 of the ids."""
        record, size, per_shard = self.record, self.ids, self.per_shard
        stop = 2**62 if last is None else last + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content"), strict=True):
                    held = content.as_buffer()
                    base = shard * per_shard
                    low, high = max(first - base, 0), min(stop - base, len(held) // record)
                    if low >= high:
                        continue
                    rows = np.frombuffer(held, np.uint8)[low * record : high * record].reshape(-1, record)[:, :size]
                    slot = pa.array(np.arange(base + low, base + high))
                    if digest:
                        crc = pa.array([crc32(r.tobytes()) for r in rows], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), slot, pa.array([size] * len(rows), pa.int64()), crc], names=["shard", "slot", "n_bytes", "ids_crc32"])
                    else:
                        cuts = np.arange(len(rows) + 1, dtype=np.int32) * size
                        ids = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(rows))])
                        yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.int64()), slot, ids], names=["shard", "slot", "ids"])

        files = self.files().filter(F.col("shard").between(first // per_shard, (stop - 1) // per_shard))
        return files.mapInArrow(run, "shard long, slot long, " + ("n_bytes long, ids_crc32 long" if digest else "ids binary"))

    def slots(self) -> DataFrame:
        """slot, doc_id, piece and n_tokens."""
        return self.spark.read.parquet(f"{self.path}/slots")

    def manifest(self) -> DataFrame:
        """shard, first_slot, slots, bytes and crc32 of every shard file."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def read(self, first: int, count: int) -> DataFrame:
        """Slots first .. first + count - 1 in order: where a reader resumes.  Only
        the shards that hold them are opened, and of these only those records cut."""
        return self.records(first, first + count - 1).orderBy("slot")


def write_shards(docs: DataFrame, path: str, stride: int = STRIDE, per_shard: int = PER_SHARD, key: int = KEY, tokenizer: str | None = None, codec: str = CODEC) -> Shards:
    """Write all documents (doc_id, text) to ``path`` in training order.

    A record is ``stride`` ids, padded with the end id.  Null and empty texts give
    one sequence that holds the end id alone; rows with equal or null doc_id are
    kept each; no documents give no shard.  Further columns are ignored.
    """
    spark, width = docs.sparkSession, id_bytes(tokenizer)
    kinds = "doc_id long, piece int, n_tokens int, task int, nth long, ids binary"
    cut = stage(docs.select("doc_id", "text").mapInArrow(_sequences(tokenizer, stride, width), kinds), "shards-cut")
    tasks = stage(cut.groupBy("task").agg(F.count("*").alias("n")), "shards-tasks")  # a row a task
    n = tasks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = stage(tasks.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "shards-bases")
    numbered = cut.join(broadcast_if_small(base), "task").withColumn("slot", slot_of(F.col("base") + F.col("nth"), n, key))
    numbered.select("slot", "doc_id", "piece", "n_tokens").write.option("compression", "zstd").parquet(f"{path}/slots")
    shards = ceil(n / per_shard)
    tasks_ = max(1, min(shards, max(ceil(stride * width * n / TASK_BYTES), spark.sparkContext.defaultParallelism)))
    pad = np.array([END], f"<u{width}").tobytes().hex()
    record = F.concat("ids", F.unhex(F.repeat(F.lit(pad), F.lit(stride) - F.col("n_tokens")))).cast("string")
    placed = numbered.select(F.floor(F.col("slot") / per_shard).cast("long").alias("shard"), "slot", "ids", "n_tokens")
    placed = placed.repartitionById(tasks_, F.floor(F.col("shard") * tasks_ / max(shards, 1)).cast("int")).sortWithinPartitions("shard", "slot")
    placed.select("shard", record.alias("value")).write.partitionBy("shard").option("compression", codec).option("zlib.compress.level", "BEST_SPEED").text(f"{path}/shards")
    out = Shards(spark, path, stride, per_shard, width)
    files = out.files() if n else spark.createDataFrame([], "shard long, content binary")
    size = F.length("content").cast("long")
    rows = files.select("shard", (F.col("shard") * per_shard).alias("first_slot"), (size / out.record).cast("long").alias("slots"), size.alias("bytes"), F.crc32("content").alias("crc32"))
    rows.write.parquet(f"{path}/manifest")
    return out


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in training order; the ids are read back from the shard files."""
    from uuid import uuid4

    shards = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch_dir(spark)}/shards-{uuid4().hex}")
    found = shards.records(digest=True).join(shards.slots(), "slot")
    return found.select("doc_id", "piece", "slot", "shard", (F.col("slot") % PER_SHARD).alias("place"), "n_tokens", "n_bytes", "ids_crc32")
