"""Best-fit packing of documents into fixed-length training sequences.

One pass encodes the documents and cuts those longer than a sequence; each piece
is numbered among the pieces of its length in its task.  The histogram of piece
lengths (at most ``capacity`` rows) goes to the driver, where ``configlp`` turns
it into configurations with copies.  Counts per (task, length) give each piece
its rank among all of its length, and the rank names its sequence and place.
No step needs the pieces of one length, source or text together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.llm.batches import slices
from tallyshelf.llm.configlp import rounded
from tallyshelf.llm.tokens import END, encoder
from tallyshelf.scratch import broadcast_if_small, stage

CAPACITY = 1024
_END = np.array([END], np.uint32).tobytes()
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` >= 1 ids; only the first may be short."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _cut(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        task = TaskContext.get().partitionId()
        seen: Counter[int] = Counter()
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + _END
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    rows.append((doc, k, start, length, crc32(ids[4 * start : 4 * (start + length)]), task, seen[length]))
                    seen[length] += 1
            columns = zip(*rows, strict=True) if rows else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    return run


def slots(configs: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Runs of places by length and rank: sorted keys (length, first rank), the
    first sequence of the run and the place in it."""
    used: Counter[int] = Counter()
    runs, sequence = [], 0
    for config, copies in configs:
        at = 0
        for length in config:
            runs.append((length, used[length], sequence, at))
            used[length] += copies
            at += length
        sequence += copies
    runs.sort()
    length, rank, first, at = (np.array(x, np.int64) for x in zip(*runs, strict=True)) if runs else [np.empty(0, np.int64)] * 4
    return length, rank, first, at


def _place(runs: tuple[np.ndarray, ...]):
    length, rank, first, at = runs
    key = (length.astype(np.uint64) << np.uint64(48)) + rank.astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            own = (batch.column("length").to_numpy(zero_copy_only=False).astype(np.uint64) << np.uint64(48)) + mine.astype(np.uint64)
            k = np.searchsorted(key, own, side="right") - 1
            out = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(first[k] + mine - rank[k]), pa.array(at[k])],
                names=[*out.schema.names, "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Pack the documents into sequences of at most ``capacity`` tokens.

    ``docs`` needs doc_id and text.  A document is its ids and an end id, so null
    and empty texts are one token.  Documents longer than ``capacity`` are cut
    into full pieces, the first taking the remainder.  Rows with equal or null
    doc_id are packed each for itself.  Returns doc_id, piece, start, length,
    ids_crc32, sequence_id and offset, one row per piece; sequences are numbered
    from 0 and filled without gaps from offset 0.
    """
    pieces = stage(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity), _PIECES), "pack-pieces")
    tasks = stage(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "pack-counts")
    histogram = sorted(tasks.groupBy("length").agg(F.sum("n").alias("n")).collect())  # at most `capacity` rows
    sizes, counts = (np.array([row[k] for row in histogram], np.int64) for k in (0, 1))
    runs = slots(rounded(sizes, counts, capacity) if histogram else [])
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    base = stage(tasks.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "pack-bases")
    ranked = pieces.join(broadcast_if_small(base), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(runs), kinds)


def op1(spark, sf_dir: str) -> DataFrame:
    """All documents into sequences of 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
