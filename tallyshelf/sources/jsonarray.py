"""One JSON array, many tasks: a feed file is cut at object boundaries by byte range.

The text source reads a file in blocks, as lines that end with "}".  Whether a block starts
inside a string follows from the number of quotes before it, its depth from the
brackets before it, both running sums over the file's blocks.  With these a task finds
the array's objects in its block; the ones that blocks cut are put together from
their parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.scratch import broadcast_if_small, stage

#: A backslash with what it escapes, a quote, or a bracket.
_SIGN = re.compile(r'\\.|["{}\[\]]', re.S)
_BLOCKS = "file string, block long, quotes long, outside long, inside long"
_PARTS = "file string, block long, kind int, text string"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes of each block, and how much deeper it ends, if it starts outside a string
    and if inside; a block's rows are counted as they come."""
    sums: dict[tuple, list[int]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            n = sums.setdefault((row["file"], row["block"]), [0, 0, 0])
            for sign in _SIGN.findall(row["value"] + "}"):
                if sign == '"':
                    n[0] += 1
                elif len(sign) == 1:
                    n[1 + n[0] % 2] += 1 if sign in "{[" else -1
    rows = [(*k, *v) for k, v in sums.items()]
    columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "block", "quotes", "outside", "inside"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole objects (kind 0), ends of objects begun before (1), middles (2) and beginnings (3)."""
    at, depth, quoted, begun, parts = None, 0, False, False, []
    out: list[tuple] = []

    def flush() -> None:
        if parts:
            out.append((*at, 3 if begun else 2, "".join(parts)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["file", "block", "kind", "text"])

    for batch in batches:
        for row in batch.to_pylist():
            if at != (row["file"], row["block"]):
                flush()
                at, depth, quoted, begun, parts = (row["file"], row["block"]), row["depth"], bool(row["quoted"]), False, []
            text = row["value"] + "}"
            start = 0 if depth >= 2 else None
            for m in _SIGN.finditer(text):
                sign = m[0]
                if sign == '"':
                    quoted = not quoted
                elif quoted or len(sign) > 1:
                    continue
                elif sign in "{[":
                    depth += 1
                    if depth == 2 and sign == "{":
                        start, begun = m.start(), True
                else:
                    depth -= 1
                    if depth == 1 and start is not None:
                        parts.append(text[start : m.end()])
                        out.append((*at, 0 if begun else 1, "".join(parts)))
                        start, parts, begun = None, [], False
            if start is not None:
                parts.append(text[start:])
        yield batch_of(out)
        out = []
    flush()
    yield batch_of(out)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): every object of the JSON arrays in the files of ``path``, as text.
    Values of the array that are no objects are left out."""
    lines = spark.read.option("lineSep", "}").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    counts = stage(lines.mapInArrow(_counts, _BLOCKS).groupBy("file", "block").agg(*(F.sum(c).alias(c) for c in ("quotes", "outside", "inside"))), "json-blocks")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    states = counts.withColumn("quoted", quoted).withColumn("deeper", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")))
    states = stage(states.select("file", "block", "quoted", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth")), "json-states")
    rows = lines.withColumn("pos", F.monotonically_increasing_id()).join(broadcast_if_small(states), ["file", "block"])
    parts = stage(rows.sortWithinPartitions("file", "block", "pos").mapInArrow(_cut, _PARTS), "json-parts")
    # parts of cut objects: a beginning, middles, an end, in the order of their blocks
    place = F.when(F.col("kind") == 3, 1).otherwise(0)
    cut = parts.filter("kind > 0").withColumn("one", F.sum(place).over(W.partitionBy("file").orderBy("block", "kind").rowsBetween(W.unboundedPreceding, 0)))
    pieces = F.sort_array(F.collect_list(F.struct("block", "kind", "text")))
    joined = cut.groupBy("file", "one").agg(F.array_join(F.transform(pieces, lambda p: p.text), "").alias("text"))
    return parts.filter("kind = 0").select("file", "text").union(joined.select("file", "text"))
