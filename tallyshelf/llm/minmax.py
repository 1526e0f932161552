"""Near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum
and its maximum, so 64 permutations make 128 values.  Bands of four values
retrieve candidates; links are confirmed on the full shingle sets.

The work, all of it in Spark joins and aggregations:

1. one pass over the texts gives a fingerprint of the shingle set, the set's
   size, 32 band keys and a 128-bit sketch (one bit of each signature value);
2. documents with equal sets form a class, named by its smallest doc_id; only
   classes go on, so a group of copies costs one row;
3. every member of a band bucket is paired with the bucket's smallest class
   (never with all others), the pairs are confirmed, and connected components
   are formed;
4. buckets that still hold several components are searched in full, in blocks:
   members of different components whose sizes and sketches allow a link have
   their full sets compared as well.  No bucket is capped.

With threshold t a pair misses all bands with probability (1 - t^4)^32 at most:
6e-11 at 0.85, 5e-8 at 0.8.  In step 4 sketches rule a link out in error with a
chance of 7e-8 at 0.85 and 2e-8 at 0.8, if no other link connects its ends.

The sides that hot keys swell are read from written tables, so that Spark can
split a skewed partition of theirs; the other side holds one row a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.batches import slices
from tallyshelf.llm.texthash import shingle_set
from tallyshelf.operators.components import connected_components
from tallyshelf.scratch import broadcast_if_small, stage

PERMUTATIONS = 64
BAND_ROWS = 4
BANDS = 2 * PERMUTATIONS // BAND_ROWS
#: Members of a bucket are compared in blocks of about this many.
BLOCK = 512

_RNG = np.random.Generator(np.random.PCG64(77))
_FACTORS = (_RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
_OFFSETS = _RNG.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)[:, None]
_BAND_FACTORS = _RNG.integers(1, 2**63, (BANDS, BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of a non-empty shingle set under each permutation."""
    low = high = None
    for at in range(0, len(shingles), 8192):
        x = shingles[None, at : at + 8192] * _FACTORS
        x += _OFFSETS
        lo, hi = x.min(axis=1), x.max(axis=1)
        low = lo if low is None else np.minimum(low, lo)
        high = hi if high is None else np.maximum(high, hi)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    keys = (sig.reshape(BANDS, BAND_ROWS) >> np.uint64(8)) * _BAND_FACTORS
    keys = keys.sum(axis=1, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    bits = (sig >> np.uint64(33)) & np.uint64(1)
    return (bits.reshape(2, 64) * _BIT).sum(axis=1, dtype=np.uint64).view(np.int64)


def sketch_cut(threshold: float) -> int:
    """Fewest equal sketch bits of a pair at the threshold, less six deviations."""
    p = (1 + threshold) / 2
    n = 2 * PERMUTATIONS
    return int(n * p - 6 * sqrt(n * p * (1 - p)))


_SIGNED = "doc_id long, n_shingles long, fp binary, bands array<long>, sk0 long, sk1 long"


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, fp, bands, sk0, sk1 = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, k)
                n.append(len(s))
                if len(s):
                    fp.append(blake2b(s.tobytes(), digest_size=16).digest())
                    sig = signature(s)
                    bands.append(band_keys(sig))
                    a, b = sketch(sig).tolist()
                else:
                    fp.append(None)
                    bands.append(None)
                    a = b = None
                sk0.append(a)
                sk1.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sk0, pa.int64()), pa.array(sk1, pa.int64())],
                names=["doc_id", "n_shingles", "fp", "bands", "sk0", "sk1"],
            )

    return run


def _confirm(k: int, percent: int):
    """Keep the pairs whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in slices(batches):
            keep = []
            for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                if b != last[0]:
                    last = (b, shingle_set(b, k))
                x, y = shingle_set(a, k), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` that are links.  ``texts`` (doc_id, text) is cut to
    the ids that pairs name before anything is shuffled."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "pair-ids")
    named = texts.join(broadcast_if_small(ids), "doc_id", "left_semi")
    left = named.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = named.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(shingle_words, percent), "a long, b long")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Components of near-duplicate documents.

    ``docs`` needs doc_id and text; further columns are ignored, whatever their
    names.  Returns doc_id, n_shingles, component_id (the smallest doc_id
    reachable over links, itself included) and kept (doc_id = component_id), one
    row per input row.  Texts that are null or without words have n_shingles 0
    and are linked with nothing.  Rows with a null doc_id link nothing: their
    component_id is null and kept is true.  Rows that share a doc_id are one node.
    """
    texts = docs.select("doc_id", "text")
    signed = stage(texts.mapInArrow(_sign(shingle_words), _SIGNED), "minmax-signed")
    usable = signed.filter("doc_id is not null and fp is not null")
    classes = usable.groupBy("fp").agg(F.min("doc_id").alias("cls"), *(F.min_by(c, "doc_id").alias(c) for c in ("n_shingles", "bands", "sk0", "sk1")))
    classes = stage(classes, "minmax-classes")
    bands = classes.select("cls", F.explode("bands").alias("band"))

    hubs = bands.groupBy("band").agg(F.min("cls").alias("hub"), F.max("cls").alias("other")).filter("hub <> other").select("band", "hub")
    hubs = broadcast_if_small(stage(hubs, "minmax-hubs"))
    pairs = stage(bands.join(hubs, "band").filter("cls <> hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")).distinct(), "minmax-stars")
    linked = stage(confirmed(pairs, texts, shingle_words, percent), "minmax-links")
    parts = stage(connected_components(linked), "minmax-parts")

    more = stage(_across(classes, parts, texts, shingle_words, percent), "minmax-links")
    whole = connected_components(linked.union(more))

    same_id = usable.select("doc_id", "fp").join(classes.select("fp", "cls"), "fp").select("doc_id", "cls")
    found = same_id.join(whole.withColumnRenamed("node", "cls"), "cls", "left").select("doc_id", F.coalesce("component", "cls").alias("c"))
    found = found.groupBy("doc_id").agg(F.min("c").alias("c"))
    out = signed.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), F.coalesce(F.coalesce("c", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def _across(classes: DataFrame, parts: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket that lie in different
    components: enough of them to connect all that any such link connects.

    A large bucket is dealt out in pairs of blocks.  First a semi-join keeps the
    members with some partner that size and sketch allow; then the full sets of
    those alone are sent to their blocks and compared there.
    """
    label = classes.select("cls", "n_shingles", "sk0", "sk1", "bands").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    label = stage(label.withColumn("part", F.coalesce("component", "cls")).drop("component"), "minmax-labels")
    bands = label.select("cls", "part", F.explode("bands").alias("band"))
    mixed = bands.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).filter("lo <> hi").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    mixed = broadcast_if_small(stage(mixed, "minmax-mixed"))
    members = label.select("cls", "part", "n_shingles", "sk0", "sk1", F.explode("bands").alias("band")).join(mixed, "band")
    members = members.withColumn("mine", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least("mine", i).alias("i"), F.greatest("mine", i).alias("j"))))
    members = stage(members.withColumn("pair", pair).select("band", "pair.i", "pair.j", "mine", "cls", "part", "n_shingles", "sk0", "sk1"), "minmax-members")
    a, b = (members.select("band", "i", "j", *(F.col(c).alias(f"{c}_{x}") for c in ("mine", "cls", "part", "n_shingles", "sk0", "sk1"))) for x in "ab")
    apart = F.bit_count(F.col("sk0_a").bitwiseXOR(F.col("sk0_b"))) + F.bit_count(F.col("sk1_a").bitwiseXOR(F.col("sk1_b")))
    on = [a.band == b.band, a.i == b.i, a.j == b.j, F.col("part_a") != F.col("part_b"), (a.i == a.j) | (F.col("mine_a") != F.col("mine_b"))]
    on += [100 * F.least("n_shingles_a", "n_shingles_b") >= percent * F.greatest("n_shingles_a", "n_shingles_b")]
    on += [apart <= 2 * PERMUTATIONS - sketch_cut(percent / 100)]
    alive = a.hint("merge").join(b, on, "left_semi").select("band", "i", "j", F.col("mine_a").alias("mine"), F.col("cls_a").alias("cls"), F.col("part_a").alias("part"))
    alive = stage(alive, "minmax-alive")
    ids = stage(alive.select(F.col("cls").alias("doc_id")).distinct(), "pair-ids")
    sets = texts.join(broadcast_if_small(ids), "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "cls long, shingles binary")
    blocks = alive.join(sets, "cls").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return blocks.select("band", "i", "j", "mine", "cls", "part", "shingles").mapInArrow(_links(percent), "a long, b long").distinct()


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t, k).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["cls", "shingles"])

    return run


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sets: a product of 0/1 matrices over
    the shingles that two sets or more hold, in slices of columns."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(every, return_inverse=True, return_counts=True)
    common = np.cumsum(count > 1) - 1
    use = count[column] > 1
    owner, column = owner[use], common[column[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - at] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _links(percent: int):
    """Per block: links between different components, less those whose ends
    earlier links of the block connect already."""

    def block(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        if len(rows) < 2:
            return
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        both = _shared(sets)
        n = np.array([len(s) for s in sets])
        ok = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y in zip(*np.nonzero(np.triu(ok, 1)), strict=True):
            p, q = root(rows[x][5]), root(rows[y][5])
            if p != q:
                parent[max(p, q)] = min(p, q)
                yield rows[x][4], rows[y][4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[:3] != rows[0][:3]:
                    out += block(rows)
                    rows = []
                rows.append(row)
            yield _pairs(out)
        yield _pairs(list(block(rows)))

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def op7(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, links from 85 % on."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle_words=3, percent=85)
