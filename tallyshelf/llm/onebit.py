"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is normalised and rotated; its code is the signs of its coordinates,
packed to bits, with two scalars: its norm and the inner product of the rotated
vector with its own code.  A query's rotated coordinates are cut to QUERY_BITS
bits, kept as bit planes; counts of the bits that code and planes share give the
estimate of the inner product, the scalars a bound on its error.  Candidates
whose bound reaches the k-th best exact score of the likeliest ones are reranked
on the original vectors.

The stated queries meet all candidates in blocks: both sides are dealt by a hash
of their id, each pair of blocks is one group, and every group returns at most k
rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.scratch import stage

#: Deviations that the error bound allows for, and bits of a query's coordinate.
DEVIATIONS, QUERY_BITS = 2.0, 4
CANDIDATE_BLOCK, QUERY_BLOCK = 16384, 2048
_CODED = "vec_id long, dim int, code binary, norm double, own double, vector binary, is_query boolean"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes, norms and own inner products of the rows of a matrix."""
    dim = vectors.shape[1]
    norm = np.sqrt((vectors * vectors).sum(axis=1))
    turned = (vectors / norm[:, None]) @ rotation(dim).T
    return np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(axis=1) / np.sqrt(dim)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, asks = batch.column("vec_id").to_pylist(), batch.column("is_query").to_pylist()
        by_dim: dict[int, list[tuple[int, bool, np.ndarray]]] = {}
        for i, ask, x in zip(ids, asks, batch.column("embedding"), strict=True):
            if i is None or not x.is_valid or x.values.null_count or not len(x.values):
                continue
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(v).all() and v.any():
                by_dim.setdefault(len(v), []).append((i, bool(ask), v))
        for dim, rows in by_dim.items():
            matrix = np.stack([v for _, _, v in rows])
            code, norm, own = encode(matrix)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([dim] * len(rows), pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(own), pa.array([v.tobytes() for v in matrix], pa.binary()), pa.array([r[1] for r in rows])],
                names=["vec_id", "dim", "code", "norm", "own", "vector", "is_query"],
            )


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _words(packed: np.ndarray) -> np.ndarray:
    """Rows of packed bits as 64-bit words."""
    wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    wide[:, : packed.shape[1]] = packed
    return wide.view(np.uint64)


def planes(turned: np.ndarray) -> tuple[float, float, np.ndarray]:
    """Offset, step and bit planes (as words) of a query's rotated coordinates."""
    low, top = float(turned.min()), float(turned.max())
    step = max((top - low) / (2**QUERY_BITS - 1), 1e-300)
    level = np.round((turned - low) / step).astype(np.uint8)
    return low, step, _words(np.packbits([(level >> j) & 1 for j in range(QUERY_BITS)], axis=1))


def _bits(words: list[np.ndarray]) -> np.ndarray:
    """Bits set in rows that are given as columns of words."""
    out = np.bitwise_count(words[0]).astype(np.int32)
    for w in words[1:]:
        out += np.bitwise_count(w)
    return out


def signed_sums(codes: list[np.ndarray], ones: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, float]:
    """The products of a query with the codes read as +1 and -1, from shared bits, and
    their deviation by the cut to bits.  ``codes`` are columns of words, ``ones``
    their numbers of bits."""
    low, step, bits = planes(turned)
    shared = np.zeros(len(ones), np.int32)
    for j, plane in enumerate(bits):
        shared += _bits([c & p for c, p in zip(codes, plane, strict=True)]) << j
    return (2 * low) * ones + (2 * step) * shared - turned.sum(), step * np.sqrt(len(turned) / 12)


def _search(k: int):
    def block(batches: list[pa.RecordBatch]) -> Iterator[tuple]:
        table = pa.Table.from_batches(batches)
        asks = table.column("side").to_numpy()
        mine, theirs = (table.take(np.flatnonzero(asks == s)).combine_chunks() for s in (1, 0))
        if not len(mine) or not len(theirs):
            return
        dim = mine.column("dim")[0].as_py()
        queries, vectors = (_matrix(t.column("vector"), np.float64) for t in (mine, theirs))
        q_ids, ids = (t.column("vec_id").to_numpy() for t in (mine, theirs))
        keys = mine.column("key").to_numpy()
        codes = [np.ascontiguousarray(c) for c in _words(_matrix(theirs.column("code"), np.uint8)).T]
        ones = _bits(codes)
        norm, own = (theirs.column(c).to_numpy() for c in ("norm", "own"))
        scale = norm / (own * np.sqrt(dim))
        variance = norm * norm * np.maximum(1 - own * own, 0) / (own * own * max(dim - 1, 1))
        scale2 = scale * scale
        rotated = queries @ rotation(dim).T
        lengths = np.sqrt((queries * queries).sum(axis=1))
        first = min(4 * k, len(ids))
        for q_id, key, q, turned, length in zip(q_ids, keys, queries, rotated, lengths, strict=True):
            sums, cut = signed_sums(codes, ones, turned)
            upper = sums * scale + DEVIATIONS * np.sqrt(variance * (length * length) + scale2 * (cut * cut))
            other = ids != q_id
            upper[~other] = -np.inf
            best = np.argpartition(-upper, first - 1)[:first]
            score = (vectors[best] * q).sum(axis=1)
            score[~other[best]] = -np.inf
            floor = np.partition(score, -k)[-k] if len(score) >= k else -np.inf
            use = np.flatnonzero((upper >= floor - 1e-6 * abs(floor)) & other) if np.isfinite(floor) else np.flatnonzero(other)
            rough = vectors[use] @ q
            if len(use) > k:  # exact scores of those that rounding could place among the first
                last = np.partition(rough, -k)[-k]
                use = use[rough >= last - 1e-9 * max(abs(last), float(np.abs(rough).max()))]
            score = (vectors[use] * q).sum(axis=1)
            order = np.lexsort((ids[use], -score))[:k]
            yield from zip([int(q_id)] * len(order), [int(key)] * len(order), ids[use][order].tolist(), score[order].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "cb", "qb")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if key is not None and tuple(keys[lo]) != key:
                    yield _rows(block(held))
                    held = []
                key = tuple(keys[lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield _rows(block(held))

    return run


def _rows(found: Iterator[tuple]) -> pa.RecordBatch:
    columns = [*zip(*found, strict=True)] or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "key", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows of each query row by inner product in double precision.

    ``vectors`` needs vec_id and embedding (an array of numbers); ``is_query``
    says which rows are queries.  A query's candidates are all rows of its length
    but those with its own vec_id.  Rows whose vec_id or vector is null, and
    vectors that are empty, zero or hold null or non-finite numbers, take no
    part.  Returns query_id, rank from 1, vec_id and score; equal scores go by
    smaller vec_id.  Repeated rows are candidates each; query rows alike in vec_id
    and vector are one query, those that share a vec_id alone are ranked each.
    """
    coded = stage(vectors.select("vec_id", "embedding", is_query.alias("is_query")).mapInArrow(_encode, _CODED), "onebit-codes")
    n, asked = coded.agg(F.count("*"), F.count_if("is_query")).first()
    cbs, qbs = max(1, ceil(n / CANDIDATE_BLOCK)), max(1, ceil(asked / QUERY_BLOCK))
    here = F.pmod(F.xxhash64("vec_id"), F.lit(cbs)).cast("int")
    there = F.pmod(F.xxhash64("vec_id"), F.lit(qbs)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    columns = ["dim", "cb", "qb", "side", "vec_id", "key", "code", "norm", "own", "vector"]
    candidates = coded.withColumns({"cb": here, "side": F.lit(0), "key": F.lit(0).cast("long")}).withColumn("qb", every(qbs)).select(*columns)
    asked_once = coded.filter("is_query").withColumn("key", F.xxhash64("vector")).dropDuplicates(["vec_id", "key"])
    queries = asked_once.withColumns({"qb": there, "side": F.lit(1)}).withColumn("cb", every(cbs)).select(*columns)
    blocks = candidates.union(queries).repartition("dim", "cb", "qb").sortWithinPartitions("dim", "cb", "qb")
    found = blocks.mapInArrow(_search(k), "query_id long, key long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5(spark, sf_dir: str) -> DataFrame:
    """Every twentieth embedding against all others."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
