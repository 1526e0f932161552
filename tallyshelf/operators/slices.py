"""Windows over ordered rows that are cut inside a key.

Rows are dealt by ranges of (key, order) and written with the number of their range, so
that a key with half of all rows lies in half of the slices.  A window then works within
(slice, key).  What it needs from earlier slices is carried: the last rows of a key,
or sums.  Slices follow the order, so a key that is in several is alone in all but the
first and last of them: there are fewer such keys than slices.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.scratch import broadcast_if_small, stage


def same(a: str, b: str, keys: list[str]) -> Column:
    """Rows of frames ``a`` and ``b`` with equal keys, null as null."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys))


#: Fixed value: rows that a slice takes, however many there are.
SLICE_ROWS = 1_000_000


def tasks(df: DataFrame) -> int:
    """As many tasks as shuffles have, or more if the rows of ``df`` ask for them: what a
    task sorts doesn't grow with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SLICE_ROWS))


def sliced(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """``df`` as a staged table with _slice: ranges of (keys, order), nulls first.  Rows
    that are equal in all of them are in one slice."""
    n = slices or tasks(df)
    return stage(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()), "slices")


def spanning(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(_slice, keys) of the keys that are in several slices: at most two rows a slice."""
    per = rows.select("_slice", *keys).distinct()
    several = per.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).filter("_n > 1").drop("_n")
    return broadcast_if_small(stage(several, "slices-spanning"))


def with_lookback(df: DataFrame, keys: list[str], order: list[str], rows: int, slices: int | None = None) -> DataFrame:
    """``df`` with _slice and _ghost: in each slice of a key also, as ghosts, the last
    ``rows`` rows that come before it.  A window over (_slice, keys) in ``order`` that
    looks back so far is right for all rows but the ghosts."""
    slices = slices or tasks(df)
    own = sliced(df, keys, order, slices)
    several = spanning(own, keys)
    back = [F.desc_nulls_last(c) for c in order]
    held = own.alias("a").join(several.alias("b"), (F.col("a._slice") == F.col("b._slice")) & same("a", "b", keys), "left_semi")
    tails = held.withColumn("_n", F.row_number().over(W.partitionBy("_slice", *keys).orderBy(*back))).filter(F.col("_n") <= rows).drop("_n")
    tails = stage(tails, "slices-tails")  # at most `rows` a slice
    near = (F.col("b._slice") > F.col("a._slice")) & (F.col("b._slice") <= F.col("a._slice") + rows)
    ghosts = tails.alias("a").join(several.alias("b"), near & same("a", "b", keys)).select(*(F.col(f"a.`{c}`") for c in df.columns), F.col("a._slice").alias("_from"), F.col("b._slice").alias("_slice"))
    ghosts = ghosts.withColumn("_n", F.row_number().over(W.partitionBy("_slice", *keys).orderBy(F.desc("_from"), *back))).filter(F.col("_n") <= rows).drop("_n", "_from")
    both = own.withColumn("_ghost", F.lit(False)).unionByName(ghosts.withColumn("_ghost", F.lit(True)))
    return both.repartition(slices, "_slice", *keys)


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, into: str, slices: int | None = None) -> DataFrame:
    """``df`` with ``into``: the sum of ``value`` over the key's rows up to and with those of
    the row's own ``order``."""
    slices = slices or tasks(df)
    own = sliced(df, keys, [order], slices)
    sums = own.groupBy("_slice", *keys).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    carried = stage(sums.withColumn("_before", before).filter("_before is not null").drop("_sum"), "slices-carried")
    w = W.partitionBy("_slice", *keys).orderBy(order).rangeBetween(W.unboundedPreceding, 0)
    out = own.repartition(slices, "_slice", *keys).withColumn(into, F.sum(value).over(w)).alias("a")
    out = out.join(broadcast_if_small(carried).alias("b"), (F.col("a._slice") == F.col("b._slice")) & same("a", "b", keys), "left")
    return out.select(*(F.col(f"a.`{c}`") for c in df.columns), (F.col(f"a.`{into}`") + F.coalesce("_before", F.lit(0))).alias(into))
