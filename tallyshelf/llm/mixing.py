"""Mixing sources to target weights.

Sizes are aggregated per source, each source's target over its size is its
repetition rate, and every document is emitted floor(rate) times plus once more
if a hash of seed, doc_id and text falls under the rate's fraction.  Sizes,
rates and draws are SQL expressions; the only rows brought together are one per
source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyshelf.llm.batches import unused
from tallyshelf.scratch import broadcast_if_small, stage

#: Weights by code-point order of the sources, repeating; the share of all sizes
#: that the mix takes, as a fraction; the most that a source is repeated.
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)
MOST = 2
SEED = "mix-1"

#: Targets: water level over the sources in order of size / weight.  The first
#: sources, while the level of the rest is above their cap, are capped; the rest
#: share what is left by weight.
TARGETS = """
WITH totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM {sized} GROUP BY source),
placed AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM totals),
weighted AS (SELECT source, source_size, {weight} AS weight FROM placed),
summed AS (SELECT source, source_size, weight,
    coalesce(sum(source_size) OVER (ORDER BY 1.0E0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
    sum(weight) OVER (ORDER BY 1.0E0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
    sum(source_size) OVER () AS all_size
  FROM weighted),
levels AS (SELECT source, source_size, weight, ({num} * all_size - {den} * {most} * size_before) / ({den}.0E0 * weight_left) AS level FROM summed),
shared AS (SELECT source, source_size, weight,
    (SELECT max(CASE WHEN level * weight < {most} * source_size THEN level END) FROM levels) AS level FROM levels)
SELECT source, source_size,
    CASE WHEN level IS NULL OR level * weight >= {most} * source_size THEN CAST({most} * source_size AS DOUBLE) ELSE level * weight END AS target
FROM shared
"""


def targets_sql(sized: str, weights=WEIGHTS, share=SHARE, most: int = MOST) -> str:
    """SQL over a table ``sized`` (source, size); both Spark and DuckDB run it."""
    cases = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(weights))
    return TARGETS.format(sized=sized, weight=f"CASE k % {len(weights)} {cases} END", num=share[0], den=share[1], most=most)


def word_count(text: Column) -> Column:
    """Number of runs of other than space and the characters 9 to 13 (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number in [0, 1) from seed, doc_id and text."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def rates(sized: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """source, source_size and target from a table with source and size."""
    return sized.sparkSession.sql(targets_sql("{sized}", weights, share, most), sized=sized)


def plan(docs: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    ``docs`` needs doc_id, text and source.  A null text has size 0; a null source
    is a source, the last in order.  Rows that are alike in doc_id and text are
    drawn alike.  A source without words has rate 0.  Further columns are ignored.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text"), seed).alias("u"))
    sized = stage(sized, "mix-sized")
    sources = stage(rates(sized, weights, share, most), "mix-sources")
    sources = broadcast_if_small(sources.withColumnRenamed("source", "of"))
    out = sized.join(sources, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = F.floor(rate).cast("long") + F.when(F.col("u") < rate - F.floor(rate), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``: each as often
    as ``plan`` says.  The texts are not shuffled: the draw is made again, and
    only the rates are joined, one row per source."""
    names = docs.columns
    of, size, target, copies, copy = unused(names, "of", "of_size", "target", "copies", "copy")
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    sources = broadcast_if_small(stage(rates(sized, weights, share, most), "mix-sources")).toDF(of, size, target)
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(0.0)
    number = F.floor(rate) + F.when(draw(F.col("doc_id"), F.col("text"), seed) < rate - F.floor(rate), 1).otherwise(0)
    out = docs.join(sources, F.col("source").eqNullSafe(F.col(of))).withColumn(copies, number.cast("int"))
    return out.filter(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*(F.col(f"`{c}`") for c in names))


def op4(spark, sf_dir: str) -> DataFrame:
    """Documents mixed to 150 % of all words."""
    got = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SIZED_SQL = r"""SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 1, 8) AS BIGINT) / 4294967296.0E0 AS u
  FROM documents"""

OP4_SQL = f"""WITH sized AS ({SIZED_SQL.format(seed=SEED)}), sources AS ({targets_sql("sized")})
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
    CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM (SELECT sized.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0E0 END AS rate
  FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source)"""
