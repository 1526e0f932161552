"""Completion of names: for each prefix the names with most offers, kept as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.scratch import broadcast_if_small, stage
from tallyshelf.sources.snapshots import CatalogStore

#: Letters of the longest prefix, names of each, folders by prefix, parts of a hot prefix.
LETTERS, NAMES, BUCKETS, PARTS = 6, 10, 16, 32


def prefixes_of(name: str = "model_name", letters: int = LETTERS):
    """The prefixes of a name in lower case, from one letter on."""
    low = F.lower(F.col(name))
    return F.transform(F.sequence(F.lit(1), F.least(F.length(low), F.lit(letters))), lambda k: F.substring(low, F.lit(1), k))


def name_counts(products: DataFrame, offers: DataFrame) -> DataFrame:
    """(model_name, offers) of every name."""
    per = offers.groupBy("product_id").agg(F.count("offer_id").alias("n"))
    return products.filter("model_name <> ''").join(per, "product_id", "left").groupBy("model_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("offers"))


def best_by_prefix(names: DataFrame, touched: DataFrame | None = None, letters: int = LETTERS, n: int = NAMES) -> DataFrame:
    """(prefix, rank, model_name, offers): the ``n`` names with most offers, ties in order;
    of ``touched`` (prefix) alone if given.  A prefix of many names is ranked in parts
    first, of which each sends n names."""
    rows = names.select("model_name", "offers", F.explode(prefixes_of(letters=letters)).alias("prefix"))
    if touched is not None:
        rows = rows.join(touched, "prefix", "left_semi")
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("model_name"), F.lit(PARTS)))
    order = F.desc("offers"), F.asc("model_name")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("prefix", "_part").orderBy(*order))).filter(F.col("rank") <= n)
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy(*order))).filter(F.col("rank") <= n)
    return rows.select("prefix", "rank", "model_name", "offers")


class PrefixTable:
    """Names and their best by prefix at ``path``, as versions of two tables."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, CatalogStore(spark, path)

    def _commit(self, names: DataFrame, best: DataFrame, base: int | None) -> int:
        bucket = F.pmod(F.xxhash64("prefix"), F.lit(BUCKETS))
        best = best.withColumn("bucket", bucket.cast("int")).repartitionByRange("bucket", "prefix").sortWithinPartitions("bucket", "prefix", "rank")
        return self.store.commit({"names": names.repartitionByRange("model_name").sortWithinPartitions("model_name"), "best": best}, base)

    def build(self, names: DataFrame) -> int:
        """A first version of (model_name, offers)."""
        return self._commit(names, best_by_prefix(names), None)

    def update(self, changed: DataFrame) -> int:
        """New counts of some names (null: the name goes): only the prefixes of these are
        ranked again."""
        version = max(self.store.versions())
        held = self.store.read(version)
        changed = stage(changed.select("model_name", "offers").filter("model_name <> ''"), "prefix-changed")
        ids = broadcast_if_small(changed.select("model_name"))
        names = stage(held["names"].join(ids, "model_name", "left_anti").unionByName(changed.filter("offers is not null")), "prefix-names")
        touched = broadcast_if_small(stage(changed.select(F.explode(prefixes_of()).alias("prefix")).distinct(), "prefix-touched"))
        best = held["best"].drop("bucket").join(touched, "prefix", "left_anti").unionByName(best_by_prefix(names, touched))
        return self._commit(names, best, version)

    def complete(self, prefix: str, limit: int = NAMES) -> DataFrame:
        """Q2: (model_name, offers), best first.  A short prefix reads its own rows; a longer
        one, or a larger limit, the range of names that start with it."""
        held, low = self.store.read(), prefix.lower()
        if low and len(low) <= LETTERS and limit <= NAMES:
            at = self.spark.range(1).select(F.pmod(F.xxhash64(F.lit(low)), F.lit(BUCKETS)).cast("int")).first()[0]
            rows = held["best"].filter((F.col("bucket") == at) & (F.col("prefix") == low) & (F.col("rank") <= limit))
            return rows.orderBy("rank").select("model_name", "offers")
        return held["names"].filter(F.lower("model_name").startswith(low)).orderBy(F.desc("offers"), "model_name").limit(limit)
