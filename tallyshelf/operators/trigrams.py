"""A trigram index over short texts: fuzzy search and similar pairs without a scan.

An index is a folder with three tables: ``postings`` (gram, field, id, n: a row for each
distinct trigram of a text and the number of that text's trigrams), dealt into folders
by gram and sorted in them, so that a lookup reads the row groups of its grams alone;
``grams`` (field, gram, often), a row for each gram; and ``names`` (id, the texts, their
gram arrays), dealt by id.  A posting list is rows, not an array: a gram of a third of all
names is as many rows, which any number of tasks read.
"""

from __future__ import annotations

import math
import re
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.scratch import broadcast_if_small, stage

#: Folders that postings and names are dealt into.
BUCKETS = 16


def trigrams(text: Column) -> Column:
    """Distinct trigrams of "  word " for every alphanumeric word."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    grams = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def grams_of(text: str) -> list[str]:
    """The trigrams of one text, in the same order."""
    padded = (f"  {w} " for w in re.split("[^a-z0-9]+", text.lower()) if w)
    return list(dict.fromkeys(p[i : i + 3] for p in padded for i in range(len(p) - 2)))


def prefix(n: int, threshold: float) -> int:
    """Of a text's n grams, how many any other at the threshold must share one of."""
    return n - math.ceil(threshold * n - 1e-9) + 1


class TrigramIndex:
    """An index at ``path`` over ``fields`` of rows with a unique ``id``."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.fields, self.buckets = spark, path.rstrip("/"), fields, buckets
        self.postings, self.grams, self.names = (spark.read.parquet(f"{self.path}/{t}") for t in ("postings", "grams", "names"))

    @classmethod
    def build(cls, df: DataFrame, key: str, fields: list[str], path: str, buckets: int = BUCKETS) -> TrigramIndex:
        """Write the index of ``df`` to a new folder.  Null texts have no grams."""
        arrays = [F.coalesce(trigrams(F.col(f)), F.array().cast("array<string>")).alias(f"grams_{k}") for k, f in enumerate(fields)]
        names = df.select(F.col(key).alias("id"), *fields, *arrays, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"))
        names.repartition("bucket", F.pmod(F.xxhash64("id", F.lit("part")), F.lit(64))).write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/names")
        names = df.sparkSession.read.parquet(f"{path}/names")
        rows = None
        for k in range(len(fields)):
            one = names.select(F.explode(f"grams_{k}").alias("gram"), F.lit(k).alias("field"), "id", F.size(f"grams_{k}").alias("n"))
            rows = one if rows is None else rows.union(one)
        rows = rows.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
        # a range of (bucket, gram, id) a task: hot grams are cut, files are sorted
        rows.repartitionByRange("bucket", "gram", "field", "id").sortWithinPartitions("bucket", "gram", "field").write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
        df.sparkSession.read.parquet(f"{path}/postings").groupBy("field", "gram").agg(F.count("*").alias("often")).write.parquet(f"{path}/grams")
        return cls(df.sparkSession, path, fields, buckets)

    def _bucket_of(self, grams: list[str]) -> list[int]:
        values = self.spark.createDataFrame([(g,) for g in grams], "gram string")
        return [r[0] for r in values.select(F.pmod(F.xxhash64("gram"), F.lit(self.buckets)).cast("int")).distinct().collect()]

    def lists(self, grams: list[str]) -> DataFrame:
        """The postings of some grams; no other folder and row group is read."""
        if not grams:
            return self.postings.limit(0)
        return self.postings.filter(F.col("bucket").isin(self._bucket_of(grams)) & F.col("gram").isin(grams))

    def texts(self, ids: DataFrame) -> DataFrame:
        """The names rows of a staged table of ids; only the folders that they lie in are read."""
        at = [r[0] for r in ids.select(F.pmod(F.xxhash64("id"), F.lit(self.buckets)).cast("int")).distinct().collect()]
        return self.names.filter(F.col("bucket").isin(at)).join(broadcast_if_small(ids), "id", "left_semi")

    def _often(self, grams: list[str]) -> dict[tuple[int, str], int]:
        """How often the grams occur, by field: a row for each gram and field asked for."""
        return {(r.field, r.gram): r.often for r in self.grams.filter(F.col("gram").isin(grams)).collect()} if grams else {}

    def similar(self, term: str, threshold: float = 0.3) -> DataFrame:
        """(id, score): texts of which some field shares at least ``threshold`` of all
        trigrams with the term, by the best field.

        Rarest grams first: a text at the threshold has one of the first n - ceil(t n) + 1;
        candidates within the sizes allowed are verified by the lists of all grams."""
        asked = grams_of(term)
        n, often, found = len(asked), self._often(asked), None
        for k in range(len(self.fields)):
            if not n:
                break
            rare = sorted(asked, key=lambda g: (often.get((k, g), 0), g))[: prefix(n, threshold)]
            sized = (F.col("field") == k) & (F.col("n") >= math.ceil(threshold * n - 1e-9)) & (F.col("n") <= math.floor(n / threshold + 1e-9))
            some = stage(self.lists([g for g in rare if (k, g) in often]).filter(sized).select("id").distinct(), "trigram-candidates")
            shared = self.lists([g for g in asked if (k, g) in often]).filter(sized).join(broadcast_if_small(some), "id", "left_semi").groupBy("id", "n").agg(F.count("*").alias("shared"))
            score = shared.select("id", (F.col("shared") / (F.col("n") + n - F.col("shared"))).alias("score"))
            found = score if found is None else found.union(score)
        if found is None:
            return self.names.select("id", F.lit(0.0).alias("score")).limit(0)
        return found.filter(F.col("score") >= threshold).groupBy("id").agg(F.max("score").alias("score"))

    def holding(self, words: list[str]) -> DataFrame:
        """ids of rows whose texts, joined by spaces and in lower case, hold every word.

        The word whose pieces are rarest in the index names the candidates; a piece
        of one or two letters stands for all grams with it.  Words without letters or
        digits need all names."""
        whole, hit = F.lower(F.concat_ws(" ", *self.fields)), F.lit(True)
        for w in words:
            hit = hit & whole.contains(w)
        best: tuple[int, list[str]] | None = None
        for piece in {p for w in words for p in re.split("[^a-z0-9]+", w) if p}:
            options = [[piece[i : i + 3]] for i in range(len(piece) - 2)]
            if not options:  # short: at most as many grams as the alphabet allows
                options = [[r.gram for r in self.grams.filter(F.col("gram").contains(piece)).select("gram").distinct().collect()]]
            often = self._often([g for o in options for g in o])
            for grams in options:
                size = sum(m for (_, g), m in often.items() if g in grams)
                if best is None or size < best[0]:
                    best = (size, grams)
        if best is None:
            return self.names.filter(hit).select("id")
        some = stage(self.lists(best[1]).select("id").distinct(), "trigram-holding")
        return self.texts(some).filter(hit).select("id")

    def search(self, term: str, threshold: float = 0.3) -> DataFrame:
        """Q1: id, the texts and score of the rows that hold every word of the term (score
        1) or have a text similar to it, best first."""
        one = self.holding(term.lower().split()).select("id", F.lit(1.0).alias("score"))
        scored = stage(one.union(self.similar(term, threshold)).groupBy("id").agg(F.max("score").alias("score")), "trigram-scored")
        rows = self.texts(scored.select("id")).select("id", *self.fields)
        return rows.join(broadcast_if_small(scored), "id").orderBy(F.desc("score"), "id")

    def pairs(self, field: str, block: str, threshold: float = 0.3) -> DataFrame:
        """(block, name_a, name_b, similarity): distinct texts of ``field`` with equal
        ``block`` (another field) whose trigram similarity reaches the threshold.

        Of each text the rarest grams are met, with their place; the grams that are
        left after it bound what a pair can share.  Pairs that pass are made
        distinct and verified by the gram arrays of their ids."""
        k = self.fields.index(field)
        own = stage(self.names.filter(F.col(field).isNotNull() & F.col(block).isNotNull()).groupBy(F.col(block).alias("block"), F.col(field).alias("name")).agg(F.min("id").alias("id")), "trigram-names")
        held = self.postings.filter(F.col("field") == k).join(broadcast_if_small(own.select("id", "block")), "id")
        often = held.groupBy("block", "gram").agg(F.count("*").alias("often"))
        often = broadcast_if_small(stage(often.filter("often > 1"), "trigram-often"))  # a gram that one text has meets nothing
        rare = held.join(often, ["block", "gram"], "left").groupBy("block", "id", "n").agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("rare"))
        first = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int") + 1
        ready = rare.select("block", "id", "n", F.posexplode(F.slice("rare", F.lit(1), first)).alias("place", "gram")).filter("gram.often is not null")
        ready = stage(ready.select("block", "id", "n", "place", F.col("gram.gram").alias("gram")), "trigram-ready")
        a, b = (ready.select("block", "gram", *(F.col(c).alias(f"{c}_{x}") for c in ("id", "n", "place"))) for x in "ab")
        need = F.lit(threshold / (1 + threshold)) * (F.col("n_a") + F.col("n_b")) - F.lit(1e-9)
        can = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
        met = a.join(b, ["block", "gram"]).filter((F.col("id_a") < F.col("id_b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (can >= need))
        met = met.select("block", "id_a", "id_b").distinct()
        arrays = self.names.select("id", F.col(field).alias("name"), F.col(f"grams_{k}").alias("grams")).join(broadcast_if_small(own.select("id")), "id", "left_semi")
        arrays = broadcast_if_small(stage(arrays, "trigram-arrays"))
        x, y = (arrays.select(*(F.col(c).alias(f"{c}_{z}") for c in ("id", "name", "grams"))) for z in "ab")
        shared = F.size(F.array_intersect("grams_a", "grams_b"))
        scored = met.join(x, "id_a").join(y, "id_b").select("block", F.least("name_a", "name_b").alias("name_a"), F.greatest("name_a", "name_b").alias("name_b"), (shared / (F.size("grams_a") + F.size("grams_b") - shared)).alias("similarity"))
        return scored.filter(F.col("similarity") >= threshold).withColumnRenamed("block", block)


def new_folder(base: str) -> str:
    return f"{base}/trigrams-{uuid4().hex}"
