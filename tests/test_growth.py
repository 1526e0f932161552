"""Steps whose cost must not grow faster than their input."""

from pyspark.sql import functions as F

from tallyshelf.operators import resolve as R
from tallyshelf.operators import slices as S
from tallyshelf.plans.queries import numbered_parts

RECORD = "row_id long, store_name string, store_product_id string, url string, title string, brand string, model_name string, model_number string, category string, color string, ram int, storage int, display_size double, connectivity_type string, price double, scraped_at timestamp, last_seen timestamp, is_active boolean"


def counted_feed(spark, rows):
    """A feed of records and the counter of rows that were made of it."""
    made = spark.sparkContext.accumulator(0)

    def counting(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    r = spark.range(rows).select(F.col("id").alias("row_id"), F.lit("b").alias("brand"), F.concat(F.lit("m"), F.col("id") % 5).alias("model_name"), F.lit("t").alias("title"), F.lit("s").alias("store_name"), F.lit("Phones").alias("category"), F.lit(1.0).alias("price"), F.lit(True).alias("is_active"), F.concat(F.lit("u"), "id").alias("url"))
    have = dict(r.dtypes)
    types = [c.rsplit(" ", 1) for c in RECORD.split(", ")]
    r = r.select(*(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in types))
    return r.mapInArrow(counting, RECORD), made


def test_ingest_makes_the_feed_once(spark):
    feed, made = counted_feed(spark, 300)
    got = {(x.entity, x.state): x.n for x in R.ingestion_report(R.ingest(feed)).collect()}
    assert got["listing", "new"] == 300 and got["product", "created"] == 5 and got["product_match", "model_name"] == 295
    assert made.value == 300


def test_ingest_offers_makes_the_feed_once(spark):
    feed, made = counted_feed(spark, 300)
    base = spark.createDataFrame([], "product_key string, brand string, model_name string")
    current = spark.createDataFrame([], "variant_id string, store_name string, store_product_id string, price double, last_seen timestamp, is_active boolean")
    known = spark.createDataFrame([("p", "Phones", "phones", True)], "category_id string, name string, slug string, is_active boolean")
    after, _, brands = R.ingest_offers(feed, base, current, known, R.empty_catalog(spark)["brands"])
    assert (after.count(), brands.count(), made.value) == (5, 1, 300)


def test_slices_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_ROWS", 100, raising=False)
    df = spark.range(2000).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"))
    rows = S.with_lookback(df, ["k"], ["t"], 1)
    assert rows.filter("not _ghost").select("_slice").distinct().count() >= 20
    assert rows.rdd.getNumPartitions() >= 20 and rows.filter("not _ghost").count() == 2000


def test_numbered_parts_are_dealt(spark, sf):
    most = numbered_parts(spark, sf).groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert most[0] <= most[1] / 4
