"""Joins and groups whose rows must not meet in one task."""

import pytest
from pyspark.sql import functions as F

from tallyshelf.operators import catalog as C
from tallyshelf.operators import resolve as R


@pytest.fixture
def shuffled(spark):
    """No broadcasts, and plans and partitions as they are dealt."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k in conf:
        spark.conf.unset(k)


def test_records_without_a_number_are_dealt(shuffled):
    r = shuffled.range(4000).select(F.col("id").alias("row_id"), F.lit("b").alias("brand"), F.concat(F.lit("m"), F.col("id") % 1000).alias("model_name"), F.lit(None).cast("string").alias("model_number"), F.lit(None).cast("string").alias("product_key"))
    out = R.match_labels(r, r.limit(0))
    assert {x.product_match: x["count"] for x in out.groupBy("product_match").count().collect()} == {"new_product": 1000, "model_name": 3000}
    assert out.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000


def test_tasks_of_sightings_grow_with_the_offers(shuffled, monkeypatch):
    monkeypatch.setattr(C, "TASK_ROWS", 100, raising=False)
    products = shuffled.range(500).select(F.col("id").alias("product_id"), F.lit("b").alias("brand"), F.concat(F.lit("m"), (F.col("id") / 2).cast("int")).alias("model_name"))
    offers = shuffled.range(2000).select((F.col("id") % 500).alias("product_id"), F.concat(F.lit("s"), F.when(F.col("id") % 500 < 100, 0).otherwise(F.col("id") % 3)).alias("store_name"))
    seen = C.sightings(products, offers)
    assert seen.rdd.getNumPartitions() >= 20
    assert C.cross_store_coverage(seen).first()[:3] == (200, 50, 250)
    assert {r.store_name: r.variants for r in C.variants_per_store_common(seen).collect()} == {"s0": 400, "s1": 400, "s2": 400}
