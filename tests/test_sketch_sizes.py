"""Sketched prices of products with many offers and stores, against the SQL."""

import duckdb
from pyspark.sql import functions as F

from tallyshelf.operators import sketches as K
from tallyshelf.plans import queries  # noqa: F401
from tallyshelf.plans.registry import ORACLE_SQL, QUERIES

COLUMNS = ["product_id", "n", "min_price", "max_price", "avg_price", "stores", "median_within"]


def test_many_stores_a_product(spark, tmp_path):
    """3 products of 9,000 offers by 3,000 to 9,000 stores."""
    r = spark.range(27000).withColumn("p", F.col("id") % 3)
    lines = r.select(
        F.col("id").alias("l_orderkey"), F.col("p").alias("l_partkey"), (F.floor(F.col("id") / 3) % (3000 * (F.col("p") + 1))).alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        (F.col("id") * 7919 % 99991 / 4).alias("l_extendedprice"), F.lit(0.0).alias("l_discount"), F.lit("N").alias("l_returnflag"), F.when(F.col("id") % 2 == 0, "O").otherwise("F").alias("l_linestatus"),
        F.expr("timestampadd(DAY, CAST(id % 20 AS INT), TIMESTAMP_NTZ'1995-01-01')").alias("l_shipdate"),
    )
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(9000).select(F.col("id").alias("s_suppkey"), F.concat(F.lit("Store "), F.col("id").cast("string")).alias("s_name")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(3).select(F.col("id").alias("p_partkey"), F.lit("b").alias("p_brand"), F.lit("m").alias("p_name"), F.lit("t").alias("p_type"), F.lit(1).alias("p_size"), F.lit(1.0).alias("p_retailprice")).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "supplier", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"select {', '.join(COLUMNS)} from ({ORACLE_SQL['a18_sketched_prices']})").fetchall()
    got = QUERIES["a18_sketched_prices"](spark, str(tmp_path)).select(*COLUMNS).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_a_quantile_beyond_the_error_is_mended(spark):
    """An answer that is far off gives way to the exact one; one that is near stays."""
    offers = spark.range(2000).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 20).alias("price"))
    answers = spark.createDataFrame([(0, 1000, 90.0), (1, 1000, 50.0)], "k long, n long, q50 double")
    got = {r.k: r for r in K.settled(answers, offers, ["k"]).withColumn("ok", K.within()).collect()}
    assert got[0].q50 == 49.0 and got[0].below == 490 and got[0].upto == 500 and got[0].ok
    assert got[1].q50 == 50.0 and got[1].ok
