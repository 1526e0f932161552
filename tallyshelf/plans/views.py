"""Catalog tables as views over a star schema: parts are products, line items are
offers seen by date, suppliers are stores, regions and nations a category tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over as many tasks as shuffles have.  A table of short rows is read by one
    task or few, as it is one small file; what is built from its rows can be much larger."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """product_id, brand, model_name, category, ram_gb, list_price."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("model_name"), F.col("p_type").alias("category"), F.col("p_size").alias("ram_gb"), F.col("p_retailprice").cast("decimal(12,2)").alias("list_price"))


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: offer_id, product_id, store_name, price,
    original_price, stock_status, is_active, last_seen."""
    stores = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("store_name"))
    status = F.when(F.col("l_returnflag") == "R", "out_of_stock").when(F.col("l_returnflag") == "A", "limited_stock").otherwise("in_stock")
    lines = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("offer_id"), F.col("l_partkey").alias("product_id"), "l_suppkey",
        F.col("l_extendedprice").cast("decimal(12,2)").alias("price"),
        (F.floor(F.col("l_extendedprice") / (1 - F.col("l_discount")) * 100 + 0.5) / 100).alias("original_price"),
        status.alias("stock_status"), (F.col("l_linestatus") == "O").alias("is_active"), F.col("l_shipdate").cast("date").alias("last_seen"),
    )
    return lines.join(stores, lines["l_suppkey"] == stores["s_suppkey"]).drop("l_suppkey", "s_suppkey")


#: The same views in DuckDB SQL.
WITH = """WITH products AS (SELECT p_partkey AS product_id, p_brand AS brand, p_name AS model_name, p_type AS category, p_size AS ram_gb,
  CAST(p_retailprice AS DECIMAL(12,2)) AS list_price FROM part),
offers AS (SELECT l_orderkey * 10 + l_linenumber AS offer_id, l_partkey AS product_id, s_name AS store_name, CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
  floor(l_extendedprice / (1 - l_discount) * 100 + 0.5) / 100 AS original_price,
  CASE l_returnflag WHEN 'R' THEN 'out_of_stock' WHEN 'A' THEN 'limited_stock' ELSE 'in_stock' END AS stock_status,
  l_linestatus = 'O' AS is_active, CAST(l_shipdate AS DATE) AS last_seen FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
"""
