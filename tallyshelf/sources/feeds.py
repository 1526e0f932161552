"""Raw store feeds: schemas, readers, writers, and the category tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.operators.hierarchy import rooted
from tallyshelf.sources.jsonarray import read_objects

_SPECS = "specifications map<string,map<string,string>>"
#: Schemas of the raw feeds, one JSON array of objects a file.
SCHEMAS = {
    "amazon": "url string, title string, deal string, productName string, price struct<current:string,original:string,discount:string>, rating struct<value:double,count:int>, image string, availability string, specifications string, categories array<string>, extractedAt string",
    "flipkart": f"url string, title string, price struct<current:int,original:int,discount:string>, rating struct<score:double,count:int>, availability string, {_SPECS}, category array<string>, tags array<string>, image string, images array<string>",
    "croma": f"url string, title string, price struct<current:string,original:string,discount:string>, rating struct<star:string,rating:string,reviews:string>, image string, allImages array<string>, {_SPECS}, categories string, extractedAt string",
    "reliance": f"url string, title string, price struct<price:string,originalPrice:string,discount:string>, rating struct<rating:string,ratingCount:int>, image struct<mainImage:string,allImages:array<string>>, {_SPECS}, availability string, categories string, extractedAt string",
}


def read_feed(spark: SparkSession, source: str, path: str) -> DataFrame:
    """A store's feed; unreadable records are kept in _corrupt."""
    reader = spark.read.schema(f"{SCHEMAS[source]}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt")
    return reader.json(path)


def read_large_feed(spark: SparkSession, source: str, path: str) -> DataFrame:
    """S1 for large files: the same records, each file read by as many tasks as it has
    blocks; objects that can't be read are kept in _corrupt."""
    schema = f"{SCHEMAS[source]}, _corrupt string"
    one = F.from_json("text", schema, {"columnNameOfCorruptRecord": "_corrupt"})
    return read_objects(spark, path).select(one.alias("r")).select("r.*")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_all_feeds(spark: SparkSession, paths: dict[str, str], read=read_feed) -> DataFrame:
    """All feeds that are there, tagged with source, in one frame."""
    out = None
    for source, path in paths.items():
        if exists(spark, path):
            one = read(spark, source, path).withColumn("source", F.lit(source))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError("none of the feeds is there")
    return out


def read_latest_feed(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """The last file by name of a folder."""
    df = read_feed(spark, source, f"{folder}/*.json").withColumn("_file", F.col("_metadata.file_name"))
    last = df.agg(F.max("_file").alias("_file"))
    return df.join(F.broadcast(last), "_file", "left_semi").drop("_file")


def write_normalized(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: partitioned by source."""
    df.withColumn("source_name", F.col("source_details.source_name")).write.mode(mode).partitionBy("source_name").parquet(path)


def append_new_by_url(existing: DataFrame, incoming: DataFrame, store: str, order: list[str]) -> DataFrame:
    """Existing rows and the incoming rows whose canonical url is new; the
    first of a batch by order stays; rows without url always stay."""
    key = rules.URL_KEYS[store](F.col("url"))
    w = W.partitionBy("_key").orderBy(*order)
    fresh = incoming.filter("url is not null").withColumn("_key", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    fresh = fresh.join(existing.filter("url is not null").select(key.alias("_key")), "_key", "left_anti").drop("_key", "_n")
    return existing.unionByName(fresh.select(*incoming.columns), allowMissingColumns=True).unionByName(incoming.filter("url is null"), allowMissingColumns=True)


#: How many children of a category are featured, where it isn't the usual number.
FEATURED = {"Mobiles": 1, "Basic Mobiles": 0, "Accessories": 5}


def build_taxonomy(edges: DataFrame, featured: int = 8, by_parent: dict[str, int] | None = None) -> DataFrame:
    """Categories with level, path, slug, sort_order and is_featured (the first
    of each parent, as many as ``by_parent`` says for its name, else ``featured``) from
    (name, parent, position).  Names are unique; those below no root are left out."""
    named = edges.select("name", "parent", "position", rules.slug(F.col("name")).alias("slug"))
    nodes = named.select(F.col("name").alias("node"), "parent", "slug")
    tree = rooted(nodes, path=(F.col("slug"), "/")).select(F.col("node").alias("name"), "level", "path")
    order = F.row_number().over(W.partitionBy("parent").orderBy("position", "name"))
    most = F.lit(featured)
    for name, n in (FEATURED if by_parent is None else by_parent).items():
        most = F.when(F.col("parent") == name, n).otherwise(most)
    return named.join(tree, "name").withColumn("sort_order", order).withColumn("is_featured", F.col("parent").isNotNull() & (F.col("sort_order") <= most)).drop("position")
