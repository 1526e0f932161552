"""Product ids that survive later batches.

A record brings up to two nodes: its brand with its model name, and its brand with its
model number.  A product is a connected component of nodes; its id is the node that was
born first, and stays while the component grows.  Where a batch joins products that had
ids of their own, the oldest id lives on and the others are redirected to it.

The state is a folder with two append-only tables, ``members`` (node, product_key as of
its batch, birth) and ``redirects`` (old_key, product_key), and a commit log that says
which parts of them count.  A batch meets the stored members by the nodes that it
brings, works on a graph of these and of the products they belong to, and writes new
nodes and new redirects alone: what it does not touch is not rewritten.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.operators.components import connected_components
from tallyshelf.operators.hierarchy import rooted
from tallyshelf.scratch import broadcast_if_small, stage
from tallyshelf.sources.commitlog import CommitLog

_MEMBERS = "node string, product_key string, batch long, row long"
_REDIRECTS = "old_key string, product_key string"


def key_id(*parts: Column) -> Column:
    """A deterministic id from natural key parts; null parts count as empty."""
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def record_nodes(brand: str = "brand", name: str = "model_name", number: str = "model_number") -> tuple[Column, Column]:
    """The name node and the number node of a record, null where it has none; a
    record without a name has neither."""
    b, n = F.lower(rules.squeeze(F.col(brand))), rules.network_key(F.col(name))
    m = F.nullif(F.upper(rules.squeeze(F.col(number))), F.lit(""))
    named = F.when(n.isNotNull(), key_id(F.lit("name"), b, n))
    return named, F.when(n.isNotNull() & m.isNotNull(), key_id(F.lit("number"), b, m))


def redirected(df: DataFrame, redirects: DataFrame, key: str = "product_key") -> DataFrame:
    """``df`` with ``key`` replaced by where it is redirected to."""
    to = broadcast_if_small(stage(redirects, "redirects")).select(F.col("old_key").alias("_old"), F.col("product_key").alias("_to"))
    return df.join(to, F.col(key) == F.col("_old"), "left").withColumn(key, F.coalesce("_to", key)).drop("_old", "_to")


class ProductIdentities:
    """The state at ``path``.  Batches are numbered by the log; one that was committed
    before is not applied again, and gets its answers from the state."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = CommitLog(spark, f"{self.path}/log")

    def _table(self, what: str, schema: str, entries: list[dict]) -> DataFrame:
        paths = [f"{e['at']}/{what}" for e in entries]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def redirects(self, entries: list[dict] | None = None) -> DataFrame:
        """(old_key, product_key): every id that lives no more, and the one that does."""
        links = self._table("redirects", _REDIRECTS, self.log.read()[1] if entries is None else entries)
        ends = links.select("product_key").distinct().join(links.select(F.col("old_key").alias("product_key")), "product_key", "left_anti")
        nodes = links.select(F.col("old_key").alias("node"), F.col("product_key").alias("parent")).union(ends.select("product_key", F.lit(None).cast("string")))
        return rooted(nodes).filter("level > 0").select(F.col("node").alias("old_key"), F.col("root").alias("product_key"))

    def members(self, entries: list[dict] | None = None) -> DataFrame:
        """(node, product_key) of all nodes, by the ids that live."""
        entries = self.log.read()[1] if entries is None else entries
        return redirected(self._table("members", _MEMBERS, entries), self.redirects(entries)).select("node", "product_key", "batch", "row")

    def assign(self, batch: str, records: DataFrame, row: str = "row_id") -> DataFrame:
        """``records`` (brand, model_name, model_number and a number ``row`` that orders
        them) with product_key, null without a name; the batch is committed."""
        name, number = record_nodes()
        keyed = stage(records.withColumns({"_name": name, "_number": number}), "identity-records")
        while True:
            n, entries = self.log.read()
            if any(e["batch"] == batch for e in entries):
                break
            at = f"{self.path}/data/{uuid4().hex}"
            self._work(keyed, row, n, entries, at)
            if self.log.append(n, {"batch": batch, "at": at}):
                break
        found = self.members().select(F.col("node").alias("_node"), "product_key")
        asked = stage(found.join(broadcast_if_small(stage(keyed.select(F.col("_name").alias("_node")).distinct(), "identity-asked")), "_node", "left_semi"), "identity-found")
        return keyed.join(broadcast_if_small(asked), F.col("_name") == F.col("_node"), "left").drop("_name", "_number", "_node")

    def _work(self, keyed: DataFrame, row: str, n: int, entries: list[dict], at: str) -> None:
        """Write the new members and redirects of a batch to ``at``."""
        born = F.min(F.col(row).cast("long")).alias("row")
        nodes = keyed.select(row, F.explode(F.array("_name", "_number")).alias("node")).filter("node is not null").groupBy("node").agg(born)
        nodes = stage(nodes, "identity-nodes")
        have = self.members(entries).join(broadcast_if_small(nodes.select("node")), "node", "left_semi")
        have = stage(have.select("node", "product_key"), "identity-known")
        # the graph of the batch: known nodes stand for the products that they belong to
        of = broadcast_if_small(have)
        nodes = stage(nodes.join(of, "node", "left").withColumn("at", F.coalesce("product_key", "node")), "identity-places")
        place = broadcast_if_small(nodes).select("node", "at")
        links = keyed.filter("_number is not null").select("_name", "_number").distinct()
        links = links.join(place.toDF("_name", "a"), "_name").join(place.toDF("_number", "b"), "_number").select("a", "b").filter("a <> b").distinct()
        parts = stage(connected_components(links, "identity-links"), "identity-parts")
        # births: of products that were there, those of the nodes that they are named for
        old = nodes.filter("product_key is not null").select(F.col("product_key").alias("at")).distinct()
        old = self._table("members", _MEMBERS, entries).join(broadcast_if_small(stage(old, "identity-touched")), F.col("node") == F.col("at"), "left_semi").groupBy(F.col("node").alias("at")).agg(F.min(F.struct("batch", "row")).alias("born"))
        new = nodes.filter("product_key is null").select("at", F.struct(F.lit(n).cast("long").alias("batch"), F.col("row").alias("row")).alias("born"))
        points = old.withColumn("old", F.lit(True)).union(new.withColumn("old", F.lit(False)))
        points = stage(points.join(broadcast_if_small(parts), F.col("at") == F.col("node"), "left").select("at", "born", "old", F.coalesce("component", "at").alias("part")), "identity-points")
        oldest = stage(points.groupBy("part").agg(F.min(F.struct("born", "at")).alias("first")).select("part", F.col("first.at").alias("product_key")), "identity-oldest")
        settled = points.join(broadcast_if_small(oldest), "part")
        settled.filter("not old").select(F.col("at").alias("node"), "product_key", F.col("born.batch").alias("batch"), F.col("born.row").alias("row")).write.parquet(f"{at}/members")
        settled.filter("old and at <> product_key").select(F.col("at").alias("old_key"), "product_key").write.parquet(f"{at}/redirects")
