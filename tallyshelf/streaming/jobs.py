"""Incremental ingestion and keyed state with Structured Streaming, and the batch
forms of the same questions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyshelf.operators.resolve import upsert
from tallyshelf.operators.slices import running_sum
from tallyshelf.sources.feeds import exists


def stream_feed(spark: SparkSession, folder: str, schema, fmt: str = "json", names: str | None = None) -> DataFrame:
    """New files of a folder, each once; of those alone whose names match, if given."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("pathGlobFilter", names) if names else reader).load(folder)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what is there and stop; the next run goes on from the checkpoint."""
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def stream_dedup(df: DataFrame, ts: str, keys: list[str], horizon: str = "1 day") -> DataFrame:
    """The first of each key within the horizon."""
    return df.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys)


class UpsertSink:
    """A table kept up to date by micro-batches.

    Rows lie in ``buckets`` by a hash of their key.  A batch reads and writes the
    buckets of its own keys only; its manifest, written last, names each bucket's
    version and makes the batch count.  A batch id that has its manifest already is
    skipped, so replays change nothing.  Versions that neither of the last two
    manifests names are deleted.
    """

    def __init__(self, path: str, keys: list[str], recency: str, buckets: int = 64):
        self.path, self.keys, self.recency, self.buckets = path.rstrip("/"), keys, recency, buckets

    def _fs(self, spark: SparkSession, name: str):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _ids(self, spark: SparkSession, name: str) -> list[int]:
        fs, path = self._fs(spark, name)
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path)) if fs.exists(path) else []

    def _manifest(self, spark: SparkSession, batch_id: int) -> dict[int, int]:
        """Version by bucket, a row a bucket."""
        return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/id={batch_id}").collect()}

    def _committed(self, spark: SparkSession) -> list[int]:
        return [i for i in self._ids(spark, "manifest") if exists(spark, f"{self.path}/manifest/id={i}/_SUCCESS")]

    def _read(self, spark: SparkSession, versions: dict[int, int], schema) -> DataFrame:
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(versions.items())]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def latest(self, spark: SparkSession) -> tuple[int, DataFrame | None]:
        """The last batch id and the table after it."""
        done = self._committed(spark)
        if not done:
            return -1, None
        versions = self._manifest(spark, done[-1])
        if not versions:
            return done[-1], None
        b, v = next(iter(versions.items()))
        return done[-1], self._read(spark, versions, spark.read.parquet(f"{self.path}/data/version={v}/bucket={b}").schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = self._committed(spark)
        if done and batch_id <= done[-1]:
            return
        versions = self._manifest(spark, done[-1]) if done else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most `buckets`
        current = self._read(spark, {b: versions[b] for b in touched if b in versions}, batch.schema)
        after = upsert(current, batch, self.keys, self.recency).drop("change", "price_changed")
        after.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={batch_id}")
        versions |= dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(versions.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/id={batch_id}")
        needed = set(versions.values()) | (set(self._manifest(spark, done[-1]).values()) if done else set())
        for version in set(self._ids(spark, "data")) - needed:
            fs, path = self._fs(spark, f"data/version={version}")
            fs.delete(path, True)

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_price_changes(df: DataFrame, max_points: int = 30) -> DataFrame:
    """T4: url, old_price, price, ts of each change in a stream of url, price, ts;
    the state keeps the last max_points prices of a listing."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        points = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for price, ts in zip(rows["price"], rows["ts"], strict=True):
            if points and points[-1] != price:
                out.append((key[0], points[-1], price, ts))
            if not points or points[-1] != price:
                points = [*points, float(price)][-max_points:]
        state.update((points,))
        yield pd.DataFrame(out, columns=["url", "old_price", "price", "ts"])

    return df.select("url", F.col("price").cast("double").alias("price"), "ts").groupBy("url").applyInPandasWithState(step, "url string, old_price double, price double, ts timestamp", "points array<double>", "append", GroupStateTimeout.NoTimeout)


def request_counts(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Requests per key and fixed window, and how many were over the limit."""
    slot = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds) * seconds
    out = events.groupBy(key, slot.cast("long").alias("window_start")).agg(F.count("*").alias("requests"))
    return out.withColumn("over_limit", F.greatest(F.col("requests") - limit, F.lit(0)))


def stream_request_counts(events: DataFrame, key: str, ts: str, window: str, delay: str) -> DataFrame:
    """T6 on a stream, with a watermark."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, window), key).agg(F.count("*").alias("requests"))


def sliding_request_counts(events: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Requests of the key in the trailing window that ends with each request.

    A request counts one from its time on and one less when the window has left it, so
    the count is a running sum, which is carried from slice to slice of a key.  Requests
    without time are counted among themselves."""
    timed = events.withColumn("_t", F.unix_micros(F.col(ts).cast("timestamp")))
    ends = timed.filter("_t is not null").groupBy(key, (F.col("_t") + seconds * 1_000_000).alias("_t")).agg((-F.count("*")).alias("_one"))
    rows = timed.withColumn("_one", F.lit(1).cast("long")).unionByName(ends, allowMissingColumns=True).withColumn("_is", F.col("_one") > 0)
    # requests without time come first; what follows them starts at 0
    rows = rows.withColumn("_none", F.col("_t").isNull())
    return running_sum(rows, [key, "_none"], "_t", "_one", "trailing").filter("_is").select(*events.columns, "trailing")


def two_bucket_estimate(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Per window the count plus half the one before, as at mid-window."""
    n = request_counts(events, key, ts, seconds, limit)
    w = W.partitionBy(key).orderBy("window_start")
    before = F.when(F.lag("window_start").over(w) == F.col("window_start") - seconds, F.lag("requests").over(w)).otherwise(0)
    return n.withColumn("estimate", F.col("requests") + before * 0.5)


def failed_items_retry(dead: DataFrame, succeeded: DataFrame, most: int = 3) -> DataFrame:
    """The dead-letter rows (url, reason, attempts) to run again: not done by
    now and under the cap, with one attempt more."""
    left = dead.join(succeeded.select("url").distinct(), "url", "left_anti").groupBy("url").agg(F.max_by("reason", "attempts").alias("reason"), F.max("attempts").alias("attempts"))
    return left.filter(F.col("attempts") < most).withColumn("attempts", F.col("attempts") + 1)


def price_alerts(seen: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per alert (alert_id, product_id, target) the first observation at or under the target."""
    hits = seen.join(alerts, "product_id").filter(F.col("price") <= F.col("target"))
    w = W.partitionBy("alert_id").orderBy("last_seen", "offer_id", "price")
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def stream_price_alerts(seen: DataFrame, alerts: DataFrame, ts: str = "last_seen") -> DataFrame:
    """T10 on a stream of product_id, offer_id, price and ``ts``: each alert of the static
    ``alerts`` (alert_id, product_id, target) once, at the first observation at or under
    its target; of one micro-batch the earliest, ties by offer_id and price.

    The stream meets the static side first, which new alerts may join between
    batches; the state of an alert is only that it has fired."""
    hits = seen.join(alerts, "product_id").filter(F.col("price") <= F.col("target"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first = None
        for rows in batches:  # one row of each batch at most stays in memory
            one = rows.sort_values(["ts", "offer_id", "price"], kind="stable").head(1)
            first = one if first is None else pd.concat([first, one]).sort_values(["ts", "offer_id", "price"], kind="stable").head(1)
        if not state.exists:
            state.update((True,))
            yield first[["alert_id", "product_id", "offer_id", "price", "ts"]]

    rows = hits.select("alert_id", "product_id", "offer_id", F.col("price").cast("double").alias("price"), F.col(ts).cast("timestamp").alias("ts"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("alert_id", "product_id", "offer_id")}
    return rows.groupBy("alert_id").applyInPandasWithState(step, f"{', '.join(f'{c} {t}' for c, t in kinds.items())}, price double, ts timestamp", "fired boolean", "append", GroupStateTimeout.NoTimeout)


def stream_expiry(seen: DataFrame, key: str, ts: str, seconds: int, delay: str = "0 seconds") -> DataFrame:
    """T5 on a stream: key, last_seen and expired_at of what is not seen for ``seconds``.

    A timer at last_seen + seconds fires when the watermark passes it, with or without
    data; a later sighting moves it.  What comes so late that its timer would lie behind
    the watermark expires at once.  A key that is seen after it expired starts anew."""
    kind = seen.schema[key].dataType.simpleString()
    rows = seen.select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts")).filter("ts is not null").withWatermark("ts", delay)
    rows = rows.withColumn("ms", F.unix_millis("ts"))

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, state_ends = state.get[0], True
            state.remove()
        else:
            last = max([int(b["ms"].max()) for b in batches if len(b)] + ([state.get[0]] if state.exists else []))
            state_ends = last + seconds * 1000 <= state.getCurrentWatermarkMs()
            if state_ends and state.exists:
                state.remove()
            elif not state_ends:
                state.update((last,))
                state.setTimeoutTimestamp(last + seconds * 1000)
        out = [(group[0], last, last + seconds * 1000)] if state_ends else []
        yield pd.DataFrame(out, columns=["key", "last", "at"])

    out = rows.groupBy("key").applyInPandasWithState(step, f"key {kind}, last long, at long", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("key").alias(key), F.timestamp_millis("last").alias("last_seen"), F.timestamp_millis("at").alias("expired_at"))
