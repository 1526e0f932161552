"""Queries of flows over driver tables: category and variant resolution, offers,
pictures, retries, and the streaming jobs run over what is there."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tallyshelf.operators import catalog as C
from tallyshelf.operators import normalize as N
from tallyshelf.operators import pages as P
from tallyshelf.operators import resolve as R
from tallyshelf.plans.parity import PHONES, phones
from tallyshelf.plans.queries import LINKS
from tallyshelf.plans.registry import query
from tallyshelf.plans.views import WITH, offers, products, table
from tallyshelf.scratch import scratch_dir, stage
from tallyshelf.streaming import jobs as T


def _folder(spark, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid4().hex}"


KNOWN = "known AS (SELECT upper(category) AS name, lower(category) AS slug, category < 'P' AS is_active FROM (SELECT DISTINCT category FROM products))"


@query("e2b_category_lookup", WITH + f", {KNOWN} SELECT product_id, CASE WHEN category < 'P' THEN lower(category) END AS category_id FROM products")
def category_lookup(spark, d):
    """Categories asked for in mixed case; inactive ones are not found."""
    p = products(spark, d)
    known = p.select("category").distinct().select(F.lower("category").alias("category_id"), F.upper("category").alias("name"), F.lower("category").alias("slug"), (F.col("category") < "P").alias("is_active"))
    asked = p.withColumn("category", F.initcap(F.lower("category")))
    return R.category_lookup(asked, known).select("product_id", "category_id")


@query(
    "e5_tablet_variants",
    WITH
    + ", v AS (SELECT product_id, CASE WHEN brand LIKE '%1' THEN 'Apple Inc' ELSE brand END AS maker, ram_gb, category FROM products) "
    "SELECT min(product_id) AS product_id, count(*) AS records FROM v GROUP BY maker, CASE "
    "WHEN maker <> 'Apple Inc' THEN ram_gb END, lower(category), ram_gb % 3, CASE ram_gb % 2 WHEN 0 THEN 'Wi-Fi+5G' ELSE 'Wi-Fi+4G' END",
)
def tablet_variants(spark, d):
    """Variants of one product per maker, told apart by display and network; RAM counts but for Apple's."""
    maker = F.when(F.col("brand").endswith("1"), "Apple Inc").otherwise(F.col("brand"))
    network = F.when(F.col("ram_gb") % 2 == 0, "Wi-Fi+5G").otherwise("Wi-Fi+4G")
    p = products(spark, d).withColumns({"row_id": F.col("product_id"), "brand": maker, "product_key": R.key_id(maker), "ram": F.col("ram_gb"), "storage": F.lit(None).cast("int"), "color": F.col("category"), "display_size": (F.col("ram_gb") % 3).cast("double"), "connectivity_type": network})
    n = p.groupBy(R.variant_key(True).alias("variant_id")).agg(F.count("*").alias("records"))
    return R.resolve_variants(p, tablets=True).select("variant_id", "product_id").join(n, "variant_id").select("product_id", "records")


@query(
    "e10_ingest_offers",
    WITH
    + ", named AS (SELECT lower(brand) AS b, lower(model_name) AS m, o.store_name, o.is_active, o.price FROM offers o "
    "JOIN products p ON o.product_id = p.product_id), last AS (SELECT b, m, store_name FROM named GROUP BY ALL) SELECT count(*) AS offers, (SELECT count(*) "
    "FROM (SELECT DISTINCT b, m FROM named)) AS products, (SELECT count(DISTINCT brand) FROM products) AS brands FROM last",
)
def ingest_offers(spark, d):
    """All offers as parsed records: offers, products and brands after the flow."""
    p = products(spark, d)
    feed = offers(spark, d).join(p, "product_id").select(F.col("offer_id").alias("row_id"), "store_name", "brand", "model_name", F.lit(None).cast("string").alias("model_number"), "category", F.lit(None).cast("string").alias("color"), F.lit(None).cast("int").alias("ram"), F.lit(None).cast("int").alias("storage"), F.lit(None).cast("double").alias("display_size"), F.lit(None).cast("string").alias("connectivity_type"), F.col("price").cast("double").alias("price"), F.col("last_seen").cast("timestamp").alias("last_seen"), "is_active", F.lit("x").alias("store_product_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("title"))
    known = p.select("category").distinct().select(F.lower("category").alias("category_id"), F.col("category").alias("name"), F.lower("category").alias("slug"), F.lit(True).alias("is_active"))
    current = spark.createDataFrame([], "variant_id string, store_name string, store_product_id string, price double, last_seen timestamp, is_active boolean")
    base = R.resolve_products(feed.select("brand", "model_name").distinct()).select("product_key", "brand", "model_name").dropDuplicates(["product_key"])
    after, counted, brands = R.ingest_offers(feed, base, current, known, R.empty_catalog(spark)["brands"])
    return after.agg(F.count("*").alias("offers")).withColumns({"products": counted.agg(F.count("*")).scalar(), "brands": brands.agg(F.count("*")).scalar()})


@query("w7_main_images", WITH + " SELECT product_id, CASE ram_gb % 3 WHEN 0 THEN 'main,other,other' WHEN 1 THEN 'other,main,other' ELSE 'main,other,side' END AS kinds FROM products")
def main_images(spark, d):
    """Pictures without a main one, with two, and with the first."""
    kinds = {0: (None, "other", None), 1: ("other", "main", "main"), 2: ("main", "main", "side")}
    image = lambda k, n: F.struct(F.concat(F.lit("u"), F.lit(n)).alias("url"), F.lit(k).cast("string").alias("type"))
    sets = [F.array(*(image(k, n) for n, k in enumerate(kinds[i]))) for i in range(3)]
    p = products(spark, d).withColumn("images", F.when(F.col("ram_gb") % 3 == 0, sets[0]).when(F.col("ram_gb") % 3 == 1, sets[1]).otherwise(sets[2]))
    return C.relabel_main_image(p).select("product_id", F.array_join(F.transform("images", lambda i: i.type), ",").alias("kinds"))


@query(
    "x6_unseen_links",
    LINKS
    + ", often AS (SELECT link FROM l GROUP BY link HAVING count(DISTINCT page_id) > (SELECT count(*) FROM pages) / 50) SELECT page_id, pos, link, rank "
    "FROM (SELECT page_id, pos, link, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank FROM f WHERE n = 1 AND link NOT IN (SELECT link "
    "FROM often)) WHERE rank <= 3",
)
def unseen_links(spark, d):
    """Links but for those that more than one page of fifty has."""
    pages = table(spark, d, "pages")
    every = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<a\\b[^>]*?\\bhref=[\"']([^\"'#]+)"), 1)).alias("link"))
    seen = every.distinct().groupBy("link").agg(F.count("*").alias("n"))
    seen = seen.filter(F.col("n") > pages.agg(F.count("*") / 50).scalar()).select("link")
    return P.related_links(pages, seen, 3)


@query(
    "n7_spec_groups",
    f"WITH phones AS ({PHONES.format(part='part')}) "
    f"SELECT id, size + 0.5E0 AS size_in, '1080 x ' || size AS resolution, CAST(5000 + size AS INTEGER) AS capacity_mah, size % 2 = 0 AS nfc, size * 1.0E0 "
    f"AS weight_g, size % 3 = 0 AS no_camera FROM phones",
)
def spec_groups(spark, d):
    """Groups from sections as Croma and Reliance name them."""
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    fields = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for p in pairs for x in p))
    n = F.col("size")
    specs = F.create_map(
        F.lit("Screen Specifications"), fields(("Screen Size in Inches", text(n, ".5 Inches")), ("Screen Resolution", text("1080 x ", n))),
        F.lit("Battery"), fields(("Battery Capacity", text((n + 5000), " mAh"))), F.lit("Network Connectivity"), fields(("NFC", F.when(n % 2 == 0, "Yes").otherwise("No"))),
        F.lit("Dimensions"), fields(("Weight", text(n, " g"))), F.lit("Camera"), fields(("Rear Camera", F.when(n % 3 != 0, "50 MP").otherwise(""))),
    )
    g = phones(spark, d).withColumn("specifications", specs).select("id", N.spec_groups().alias("g"))
    return g.select("id", "g.display.size_in", "g.display.resolution", "g.battery.capacity_mah", "g.connectivity.nfc", "g.design.weight_g", F.col("g.camera").isNull().alias("no_camera"))


@query(
    "n8_spec_groups_extended",
    f"WITH phones AS ({PHONES.format(part='part')}) SELECT id, CASE WHEN storage LIKE '%TB' THEN (1 + size % 2) * 1024 "
    f"WHEN storage LIKE '%GB' THEN size END AS internal_gb, size || ' months' AS summary, name AS model_number, storage IS NULL AS no_storage, true AS "
    f"no_sensors FROM phones",
)
def spec_groups_extended(spark, d):
    fields = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for p in pairs for x in p))
    specs = F.create_map(F.lit("Memory & Storage Features"), fields(("Internal Storage", F.col("storage"))), F.lit("Warranty"), fields(("Warranty Summary", F.concat("size", F.lit(" months")))), F.lit("General"), fields(("Model Number", F.col("name"))))
    g = phones(spark, d).withColumn("specifications", specs).select("id", N.spec_groups(N.EXTENDED).alias("g"))
    return g.select("id", "g.storage.internal_gb", "g.warranty.summary", "g.general.model_number", F.col("g.storage").isNull().alias("no_storage"), F.col("g.sensors").isNull().alias("no_sensors"))


def _events(spark, d):
    schema = table(spark, d, "events").schema
    return T.stream_feed(spark, d, schema, "parquet", "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("t1_stream_feed", "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def stream_feed(spark, d):
    """All events through a resumable stream, run twice: the second finds nothing new."""
    out, checkpoint = _folder(spark, "t1"), _folder(spark, "t1-checkpoint")
    for _ in range(2):
        T.run_available(_events(spark, d), out, checkpoint)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("events"))


@query("t2_stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, d):
    """The first event of each user, as the stream has one batch."""
    out = _folder(spark, "t2")
    T.run_available(T.stream_dedup(_events(spark, d), "ts", ["user_id"], "36500 days"), out, _folder(spark, "t2-checkpoint"))
    return spark.read.parquet(out).select("user_id")


@query("t3_stream_upsert", "SELECT user_id, max(ts) AS ts FROM events GROUP BY user_id")
def stream_upsert(spark, d):
    """The latest event of each user, kept up to date by key."""
    sink = T.UpsertSink(_folder(spark, "t3"), ["user_id"], "ts", 8)
    rows = _events(spark, d).select("user_id", "ts", F.col("value").alias("price"))
    sink.start(rows, _folder(spark, "t3-checkpoint")).awaitTermination()
    return sink.latest(spark)[1].select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query(
    "t4_stream_price_changes",
    "SELECT user_id, old_price, price FROM (SELECT user_id, value AS price, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old_price "
    "FROM events) WHERE old_price <> price",
)
def stream_changes(spark, d):
    """Changes of each user's value from event to event."""
    out = _folder(spark, "t4")
    rows = _events(spark, d).select(F.col("user_id").cast("string").alias("url"), F.col("value").alias("price"), "ts")
    T.run_available(T.stream_price_changes(rows), out, _folder(spark, "t4-checkpoint"))
    return spark.read.parquet(out).select(F.col("url").cast("long").alias("user_id"), "old_price", "price")


@query(
    "t5_stream_expiry",
    "SELECT user_id, count(*) AS expired, min(last_ms) AS last_ms FROM (SELECT user_id, max(CAST(floor(epoch_us(ts) / 1000) AS BIGINT)) AS last_ms FROM events GROUP BY user_id) "
    "WHERE last_ms + 43200000 < (SELECT max(CAST(floor(epoch_us(ts) / 1000) AS BIGINT)) - 60000 FROM events) GROUP BY user_id",
)
def stream_expiry(spark, d):
    """Users not seen for half a day before the last event, less a minute of delay, by timers."""
    out = _folder(spark, "t5")
    T.run_available(T.stream_expiry(_events(spark, d), "user_id", "ts", 43200, "60 seconds"), out, _folder(spark, "t5-checkpoint"))
    return spark.read.parquet(out).groupBy("user_id").agg(F.count("*").alias("expired"), F.min(F.unix_millis("last_seen")).alias("last_ms"))


ALERTS = "WITH a AS (SELECT user_id AS product_id, unnest([1, 2]) AS k, avg(value) AS middle FROM events GROUP BY user_id), t AS (SELECT product_id * 10 + k AS alert_id, product_id, middle / k - 15 AS target FROM a) "


@query(
    "t10_stream_alerts",
    ALERTS + "SELECT alert_id, product_id, event_id AS offer_id, value AS price FROM (SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY ts, event_id, value) AS n FROM events JOIN t ON product_id = user_id WHERE value <= target) WHERE n = 1",
)
def stream_alerts(spark, d):
    """Two alerts for each user's value, below the mean and below half of it; the stream
    runs twice and fires none again."""
    e = table(spark, d, "events")
    means = e.groupBy(F.col("user_id").alias("product_id")).agg(F.avg("value").alias("middle"))
    alerts = means.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k")).select((F.col("product_id") * 10 + F.col("k")).alias("alert_id"), "product_id", (F.col("middle") / F.col("k") - 15).alias("target"))
    alerts = stage(alerts, "alerts")
    out, checkpoint = _folder(spark, "t10"), _folder(spark, "t10-checkpoint")
    for _ in range(2):
        rows = _events(spark, d).select(F.col("user_id").alias("product_id"), F.col("event_id").alias("offer_id"), F.col("value").alias("price"), "ts")
        T.run_available(T.stream_price_alerts(rows, alerts, "ts"), out, checkpoint)
    return spark.read.parquet(out).select("alert_id", "product_id", "offer_id", "price")


@query(
    "t9_failed_items",
    "SELECT user_id, n + 1 AS attempts FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) WHERE n < 70 AND user_id NOT IN (SELECT user_id "
    "FROM events WHERE value > 250)",
)
def failed_items(spark, d):
    """Users with fewer than 70 events, each an attempt, but for those who got beyond 250."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("url"), "value", "event_type")
    dead = e.groupBy("url").agg(F.count("*").alias("attempts"), F.min("event_type").alias("reason"))
    return T.failed_items_retry(dead, e.filter("value > 250"), 70).select(F.col("url").cast("long").alias("user_id"), "attempts")


SUMMARY = """, m AS (SELECT DISTINCT lower(brand) AS b, regexp_replace(trim(lower(model_name)), ' 5g$', '') AS m, ram_gb FROM products p JOIN offers o ON p.product_id = o.product_id)
SELECT 'brand' AS entity, 'created' AS state, count(DISTINCT b) AS n FROM m UNION ALL SELECT 'variant', 'created', count(DISTINCT (b, m, ram_gb)) FROM m UNION ALL SELECT 'listing', 'new', count(DISTINCT offer_id) FROM offers
UNION ALL SELECT 'reject', 'no brand', count(*) FROM offers o JOIN products p ON o.product_id = p.product_id WHERE trim(brand) = '' HAVING count(*) > 0"""


@query("a15_ingestion_summary", WITH + SUMMARY)
def ingestion_summary(spark, d):
    """Brands, variants and listings after all offers went through the flow."""
    r = offers(spark, d).join(products(spark, d), "product_id").select(
        F.col("offer_id").alias("row_id"), "store_name", F.concat(F.lit("https://shop.example/"), F.col("offer_id").cast("string")).alias("url"), F.concat_ws(" ", "brand", "model_name").alias("title"),
        "brand", "model_name", F.lit(None).cast("string").alias("model_number"), "category", F.lit(None).cast("string").alias("color"), F.col("ram_gb").cast("int").alias("ram"), F.lit(None).cast("int").alias("storage"),
        F.lit(None).cast("double").alias("display_size"), F.lit(None).cast("string").alias("connectivity_type"), "price", F.col("last_seen").cast("timestamp").alias("scraped_at"),
    )
    return R.ingestion_summary(R.ingest(r)).filter("n > 0")
