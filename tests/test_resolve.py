import datetime as dt

from pyspark.sql import functions as F

from tallyshelf.operators import catalog as C
from tallyshelf.operators import resolve as R
from tallyshelf.operators.catalog import price_history, relabel_main_image

T = dt.datetime(2024, 1, 1)
FEED = "row_id long, store_name string, url string, title string, brand string, model_name string, model_number string, category string, color string, ram int, storage int, display_size double, connectivity_type string, price double, scraped_at timestamp"


def feed(spark, *rows):
    base = (None, "s", None, "t", None, None, None, None, None, None, None, None, None, 1.0, T)
    names = [c.split()[0] for c in FEED.split(", ")]
    return spark.createDataFrame([tuple(r.get(n, b) for n, b in zip(names, base, strict=True)) for r in rows], FEED)


def groups(df, key="product_key"):
    return sorted(sorted(r[0]) for r in df.groupBy(key).agg(F.collect_list("row_id")).select("collect_list(row_id)").collect())


def test_network_names_and_numbers(spark):
    f = feed(spark, {"row_id": 1, "brand": "Samsung", "model_name": "Galaxy A16"}, {"row_id": 2, "brand": "samsung", "model_name": "galaxy a16 5G", "model_number": "SM-A166"}, {"row_id": 3, "brand": "Samsung", "model_name": "Galaxy A16 4G"}, {"row_id": 4, "brand": "Samsung", "model_name": "A-16", "model_number": "sm-a166"}, {"row_id": 5, "brand": "Other", "model_name": "Galaxy A16"})
    assert groups(R.resolve_products(f, "name")) == [[1, 2], [3], [4], [5]]
    assert groups(R.resolve_products(f, "components")) == [[1, 2, 4], [3], [5]]
    assert groups(R.resolve_products(f.repartition(3), "components")) == [[1, 2, 4], [3], [5]]


def test_apple_ignores_ram(spark):
    f = feed(spark, *({"row_id": k, "brand": b, "model_name": "m", "ram": r, "storage": 128, "color": c} for k, (b, r, c) in enumerate([("Apple", 8, "Jet Black"), ("Apple", None, "jet  black color"), ("Samsung", 8, "x"), ("Samsung", None, "x")])))
    assert R.resolve_variants(R.resolve_products(f)).count() == 3


def test_ingest_twice_is_once(spark):
    f = feed(spark, {"row_id": 1, "url": "u1", "brand": "A", "model_name": "m"}, {"row_id": 2, "url": "u1", "brand": "A", "model_name": "m", "price": 2.0, "scraped_at": T + dt.timedelta(1)}, {"row_id": 3, "title": " ", "brand": "A", "model_name": "m"}, {"row_id": 4, "brand": None, "model_name": "m"})
    one = R.ingest(f)
    assert one.rejects.select("reject_reason").distinct().count() == 2
    assert [(r.price, r.change) for r in one.listings.collect()] == [(2.0, "new")]
    two = R.ingest(f, {"brands": one.brands, "variants": one.variants, "listings": one.listings.drop("change", "price_changed")})
    assert two.brands.filter("is_new").count() == 0 and two.variants.filter("is_new").count() == 0
    got = two.listings.collect()
    assert [(r.change, r.price_changed, r.created_at) for r in got] == [("updated", False, T + dt.timedelta(1))]
    assert {r.n for r in R.ingestion_summary(two).collect()} == {1}


def test_ingest_categories_and_report(spark):
    f = feed(spark, {"row_id": 1, "brand": "A", "model_name": "m", "model_number": "X-1"}, {"row_id": 2, "brand": "A", "model_name": "m2", "model_number": "x-1", "category": "Tablets"}, {"row_id": 3, "brand": "A", "model_name": "m", "category": "Toys"}, {"row_id": 4, "brand": "A", "model_name": "z", "category": "Toys"}, {"row_id": 5, "brand": None, "model_name": "m"})
    cats = spark.createDataFrame([("1", "Smartphones"), ("2", "Tablets"), ("3", "others")], "category_id string, name string")
    one = R.ingest(f, {"categories": cats})
    assert {r.row_id: (r.category_id, r.product_match, r.category_match) for r in one.labels.collect()} == {1: ("1", "new_product", "default"), 2: ("2", "model_number", "name"), 3: ("3", "model_name", "other"), 4: ("3", "new_product", "other")}
    assert sorted((r.category_id, r.model_number, r.is_new) for r in one.products.collect()) == [("1", "X-1", True), ("3", None, True)]
    got = {(r.entity, r.state): (r.n, r.pct) for r in R.ingestion_report(one).collect()}
    assert got["processed", "s"] == (4, None) and got["skipped", "s"] == (1, None) and got["deduplicated", "records"] == (2, 50.0)
    assert got["product", "created"][0] == 2 and got["category", "existing"][0] == 3 and got["product_match", "model_number"][0] == 1
    two = R.ingest(f, {"categories": cats, "products": one.products})
    assert {r.is_new for r in two.products.collect()} == {False} and "new_product" not in {r.product_match for r in two.labels.collect()}


def test_ingest_offers_counts(spark):
    f = feed(spark, {"row_id": 1, "brand": "A", "model_name": "m", "category": "tablets"}, {"row_id": 2, "brand": "A", "model_name": "n", "category": "x"}).withColumns({"store_product_id": F.lit("1"), "last_seen": F.lit(T), "is_active": F.lit(True)})
    cats = spark.createDataFrame([("2", "Tablets", "tabs", True)], "category_id string, name string, slug string, is_active boolean")
    current = spark.createDataFrame([], "variant_id string, store_name string, store_product_id string, price double, last_seen timestamp, is_active boolean")
    products = R.resolve_products(f).select("product_key", "model_name")
    after, counted, brands = R.ingest_offers(f, products, current, cats, R.empty_catalog(spark)["brands"])
    assert after.count() == 1 and brands.count() == 1
    assert sorted((r.model_name, r.active_offers, r.offers) for r in counted.collect()) == [("m", 1, 1), ("n", 0, None)]


def test_empty_feed(spark):
    r = R.ingest(feed(spark))
    assert r.brands.count() == r.products.count() == r.listings.count() == 0


def test_reconcile(spark):
    rows = [
        (("Xiaomi", "CPH2717", "redmi", "Note 13"), ("Redmi", "Note 13", "CPH2717", False)),
        (("Samsung", "Galaxy S24", "Samsung", "Galaxy S24 5G"), ("Samsung", "Galaxy S24 5G", None, False)),
        (("Samsung", "Samsung Galaxy S24", "samsung", "Galaxy S24"), ("Samsung", "Samsung Galaxy S24", None, False)),
        (("vivo", "Y300 Pro", "OPPO", "Reno 14"), ("Oppo", "Reno 14", None, True)),
        (("Samsung", "Galaxy Note", "Samsung", "Galaxy S24 Ultra"), ("Samsung", "Galaxy S24 Ultra", None, True)),
        ((None, None, "OPPO", "Reno 14"), ("Oppo", "Reno 14", None, False)),
        (("Apple", "A3290", None, None), ("Apple", "A3290", "A3290", False)),
        ((None, None, None, None), (None, None, None, False)),
    ]
    df = spark.createDataFrame([(k, *r) for k, (r, _) in enumerate(rows)], "k int, spec_brand string, spec_model string, title_brand string, title_model string")
    got = [tuple(r) for r in R.reconcile_identifiers(df).orderBy("k").select("brand", "model_name", "model_number", "needs_manual_review").collect()]
    assert got == [w for _, w in rows]


def test_history_keeps_thirty(spark):
    df = spark.range(32).select(F.lit(1).alias("k"), F.col("id").alias("offer_id"), F.col("id").cast("double").alias("price"), F.col("id").alias("t"))
    points = price_history(df, ["k"], "t").first().points
    assert [p.price for p in points] == [float(x) for x in range(1, 31)]


def test_main_image(spark):
    df = spark.createDataFrame([([("a", "other"), ("b", "main"), ("c", "main")],), ([("a", None)],)], "images array<struct<url:string,type:string>>")
    got = [[tuple(i) for i in r.images] for r in relabel_main_image(df).collect()]
    assert got == [[("a", "other"), ("b", "main"), ("c", "other")], [("a", "main")]]


def test_constraints_and_categories(spark):
    bad = R.constraint_rejects(spark.createDataFrame([(-1.0, 6.0, "ftp:x"), (1.0, 4.0, "https://a.b/c"), (None, None, None)], "price double, rating double, url string"))
    assert [r.broken for r in bad.collect()] == [["price", "rating", "url"]]
    cats = spark.createDataFrame([("1", "Smartphones", "smartphones", True), ("2", "others", "others", True)], "category_id string, name string, slug string, is_active boolean")
    f = spark.createDataFrame([(None,), ("Smartphones",), ("x",), ("SMARTPHONES",)], "category string")
    assert [r.category_id for r in R.assign_category(f.coalesce(1), cats).orderBy("category").collect()] == ["1", "2", "1", "2"]
    assert {r.category: r.category_id for r in R.category_lookup(f, cats).collect()} == {None: None, "Smartphones": "1", "x": None, "SMARTPHONES": "1"}


def test_sort_keeps_all_rows(spark):
    p = spark.range(300).select(F.col("id").alias("product_id"), (F.col("id") % 7).cast("double").alias("list_price")).repartition(5)
    o = spark.range(900).select((F.col("id") % 250).alias("product_id"), F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("last_seen"))
    got = C.sort_products(p, "price").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 301)) and [r.product_id for r in got] == sorted(range(300), key=lambda k: (k % 7, k))
    assert [r.product_id for r in C.sort_products(p, "date", o).filter("position <= 2 or position = 300").orderBy("position").collect()] == [149, 148, 299]
    assert [r.product_id for r in C.sort_products(p, "popularity", o).filter("position in (1, 150, 151, 251)").orderBy("position").collect()] == [0, 149, 150, 250]
