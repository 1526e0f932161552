import json

from tallyshelf.operators import normalize as N
from tallyshelf.operators.enrich import CATEGORIES, classify_batches, extract_attributes, keyword_model
from tallyshelf.operators.pages import extract_images_breadcrumb_tags, extract_price_rating, parse_tables
from tallyshelf.sources import feeds as S


def put(path, rows):
    path.write_text(json.dumps(rows))
    return str(path)


def test_reliance(spark, tmp_path):
    p = put(tmp_path / "r.json", [{"url": "https://r.in/1", "title": "Redmi Note 13 128 GB, 8 GB RAM (Arctic White, 2024) 5G", "price": {"price": "MRP ₹14,999.00", "originalPrice": "₹16,999.00"}, "rating": {"rating": "4.2", "ratingCount": 10}, "image": {"mainImage": "https://i/1", "allImages": ["https://i/resize-w:75/a.jpg", "https://i/resize-w:540/a.jpg", "https://i/1", "https://i/video.mp4"]}, "specifications": {"General": {"Brand": "Xiaomi", "Model": "CPH2717"}, "Battery": {"Battery Capacity": "5000 mAh"}}, "availability": None, "categories": "x", "extractedAt": "2024-05-01T10:00:00Z"}])
    r = N.normalize_reliance(S.read_feed(spark, "reliance", p)).first()
    assert (r.product_identifiers.brand, r.product_identifiers.model_number, r.product_identifiers.needs_manual_review) == ("Redmi", "CPH2717", False)
    assert (r.listing_info.price.current, r.listing_info.price.original, r.listing_info.price.discount_percent) == (14999, 16999, 12)
    assert (r.product_identifiers.model_name, r.variant_attributes.color, r.variant_attributes.ram, r.variant_attributes.storage) == ("Note 13 5G", "Arctic White", 8, 128)
    assert r.listing_info.image_urls == ["https://i/original/a.jpg", "https://i/video.mp4"]
    assert r.key_specifications.battery.capacity_mah == 5000 and r.key_specifications.camera is None


def test_flipkart_and_all(spark, tmp_path):
    phone = {"url": "/p/1?pid=2&x=1", "title": "Apple iPhone 15 (Blue, 128 GB)", "price": {"current": 60000, "original": 70000, "discount": "14% off"}, "rating": {"score": 4.6, "count": 9}, "specifications": {"General": {"Model Name": "iPhone 15", "Browse Type": "Smartphones"}, "Memory & Storage Features": {"Internal Storage": "128 GB"}}, "category": ["Home", "Mobiles", "x", "APPLE Mobiles"], "image": "https://i/128/128/m.jpg", "images": ["https://i/416/416/m.jpg", "https://i/416/416/n.jpg"]}
    tab = {"url": "/p/3", "title": "Lenovo Tab M10 4 GB RAM 1 TB ROM 25.65 cm (10.1 inch)", "price": {"current": 10}, "specifications": {"General": {"RAM": "4 GB", "Connectivity": "Wi-Fi+5G"}, "Product Details": {"Display Size": "25.65 cm (10.1 inch)"}}, "category": ["Home", "x", "Tablets", "Lenovo Tablets"]}
    p = put(tmp_path / "f.json", [phone, tab, {"title": " "}])
    df = S.read_feed(spark, "flipkart", p)
    r = N.normalize_flipkart_phones(df).first()
    assert (r.product_identifiers.brand, r.product_identifiers.model_name, r.category, r.variant_attributes.storage, r.variant_attributes.color, r.listing_info.image_urls) == ("Apple", "iPhone 15", "Smartphones", 128, None, ["https://i/845/845/n.jpg"])
    t = N.normalize_flipkart_tablets(df).collect()
    assert len(t) == 1 and (t[0].variant_attributes.ram, t[0].variant_attributes.storage, t[0].variant_attributes.display_size, t[0].variant_attributes.connectivity_type, t[0].product_identifiers.model_name) == (4, 1024, 10.1, "Wi-Fi+5G", "Tab M10")
    both = S.read_all_feeds(spark, {"flipkart": p, "croma": str(tmp_path / "none.json")})
    assert both.count() == 3 and both.first().source == "flipkart"
    out = str(tmp_path / "out")
    S.write_normalized(N.normalize_flipkart_phones(df), out)
    assert spark.read.parquet(out).count() == 2
    assert S.read_latest_feed(spark, "flipkart", str(tmp_path)).count() == 3


def test_croma_and_amazon(spark, tmp_path):
    c = put(tmp_path / "c.json", [{"url": "u", "title": "vivo T3", "price": {"current": "₹19,999.50", "original": "₹24,999"}, "rating": {"star": "Not Available"}, "specifications": {"Manufacturer Details": {"Brand": "vivo | x", "Model Series": "T3"}, "Screen Specifications": {"Screen Size in Inches": "6.7 Inches"}, "Storage Specifications": {"RAM": "8 GB"}}}])
    r = N.normalize_croma(S.read_feed(spark, "croma", c)).first()
    assert (r.product_identifiers.brand, r.listing_info.price.current, r.listing_info.rating.score, r.variant_attributes.ram, r.key_specifications.display.size_in) == ("vivo", 20000, None, 8, 6.7)
    a = put(tmp_path / "a.json", [{"url": "u1", "title": "Phone", "price": {"current": "₹9,999"}, "image": "https://i/x._SX300_.jpg", "specifications": {"Brand": "Q", "Technical Details": {"technicalDetails": {"Item model number": "N1"}}}, "categories": ["a", "b", "c", "Smartphones"]}, {"url": "u2", "title": "Tab", "specifications": {"Screen Size": "10.4 inches", "Technical Details": {"technicalDetails": {"Resolution": "2000 x 1200", "Product Dimensions": "0.7 x 24.5 x 15.4 cm; 465 g"}}, "Product Details": {"productDetails": {"display size": "10.4 inches"}}}, "categories": ["a", "Tablets"]}])
    attrs = spark.createDataFrame([("u1", "Quix", "Q1", "Red", 6, 128, None, None, False)], "url string, brand_name string, model_name string, color string, ram int, storage int, display_size double, connectivity_type string, not_tablet boolean")
    feed = S.read_feed(spark, "amazon", a)
    rows = {x.source_details.url: x for x in N.normalize_amazon_phones(feed, attrs).collect()}
    assert (rows["u1"].product_identifiers.brand, rows["u1"].product_identifiers.model_number, rows["u1"].category, rows["u1"].listing_info.image_url) == ("Quix", "N1", "Smartphones", "https://i/x.jpg")
    assert rows["u2"].product_identifiers.brand is None
    t = N.normalize_amazon_tablets(feed, attrs).collect()
    assert [x.source_details.url for x in t] == ["u2"] and t[0].variant_attributes.display_size == 10.4
    design, display = t[0].key_specifications.design, t[0].key_specifications.display
    assert (design.depth_mm, design.width_mm, design.height_mm, design.weight_g, display.ppi) == (7.0, 245.0, 154.0, 465.0, 224)


def test_append_new(spark):
    old = spark.createDataFrame([("https://a.in/dp/B000000001?x=1", 1)], "url string, n int")
    new = spark.createDataFrame([("https://a.in/dp/B000000001", 2), ("https://a.in/dp/B000000002/a", 3), ("https://a.in/dp/B000000002/b", 4), (None, 5), (None, 6)], "url string, n int")
    assert sorted(r.n for r in S.append_new_by_url(old, new, "amazon", ["n"]).collect()) == [1, 3, 5, 6]


def test_spec_tables_and_prices(spark):
    html = "<h2>Display</h2><table><tr><th>Size:</th><td>6.1 inch</td></tr><tr><td colspan=2>Camera</td></tr><tr><td>Rear</td><td>50 MP</td></tr><tr><td>Cut</td><td>abc...</td></tr></table>"
    assert parse_tables(html) == {"Display": {"Size": "6.1 inch"}, "Camera": {"Rear": "50 MP"}}
    assert parse_tables(None) == {}
    page = spark.createDataFrame([(1, "u", "<p>M.R.P.: ₹2,000</p><b>₹1,500.00</b> 25% off 4.3 out of 5 1,204 ratings <img src='a.jpg'><ul class='breadcrumb'><a href='/x'>Home</a><a>Phones</a></ul><li class='highlight'>Fast</li>"), (2, "v", None)], "page_id long, url string, html string")
    r = extract_price_rating(page).orderBy("page_id").collect()
    assert (r[0].original_price, r[0].discount_percent, r[0].rating, r[0].rating_count) == (2000, 25, 4.3, 1204) and r[1].price is None
    i = extract_images_breadcrumb_tags(page).orderBy("page_id").first()
    assert (i.main_image, i.breadcrumb, i.tags) == ("a.jpg", ["Home", "Phones"], ["Fast"])


def test_model_failures_get_the_default(spark):
    df = spark.createDataFrame([("u", "Galaxy Tab tablet"), ("v", None)], "url string, title string")
    assert {r.url: r.category for r in classify_batches(df).collect()} == {"u": "tablets", "v": "mobile-phones"}
    assert {r.confidence for r in classify_batches(df, lambda t: t[:0]).collect()} == {0.1}


def test_categories_and_attributes(spark):
    titles = ["Mi Power Bank 10000", "Galaxy S24 case", "boAt earbuds", "Noise smart watch", "Xbox Series S", "Canon DSLR", "LG smart TV", "Lenovo Tab M10", "HP laptop 14", "HP desktop", "Vivo phone"]
    got = [c for c, _ in keyword_model(titles)]
    assert len(set(got)) == len(CATEGORIES) == 11 and set(got) == set(CATEGORIES)
    df = spark.createDataFrame([("a", "Vivo T3", "mobile-phones"), ("b", None, "laptops"), ("c", "x", "broken"), ("d", "y", None)], "url string, title string, category string")

    def model(category, some):
        if category == "broken":
            raise ValueError
        return [{"brand": t[:4], "ram_gb": 8, "lens_mount": "no"} for t in some]

    rows = {r.url: r.attributes for r in extract_attributes(df, model).collect()}
    assert rows == {"a": {"brand": "Vivo", "ram_gb": "8"}, "b": {"brand": "", "ram_gb": "8"}, "c": {}, "d": {"brand": "y"}}
