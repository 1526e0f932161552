import pytest
from pyspark.sql import functions as F

from tallyshelf.functions import rules as R

s = lambda v: F.lit(v).cast("string")
tuple_of = lambda c: F.array(c["model_name"], c["model_name_with_5g"])
CASES = [
    (lambda: R.rounded_price(s("MRP ₹54,900.00")), 54900),
    (lambda: R.discount_percent(F.lit(14999.0), F.lit(16999.0)), 12),
    (lambda: R.capacity_gb(s("1 TB")), 1024),
    (lambda: R.capacity_gb(s("4096 MB")), 4),
    (lambda: R.network_key(s("Galaxy A16 5G")), "galaxy a16"),
    (lambda: R.network_key(s("Galaxy A16 4G")), "galaxy a16 4g"),
    (lambda: R.color_key(s("Jet  Black Color")), "jet black"),
    (lambda: R.rating_score(s("Not Available")), None),
    (lambda: R.rating_count(s("1,204 Ratings")), 1204),
    (lambda: R.display_inches(s("25.4 cm")), 10.0),
    (lambda: R.display_inches(s("26.42 cm (10.4 inch)")), 10.4),
    (lambda: R.display_inches(s("10.1")), 10.1),
    (lambda: R.display_inches(s("40 inch")), None),
    (lambda: R.screen_inches(s("27.9 Centimetres")), 11.0),
    (lambda: R.screen_inches(s("17.3 Inches")), 17.3),
    (lambda: R.stock_status(s(None)), "in_stock"),
    (lambda: R.stock_status(s("Currently unavailable.")), "out_of_stock"),
    (lambda: R.stock_status(s("Only few left")), "limited_stock"),
    (lambda: R.stock_status(s("Only 2 left in stock")), "in_stock"),
    (lambda: R.stock_status(s("Coming Soon")), "pre_order"),
    (lambda: R.stock_status(s("Pre-order now")), "pre_order"),
    (lambda: R.product_slug(s("Galaxy S25+ & Case")), "galaxy-s25+-and-case"),
    (lambda: R.slug(s("  Mobile Phones & More ")), "mobile-phones-more"),
    (lambda: R.first_number(s("₹1,29,999.00")), 129999),
    (lambda: R.similarity(s("Galaxy S24"), s("galaxy s24 ")), 100),
    *((lambda v=v: R.is_model_number(s(v)), True) for v in ("CPH2717", "cph2717", "SM-F966BDBGINS", "E166PD", "S937BC", "P55", "T3")),
    *((lambda v=v: R.is_model_number(s(v)), False) for v in ("Reno 14", "10C", "Galaxy S24", "Note")),
    (lambda: R.without_brand(s("OPPO Reno 14 5G"), s("oppo")), "Reno 14 5G"),
    (lambda: R.without_brand(s("OnePlus 13R"), s("one plus")), "13R"),
    (lambda: R.without_brand(s("One 13R"), s("one plus")), "13R"),
    (lambda: R.without_brand(s("Oppo"), s("oppo")), "Oppo"),
    (lambda: R.without_5g(s("Reno 14 5G")), "Reno 14"),
    (lambda: R.without_5g(s("Reno 14 4G")), "Reno 14 4G"),
    (lambda: R.title_brand(s("redmi Note 13 (Blue, 128 GB)")), "redmi"),
    (lambda: R.title_brand(s("Sonya phone")), None),
    (lambda: R.title_model(s("Redmi Note 13 128 GB, 8 GB RAM, Blue, 5G")), "Note 13 5G"),
    (lambda: R.title_model(s("OnePlus Nord CE4, Dark")), "Nord CE4"),
    (lambda: R.title_model(s("Nokia 105 - Mobile Phone")), "105"),
    (lambda: R.title_model(s("Quix A1")), None),
    (lambda: R.standard_brand(s("one plus")), "OnePlus"),
    (lambda: R.standard_brand(s("OPPO")), "Oppo"),
    (lambda: R.standard_brand(s("iQOO")), "iQOO"),
    (lambda: R.standard_brand(s("")), None),
    (lambda: R.clean_model(s("Note 13 (Blue) , 8 GB")), "Note 13"),
    (lambda: R.is_model_name(s("Mobile Phone")), False),
    (lambda: R.color_key(s("Multicolor")), "multicolor"),
    (lambda: R.color_key(s("Blue colour")), "blue colour"),
    (lambda: R.gigabytes(s("512MB")), 1),
    (lambda: R.gigabytes(s("1.5 TB")), 1536),
    (lambda: R.image_url(s("https://i/416/416/x/1/2/a.jpg"), "flipkart"), "https://i/845/845/x/1/2/a.jpg"),
    (lambda: R.image_url(s("https://i/v2/resize-w:75/a.jpg"), "reliance"), "https://i/v2/original/a.jpg"),
    (lambda: R.image_url(s("https://i/a._SX679_.jpg"), "amazon"), "https://i/a.jpg"),
    (lambda: R.image_urls(F.array(s("a/video_thumbnail/x"), s("v.mp4"), s(None), s("v.mp4")), "croma"), ["v.mp4"]),
    (lambda: R.image_urls(F.array(s("i/1/1/a"), s("i/2/2/b"), s("i/3/3/b")), "flipkart", s("i/9/9/a")), ["i/845/845/b"]),
    (lambda: R.amazon_key(s("https://a.in/x/dp/B0ABCDEFGH/ref=1?q=2")), "https://a.in/x/dp/B0ABCDEFGH"),
    (lambda: R.flipkart_key(s("/p/itm1?pid=MOB1&lid=2")), "https://www.flipkart.com/p/itm1?pid=MOB1"),
    (lambda: R.croma_key(s("https://WWW.Croma.com/P/1/?a=b#c")), "https://www.croma.com/P/1"),
    (lambda: R.reliance_key(s("https://r.in/p?internal_source=x&id=7")), "https://r.in/p?id=7"),
    (lambda: R.pixels_per_inch(s("1080 x 2400"), F.lit(6.5)), 405),
    (lambda: R.millimetres(s("7.5 cm")), 75.0),
    (lambda: R.formatted_price(F.lit(54900), s("INR")), "₹54900"),
    (lambda: R.formatted_price(F.lit(54900.5), s("CHF")), "CHF54900.5"),
    (lambda: tuple_of(R.network_names(s("Galaxy A16 5G"), s("x 4G"), s(None))), ["Galaxy A16", "Galaxy A16 5G"]),
    (lambda: tuple_of(R.network_names(s("Galaxy A16"), s("A16 4G phone"), s(None))), ["Galaxy A16", "Galaxy A16 4G"]),
    (lambda: tuple_of(R.network_names(s("Galaxy A16 (Blue)"), s(None), s("4G, 5G"))), ["Galaxy A16", "Galaxy A16 5G"]),
    (lambda: tuple_of(R.network_names(s("Galaxy A16"), s("phone"), s(None))), ["Galaxy A16", "Galaxy A16 5G"]),
    (lambda: R.flipkart_key(s("/p/x?pid=A1&lid=2")), "https://www.flipkart.com/p/x?pid=A1"),
    (lambda: R.flipkart_key(s("https://www.flipkart.com/search?id=1")), "https://www.flipkart.com/search?id=1"),
    (lambda: R.flipkart_key(s("/p/x?lid=1&pid=2")), "https://www.flipkart.com/p/x?lid=1&pid=2"),
    (lambda: R.flipkart_key(s("")), ""),
    (lambda: R.reliance_key(s("/p/1?internal=a&internalId=5&internal_x=1&b=2#f")), "https://www.reliancedigital.in/p/1?internalId=5&b=2#f"),
    (lambda: R.reliance_key(s("https://WWW.Reliancedigital.in?internal_source=x")), "https://www.reliancedigital.in/"),
    (lambda: R.reliance_key(s("/p?a=%zz&b=x%2Fy z&&c")), "https://www.reliancedigital.in/p?a=%zz&b=x%2Fy+z&c="),
    (lambda: R.network_names(s("Galaxy(2024)A"), s("x"), s(None))["model_name"], "Galaxy A"),
    (lambda: R.title_breadcrumb(s("Apple iPhone-16 Pro"), F.array(s("a"))), list(R.SMARTPHONE_CRUMBS)),
    (lambda: R.title_breadcrumb(s("Apple iPhone 15"), F.array(s("a"))), ["a"]),
    (lambda: R.url_or_placeholder(s(""), s("My Store"), F.lit(7)), "https://my-store.example/7"),
    *((lambda v=v, c=c: R.connectivity_type(s(v), F.array(s("a"), s("b"), s("c"), s(c))), w) for v, c, w in (
        ("Wi-Fi+5G", None, "Wi-Fi+5G"), ("4G", None, "Wi-Fi+4G"), ("3G", None, "Wi-Fi+3G"), ("Wi-Fi Only", None, "Wi-Fi Only"), ("other", "Tablets with Call Facility", "Wi-Fi+Cellular"),
        (None, "Tablets without Call Facility", "Wi-Fi Only"), (None, None, "Wi-Fi Only"),
    )),
    (lambda: R.connectivity_kind(s("Cellular, Wi-Fi")), "Wi-Fi + Cellular"),
    (lambda: R.connectivity_kind(s("WiFi")), "Wi-Fi Only"),
    (lambda: R.connectivity_kind(s("Bluetooth")), "Bluetooth"),
    (lambda: R.discount_2(F.lit(75), F.lit(100)), 25.0),
    (lambda: R.plain_price(s("$1,299.50")).cast("double"), 1299.5),
]


@pytest.fixture(scope="module")
def answers(spark):
    return spark.range(1).select(*(make().alias(f"c{k}") for k, (make, _) in enumerate(CASES))).first()


@pytest.mark.parametrize("k", range(len(CASES)))
def test_rule(answers, k):
    assert answers[k] == CASES[k][1]
