"""Selectors over parsed pages, and golden pages of the stores."""

import pytest

from tallyshelf.operators.pages import related_links
from tallyshelf.operators.selectors import SIMILAR, STORE_FIELDS, Field, block_links, compiled, parse, select, select_fields

PAGE = '<div id="a" class="x y"><p>one<p class="z">two <b>bold</b></p><ul><li>1<li>2</ul><img src="i.png"><span data-k="long value">GB RAM</span><script>p.z{}</script></div><p class="z">three &amp; four</p>'


@pytest.mark.parametrize("selector, want", [
    ("p", ["one", "two bold", "three & four"]), ("div p", ["one", "two bold"]), ("div > p", ["one", "two bold"]), ("p.z", ["two bold", "three & four"]), ("#a .z", ["two bold"]), ("#a.x.y b", ["bold"]), ("div.y > b", []),
    ("li", ["1", "2"]), ("[data-k]", ["GB RAM"]), ("span[data-k*='long']", ["GB RAM"]), ("span[data-k='long']", []), ("span:contains(GB):contains(RAM)", ["GB RAM"]), ("* b", ["bold"]), ("i", []), ("div b", ["bold"]),
])
def test_selectors(selector, want):
    assert [e.text() for e in select(parse(PAGE), compiled(selector))] == want


@pytest.mark.parametrize("selector", ["", "p:nth(1)", "a[b", "&"])
def test_unknown_selectors_are_told(selector):
    with pytest.raises(ValueError):
        compiled(selector)


GOLDEN = {
    "amazon": ('<h1 id="title"><span id="productTitle"> Samsung  Galaxy\n S24 (Grey) </span></h1><div id="corePriceDisplay_desktop_feature_div"><span class="priceToPay"><span class="a-price-whole">74,999</span></span><span data-a-strike="true"><span class="a-offscreen">₹79,999</span></span></div><div id="availability"><span>In stock</span></div>', ("Samsung Galaxy S24 (Grey)", "74,999", "₹79,999", "In stock")),
    "flipkart": ('<h1><span class="VU-ZEz">vivo T4 (8 GB RAM)</span></h1><div class="Nx9bqj CxhGGd">₹21,999</div><div class="yRaY8j A6+E6v">₹25,999</div>', ("vivo T4 (8 GB RAM)", "₹21,999", "₹25,999", None)),
    "croma": ('<h1 class="pd-title pd-title-normal">OnePlus 13</h1><span id="pdp-product-price">₹69,999</span><span id="old-price">₹72,999</span>', ("OnePlus 13", "₹69,999", "₹72,999", None)),
    "reliance": ('<h1 class="product-name">Moto G85</h1><div class="product-price">₹15,999</div><span class="product-marked-price">₹20,999</span>', ("Moto G85", "₹15,999", "₹20,999", None)),
}


@pytest.mark.parametrize("store", sorted(GOLDEN))
def test_golden_pages(spark, store):
    html, want = GOLDEN[store]
    pages = spark.createDataFrame([("1", "u", html, "t"), ("2", "v", None, "t"), ("3", None, "", "t"), ("4", "w", "<h1 id=title>too short</h1>", "t")], "page_id string, url string, html string, title string")
    got = {r.page_id: (r.title, r.price, r.original_price, r.availability) for r in select_fields(pages, STORE_FIELDS[store]).collect()}
    assert got == {"1": want, "2": (None,) * 4, "3": (None,) * 4, "4": (None,) * 4}


def test_first_selector_within_the_window_wins(spark):
    pages = spark.createDataFrame([(1, "u", "<b>x</b><i>long enough</i><u>also long enough</u><b>this one is second</b>")], "page_id long, url string, html string")
    fields = {"a": Field(("b", "i", "u"), least=3), "b": Field(("q", "u"), most=3), "all": Field(("q", "b"), every=True), "none": Field(("q",), every=True)}
    r = select_fields(pages, fields).first()
    assert (r.a, r.b, r.all, r.none) == ("long enough", None, ["x", "this one is second"], [])


def test_block_links_and_seen(spark):
    block = lambda head, *hrefs: f'<div class="pq8uUv"><div class="jOp9db">{head}</div>{"".join(f"<a class=VJA3rP href={h}>x</a>" for h in hrefs)}<a href="/no">y</a></div>'
    rows = [(1, "u", block("Similar Products", "/a?pid=1&x", "/a?pid=2") + block("Sponsored", "/a?pid=3")), (2, "u", block("Similar Products", "/a?pid=2&y=1", "/a?pid=4", "/a?pid=5", "/a?pid=6")), (3, "u", None), (4, "u", "<a class=VJA3rP href=/a?pid=9>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(tuple(r) for r in block_links(pages, SIMILAR["flipkart"]).collect()) == [(1, 0, "/a?pid=1&x"), (1, 1, "/a?pid=2"), (2, 0, "/a?pid=2&y=1"), (2, 1, "/a?pid=4"), (2, 2, "/a?pid=5"), (2, 3, "/a?pid=6")]
    base = "https://www.flipkart.com/a?pid="
    seen = spark.createDataFrame([(f"{base}4",)], "link string")
    got = related_links(pages, seen, 1, block=SIMILAR["flipkart"], store="flipkart")
    assert sorted((r.page_id, r.link, r["rank"]) for r in got.collect()) == [(1, f"{base}1", 1), (2, f"{base}5", 1)]
