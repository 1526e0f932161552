"""Stored product pages to fields, specification tables, prices and links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.operators.selectors import Block, block_links


#: Common entities and what they stand for, in the order they are decoded.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def plain(c: Column, entities: dict[str, str] = ENTITIES, squeeze: Callable[[Column], Column] = rules.squeeze) -> Column:
    """Text of an HTML fragment: tags out, common entities decoded, spaces squeezed."""
    out = F.regexp_replace(c, "<[^>]*>", " ")
    for name, char in entities.items():
        out = F.replace(out, F.lit(name), F.lit(char))
    return squeeze(out)


def element(tag: str, html: Column | None = None, entities: dict[str, str] = ENTITIES, squeeze: Callable[[Column], Column] = rules.squeeze) -> Column:
    """Inner text of the first element of a tag; null if there is none."""
    html = F.col("html") if html is None else html
    return F.nullif(plain(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1), entities, squeeze), F.lit(""))


def extract_page_fields(pages: DataFrame, least: int = 3, most: int = 500) -> DataFrame:
    """Title (h1, else title element) within a length window, and availability text."""
    title = F.coalesce(element("h1"), element("title"))
    stock = F.regexp_substr(F.lower("html"), F.lit("in stock|out of stock|currently unavailable|only [0-9]+ left|sold out|pre-?order"))
    return pages.select("page_id", "url", F.when(F.length(title).between(least, most), title).alias("title"), element("title").alias("head_title"), stock.alias("availability"))


class _Tables(HTMLParser):
    """Sections, labels and values of tables: a heading or one-cell row names the section."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: dict[str, dict[str, str]] = {}
        self.section, self.cells, self.text, self.heading = "General", [], None, False

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.cells = []
        elif tag in ("td", "th") or tag in ("h2", "h3", "caption"):
            self.text, self.heading = "", tag not in ("td", "th")

    def handle_data(self, data):
        if self.text is not None:
            self.text += data

    def handle_endtag(self, tag):
        if tag in ("td", "th", "h2", "h3", "caption") and self.text is not None:
            value = " ".join(self.text.split())
            if self.heading:
                self.section = value or self.section
            else:
                self.cells.append(value)
            self.text = None
        elif tag == "tr":
            if len(self.cells) == 1 and self.cells[0]:
                self.section = self.cells[0]
            elif len(self.cells) >= 2:
                key, value = self.cells[0].strip(" :：-"), self.cells[1]
                if key and value and len(key) <= 100 and len(value) <= 1000 and not value.endswith(("...", "…")):
                    self.out.setdefault(self.section, {})[key] = value
            self.cells = []


def parse_tables(html: str | None) -> dict[str, dict[str, str]]:
    parser = _Tables()
    parser.feed(html or "")
    return parser.out


def extract_spec_table(pages: DataFrame) -> DataFrame:
    """page_id, url, specifications (section to label to value)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"page_id": df["page_id"], "url": df["url"], "specifications": [parse_tables(h) for h in df["html"]]})

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, url string, specifications map<string,map<string,string>>")


def extract_price_rating(pages: DataFrame) -> DataFrame:
    """Price, list price and discount by ₹ patterns, rating "x out of 5" and count."""
    text = plain(F.col("html"))
    prices = F.regexp_extract_all(text, F.lit(r"(?:₹|Rs\.?)\s*([0-9][0-9,]*(?:\.[0-9]+)?)"), 1)
    mrp = F.regexp_extract(text, r"(?i)M\.?R\.?P\.?:?\s*(?:₹|Rs\.?)\s*([0-9][0-9,]*(?:\.[0-9]+)?)", 1)
    return pages.select(
        "page_id", "url", rules.rounded_price(F.get(prices, 0)).alias("price"), rules.rounded_price(F.coalesce(F.nullif(mrp, F.lit("")), F.get(prices, 1))).alias("original_price"),
        F.regexp_extract(text, r"([0-9]{1,2})\s*% off", 1).try_cast("int").alias("discount_percent"),
        F.regexp_extract(text, r"([0-5](?:\.[0-9])?) out of 5", 1).try_cast("double").alias("rating"),
        F.regexp_replace(F.regexp_extract(text, r"(?i)([0-9][0-9,]*)\s*(?:ratings|reviews)", 1), ",", "").try_cast("int").alias("rating_count"),
    )


def extract_images_breadcrumb_tags(pages: DataFrame) -> DataFrame:
    """Image addresses (main first), breadcrumb names and list items as tags."""
    images = F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)<img\b[^>]*?\bsrc=["']([^"']+)"""), 1))
    nav = F.regexp_extract("html", r"(?is)<(?:nav|ul|ol)\b[^>]*breadcrumb[^>]*>(.*?)</(?:nav|ul|ol)>", 1)
    text = lambda x: plain(x)  # noqa: E731  (Spark passes a column for each parameter of a function, also for those with defaults)
    names = F.filter(F.transform(F.regexp_extract_all(nav, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), 1), text), lambda x: x != "")
    tags = F.filter(F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<li\b[^>]*highlight[^>]*>(.*?)</li>"), 1), text), lambda x: x != "")
    return pages.select("page_id", "url", F.get(images, 0).alias("main_image"), images.alias("images"), names.alias("breadcrumb"), tags.alias("tags"))


def page_links(pages: DataFrame, pattern: str | None = None) -> DataFrame:
    """page_id, pos and link of every anchor, optionally of those that match."""
    found = F.regexp_extract_all("html", F.lit(r"""<a\b[^>]*?\bhref=["']([^"'#]+)"""), 1)
    out = pages.select("page_id", F.posexplode(found).alias("pos", "link"))
    return out.filter(F.col("link").rlike(pattern)) if pattern else out


def extract_links(pages: DataFrame, store: str | None = None, pattern: str | None = None) -> DataFrame:
    """Each canonical link once, where it was seen first, in page order."""
    key = rules.URL_KEYS[store](F.col("link")) if store else F.col("link")
    w = W.partitionBy("link").orderBy("page_id", "pos")
    return page_links(pages, pattern).withColumn("link", key).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def related_links(pages: DataFrame, seen: DataFrame, max_per_page: int, pattern: str | None = None, block: Block | None = None, store: str | None = None) -> DataFrame:
    """Links not yet seen, each on its first page, at most so many a page; of all
    anchors, or of one block (``SIMILAR`` of a store).  With ``store`` they are
    canonical addresses, as those of ``seen`` are."""
    found = page_links(pages, pattern) if block is None else block_links(pages, block)
    found = found.withColumn("link", rules.URL_KEYS[store](F.col("link"))) if store else found
    first = found.groupBy("link").agg(F.min(F.struct("page_id", "pos")).alias("at")).select("at.page_id", "at.pos", "link")
    new = first.join(seen.select("link").distinct(), "link", "left_anti")
    return new.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("pos"))).filter(F.col("rank") <= max_per_page)


def default_categories(title: Column) -> Column:
    """A breadcrumb by keyword where none was found; empty without a title."""
    low = F.lower(title)
    make = lambda *names: F.array(*(F.lit(n) for n in names)).cast("array<string>")
    return (
        F.when(F.coalesce(title, F.lit("")) == "", make())
        .when(low.rlike("phone|mobile"), make("Electronics", "Mobile Phones"))
        .when(low.rlike("laptop|computer|tablet"), make("Electronics", "Computers"))
        .otherwise(make("Electronics"))
    )


#: What error pages say.
ERROR_TEXTS = (("captcha", r"(?i)captcha|enter the characters you see|not a robot"), ("denied", r"(?i)access denied|403 forbidden|request blocked"), ("not_found", r"(?i)page not found|404 not found|looking for something\?"))


def flag_error_pages(pages: DataFrame) -> DataFrame:
    """pages with error (captcha, denied, not_found or null)."""
    text, flag = plain(F.col("html")), None
    for name, pattern in ERROR_TEXTS:
        flag = F.when(text.rlike(pattern), name) if flag is None else flag.when(text.rlike(pattern), name)
    return pages.withColumn("error", flag)
