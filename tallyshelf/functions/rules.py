"""Scalar rules of catalog integration as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeeze(c: Column) -> Column:
    """Trim all white space and collapse runs of it."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def slug(c: Column) -> Column:
    """Lower case, non-word characters out, white space and dashes to one dash."""
    out = F.regexp_replace(F.lower(c), r"[^a-z0-9\s_-]", "")
    return F.regexp_replace(F.regexp_replace(out, r"[\s_-]+", "-"), r"^-+|-+\z", "")


def product_slug(c: Column) -> Column:
    """As slug, but & @ % are spelled out and + stays."""
    out = F.lower(c)
    for sign, word in (("&", "and"), ("@", "at"), ("%", "percent")):
        out = F.replace(out, F.lit(sign), F.lit(word))
    out = F.regexp_replace(out, r"[^a-z0-9+\s_-]", "")
    return F.regexp_replace(F.regexp_replace(out, r"[\s_-]+", "-"), r"^-+|-+\z", "")


def network_key(c: Column) -> Column:
    """Model name without a final " 5g"; " 4g" is another model."""
    return F.regexp_replace(squeeze(F.lower(c)), r" 5g\z", "")


def color_key(c: Column) -> Column:
    """C4: lower case, no final word "color", single spaces; "multicolor" stays."""
    return squeeze(F.regexp_replace(F.lower(c), r"\s+color\s*\z", ""))


def first_number(c: Column) -> Column:
    """C5, digit-run dialect: the first run of digits and commas."""
    return F.regexp_replace(F.regexp_substr(c, F.lit("[0-9][0-9,]*")), ",", "").try_cast("int")


def rounded_price(c: Column) -> Column:
    """C5, decimal dialect: the first decimal number, rounded half up."""
    n = F.regexp_replace(F.regexp_substr(c, F.lit(r"[0-9][0-9,]*(\.[0-9]+)?")), ",", "").try_cast("double")
    return F.floor(n + 0.5).cast("int")


def plain_price(c: Column) -> Column:
    """C5, generic dialect: currency signs and commas stripped."""
    return F.regexp_replace(c, r"[₹$,\s]", "").try_cast("decimal(10,2)")


def discount_percent(current: Column, original: Column, equal_counts: bool = True) -> Column:
    """Whole percent off the original price, null where it is lower."""
    ok = original >= current if equal_counts else original > current
    return F.when(ok & (original > 0), F.floor((original - current) / original * 100 + 0.5).cast("int"))


def discount_2(current: Column, original: Column) -> Column:
    """C6 for offers: percent with two decimals, 0 without a higher original."""
    current, original = current.cast("double"), original.cast("double")
    return F.when(original > current, F.floor((original - current) / original * 10000 + 0.5) / 100).otherwise(F.lit(0.0))


def rating_score(c: Column) -> Column:
    """A number, or null for "Not Available" and the like."""
    return F.regexp_substr(c, F.lit(r"[0-9]+(\.[0-9]+)?")).try_cast("double")


def rating_count(c: Column) -> Column:
    return F.regexp_replace(F.regexp_substr(c, F.lit("[0-9][0-9,]*")), ",", "").try_cast("int")


def capacity_gb(c: Column) -> Column:
    """C8: "1 TB", "512 GB", "4096 MB" as whole GB."""
    n = F.regexp_extract(c, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(TB|GB|MB)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(c, r"(?i)([0-9]+(?:\.[0-9]+)?)\s*(TB|GB|MB)", 2))
    gb = F.when(unit == "TB", n * 1024).when(unit == "MB", n / 1024).otherwise(n)
    return F.floor(gb + 0.5).cast("int")


def gigabytes(c: Column) -> Column:
    """C8, plain dialect: the first number, as TB or MB if the text has these, else GB."""
    n, low = F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lower(c)
    return F.floor(F.when(low.contains("tb"), n * 1024).when(low.contains("mb"), n / 1024).otherwise(n) + 0.5).cast("int")


def _bounded(size: Column, least: float, most: float) -> Column:
    return F.when(size.between(least, most), F.floor(size * 10 + 0.5) / 10)


def _number(c: Column, pattern: str) -> Column:
    return F.regexp_extract(c, pattern, 1).try_cast("double")


def display_inches(c: Column) -> Column:
    """C9, Flipkart: the inches in brackets, else the first number, over 2.54 if the
    text has cm and no inch; 6 to 15 inches, one decimal."""
    low, first = F.lower(c), _number(c, r"(\d+\.?\d*)")
    plain = F.when(low.contains("cm") & ~low.contains("inch"), first / 2.54).otherwise(first)
    return F.coalesce(_bounded(_number(c, r"(?i)\((\d+\.?\d*)\s*inch\)"), 6, 15), _bounded(plain, 6, 15))


def screen_inches(c: Column) -> Column:
    """C9, Amazon: the first number, over 2.54 if its unit is cm; 6 to 20 inches."""
    unit = F.lower(F.regexp_extract(c, r"(?i)\d+\.?\d*\s*(inch|inches|cm|centimetres?)?", 1))
    first = _number(c, r"(\d+\.?\d*)")
    return _bounded(F.when(unit.rlike("cm|centimetre"), first / 2.54).otherwise(first), 6, 20)


def connectivity_type(c: Column, breadcrumb: Column) -> Column:
    """C10, Flipkart: the named networks; else by the call facility of the fourth
    breadcrumb; else Wi-Fi alone."""
    crumb = F.lower(F.get(breadcrumb, 3))
    return (
        F.when(c.isin("Wi-Fi+5G", "Wi-Fi+4G", "Wi-Fi+3G", "Wi-Fi Only"), c)
        .when(c.isin("4G", "3G"), F.concat(F.lit("Wi-Fi+"), c))
        .when(crumb.contains("with call facility"), "Wi-Fi+Cellular")
        .otherwise("Wi-Fi Only")
    )


def connectivity_kind(c: Column) -> Column:
    """C10, Amazon: cellular or Wi-Fi where the text says so, else the text."""
    low = F.lower(c)
    return F.when(low.rlike("cellular|5g|4g"), "Wi-Fi + Cellular").when(low.rlike("wi-fi|wifi"), "Wi-Fi Only").otherwise(c)


def stock_status(c: Column) -> Column:
    """C11: from availability text; null counts as in stock."""
    low = F.lower(c)
    return (
        F.when(low.rlike("out of stock|unavailable"), "out_of_stock")
        .when(low.rlike("limited|few left"), "limited_stock")
        .when(low.rlike("pre-order|coming soon"), "pre_order")
        .otherwise("in_stock")
    )


#: Brand spellings that are standardised.
BRAND_NAMES = {
    "samsung": "Samsung", "apple": "Apple", "xiaomi": "Xiaomi", "redmi": "Redmi", "oneplus": "OnePlus", "one plus": "OnePlus", "realme": "Realme", "vivo": "Vivo",
    "oppo": "Oppo", "poco": "POCO", "tecno": "Tecno", "motorola": "Motorola", "moto": "Motorola", "nokia": "Nokia", "nothing": "Nothing",
}
#: What is no model name.
NOT_A_MODEL = ("product information", "mobile phone information", "smartphone", "mobile phone", "phone", "mobile")
#: Brands that a title may start with.
TITLE_BRANDS = (
    "Apple", "Samsung", "Redmi", "Realme", "OnePlus", "POCO", "Vivo", "Tecno", "Google", "Infinix", "Nothing", "Motorola", "Nokia", "Huawei", "Honor", "Asus", "Lenovo", "HTC", "Sony", "LG",
    "BlackBerry", "ZTE", "Alcatel", "Gionee", "Micromax", "Lava", "Intex", "Karbonn", "iBall", "Xolo", "Spice", "Videocon", "Onida", "BPL", "Godrej", "Panasonic", "Sharp", "Toshiba", "Philips",
    "Sanyo", "Hitachi", "Daewoo", "Hyundai", "Sansui", "Akai", "Bush", "Goodmans", "Grundig", "Loewe", "Metz", "Nordmende", "Telefunken", "Thomson", "Vestel", "Wharfedale", "Yamaha", "Denon",
    "Marantz", "Onkyo", "Pioneer", "Technics", "JVC", "Kenwood",
)
#: Shapes of manufacturers' numbers, in any case.
MODEL_NUMBERS = (r"[A-Z]{2,4}\d{3,4}[A-Z]*", r"[A-Z]{2,3}-[A-Z0-9]{5,}", r"[A-Z]\d{2,4}[A-Z]{0,2}", r"[A-Z]{1,2}\d{1,3}[A-Z]?", r"[A-Z]+\d+[A-Z]*")


def standard_brand(c: Column) -> Column:
    """The standard spelling; other brands stay as they are, empty ones are null."""
    names = F.create_map(*(F.lit(x) for pair in BRAND_NAMES.items() for x in pair))
    return F.nullif(F.coalesce(F.try_element_at(names, F.lower(c)), c), F.lit(""))


def clean_model(c: Column) -> Column:
    """Without bracketed parts and what follows the last comma; empty is null."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)", ""), r",[^,]*\z", " ")
    return F.nullif(squeeze(bare), F.lit(""))


def clean_model_spaced(c: Column) -> Column:
    """C12 as Croma's feed has it: a space for brackets and for what follows the last comma."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"\([^)]*\)", " "), r",[^,]*\z", " ")
    return F.nullif(squeeze(bare), F.lit(""))


def is_model_name(c: Column) -> Column:
    """Two characters or more and no general term."""
    return (F.length(squeeze(c)) >= 2) & ~F.lower(squeeze(c)).isin(*NOT_A_MODEL)


def is_model_number(c: Column) -> Column:
    """Shaped like a manufacturer's number rather than a name."""
    return squeeze(c).rlike(r"(?i)^(" + "|".join(MODEL_NUMBERS) + r")\z")


def similarity(a: Column, b: Column) -> Column:
    """C14: rounded percent of the longer length that needs no edit."""
    a, b = F.lower(squeeze(a)), F.lower(squeeze(b))
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most == 0, F.lit(100)).otherwise(F.floor((most - F.levenshtein(a, b)) / most * 100 + 0.5)).cast("int")


def without_brand(model: Column, brand: Column) -> Column:
    """The model without a leading brand in any case, spelled as it is, without
    spaces, or by its first word; a model that is nothing else stays."""

    def strip(x: Column) -> Column:
        out = F.when(x["model"].isNull() | (F.coalesce(x["brand"], F.lit("")) == ""), x["model"])
        for name in (x["brand"], F.regexp_replace(x["brand"], " ", ""), F.split(x["brand"], " ")[0]):
            rest = squeeze(F.substring(x["model"], F.length(name) + 1, F.length(x["model"])))
            out = out.when(F.lower(x["model"]).startswith(name) & (rest != ""), rest)
        return out.otherwise(x["model"])

    return let(F.struct(squeeze(model).alias("model"), F.lower(squeeze(brand)).alias("brand")), strip)


def without_5g(model: Column) -> Column:
    """The model without a final 5G."""
    return squeeze(F.regexp_replace(model, r"(?i)\s*5g\s*\z", ""))


def title_brand(title: Column) -> Column:
    """The known brand that a title starts with, as written there."""
    return F.nullif(F.regexp_extract(squeeze(title), rf"(?i)^({'|'.join(TITLE_BRANDS)})\b", 1), F.lit(""))


#: What ends a model name in a title, besides its end.
TITLE_STOPS = (r"\s+\d+(?:\.\d+)?\s*(?:GB|TB)\b", r"\s*,", r"\s+Mobile Phone\b")


def title_model(title: Column) -> Column:
    """What follows the brand up to a capacity, comma or "Mobile Phone", with
    the 5G that the title has elsewhere; null without a known brand."""
    names, fast = "|".join(TITLE_BRANDS), r"(?i)\b5G\b"
    found = F.regexp_extract(squeeze(title), rf"(?i)^(?:{names})\s+(.+?)(?={'|'.join(TITLE_STOPS)}|\z)", 1)

    def whole(model: Column) -> Column:
        model = F.when(title.rlike(fast) & ~model.rlike(fast), F.concat(model, F.lit(" 5G"))).otherwise(model)
        return squeeze(F.regexp_replace(model, r"[\s\-,:]+\z", ""))

    return let(F.nullif(found, F.lit("")), whole)


def image_url(url: Column, store: str) -> Column:
    """C17: the full-size address of a picture."""
    if store == "amazon":
        return F.regexp_replace(F.regexp_replace(url, r"_(SX|SY)\d+_", ""), r"\.{2,}", ".")
    if store == "flipkart":
        return F.regexp_replace(url, r"(?s)^(.*?)/\d+/\d+/", "$1/845/845/")
    if store == "reliance":
        return F.regexp_replace(url, r"(?s)^(.*?)resize-w:\d+", "$1original")
    return F.when(~url.contains("video_thumbnail"), url)


def image_urls(urls: Column, store: str, main: Column | None = None) -> Column:
    """C17: full-size, distinct pictures in order, but for the main one where it is
    given; of Croma no video thumbnails; null lists are empty."""
    found = F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: image_url(F.nullif(u, F.lit("")), store))
    good = F.array_distinct(F.filter(found, lambda u: u.isNotNull()))
    return good if main is None else F.filter(good, lambda u: ~u.eqNullSafe(image_url(main, store)))


def pixels_per_inch(resolution: Column, inches: Column) -> Column:
    """From "1080 x 2400" and the diagonal."""
    w = F.regexp_extract(resolution, r"(\d{3,5})\s*[x×*]\s*(\d{3,5})", 1).try_cast("double")
    h = F.regexp_extract(resolution, r"(\d{3,5})\s*[x×*]\s*(\d{3,5})", 2).try_cast("double")
    return F.when(inches > 0, F.floor(F.sqrt(w * w + h * h) / inches + 0.5).cast("int"))


def millimetres(c: Column) -> Column:
    """A length in cm or mm as mm."""
    n = F.regexp_substr(c, F.lit(r"[0-9]+(\.[0-9]+)?")).try_cast("double")
    return F.when(F.lower(c).contains("cm"), n * 10).otherwise(n)


#: Currency signs.
CURRENCY_SIGNS = {"INR": "₹", "USD": "$", "EUR": "€", "GBP": "£"}


def formatted_price(price: Column, currency: Column) -> Column:
    """Sign (or code) and the price as a number prints, without grouping."""
    signs = F.create_map(*(F.lit(x) for pair in CURRENCY_SIGNS.items() for x in pair))
    number = F.regexp_replace(F.regexp_replace(price.cast("decimal(38,10)").cast("string"), r"0+\z", ""), r"\.\z", "")
    return F.concat(F.coalesce(F.try_element_at(signs, currency), currency), number)


def total_cost(price: Column, shipping: Column) -> Column:
    """Price and shipping, where missing shipping is free."""
    return price + F.coalesce(shipping, F.lit(0))


def network_names(model: Column, title: Column, network: Column) -> Column:
    """C20: (model_name, model_name_with_5g).  A model that names 4G or 5G gives its
    form without; else title, then network field, then 5G give the form with."""
    base = clean_model_spaced(model)
    five, four = (rf"(?i)\b{n}g\b" for n in (5, 4))
    said = lambda pattern: F.coalesce(title.rlike(pattern), F.lit(False)) | F.coalesce(network.rlike(pattern), F.lit(False))
    once = lambda pattern: squeeze(F.regexp_replace(base, r"(?s)^(.*?)" + pattern.replace("(?i)", "(?i:") + ")", "$1"))
    bare = F.when(base.rlike(five), once(five)).when(base.rlike(four), once(four))
    with_ = F.when(bare.isNotNull(), base).otherwise(F.concat(base, F.when(~said(five) & said(four), " 4G").otherwise(" 5G")))
    return F.struct(F.coalesce(F.nullif(bare, F.lit("")), base).alias("model_name"), with_.alias("model_name_with_5g"))


def url_or_placeholder(url: Column, store: Column, key: Column) -> Column:
    """A stand-in address where there is none."""
    return F.coalesce(F.nullif(url, F.lit("")), F.concat(F.lit("https://"), slug(store), F.lit(".example/"), key.cast("string")))


#: The breadcrumb of smartphones.
SMARTPHONE_CRUMBS = ("Electronics", "Mobiles & Accessories", "Smartphones & Basic Mobiles", "Smartphones")


def title_breadcrumb(title: Column, breadcrumb: Column) -> Column:
    """Titles that name an iPhone 16 set the breadcrumb; null ones are empty."""
    fixed = F.array(*(F.lit(c) for c in SMARTPHONE_CRUMBS))
    return F.when(F.lower(title).rlike(r"iphone(\s*|-|_)16"), fixed).otherwise(F.coalesce(breadcrumb, F.array().cast("array<string>")))


def amazon_key(url: Column) -> Column:
    """up to /dp/ASIN."""
    return F.coalesce(F.regexp_substr(url, F.lit(r"^.*?/dp/[A-Z0-9]{10}")), url)


def _absolute(url: Column, site: str) -> Column:
    return F.when(F.lower(url).startswith("http"), url).otherwise(F.concat(F.lit(site), F.when(url.startswith("/"), "").otherwise("/"), url))


def flipkart_key(url: Column) -> Column:
    """the full address up to a pid that is its first parameter, else all of it;
    empty and null stay."""
    full = _absolute(url, "https://www.flipkart.com")
    return F.when(F.coalesce(url, F.lit("")) == "", url).otherwise(F.coalesce(F.regexp_substr(full, F.lit(r"^.*?\?pid=[^&]+")), full))


def croma_key(url: Column) -> Column:
    """lower-case host, no query, fragment or trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"/+\z", "")
    host = F.regexp_extract(bare, r"^(https?://[^/]+)", 1)
    return F.concat(F.lower(host), F.substring(bare, F.length(host) + 1, F.length(bare)))


def reliance_key(url: Column) -> Column:
    """the full address without the parameters internal and internal_*.  The
    others stay in order, as a form encodes them (name=value, + for a space); host in
    lower case; empty and null stay."""
    full = _absolute(url, "https://www.reliancedigital.in")
    host = F.regexp_extract(full, r"^([^/?#]*//[^/?#]*)", 1)
    rest = F.substring(full, F.length(host) + 1, F.length(full))
    path, query, fragment = (F.regexp_extract(rest, r"^([^?#]*)(?:\?([^#]*))?(#.*)?$", k) for k in (1, 2, 3))
    coded = lambda c: F.coalesce(F.url_encode(F.try_url_decode(c)), c)

    def pair(c: Column) -> Column:
        name, value = F.substring_index(c, "=", 1), F.regexp_extract(c, "^[^=]*=(.*)$", 1)
        return F.struct(F.coalesce(F.try_url_decode(name), name).alias("plain"), F.concat(coded(name), F.lit("="), coded(value)).alias("text"))

    pairs = F.transform(F.filter(F.split(query, "&"), lambda c: c != ""), pair)
    kept = F.filter(pairs, lambda c: (c.plain != "internal") & ~c.plain.startswith("internal_"))
    params = F.array_join(F.transform(kept, lambda c: c.text), "&")
    key = F.concat(F.lower(host), F.when(path == "", "/").otherwise(path), F.when(params != "", F.concat(F.lit("?"), params)).otherwise(""), fragment)
    return F.when(F.coalesce(url, F.lit("")) == "", url).otherwise(key)


URL_KEYS = {"amazon": amazon_key, "flipkart": flipkart_key, "croma": croma_key, "reliance": reliance_key}
