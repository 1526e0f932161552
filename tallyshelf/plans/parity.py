"""Queries of the scalar rules and feed normalisers over store-like values that are
built from the parts table; the SQL states each rule by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.operators import normalize as N
from tallyshelf.operators import resolve as R
from tallyshelf.plans.registry import query
from tallyshelf.plans.views import spread, table

#: One store-like record per part; Spark and DuckDB run the same text.
PHONES = """SELECT p_partkey AS id, p_name AS name, p_size AS size, CAST(p_retailprice AS DOUBLE) AS price,
  CASE p_partkey % 7 WHEN 0 THEN 'Samsung' WHEN 1 THEN 'OPPO' WHEN 2 THEN 'one plus' WHEN 3 THEN 'Xiaomi' WHEN 4 THEN 'Quix' WHEN 5 THEN NULL ELSE 'realme' END AS spec_brand,
  CASE p_size % 6 WHEN 0 THEN 'Redmi ' WHEN 1 THEN 'samsung ' WHEN 2 THEN 'OnePlus ' WHEN 3 THEN 'Quix ' WHEN 4 THEN 'Vivo ' ELSE 'realme ' END || p_name ||
    CASE p_partkey % 5 WHEN 0 THEN ' 128 GB, Blue' WHEN 1 THEN ' 5G' WHEN 2 THEN ' 8 GB RAM 5G' WHEN 3 THEN ', Red -' ELSE ' Mobile Phone' END AS title,
  CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' 5G' WHEN 2 THEN 'CPH' || (2000 + p_size) WHEN 3 THEN 'Samsung ' || p_name WHEN 4 THEN NULL ELSE 'sm-f' || p_size || 'bdb' END AS spec_model,
  CASE p_size % 9 WHEN 0 THEN NULL WHEN 1 THEN 'In Stock' WHEN 2 THEN 'Currently unavailable.' WHEN 3 THEN 'OUT OF STOCK' WHEN 4 THEN 'Only few left' WHEN 5 THEN 'Coming Soon'
    WHEN 6 THEN 'Pre-order' WHEN 7 THEN 'Limited offer' ELSE 'Only 2 left in stock' END AS availability,
  CASE p_size % 8 WHEN 0 THEN 'Wi-Fi+5G' WHEN 1 THEN 'Wi-Fi+4G' WHEN 2 THEN '4G' WHEN 3 THEN '3G' WHEN 4 THEN 'Wi-Fi Only' WHEN 5 THEN 'Cellular' ELSE NULL END AS network,
  CASE p_partkey % 3 WHEN 0 THEN 'Tablets with Call Facility' WHEN 1 THEN 'Tablets without Call Facility' ELSE NULL END AS crumb,
  CASE p_partkey % 5 WHEN 0 THEN (12 + p_size) || ' cm' WHEN 1 THEN (12 + p_size) || '.5 cm (' || (p_size % 20) || '.4 inch)' WHEN 2 THEN '' || (p_size % 25) WHEN 3 THEN (p_size % 25) || ' Inches' ELSE NULL END AS display,
  CASE p_partkey % 4 WHEN 0 THEN 'Jet  Black Color' WHEN 1 THEN 'Multicolor' WHEN 2 THEN 'Deep ' || p_name ELSE 'BLUE colour' END AS color,
  CASE p_partkey % 3 WHEN 0 THEN p_size || ' GB' WHEN 1 THEN (1 + p_size % 2) || ' TB' ELSE NULL END AS storage,
  'https://i.example/' || p_size || '/' || p_size || '/a/1/2/' || p_partkey || '.jpg' AS image_f,
  'https://i.example/resize-w:' || p_size || '/' || p_partkey || '/resize-w:9/x.jpg' AS image_r,
  'https://i.example/' || p_partkey || '._SX' || p_size || '_.jpg' AS image_a,
  'https://i.example/' || CASE p_size % 2 WHEN 0 THEN 'video_thumbnail' ELSE 'video' END || p_partkey || '.mp4' AS image_c
FROM {part}"""
WITH = f"WITH phones AS ({PHONES.format(part='part')})"


def phones(spark, d) -> DataFrame:
    return spark.sql(PHONES, part=spread(table(spark, d, "part")))


@query("c4_color_keys", WITH + r"SELECT id, trim(regexp_replace(regexp_replace(lower(color), '\s+color\s*$', ''), '\s+', ' ', 'g')) AS color_key FROM phones")
def color_keys(spark, d):
    return phones(spark, d).select("id", rules.color_key(F.col("color")).alias("color_key"))


INCHES = r"""SELECT id, CASE WHEN bracket BETWEEN 6 AND 15 THEN floor(bracket * 10 + 0.5) / 10 WHEN plain BETWEEN 6 AND 15 THEN floor(plain * 10 + 0.5) / 10 END AS flipkart,
  CASE WHEN free BETWEEN 6 AND 20 THEN floor(free * 10 + 0.5) / 10 END AS amazon
FROM (SELECT id, TRY_CAST(regexp_extract(display, '\((\d+\.?\d*)\s*inch\)', 1, 'i') AS DOUBLE) AS bracket, first / CASE WHEN display ILIKE '%cm%' AND NOT display ILIKE '%inch%' THEN 2.54 ELSE 1 END AS plain,
  first / CASE WHEN regexp_matches(display, '^\d+\.?\d*\s*(cm|centimet)', 'i') THEN 2.54 ELSE 1 END AS free
  FROM (SELECT id, display, TRY_CAST(regexp_extract(display, '\d+\.?\d*') AS DOUBLE) AS first FROM phones))"""


@query("c9_display_inches", WITH + INCHES)
def display_inches(spark, d):
    return phones(spark, d).select("id", rules.display_inches(F.col("display")).alias("flipkart"), rules.screen_inches(F.col("display")).alias("amazon"))


NETWORKS = """SELECT id, CASE WHEN network IN ('Wi-Fi+5G', 'Wi-Fi+4G', 'Wi-Fi Only') THEN network WHEN network = '4G' THEN 'Wi-Fi+4G' WHEN network = '3G' THEN 'Wi-Fi+3G'
  WHEN crumb = 'Tablets with Call Facility' THEN 'Wi-Fi+Cellular' ELSE 'Wi-Fi Only' END AS flipkart,
  CASE WHEN network ILIKE '%cellular%' OR network ILIKE '%5g%' OR network ILIKE '%4g%' THEN 'Wi-Fi + Cellular' WHEN network ILIKE '%wi-fi%' THEN 'Wi-Fi Only' ELSE network END AS amazon FROM phones"""


@query("c10_connectivity", WITH + NETWORKS)
def connectivity(spark, d):
    crumbs = F.array(F.lit("Home"), F.lit("Computers"), F.lit("Tablets"), F.col("crumb"))
    return phones(spark, d).select("id", rules.connectivity_type(F.col("network"), crumbs).alias("flipkart"), rules.connectivity_kind(F.col("network")).alias("amazon"))


STOCK = """CASE WHEN availability IS NULL THEN 'in_stock' WHEN lower(availability) LIKE '%out of stock%' OR lower(availability) LIKE '%unavailable%' THEN 'out_of_stock'
  WHEN lower(availability) LIKE '%limited%' OR lower(availability) LIKE '%few left%' THEN 'limited_stock' WHEN lower(availability) LIKE '%pre-order%' OR lower(availability) LIKE '%coming soon%' THEN 'pre_order' ELSE 'in_stock' END"""


@query("c11_stock_status", WITH + f"SELECT id, {STOCK} AS status FROM phones")
def stock(spark, d):
    return phones(spark, d).select("id", rules.stock_status(F.col("availability")).alias("status"))


def _brand(c: str) -> str:
    return f"CASE lower({c}) WHEN 'samsung' THEN 'Samsung' WHEN 'redmi' THEN 'Redmi' WHEN 'oneplus' THEN 'OnePlus' WHEN 'one plus' THEN 'OnePlus' WHEN 'oppo' THEN 'Oppo' WHEN 'realme' THEN 'Realme' WHEN 'vivo' THEN 'Vivo' WHEN 'xiaomi' THEN 'Xiaomi' ELSE {c} END"


def _clean(c: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace(regexp_replace({c}, '\([^)]*\)', '', 'g'), ',[^,]*$', ' '), '\s+', ' ', 'g')), '')"


@query(
    "c12_brands_and_models",
    WITH
    + f"SELECT id, {_brand('spec_brand')} AS brand, {_clean('title')} AS model, length(trim(name)) >= 2 "
    f"AND lower(trim(name)) NOT IN ('product information', 'mobile phone information', 'smartphone', 'mobile phone', 'phone', 'mobile') AS valid FROM phones",
)
def brands_and_models(spark, d):
    return phones(spark, d).select("id", rules.standard_brand(F.col("spec_brand")).alias("brand"), rules.clean_model(F.col("title")).alias("model"), rules.is_model_name(F.col("name")).alias("valid"))


def _number(c: str) -> str:
    shapes = ("[A-Z]{2,4}[0-9]{3,4}[A-Z]*", "[A-Z]{2,3}-[A-Z0-9]{5,}", "[A-Z][0-9]{2,4}[A-Z]{0,2}", "[A-Z]{1,2}[0-9]{1,3}[A-Z]?", "[A-Z]+[0-9]+[A-Z]*")
    return "(" + " OR ".join(f"regexp_matches(trim({c}), '^{s}$', 'i')" for s in shapes) + ")"


@query("c13_model_numbers", WITH + f"SELECT id, {_number('spec_model')} AS spec, {_number('name')} AS name, {_number('spec_brand || size')} AS joined FROM phones")
def model_numbers(spark, d):
    named = {"spec": F.col("spec_model"), "name": F.col("name"), "joined": F.concat("spec_brand", F.col("size").cast("string"))}
    return phones(spark, d).select("id", *(rules.is_model_number(c).alias(n) for n, c in named.items()))


TITLE_BRAND = "nullif(regexp_extract(trim(title), '^(redmi|samsung|oneplus|vivo|realme)\\b', 1, 'i'), '')"
TITLE_MODEL = r"""CASE WHEN found <> '' THEN trim(regexp_replace(CASE WHEN regexp_matches(title, '\b5G\b', 'i') AND NOT regexp_matches(found, '\b5G\b', 'i') THEN found || ' 5G' ELSE found END, '[\s\-,:]+$', '')) END"""
TITLES = WITH + rf""", found AS (SELECT *, {TITLE_BRAND} AS title_brand,
  regexp_extract(trim(title), '^(?:redmi|samsung|oneplus|vivo|realme)\s+(.+?)(?:\s+\d+(?:\.\d+)?\s*(?:GB|TB)\b|\s*,|\s+Mobile Phone\b|$)', 1, 'i') AS found FROM phones),
titles AS (SELECT *, {TITLE_MODEL} AS title_model FROM found)"""


@query("c16_titles", TITLES + " SELECT id, title_brand, title_model FROM titles")
def titles(spark, d):
    return phones(spark, d).select("id", rules.title_brand(F.col("title")).alias("title_brand"), rules.title_model(F.col("title")).alias("title_model"))


@query("c17_images", WITH + r""" SELECT id, regexp_replace(image_f, '/\d+/\d+/', '/845/845/') AS flipkart, regexp_replace(image_r, 'resize-w:\d+', 'original') AS reliance,
  regexp_replace(regexp_replace(image_a, '_(SX|SY)\d+_', '', 'g'), '\.{2,}', '.', 'g') AS amazon, CASE WHEN NOT contains(image_c, 'video_thumbnail') THEN image_c END AS croma FROM phones""")
def images(spark, d):
    return phones(spark, d).select("id", *(rules.image_url(F.col(f"image_{s[0]}"), s).alias(s) for s in ("flipkart", "reliance", "amazon", "croma")))


@query(
    "c19_prices",
    WITH
    + " SELECT id, CASE size % 3 WHEN 0 THEN '₹' WHEN 1 THEN '$' ELSE 'CHF' END || regexp_replace(CAST(price AS VARCHAR), '\\.0$', '') AS shown, price + CASE "
    "WHEN size % 4 = 0 THEN 0 ELSE size END AS total FROM phones",
)
def prices(spark, d):
    p, code = phones(spark, d), F.when(F.col("size") % 3 == 0, "INR").when(F.col("size") % 3 == 1, "USD").otherwise("CHF")
    shipping = F.when(F.col("size") % 4 != 0, F.col("size"))
    return p.select("id", rules.formatted_price(F.col("price"), code).alias("shown"), rules.total_cost(F.col("price"), shipping).alias("total"))


NAMES = rf""", named AS (SELECT *, {_clean('spec_model')} AS base, regexp_matches(spec_model, '\b5g\b', 'i') AS five FROM phones)
SELECT id, CASE WHEN five THEN trim(regexp_replace(regexp_replace(base, '\b5g\b', '', 'i'), '\s+', ' ', 'g')) ELSE base END AS model_name,
  CASE WHEN five THEN base WHEN regexp_matches(title, '\b5g\b', 'i') OR network IN ('Wi-Fi+5G') THEN base || ' 5G' WHEN network IN ('4G', 'Wi-Fi+4G') THEN base || ' 4G' ELSE base || ' 5G' END AS model_name_with_5g FROM named"""


@query("c20_network_names", WITH + NAMES)
def network_names(spark, d):
    out = phones(spark, d).select("id", rules.network_names(F.col("spec_model"), F.col("title"), F.col("network")).alias("n"))
    return out.select("id", "n.model_name", "n.model_name_with_5g")


BRACKETS = r"""SELECT id, model_name, CASE WHEN model_name LIKE '%4G' THEN model_name ELSE model_name || ' 5G' END AS model_name_with_5g FROM (
  SELECT id, CASE id % 3 WHEN 0 THEN 'Galaxy ' || size || ' A' WHEN 1 THEN 'Note Pro' ELSE 'Y' || size || ' Lite' END AS model_name FROM phones)"""


@query("c20_bracketed_names", WITH + BRACKETS)
def bracketed_names(spark, d):
    """Names with brackets inside a word and after a comma."""
    model = F.expr("CASE id % 3 WHEN 0 THEN concat('Galaxy ', size, '(2024)A') WHEN 1 THEN 'Note(8 GB) (Blue)Pro, 128 GB' ELSE concat(' Y', size, ' Lite,') END")
    out = phones(spark, d).select("id", rules.network_names(model, F.lit("x"), F.lit(None).cast("string")).alias("n"))
    return out.select("id", "n.model_name", "n.model_name_with_5g")


@query("c22_breadcrumbs", WITH + " SELECT id, CASE WHEN size % 4 < 3 THEN 'Electronics>Mobiles & Accessories>Smartphones & Basic Mobiles>Smartphones' ELSE 'Home>' || name END AS crumbs FROM phones")
def title_breadcrumbs(spark, d):
    kind = F.element_at(F.array(*(F.lit(x) for x in ("iPhone 16 Pro", "Apple iphone-16", "IPHONE_16e", "iPhone 15"))), (F.col("size") % 4 + 1).cast("int"))
    crumbs = rules.title_breadcrumb(kind, F.array(F.lit("Home"), F.col("name")))
    return phones(spark, d).select("id", F.array_join(crumbs, ">").alias("crumbs"))


def _alike(a: str, b: str) -> str:
    most = f"greatest(length(trim({a})), length(trim({b})))"
    return f"floor(({most} - levenshtein(lower(trim({a})), lower(trim({b})))) / {most} * 100 + 0.5)"


def _bare(model: str) -> str:
    strip = " ".join(f"WHEN starts_with(lower({model}), {b}) AND trim(substr({model}, length({b}) + 1)) <> '' THEN trim(substr({model}, length({b}) + 1))" for b in ("lower(brand)", "replace(lower(brand), ' ', '')", "split_part(lower(brand), ' ', 1)"))
    return rf"trim(regexp_replace(CASE WHEN brand IS NULL THEN {model} {strip} ELSE {model} END, '\s*5g\s*$', '', 'i'))"


def _worth(c: str) -> str:
    return f"(len(string_split_regex({c}, '\\s+')) * 10 + length({c}))"


RECONCILED = TITLES + f""", sides AS (SELECT id, {_brand('spec_brand')} AS sb, {_brand('title_brand')} AS tb, {_clean('spec_model')} AS sm, {_clean('title_model')} AS tm FROM titles),
branded AS (SELECT *, CASE WHEN tb IS NULL THEN sb WHEN sb IS NULL OR tb IN ('Redmi', 'POCO') THEN tb WHEN {_alike('sb', 'tb')} >= 90 AND length(sb) >= length(tb) THEN sb ELSE tb END AS brand,
  coalesce(tb NOT IN ('Redmi', 'POCO') AND {_alike('sb', 'tb')} < 90, false) AS apart, CASE WHEN {_number('sm')} THEN sm END AS number FROM sides),
compared AS (SELECT *, number IS NULL AND sm IS NOT NULL AND tm IS NOT NULL AS pair, {_alike(_bare('sm'), _bare('tm'))} >= 90 AS near FROM branded)
SELECT id, brand, CASE WHEN tm IS NULL THEN sm WHEN pair AND near AND {_worth('sm')} >= {_worth('tm')} THEN sm ELSE tm END AS model_name, number AS model_number, apart OR (pair AND NOT near) AS needs_manual_review FROM compared"""


@query("e8_reconcile_identifiers", RECONCILED)
def reconcile(spark, d):
    sided = phones(spark, d).withColumns({"title_brand": rules.title_brand(F.col("title")), "title_model": rules.title_model(F.col("title"))})
    return R.reconcile_identifiers(sided).select("id", "brand", "model_name", "model_number", "needs_manual_review")


# Feed normalisers over records of the stores' shapes.


def _map(*pairs) -> F.Column:
    return F.create_map(*(x if not isinstance(x, str) else F.lit(x) for pair in pairs for x in pair))


def _flat(out: DataFrame, *more: str) -> DataFrame:
    kept = ["product_identifiers.brand", "product_identifiers.model_name", "product_identifiers.model_number", "category", "variant_attributes.color", "variant_attributes.ram", "variant_attributes.storage", "listing_info.price.current", "listing_info.price.original", "listing_info.price.discount_percent", "listing_info.image_url"]
    return out.select(F.col("source_details.url").alias("url"), *kept, F.size("listing_info.image_urls").alias("images"), *more)


PRICED = "CAST(floor(price) AS INTEGER) AS current, CAST(floor(price) AS INTEGER) + size AS original"
OFF = "CAST(floor(size / CAST(floor(price) + size AS DOUBLE) * 100 + 0.5) AS INTEGER)"


@query("n3_flipkart_phones", WITH + rf""" SELECT 'u/' || id AS url, coalesce(nullif(CASE id % 2 WHEN 0 THEN 'vivo' ELSE '' END, ''), CASE size % 6 WHEN 0 THEN 'Xiaomi' WHEN 1 THEN 'Samsung' WHEN 2 THEN 'OnePlus' WHEN 4 THEN 'Vivo' WHEN 5 THEN 'Realme' END) AS brand,
  coalesce(spec_model, CASE WHEN size % 6 IN (0, 3) THEN NULL ELSE trim(substr(title, instr(title, ' ') + 1)) END) AS model_name, 'n' || id AS model_number, CASE size % 2 WHEN 0 THEN 'Smartphones' ELSE 'Feature Phones' END AS category,
  trim(regexp_replace(color, '\s+', ' ', 'g')) AS color, size AS ram, CASE WHEN storage LIKE '%GB' THEN size END AS storage, {PRICED}, size % 50 AS discount_percent, regexp_replace(image_f, '/\d+/\d+/', '/845/845/') AS image_url, 1 AS images FROM phones""")
def flipkart_phones(spark, d):
    p = phones(spark, d)
    specs = _map(("General", _map(("Model Name", F.col("spec_model")), ("Color", F.col("color")), ("Model Number", F.concat(F.lit("n"), "id")), ("Smartphone", F.when(F.col("size") % 2 == 0, "Yes").otherwise("No")))),
                 ("Memory & Storage Features", _map(("RAM", F.concat("size", F.lit(" GB"))), ("Internal Storage", F.col("storage")))))
    crumbs = F.array(F.lit("Home"), F.lit("x"), F.lit("y"), F.when(F.col("id") % 2 == 0, "vivo Mobiles").otherwise(""))
    price = F.struct(F.floor("price").cast("int").alias("current"), (F.floor("price").cast("int") + F.col("size")).alias("original"), F.concat(F.col("size") % 50, F.lit("% off")).alias("discount"))
    rating = F.struct(F.lit(4.5).alias("score"), F.lit(7).alias("count"))
    feed = p.select(F.concat(F.lit("u/"), "id").alias("url"), "title", price.alias("price"), rating.alias("rating"), "availability", specs.alias("specifications"), crumbs.alias("category"), F.col("image_f").alias("image"), F.array("image_f", "image_a", "image_a").alias("images"))
    return _flat(N.normalize_flipkart_phones(feed))


#: Titles of tablets, of whose parts the model name is what name stands for.
TABLET_TITLE = """CASE size % 6 WHEN 0 THEN 'Lenovo ' || name || ' Tab (2nd Gen) 8 GB RAM' WHEN 1 THEN 'samsung ' || name || ' (Grey)' WHEN 2 THEN 'Apple ' || name || ' 8 GB RAM 128 GB ROM 10.1 inch'
  WHEN 3 THEN 'Quix ' || name || ' 10.5 inch Wi-Fi Only' WHEN 4 THEN 'MI ' || name || ' iPad (Blue)' ELSE 'vivo ' || name || ' wi-fi  only (x)' END"""


@query("n4_flipkart_tablets", WITH + rf""" SELECT 'u/' || id AS url, CASE WHEN size % 6 = 2 THEN 'Apple' WHEN id % 2 = 0 THEN 'Lenovo' ELSE upper(t[1]) || lower(substr(split_part(t, ' ', 1), 2)) END AS brand,
  coalesce(spec_model, CASE WHEN size % 6 = 3 THEN 'Quix ' || name ELSE name END) AS model_name, 'n' || id AS model_number, 'Tablets' AS category,
  trim(regexp_replace(color, '\s+', ' ', 'g')) AS color, nullif(size % 9, 0) AS ram, CASE WHEN storage LIKE '%TB' THEN (1 + size % 2) * 1024 WHEN storage LIKE '%GB' THEN size WHEN size % 6 = 2 THEN 128 END AS storage, {PRICED}, size % 50 AS discount_percent,
  regexp_replace(image_f, '/\d+/\d+/', '/845/845/') AS image_url, 0 AS images, i.flipkart AS display_size, n.flipkart AS connectivity_type FROM (SELECT *, {TABLET_TITLE} AS t FROM phones) JOIN ({INCHES}) i USING (id) JOIN ({NETWORKS.replace("WHEN crumb = 'Tablets with Call Facility' THEN 'Wi-Fi+Cellular' ", "")}) n USING (id) WHERE id % 4 < 3""")
def flipkart_tablets(spark, d):
    p = phones(spark, d).withColumn("title", F.expr(TABLET_TITLE))
    specs = _map(("General", _map(("Model Name", F.col("spec_model")), ("Color", F.col("color")), ("Model Number", F.concat(F.lit("n"), "id")), ("RAM", F.concat(F.col("size") % 9, F.lit(".0 GB"))), ("Connectivity", F.col("network")))),
                 ("Product Details", _map(("Internal Storage", F.col("storage")), ("Display Size", F.col("display")))))
    crumbs = F.array(F.lit("Home"), F.lit("x"), F.when(F.col("id") % 4 < 3, "Tablets"), F.when(F.col("id") % 2 == 0, "Lenovo Tablets").otherwise("All Tablets of stores"))
    price = F.struct(F.floor("price").cast("int").alias("current"), (F.floor("price").cast("int") + F.col("size")).alias("original"), F.concat(F.col("size") % 50, F.lit("% off")).alias("discount"))
    rating = F.struct(F.lit(4.5).alias("score"), F.lit(7).alias("count"))
    feed = p.select(F.concat(F.lit("u/"), "id").alias("url"), "title", price.alias("price"), rating.alias("rating"), "availability", specs.alias("specifications"), crumbs.alias("category"), F.col("image_f").alias("image"), F.array("image_f").alias("images"))
    return _flat(N.normalize_flipkart_tablets(feed), "variant_attributes.display_size", "variant_attributes.connectivity_type")


@query("a14_attribute_completion", WITH + " SELECT count(*) AS total_products, count(*) FILTER (spec_brand IS NOT NULL AND spec_model IS NOT NULL) AS products_with_attributes, floor(count(*) FILTER (spec_brand IS NOT NULL AND spec_model IS NOT NULL) * 10000 / count(*) + 0.5) / 100 AS completion_pct FROM phones")
def attribute_completion(spark, d):
    return R.attribute_completion(phones(spark, d).select(F.col("spec_brand").alias("brand"), F.col("spec_model").alias("model_name")))


@query("a14_unknown_brands", WITH + " SELECT 'brand' AS kind, coalesce(spec_brand, 'unknown') AS name, count(*) AS n FROM phones GROUP BY ALL UNION ALL SELECT 'category', coalesce(crumb, 'unknown'), count(*) FROM phones GROUP BY ALL")
def unknown_brands(spark, d):
    return R.processing_stats(phones(spark, d).select(F.col("spec_brand").alias("brand"), F.col("crumb").alias("category")))


@query("n5_croma", WITH + rf""" SELECT 'u/' || id AS url, spec_brand AS brand, spec_model AS model_name, 'n' || id AS model_number, CAST(NULL AS VARCHAR) AS category, trim(regexp_replace(color, '\s+', ' ', 'g')) AS color, size AS ram,
  CASE WHEN storage LIKE '%TB' THEN (1 + size % 2) * 1024 WHEN storage LIKE '%GB' THEN size END AS storage, {PRICED}, {OFF} AS discount_percent, CASE WHEN size % 2 = 1 THEN image_c END AS image_url, CAST(size % 2 AS INTEGER) + 1 AS images FROM phones""")
def croma(spark, d):
    p = phones(spark, d)
    specs = _map(("Manufacturer Details", _map(("Brand", F.concat("spec_brand", F.lit(" | x"))), ("Model Series", F.col("spec_model")), ("Model Number", F.concat(F.lit("n"), "id")))),
                 ("Aesthetics", _map(("Color", F.lit("PLAIN")), ("Brand Color", F.col("color")))), ("Storage Specifications", _map(("RAM", F.concat("size", F.lit("GB"))), ("Internal Storage", F.col("storage")))))
    rupees = lambda c: F.concat(F.lit("₹"), c.cast("int").cast("string"), F.lit(".00"))
    price = F.struct(rupees(F.floor("price")).alias("current"), rupees(F.floor("price") + F.col("size")).alias("original"), F.lit(None).cast("string").alias("discount"))
    rating = F.struct(F.lit("Not Available").alias("star"), F.lit("1,204").alias("rating"), F.lit(None).cast("string").alias("reviews"))
    feed = p.select(F.concat(F.lit("u/"), "id").alias("url"), "title", price.alias("price"), rating.alias("rating"), F.col("image_c").alias("image"), F.array("image_c", "image_c", "image_f").alias("allImages"), specs.alias("specifications"), F.lit("2024-05-01T10:00:00Z").alias("extractedAt"))
    return _flat(N.normalize_croma(feed))


@query("n6_reliance", RECONCILED.replace("SELECT id, brand, CASE WHEN tm IS NULL", ", settled AS (SELECT id, brand, CASE WHEN tm IS NULL") + rf""")
SELECT 'u/' || s.id AS url, s.brand, CASE WHEN starts_with(lower(s.model_name), lower(s.brand)) AND trim(substr(s.model_name, length(s.brand) + 1)) <> '' THEN trim(substr(s.model_name, length(s.brand) + 1)) ELSE s.model_name END AS model_name, s.model_number,
  CAST(NULL AS VARCHAR) AS category, trim(regexp_replace(color, '\s+', ' ', 'g')) AS color, size AS ram, CASE WHEN storage LIKE '%TB' THEN (1 + size % 2) * 1024 WHEN storage LIKE '%GB' THEN size WHEN id % 5 = 0 THEN 128 END AS storage,
  {PRICED}, CASE WHEN size > 0 THEN {OFF} END AS discount_percent, regexp_replace(image_r, 'resize-w:\d+', 'original') AS image_url, 1 AS images, s.needs_manual_review FROM settled s JOIN phones USING (id)""")
def reliance(spark, d):
    p = phones(spark, d)
    specs = _map(("General", _map(("Brand", F.col("spec_brand")), ("Model", F.lit("Mobile Phone")), ("Color", F.col("color")))), ("More", _map(("Model Name", F.col("spec_model")), ("RAM", F.concat("size", F.lit(" GB"))), ("Internal Storage", F.col("storage")))))
    rupees = lambda c: F.concat(F.lit("MRP ₹"), c.cast("int").cast("string"), F.lit(".00"))
    price = F.struct(rupees(F.floor("price")).alias("price"), rupees(F.floor("price") + F.col("size")).alias("originalPrice"))
    rating, image = F.struct(F.lit(4.5).alias("rating"), F.lit(7).alias("ratingCount")), F.struct(F.col("image_r").alias("mainImage"), F.array("image_r", "image_f", "image_f").alias("allImages"))
    feed = p.select(F.concat(F.lit("u/"), "id").alias("url"), "title", price.alias("price"), rating.alias("rating"), image.alias("image"), "availability", specs.alias("specifications"), F.lit("2024-05-01T10:00:00Z").alias("extractedAt"))
    return _flat(N.normalize_reliance(feed), "product_identifiers.needs_manual_review")


def _amazon_feed(p: DataFrame) -> DataFrame:
    details = F.struct(F.col("network").alias("Connectivity Type"), F.concat(F.lit("n"), "id").alias("Item model number"), F.lit("0.9 x 7.8 x 16.9 cm; 195 g").alias("Product Dimensions"), F.lit("1000 x 2000").alias("Resolution"))
    sizes = F.struct(F.concat("size", F.lit(" inches")).alias("display size"))
    specs = F.to_json(F.struct(F.col("spec_brand").alias("Brand"), F.col("display").alias("Screen Size"), F.struct(details.alias("technicalDetails")).alias("Technical Details"), F.struct(sizes.alias("productDetails")).alias("Product Details")))
    price = F.struct(F.concat(F.lit("₹"), F.floor("price").cast("int").cast("string"), F.lit(".50")).alias("current"), F.concat(F.lit("₹"), (F.floor("price").cast("int") + F.col("size")).cast("string")).alias("original"), F.concat(F.lit("-"), F.col("size") % 50, F.lit("%")).alias("discount"))
    rating = F.struct(F.lit(4.5).alias("value"), F.lit(7).alias("count"))
    crumbs = F.array(F.lit("Home"), F.when(F.col("id") % 3 > 0, "Tablets"), F.lit("x"), F.col("name"))
    return p.select(F.concat(F.lit("u/"), "id").alias("url"), "title", price.alias("price"), rating.alias("rating"), F.col("image_a").alias("image"), "availability", specs.alias("specifications"), crumbs.alias("categories"), F.lit("2024-05-01T10:00:00Z").alias("extractedAt"))


def _amazon_attributes(p: DataFrame) -> DataFrame:
    known = p.filter("id % 2 = 0")
    return known.select(F.concat(F.lit("u/"), "id").alias("url"), F.concat(F.lit("B"), "size").alias("brand_name"), F.col("name").alias("model_name"), F.lit("Red").alias("color"), F.col("size").cast("int").alias("ram"), F.lit(256).alias("storage"), F.lit(None).cast("double").alias("display_size"), F.lit(None).cast("string").alias("connectivity_type"), (F.col("id") % 10 == 4).alias("not_tablet"))


@query("n1_amazon_phones", WITH + rf""" SELECT 'u/' || id AS url, CASE WHEN id % 2 = 0 THEN 'B' || size END AS brand, CASE WHEN id % 2 = 0 THEN name END AS model_name, 'n' || id AS model_number, name AS category, CASE WHEN id % 2 = 0 THEN 'Red' END AS color,
  CASE WHEN id % 2 = 0 THEN size END AS ram, CASE WHEN id % 2 = 0 THEN 256 END AS storage, {PRICED}, size % 50 AS discount_percent, replace(image_a, '._SX' || size || '_.', '.') AS image_url,
  CASE WHEN size > 0 THEN CAST(floor(sqrt(5000000.0) / size + 0.5) AS INTEGER) END AS ppi, 9.0E0 AS depth_mm, 195.0E0 AS weight_g FROM phones""")
def amazon_phones(spark, d):
    p = phones(spark, d)
    out = N.normalize_amazon_phones(_amazon_feed(p), _amazon_attributes(p))
    return _flat(out, "key_specifications.display.ppi", "key_specifications.design.depth_mm", "key_specifications.design.weight_g").drop("images")


@query("n2_amazon_tablets", WITH + rf""" SELECT 'u/' || id AS url, coalesce(spec_brand, CASE WHEN id % 2 = 0 THEN 'B' || size END, CASE size % 6 WHEN 1 THEN 'Samsung' WHEN 2 THEN 'Oneplus' END) AS brand, CASE WHEN id % 2 = 0 THEN name END AS model_name, 'n' || id AS model_number, 'Tablets' AS category,
  CASE WHEN id % 2 = 0 THEN 'Red' END AS color, CASE WHEN id % 2 = 0 THEN size WHEN id % 5 = 2 THEN 8 END AS ram, CASE WHEN id % 2 = 0 THEN 256 END AS storage, {PRICED}, size % 50 AS discount_percent, replace(image_a, '._SX' || size || '_.', '.') AS image_url,
  i.amazon AS display_size, n.amazon AS connectivity_type FROM phones JOIN ({INCHES}) i USING (id) JOIN ({NETWORKS}) n USING (id) WHERE id % 3 > 0 AND id % 10 <> 4""")
def amazon_tablets(spark, d):
    p = phones(spark, d)
    out = N.normalize_amazon_tablets(_amazon_feed(p), _amazon_attributes(p))
    return _flat(out, "variant_attributes.display_size", "variant_attributes.connectivity_type").drop("images")
