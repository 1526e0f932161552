"""Questions to the catalog: offers, comparisons, summaries, facets, search.

Offers are frames with offer_id, product_id, store_name, price, original_price,
stock_status, is_active and last_seen; products have product_id, brand,
model_name and category.  Null prices never win a ranking; ties end on offer_id
or another unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.functions.rules import discount_2, network_key
from tallyshelf.operators.hierarchy import breadcrumbs, closure as category_closure  # noqa: F401
from tallyshelf.operators.slices import tasks, with_lookback
from tallyshelf.operators.trigrams import trigrams
from tallyshelf.scratch import stage

AVAILABLE = ("in_stock", "limited_stock")


def price():
    return F.col("price").cast("double")


def mean(c: str):
    """An average that doesn't depend on the order of addition: an exact decimal sum over the count."""
    return F.sum(c).cast("double") / F.count(c)


def available_offers(offers: DataFrame) -> DataFrame:
    """F3."""
    return offers.filter(F.col("is_active") & F.col("stock_status").isin(*AVAILABLE))


def good_deals(offers: DataFrame, threshold: float = 20) -> DataFrame:
    """offers discounted by the threshold or more."""
    return offers.withColumn("discount", discount_2(F.col("price"), F.col("original_price"))).filter(F.col("discount") >= threshold)


def filter_catalog(products: DataFrame, **wanted) -> DataFrame:
    """any of min_price, max_price, brands, categories, min_ram, max_ram."""
    tests = {"min_price": lambda v: F.col("list_price") >= v, "max_price": lambda v: F.col("list_price") <= v, "brands": lambda v: F.col("brand").isin(*v), "categories": lambda v: F.col("category").isin(*v), "min_ram": lambda v: F.col("ram_gb") >= v, "max_ram": lambda v: F.col("ram_gb") <= v}
    for name, value in wanted.items():
        products = products.filter(tests[name](value))
    return products


def best_offers(offers: DataFrame, limit: int = 5) -> DataFrame:
    """The cheapest available offers of each product."""
    w = W.partitionBy("product_id").orderBy("price", "store_name", "offer_id", "last_seen")
    return available_offers(offers).filter("price is not null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def price_comparison(offers: DataFrame) -> DataFrame:
    """Active offers by price with rank and the gap to the best."""
    w = W.partitionBy("product_id")
    return offers.filter("is_active and price is not null").withColumns({"rank": F.rank().over(w.orderBy("price")), "gap": F.col("price") - F.min("price").over(w)})


def _changes(seen: DataFrame, keys: list[str], when: str, tie: str, slices: int | None = None) -> DataFrame:
    """Observations with _slice whose price differs from old_price, the one before."""
    order = [when, tie, "price"]
    w = W.partitionBy("_slice", *keys).orderBy(*order)
    rows = with_lookback(seen, keys, order, 1, slices).withColumn("old_price", F.lag("price").over(w))
    return rows.filter(~F.col("_ghost") & (F.col("old_price") != F.col("price"))).drop("_ghost")


def price_changes(seen: DataFrame, keys: list[str], when: str, tie: str = "offer_id") -> DataFrame:
    """Observations whose price differs from the one before."""
    return _changes(seen, keys, when, tie).drop("_slice")


def price_history(seen: DataFrame, keys: list[str], when: str, tie: str = "offer_id", max_points: int = 30) -> DataFrame:
    """The prices before each change, the last max_points, oldest first.  The last
    of each slice of a key meet the key's others, in as many tasks as their rows ask for."""
    order = F.desc(when), F.desc(tie), F.desc("price")
    nth = lambda df, *group: df.withColumn("nth", F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col("nth") <= max_points)
    n = tasks(seen)
    last = nth(nth(_changes(seen, keys, when, tie, n), "_slice", *keys).select(*keys, when, tie, "price", "old_price").repartition(n, *keys), *keys)
    points = F.sort_array(F.collect_list(F.struct((-F.col("nth")).alias("place"), F.col("old_price").alias("price"), F.col(when).alias("date"))))
    return last.groupBy(*keys).agg(points.alias("points")).withColumn("points", F.transform("points", lambda p: F.struct(p.price.alias("price"), p.date.alias("date"))))


def price_trend(seen: DataFrame, keys: list[str], when: str, tie: str = "offer_id", rows: int = 3) -> DataFrame:
    """Moving average over the last rows observations and its direction."""
    sort = [when, tie, "price"]
    order = W.partitionBy("_slice", *keys).orderBy(*sort)
    near = order.rowsBetween(-(rows - 1), 0)
    average = F.sum("price").over(near).cast("double") / F.count("price").over(near)
    out = with_lookback(seen, keys, sort, rows).withColumn("moving_avg", average)
    before = F.lag("moving_avg").over(order)
    out = out.withColumn("direction", F.when(before.isNull() | (F.col("moving_avg") == before), "flat").when(F.col("moving_avg") > before, "up").otherwise("down"))
    return out.filter("not _ghost").drop("_slice", "_ghost")


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an explicit order."""
    return df.withColumn("_nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_nth = 1").drop("_nth")


def relabel_main_image(variants: DataFrame, gallery: str = "other") -> DataFrame:
    """Images (array of url and type) with one main: the first main, else the
    first of all; further mains become gallery images."""
    at = F.array_position(F.transform("images", lambda i: i.type == "main"), True)
    main = F.when(at > 0, at - 1).otherwise(0)
    label = lambda i, k: F.struct(i.url.alias("url"), F.when(k == main, "main").when(i.type == "main", gallery).otherwise(F.coalesce(i.type, F.lit(gallery))).alias("type"))
    return variants.withColumn("images", F.transform("images", label))


def product_detail(products: DataFrame, offers: DataFrame, brands: DataFrame | None = None, categories: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
    """Products with slug, brand and category names, variants and offers, those
    without variants or offers kept; position is an offer's place by price in its
    product.  brands (brand_id, brand_name) and categories (category_id,
    category_name) are joined by id; offers by variant_id where variants are given.
    """
    out = products if "slug" in products.columns else products.withColumn("slug", rules.product_slug(F.concat_ws(" ", "brand", "model_name")))
    if brands is not None:
        out = out.join(brands, "brand_id")
    if categories is not None:
        out = out.join(categories, "category_id")
    key = "product_id"
    if variants is not None:
        out, key = out.join(variants, "product_id", "left"), "variant_id"
    order = W.partitionBy("product_id").orderBy(F.asc_nulls_last("price"), "store_name", "offer_id")
    return out.join(offers.select(key, "offer_id", "store_name", "price", "stock_status"), key, "left").withColumn("position", F.row_number().over(order))


def offers_by_store(offers: DataFrame, products: DataFrame, store: str, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of a store's active offers by price, with the total count; only
    the page's rows meet their products."""
    mine = offers.filter(F.col("is_active") & (F.col("store_name") == store))
    return paginate(mine, page, limit, ["price", "offer_id", "product_id", "last_seen"]).join(products, "product_id", "left")


def paginate(df: DataFrame, page: int, limit: int, order: list[str]) -> DataFrame:
    """L1: rows of a page, each with total, the count over all pages."""
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit)
    return rows.withColumn("total", df.agg(F.count("*")).scalar())


def next_page(df: DataFrame, key: str, after, limit: int) -> DataFrame:
    """L1, keyset form for deep pages: the rows after a unique key."""
    return df.filter(F.col(key) > after).orderBy(key).limit(limit)


def sort_products(products: DataFrame, by: str, offers: DataFrame | None = None, descending: bool | None = None) -> DataFrame:
    """L2: all products with position from 1, by price (list_price, lowest first),
    rating (highest first), popularity (offers, most first) or date (last_seen of the
    offers, newest first); nulls last, ties by product_id.

    The sorted rows are written; positions are places in a partition plus the
    rows of the partitions before it.
    """
    if by == "price":
        keyed, key, down = products, "list_price", False
    elif by == "rating":
        keyed, key, down = products, by, True
    elif by in ("popularity", "date"):
        value = F.count("*").alias("popularity") if by == "popularity" else F.max("last_seen").alias("date")
        keyed, key, down = products.join(offers.groupBy("product_id").agg(value), "product_id", "left"), by, True
        if by == "popularity":
            keyed = keyed.withColumn(key, F.coalesce(key, F.lit(0)))
    else:
        raise ValueError(f"no order {by!r}")
    down = down if descending is None else descending
    order = F.desc_nulls_last(key) if down else F.asc_nulls_last(key)
    rows = stage(keyed.orderBy(order, "product_id").withColumn("_id", F.monotonically_increasing_id()), "sorted-products")
    rows = rows.withColumn("_part", F.shiftright("_id", 33))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(parts), "_part").withColumn("position", place).drop("_id", "_part", "_before")


def stale_offers(offers: DataFrame, products: DataFrame, as_of, days: int) -> DataFrame:
    """Active offers not seen for days before as_of, with their product."""
    return offers.filter(F.col("is_active") & (F.col("last_seen") < F.date_sub(as_of, days))).join(products, "product_id", "left")


def deactivate_stale(offers: DataFrame, as_of, days: int = 7) -> DataFrame:
    """T5: active offers not seen since the cut-off become inactive."""
    return offers.withColumn("is_active", F.col("is_active") & ~(F.col("last_seen") < F.date_sub(as_of, days)))


def variant_names(products: DataFrame) -> DataFrame:
    """Display name from brand, model and what is known of the variant."""
    ram = F.when(F.col("ram_gb").isNotNull(), F.concat(F.col("ram_gb").cast("string"), F.lit("GB RAM")))
    return products.withColumn("display_name", F.concat_ws(" ", "brand", "model_name", ram))


def tablet_variant_names(tablets: DataFrame) -> DataFrame:
    """J4 for tablets: brand, model, storage (whole TB from 1,024 GB on), display size,
    connectivity and colour, as far as they are known; zero and empty are not."""
    text = lambda c: F.nullif(F.regexp_replace(F.col(c).cast("string"), r"\.0\z", ""), F.lit(""))
    gb, size = F.nullif(F.col("storage_gb"), F.lit(0)), F.nullif(text("display_size"), F.lit("0"))
    storage = F.when(gb >= 1024, F.concat(F.floor(gb / 1024 + 0.5).cast("string"), F.lit(" TB ROM"))).otherwise(F.concat(text("storage_gb"), F.lit(" GB ROM")))
    parts = [F.when(gb.isNotNull(), storage), F.concat(size, F.lit(" Inch")), F.concat(F.lit("with "), text("connectivity_type")), F.concat(F.lit("("), text("color"), F.lit(")"))]
    return tablets.withColumn("display_name", F.concat_ws(" ", "brand", "model_name", *parts))


def match_attributes(variants: DataFrame, wanted: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Variants that equal a wanted row in key and every attribute, null as null."""
    v, w = variants.alias("v"), wanted.alias("w")
    on = F.col(f"v.{key}") == F.col(f"w.{key}")
    for a in attributes:
        on = on & F.col(f"v.{a}").eqNullSafe(F.col(f"w.{a}"))
    return v.join(w, on, "left_semi")


def models_in_both(a: DataFrame, b: DataFrame, name: str = "model_name") -> DataFrame:
    """J7, U2."""
    return a.select(name).filter(F.col(name).isNotNull()).intersect(b.select(name))


def models_only_in(a: DataFrame, b: DataFrame, name: str = "model_name") -> DataFrame:
    """J8, U3."""
    return a.select(name).filter(F.col(name).isNotNull()).subtract(b.select(name))


def all_models(*feeds: DataFrame, name: str = "model_name") -> DataFrame:
    """U1."""
    out = feeds[0].select(name)
    for f in feeds[1:]:
        out = out.union(f.select(name))
    return out.filter(F.col(name).isNotNull()).distinct()


def compare_specs(items: DataFrame, ids: list, specs: list[str], key: str = "product_id", offers: DataFrame | None = None) -> DataFrame:
    """One row per spec, one column per chosen item; with offers also their
    lowest and highest price."""
    chosen = items.filter(F.col(key).isin(*ids))
    if offers is not None:
        prices = offers.filter(F.col(key).isin(*ids)).groupBy(key).agg(F.min(price()).alias("min_price"), F.max(price()).alias("max_price"))
        chosen, specs = chosen.join(prices, key, "left"), [*specs, "min_price", "max_price"]
    rows = chosen.select(key, F.explode(F.create_map(*(x for s in specs for x in (F.lit(s), F.col(s).cast("string"))))).alias("spec", "value"))
    return rows.groupBy("spec").pivot(key, ids).agg(F.first("value")).select("spec", *(F.col(str(i)).alias(f"item_{i}") for i in ids))


def brand_summary(products: DataFrame, offers: DataFrame) -> DataFrame:
    """A1: products and offer prices per brand; brands without offers kept.  Offers
    are summed by product before they meet the products (one row each)."""
    per = offers.groupBy("product_id").agg(F.min(price()).alias("low"), F.max(price()).alias("high"), F.sum("price").alias("total"), F.count("price").alias("n"))
    joined = products.select("product_id", "brand").join(per, "product_id", "left")
    average = F.sum("total").cast("double") / F.nullif(F.sum("n"), F.lit(0))
    return joined.groupBy("brand").agg(F.count("*").alias("products"), F.min("low").alias("min_price"), F.max("high").alias("max_price"), average.alias("avg_price"))


def top_stores(offers: DataFrame, limit: int = 10) -> DataFrame:
    """A2."""
    out = offers.filter("is_active").groupBy("store_name").agg(F.count("*").alias("offers"), mean("price").alias("avg_price"), F.min(price()).alias("min_price"), F.max(price()).alias("max_price"))
    return out.orderBy(F.desc("offers"), "store_name").limit(limit)


def refresh_price_stats(products: DataFrame, offers: DataFrame) -> DataFrame:
    """A3: products with the price range of their offers."""
    stats = offers.groupBy("product_id").agg(F.min(price()).alias("min_price"), F.max(price()).alias("max_price"), mean("price").alias("avg_price"))
    return products.join(stats, "product_id", "left")


def refresh_counts(products: DataFrame, offers: DataFrame) -> DataFrame:
    """A4: active offers per product, none as 0."""
    n = offers.filter("is_active").groupBy("product_id").agg(F.count("*").alias("active_offers"))
    return products.join(n, "product_id", "left").withColumn("active_offers", F.coalesce("active_offers", F.lit(0)))


#: Fixed value: rows of offers that a task takes, however many there are.
TASK_ROWS = 1_000_000


def sightings(products: DataFrame, offers: DataFrame) -> DataFrame:
    """brand, name_key, store_name, product_id of every offer: input of A5 to A8.  Offers
    are dealt by product to as many tasks as their rows ask for."""
    named = products.select("product_id", "brand", network_key(F.col("model_name")).alias("name_key"))
    tasks = max(int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-offers.count() // TASK_ROWS))
    return offers.select("product_id", "store_name").repartition(tasks, "product_id").distinct().join(named, "product_id")


def _stores(seen: DataFrame) -> DataFrame:
    """brand, name_key, a, b: the first and last store of each model, first by product,
    where a product's rows already lie together."""
    per = seen.groupBy("product_id", "brand", "name_key").agg(F.min("store_name").alias("a"), F.max("store_name").alias("b"))
    return per.groupBy("brand", "name_key").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def cross_store_coverage(seen: DataFrame) -> DataFrame:
    """A5: models in several stores, in one, all, and the share in several."""
    out = _stores(seen).agg(F.count_if(F.col("a") != F.col("b")).alias("common"), F.count_if(F.col("a") == F.col("b")).alias("single"), F.count("*").alias("total"))
    return out.withColumn("coverage_pct", F.floor(F.col("common") * 10000 / F.col("total") + 0.5) / 100)


def store_exclusives(seen: DataFrame) -> DataFrame:
    """Models that only one store has, per store."""
    one = seen.groupBy("brand", "name_key").agg(F.min("store_name").alias("store_name"), F.max("store_name").alias("last")).filter("store_name = last")
    return one.groupBy("store_name").agg(F.count("*").alias("exclusive_models"))


def variants_per_store_common(seen: DataFrame) -> DataFrame:
    """Distinct products per store over models in several stores."""
    common = _stores(seen).filter("a <> b").select("brand", "name_key")
    products = seen.select("product_id", "brand", "name_key").distinct().join(common, ["brand", "name_key"], "left_semi").select("product_id")
    pairs = seen.select("product_id", "store_name").distinct().join(products, "product_id", "left_semi")
    return pairs.groupBy("store_name").agg(F.count("*").alias("variants"))


def common_products_list(seen: DataFrame, limit: int = 10) -> DataFrame:
    """Models with most stores."""
    out = seen.groupBy("brand", "name_key").agg(F.array_join(F.sort_array(F.collect_set("store_name")), ",").alias("stores"), F.countDistinct("store_name").alias("n_stores"), F.countDistinct("product_id").alias("variants")).filter("n_stores > 1")
    return out.orderBy(F.desc("n_stores"), "brand", "name_key").limit(limit)


def distinct_models(feed: DataFrame, source: str, approximate: bool = False) -> DataFrame:
    """Rows and distinct names per source and in all (source null)."""
    count = F.approx_count_distinct if approximate else F.countDistinct
    return feed.groupingSets([[F.col(source)], []], F.col(source)).agg(F.count("*").alias("rows"), count("model_name").alias("names"), count("product_id").alias("numbers"))


def model_report(feed: DataFrame, source: str, values: list[str], limit: int = 20) -> DataFrame:
    """A10: rows per model and source, with status, the first number, most rows first."""
    counts = [F.count_if(F.col(source) == v).alias(f"n_{v}") for v in values]
    out = feed.groupBy("brand", "model_name").agg(*counts, F.min("product_id").alias("first_number"), F.count("*").alias("n"))
    sources = sum(((F.col(f"n_{v}") > 0).cast("int") for v in values), F.lit(0))
    return out.withColumn("status", F.when(sources > 1, "several").otherwise("one")).orderBy(F.desc("n"), "brand", "model_name").limit(limit)


def category_rollup(closure: DataFrame, counts: DataFrame) -> DataFrame:
    """Figures of each node with all below it.  closure: ancestor, descendant;
    counts: node, n, min_price, max_price."""
    return closure.join(counts, closure["descendant"] == counts["node"]).groupBy("ancestor").agg(F.sum("n").alias("n"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"))


def facets(products: DataFrame, offers: DataFrame, band: int = 20000) -> DataFrame:
    """Products by brand, category, RAM, price band, store and, where products have
    storage_gb, storage; a product counts once in each store that has it."""
    price = offers.groupBy("product_id").agg(F.min("price").alias("price"))
    df = products.join(price, "product_id", "left").select("brand", "category", F.col("ram_gb").cast("string").alias("ram"), (F.floor(F.col("price") / band) * band).cast("bigint").cast("string").alias("band"))
    cols = ["brand", "category", "ram", "band"]
    out = df.groupingSets([[F.col(c)] for c in cols], *(F.col(c) for c in cols)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which = {7: "brand", 11: "category", 13: "ram", 14: "band"}
    facet = F.coalesce(*(F.when(F.col("g") == g, F.lit(c)) for g, c in which.items()))
    stores = offers.select("product_id", "store_name").distinct().groupBy(F.lit("store").alias("facet"), F.col("store_name").alias("value")).agg(F.count("*").alias("n"))
    out = out.select(facet.alias("facet"), F.coalesce(*cols).alias("value"), "n").unionByName(stores)
    if "storage_gb" in products.columns:
        storage = products.groupBy(F.col("storage_gb").cast("string").alias("value")).agg(F.count("*").alias("n"))
        out = out.unionByName(storage.withColumn("facet", F.lit("storage")))
    return out


def price_analysis(offers: DataFrame) -> DataFrame:
    """Range, average, median, spread and cheapest store per product."""
    best = F.min(F.struct("price", "store_name")).getField("store_name")
    return offers.filter("price is not null").groupBy("product_id").agg(F.min(price()).alias("min_price"), F.max(price()).alias("max_price"), mean("price").alias("avg_price"), F.percentile(price(), 0.5).alias("median_price"), (F.max(price()) - F.min(price())).alias("spread"), best.alias("cheapest_store"))


def store_wins(offers: DataFrame) -> DataFrame:
    """Products on which a store has the lowest active price."""
    ranked = price_comparison(offers).filter("rank = 1").select("product_id", "store_name").distinct()
    return ranked.groupBy("store_name").agg(F.count("*").alias("wins"))


def store_matrix(offers: DataFrame, stores: list[str]) -> DataFrame:
    """Lowest price per product and store, a column for each given store."""
    return offers.filter(F.col("store_name").isin(*stores)).groupBy("product_id").pivot("store_name", stores).agg(F.min(price()))


def brand_category_matrix(products: DataFrame) -> DataFrame:
    """Counts per brand and category with all subtotals."""
    return products.cube("brand", "category").agg(F.count("*").alias("products"), F.grouping_id().alias("level"))


def search_trends(log: DataFrame, ts: str, term: str) -> DataFrame:
    """Uses of each term a day and the change from its last day."""
    day = log.groupBy(F.to_date(ts).alias("day"), F.col(term).alias("term")).agg(F.count("*").alias("uses"))
    return day.withColumn("change", F.col("uses") - F.lag("uses").over(W.partitionBy("term").orderBy("day")))


def top_models(feed: DataFrame, source: str, n: int = 10) -> DataFrame:
    """L3: most frequent names per source."""
    counts = feed.groupBy(source, "model_name").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy(source).orderBy(F.desc("n"), "model_name"))).filter(F.col("rank") <= n)


def _price_neighbours(products: DataFrame, n: int, *carried: str) -> DataFrame:
    """Each product with the ``n`` of its brand and category nearest in price (ties: smaller ids),
    as ``other``, their gap and rank; ``carried`` columns come along on both sides.

    Each product meets its n neighbours on either side in price order and the
    first of its own price, which hold the n nearest with ties to smaller ids; no
    group is paired with itself."""
    group = W.partitionBy("brand", "category")
    me = F.struct("product_id", "list_price", *carried)
    above = [F.lead(me, k).over(group.orderBy("list_price", "product_id")) for k in range(1, n + 1)]
    below = [F.lag(me, k).over(group.orderBy("list_price", F.desc("product_id"))) for k in range(1, n + 1)]
    same = W.partitionBy("brand", "category", "list_price").orderBy("product_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    equal = [F.nth_value(me, k).over(same) for k in range(1, n + 2)]
    near = products.select("product_id", "list_price", *carried, F.array_distinct(F.array(*above, *below, *equal)).alias("near"))
    near = near.withColumn("other", F.explode("near")).drop("near").filter("other is not null and other.product_id <> product_id")
    gap = F.abs(F.col("other.list_price") - F.col("list_price"))
    rank = F.row_number().over(W.partitionBy("product_id").orderBy("gap", "other.product_id"))
    return near.withColumn("gap", gap).withColumn("rank", rank).filter(F.col("rank") <= n)


def related_products(products: DataFrame, n: int = 3) -> DataFrame:
    """L4: products of the same brand and category nearest in price."""
    near = _price_neighbours(products, n)
    return near.select("product_id", F.col("other.product_id").alias("related_id"), F.col("gap").cast("double").alias("gap"), "rank")


def related_by_name(products: DataFrame, n: int = 3, pool: int = 10) -> DataFrame:
    """L4: of the ``pool`` products of the same brand and category nearest in price, the ``n``
    whose names are most alike (shared trigrams over all), ties to the nearer price and the
    smaller id.  A null name is like no other."""
    near = _price_neighbours(products, pool, "model_name")
    mine, others = trigrams(F.col("model_name")), trigrams(F.col("other.model_name"))
    near = near.withColumns({"mine": mine, "others": others}).withColumn("shared", F.size(F.array_intersect("mine", "others")))
    either = F.size("mine") + F.size("others") - F.col("shared")
    near = near.withColumn("similarity", F.coalesce(F.when((F.col("shared") > 0) & (either > 0), F.col("shared") / either), F.lit(0.0)))
    rank = F.row_number().over(W.partitionBy("product_id").orderBy(F.desc("similarity"), "gap", "other.product_id"))
    out = near.withColumn("rank", rank).filter(F.col("rank") <= n)
    return out.select("product_id", F.col("other.product_id").alias("related_id"), F.col("gap").cast("double").alias("gap"), "similarity", "rank")
