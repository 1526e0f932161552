"""Entity resolution: feed records to brands, categories, products, variants,
listings and offers.  Ids are hashes of natural keys, so a retried task or a
second run gives the same id."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyshelf.functions import rules
from tallyshelf.operators.catalog import first_seen, refresh_counts
from tallyshelf.operators.components import connected_components
from tallyshelf.operators.identity import ProductIdentities, key_id, record_nodes, redirected
from tallyshelf.operators.slices import same
from tallyshelf.scratch import broadcast_if_small, stage

#: What a record's product follows from; records alike in these are resolved once.
SPELLING = ["brand", "model_name", "model_number"]


def by_spelling(feed: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
    """feed with the other columns of ``of``, which has one row a spelling (``keys``, null as null)."""
    more = [c for c in of.columns if c not in keys]
    out = feed.drop(*more).alias("f").join(broadcast_if_small(stage(of, "spellings")).alias("s"), same("f", "s", keys), "left")
    return out.select("f.*", *(F.col(f"s.`{c}`") for c in more))


def resolve_brands(feed: DataFrame, brands: DataFrame) -> DataFrame:
    """All brands after the feed: those there (is_new false) and new ones.

    feed has brand; brands have brand_id, name and slug.  A feed brand matches by
    slug, then by trimmed name; null and empty brands make none.
    """
    named = feed.select("brand").distinct().select(rules.squeeze(F.col("brand")).alias("name")).filter("name <> ''").withColumn("slug", rules.slug(F.col("name")))
    new = named.join(brands.select("slug"), "slug", "left_anti").join(brands.select(F.trim("name").alias("name")), "name", "left_anti")
    new = new.groupBy("slug").agg(F.min("name").alias("name")).select(key_id(F.col("slug")).alias("brand_id"), "name", "slug", F.lit(True).alias("is_new"))
    return brands.select("brand_id", "name", "slug", F.lit(False).alias("is_new")).unionByName(new)


def brand_of(feed: DataFrame, brands: DataFrame) -> DataFrame:
    """feed with brand_id, by slug."""
    keyed = feed.select("brand").distinct().withColumn("_slug", rules.slug(rules.squeeze(F.col("brand"))))
    return by_spelling(feed, keyed.join(brands.select("brand_id", F.col("slug").alias("_slug")), "_slug").drop("_slug"), ["brand"])


def assign_category(feed: DataFrame, categories: DataFrame, default: str = "Smartphones", other: str = "others") -> DataFrame:
    """category_id by exact name; a missing name counts as the default, an
    unknown one as other if that exists, else null."""
    known = categories.select(F.col("category_id").alias("_id"), F.col("name").alias("_name"))
    fallback = categories.filter(F.col("name") == other).agg(F.min("category_id")).scalar()
    out = feed.join(known, F.coalesce("category", F.lit(default)) == F.col("_name"), "left")
    return out.withColumn("category_id", F.coalesce(F.col("_id"), fallback)).drop("_id", "_name")


def category_lookup(feed: DataFrame, categories: DataFrame) -> DataFrame:
    """category_id of active categories by exact slug or name, then in lower case."""
    keys = (F.col("slug"), F.col("name"), F.lower("slug"), F.lower("name"))
    on = categories.filter("is_active").select("category_id", F.explode(F.array(*(F.struct(k.alias("k"), F.lit(p).alias("p")) for p, k in enumerate(keys)))).alias("e"))
    best = on.groupBy(F.col("e.k").alias("_k")).agg(F.min_by("category_id", F.struct("e.p", "category_id")).alias("_id"))
    best = broadcast_if_small(stage(best, "category-names"))
    exact, low = best.select(F.col("_k").alias("_a"), F.col("_id").alias("_ia")), best.select(F.col("_k").alias("_b"), F.col("_id").alias("_ib"))
    out = feed.join(exact, F.col("category") == F.col("_a"), "left").join(low, F.lower("category") == F.col("_b"), "left")
    return out.withColumn("category_id", F.coalesce("_ia", "_ib")).drop("_a", "_b", "_ia", "_ib")


def dealt(key: str, *row: str) -> Column:
    """A key id to join by from the left, for rows without one a value of their own that no
    id has: as null they would all meet in one task."""
    return F.coalesce(F.col(key), F.concat(F.lit("-"), F.xxhash64(*row).cast("string")))


def resolve_products(feed: DataFrame, mode: str = "name") -> DataFrame:
    """Feed with product_key, equal for records of one product.

    feed has brand, model_name and model_number.  Within a brand, mode "name" joins
    records by network-normalised model name; mode "components" also by model number,
    and takes the connected components of both keys.  Keys are made once a spelling.
    """
    if mode == "name":
        name = rules.network_key(F.col("model_name"))
        key = F.when(name.isNotNull(), key_id(F.lower(rules.squeeze(F.col("brand"))), name))
        return by_spelling(feed, feed.select("brand", "model_name").distinct().withColumn("product_key", key), ["brand", "model_name"])
    name, number = record_nodes()
    kinds = stage(feed.select(*SPELLING).distinct().withColumns({"_node": name, "_number": number}), "spelling-nodes")
    parts = connected_components(kinds.select(F.col("_node").alias("a"), F.col("_number").alias("b")).filter("b is not null").distinct(), "products")
    found = kinds.withColumn("_at", dealt("_node", *SPELLING)).join(parts.select(F.col("node").alias("_at"), "component"), "_at", "left")
    return by_spelling(feed, found.select(*SPELLING, F.coalesce("component", "_node").alias("product_key")), SPELLING)


def backfill_model_numbers(products: DataFrame, feed: DataFrame) -> DataFrame:
    """Null model_number of products (product_key) from the feed's first record that has one."""
    first = feed.filter("model_number is not null").groupBy("product_key").agg(F.min_by("model_number", "row_id").alias("_found"))
    return products.join(first, "product_key", "left").withColumn("model_number", F.coalesce("model_number", "_found")).drop("_found")


def variant_key(tablets: bool = False) -> Column:
    """Product, RAM (not for Apple), storage, normalised colour; for
    tablets also display size and connectivity."""
    apple = F.lower("brand").contains("apple")  # spares most rows the next test
    if not tablets:
        apple = apple & (F.lower(rules.squeeze(F.col("brand"))) == "apple")
    apple = F.coalesce(apple, F.lit(False))
    parts = [F.col("product_key"), F.when(~apple, F.col("ram")), F.col("storage"), rules.color_key(F.col("color"))]
    if tablets:
        parts += [F.col("display_size"), F.col("connectivity_type")]
    return key_id(*parts)


def resolve_variants(feed: DataFrame, existing: DataFrame | None = None, tablets: bool = False) -> DataFrame:
    """One row per variant of the feed, its first record, with variant_id
    and is_new (not in existing, which has variant_id)."""
    return first_variants(feed.withColumn("variant_id", variant_key(tablets)), existing, F.lit(tablets))


def first_variants(keyed: DataFrame, existing: DataFrame | None, tablets: Column) -> DataFrame:
    """Variants of records that have variant_id, of which some may be tablets."""
    out = first_seen(keyed, ["variant_id"], ["row_id"])
    out = out.withColumn("ram", F.when(~(tablets & F.coalesce(F.lower("brand").contains("apple"), F.lit(False))), F.col("ram")))
    if existing is None:
        return out.withColumn("is_new", F.lit(True))
    old = existing.select("variant_id", F.lit(False).alias("_old")).distinct()
    return out.join(old, "variant_id", "left").withColumn("is_new", F.col("_old").isNull()).drop("_old")


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], recency: str, created: str | None = None) -> DataFrame:
    """Current with incoming rows over them, by null-safe keys.

    Of several incoming rows of a key the latest wins, ties by all columns; the
    current row's created value stays.  change is new, updated or kept and
    price_changed compares prices where both sides have the key.
    """
    columns = current.columns
    w = W.partitionBy(*keys).orderBy(F.desc(recency), F.desc(F.xxhash64(*[c for c in columns if c not in keys])))
    latest = incoming.select(*columns).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    side = lambda df, tag: df.select(*(F.col(n).alias(f"_{tag}_{n}") for n in columns), F.lit(True).alias(f"_{tag}"))
    on = reduce(lambda x, y: x & y, (F.col(f"_c_{k}").eqNullSafe(F.col(f"_i_{k}")) for k in keys))
    both = side(current, "c").join(side(latest, "i"), on, "full_outer")
    pick = lambda n: F.when(F.col("_i").isNull(), F.col(f"_c_{n}")).otherwise(F.coalesce(F.col(f"_c_{n}"), F.col(f"_i_{n}")) if n == created else F.col(f"_i_{n}")).alias(n)
    change = F.when(F.col("_i").isNull(), "kept").when(F.col("_c").isNull(), "new").otherwise("updated").alias("change")
    moved = F.coalesce(F.col("_c_price") != F.col("_i_price"), F.lit(False)).alias("price_changed")
    return both.select(*(pick(n) for n in columns), change, moved)


def upsert_listings(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """By url."""
    return upsert(current, incoming, ["url"], "scraped_at", "created_at")


def upsert_offers(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """By variant, store and the store's product id."""
    return upsert(current, incoming, ["variant_id", "store_name", "store_product_id"], "last_seen")


def join_enrichment(feed: DataFrame, attributes: DataFrame) -> DataFrame:
    """Feed with attrs, a struct of the known attributes for its url; the first
    row per url wins; records without a match keep null."""
    known = ["brand_name", "model_name", "color", "ram", "storage", "display_size", "connectivity_type", "not_tablet"]
    have = [c for c in known if c in attributes.columns]
    once = first_seen(attributes, ["url"], [F.col(c) for c in attributes.columns])
    return feed.join(once.select("url", F.struct(*have).alias("attrs")), "url", "left")


def reconcile_identifiers(df: DataFrame) -> DataFrame:
    """Brand, model_name, model_number and needs_manual_review from
    spec_brand, spec_model, title_brand and title_model.

    A missing side gives way to the other.  Brands: a Redmi or POCO title wins; at
    90 % similarity the longer stays, ties to the specification; else the title's
    stays and the record is flagged.  Models: a specification that is shaped like
    a model number gives way to the title's; brand and 5G are left out for the
    comparison alone; at 90 % the more informative one stays (10 a word and its
    length, ties to the specification), else the title's, flagged.
    """

    def settle(x: Column) -> Column:
        near, sub = rules.similarity(x["spec_brand"], x["title_brand"]) >= 90, x["title_brand"].isin("Redmi", "POCO")
        longer = F.length(x["spec_brand"]) >= F.length(x["title_brand"])
        brand = F.when(x["title_brand"].isNull() | (near & ~sub & longer), x["spec_brand"]).otherwise(x["title_brand"])
        return F.struct(brand.alias("brand"), F.coalesce(~near & ~sub, F.lit(False)).alias("apart"), x["spec"].alias("spec"), x["title"].alias("title"))

    def choose(x: Column) -> Column:
        number = F.when(rules.is_model_number(x["spec"]), x["spec"])
        bare = lambda m: rules.without_5g(rules.without_brand(m, x["brand"]))
        score = lambda m: F.size(F.split(m, r"\s+")) * 10 + F.length(m)
        both = x["spec"].isNotNull() & x["title"].isNotNull() & number.isNull()
        return F.struct(x["brand"].alias("brand"), x["apart"].alias("apart"), x["spec"].alias("spec"), x["title"].alias("title"), number.alias("number"), both.alias("both"), (both & (rules.similarity(bare(x["spec"]), bare(x["title"])) >= 90)).alias("alike"), (score(x["spec"]) >= score(x["title"])).alias("more"))

    def result(x: Column) -> Column:
        model = F.when(x["title"].isNull() | (x["alike"] & x["more"]), x["spec"]).otherwise(x["title"])
        return F.struct(x["brand"].alias("brand"), model.alias("model_name"), x["number"].alias("model_number"), (x["apart"] | (x["both"] & ~x["alike"])).alias("needs_manual_review"))

    sides = F.struct(
        rules.standard_brand(F.col("spec_brand")).alias("spec_brand"), rules.standard_brand(F.col("title_brand")).alias("title_brand"),
        rules.clean_model(F.col("spec_model")).alias("spec"), rules.clean_model(F.col("title_model")).alias("title"),
    )
    out = rules.let(rules.let(rules.let(sides, settle), choose), result)
    return df.withColumn("_settled", out).withColumns({c: F.col(f"_settled.{c}") for c in ("brand", "model_name", "model_number", "needs_manual_review")}).drop("_settled")


def mark_rejects(df: DataFrame, target_category: str | None = None) -> DataFrame:
    """df with reject_reason, null for good rows."""
    blank = lambda c: ~F.coalesce(F.col(c).rlike(r"(?U)\S"), F.lit(False))
    reason = F.when(blank("title"), "empty title")
    if target_category is not None:
        reason = reason.when(~F.col("category").eqNullSafe(F.lit(target_category)), "other category")
    reason = reason.when(blank("brand"), "no brand").when(F.col("model_name").isNull(), "not resolved")
    return df.withColumn("reject_reason", reason)


def split_rejects(df: DataFrame, target_category: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with reject_reason)."""
    marked = mark_rejects(df, target_category)
    return marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")


def constraint_rejects(df: DataFrame) -> DataFrame:
    """Rows whose fields break a constraint, with the rule's name."""
    rule = {
        "price": F.col("price") < 0, "discount": ~F.col("discount").between(0, 100), "rating": ~F.col("rating").between(0, 5),
        "currency": ~F.col("currency").isin("INR", "USD", "EUR", "GBP"), "url": ~F.col("url").rlike(r"^https?://[^\s/]+"),
    }
    hits = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in rule.items() if name in df.columns)), lambda x: x.isNotNull())
    return df.withColumn("broken", hits).filter(F.size("broken") > 0)


@dataclass
class Catalog:
    """What ingestion returns: six tables with the rejects, per record its ids and
    match labels (product_match, category_match), and with stored identities the
    product keys that live no more (old_key, product_key)."""

    brands: DataFrame
    categories: DataFrame
    products: DataFrame
    variants: DataFrame
    listings: DataFrame
    rejects: DataFrame
    labels: DataFrame
    redirects: DataFrame | None = None


def empty_catalog(spark) -> dict[str, DataFrame]:
    make = lambda schema: spark.createDataFrame([], schema)
    return {"brands": make("brand_id string, name string, slug string"), "categories": make("category_id string, name string"), "products": make("product_key string, brand string, model_name string, model_number string"), "variants": make("variant_id string"), "listings": make("url string, variant_id string, store_name string, title string, price double, scraped_at timestamp, created_at timestamp")}


def earlier_records(kinds: DataFrame, old: DataFrame) -> DataFrame:
    """kinds (spellings with product_key and row_id, that of their first record) and for
    their model number, name and product, as number, name and product: the first record
    that has it (_row) and whether an old product has it (_old)."""
    brand = F.lower(rules.squeeze(F.col("brand")))
    named = lambda df: df.withColumns({"_name": key_id(brand, rules.network_key(F.col("model_name"))), "_number": F.when(F.nullif(rules.squeeze(F.col("model_number")), F.lit("")).isNotNull(), key_id(brand, F.upper(rules.squeeze(F.col("model_number")))))})
    out = stage(named(kinds), "kinds-named")
    every = out.select("product_key", "_name", "_number", "row_id", F.lit(False).alias("_old")).unionByName(named(old).select("product_key", "_name", "_number", F.lit(None).cast(kinds.schema["row_id"].dataType).alias("row_id"), F.lit(True).alias("_old")))
    for k, tag in (("_number", "number"), ("_name", "name"), ("product_key", "product")):
        seen = every.filter(F.col(k).isNotNull()).groupBy(F.col(k).alias("_at")).agg(F.min("row_id").alias(f"_{tag}_row"), F.max("_old").alias(f"_{tag}_old"))
        out = out.withColumn("_at", dealt(k, "row_id")).join(seen, "_at", "left").drop("_at")
    return out.drop("row_id", "_name", "_number")


def product_match() -> Column:
    """The match label of a record with the columns of its spelling in ``earlier_records``."""
    earlier = lambda tag: F.coalesce(F.col(f"_{tag}_old") | (F.col(f"_{tag}_row") < F.col("row_id")), F.lit(False))
    return F.when(earlier("number"), "model_number").when(earlier("name"), "model_name").when(F.col("_product_old"), "existing").when(earlier("product"), "linked").otherwise("new_product")


def match_labels(records: DataFrame, old: DataFrame) -> DataFrame:
    """records (with product_key) and product_match: model_number or model_name if
    an earlier record or an old product has it, existing or linked if the product
    is old or was found by a later record's keys, else new_product."""
    keys = [*SPELLING, "product_key"]
    of = earlier_records(records.groupBy(*keys).agg(F.min("row_id").alias("row_id")), old)
    return by_spelling(records, of, keys).withColumn("product_match", product_match()).select(*records.columns, "product_match")


def ingest(feed: DataFrame, catalog: dict[str, DataFrame] | None = None, mode: str = "components", identities: ProductIdentities | None = None, batch: str = "") -> Catalog:
    """Brand, category, product, variant and listing of every record.

    feed has row_id, store_name, url, title, brand, model_name, model_number,
    category, color, ram, storage, display_size, connectivity_type, price and
    scraped_at.  Tablets (category Tablets) get the tablet key.  catalog may have
    categories (category_id, name), by which records get their category_id (none
    without them), and products of an earlier run, which new records join.  With
    ``identities`` the feed is ``batch`` of that state: products keep their keys over
    batches, and old products are met by their nodes instead of resolved again.
    """
    spark = feed.sparkSession
    catalog = empty_catalog(spark) | (catalog or {})
    marked = stage(mark_rejects(feed), "feed")
    good, rejects = marked.filter("reject_reason is null").drop("reject_reason"), marked.filter("reject_reason is not null")
    brands = stage(resolve_brands(good, catalog["brands"]), "brands")
    good = brand_of(good, brands)
    categories = broadcast_if_small(stage(catalog["categories"], "categories"))
    known = F.coalesce("category", F.lit("Smartphones"))
    named = assign_category(good, categories).join(categories.select(F.col("name").alias("_known")).distinct(), known == F.col("_known"), "left")
    good = named.withColumn("category_match", F.when(F.col("_known").isNotNull(), F.when(F.col("category").isNull(), "default").otherwise("name")).when(F.col("category_id").isNotNull(), "other").otherwise("none")).drop("_known")
    tablets = F.coalesce(F.col("category") == "Tablets", F.lit(False))
    variant = F.when(tablets, variant_key(True)).otherwise(variant_key(False))
    if identities is None:
        kinds = good.groupBy(*SPELLING).agg(F.min("row_id").alias("row_id")).withColumn("_old", F.lit(False))
        before = catalog["products"].select(*SPELLING, F.lit(True).alias("_old"))
        resolved = stage(resolve_products(stage(kinds.unionByName(before, allowMissingColumns=True), "kinds"), mode), "resolved")
        kinds, old, redirects = resolved.filter("not _old").drop("_old"), resolved.filter("_old").drop("_old", "row_id"), None
        keyed = by_spelling(good, earlier_records(kinds, old), SPELLING).withColumn("product_match", product_match())
        labels = stage(keyed.select(*good.columns, "product_key", "product_match", variant.alias("variant_id")), "labels")
    else:
        keyed = stage(identities.assign(batch, good), "resolved")
        redirects = identities.redirects()
        old = redirected(catalog["products"].select("product_key", *SPELLING), redirects)
        labels = stage(match_labels(keyed, old).withColumn("variant_id", variant), "labels")
    keyed = labels.drop("product_match", "variant_id")
    products = keyed.groupBy("product_key").agg(*(F.min_by(c, "row_id").alias(c) for c in ("brand", "brand_id", "model_name", "category", "category_id")), F.lit(None).cast("string").alias("model_number"), F.count("*").alias("records"))
    products = backfill_model_numbers(products, keyed).withColumn("slug", F.concat_ws("-", rules.slug(F.col("brand")), rules.product_slug(F.col("model_name"))))
    products = products.join(old.select("product_key", F.lit(False).alias("_new")).distinct(), "product_key", "left").withColumn("is_new", F.coalesce("_new", F.lit(True))).drop("_new")
    variants = first_variants(labels.drop("product_match"), catalog["variants"], tablets)
    incoming = labels.filter("url is not null").select("url", "variant_id", "store_name", "title", F.col("price").cast("double").alias("price"), "scraped_at", F.col("scraped_at").alias("created_at"))
    return Catalog(brands, categories, products, variants, upsert_listings(catalog["listings"], incoming), rejects, labels, redirects)


def ingest_offers(feed: DataFrame, products: DataFrame, current: DataFrame, categories: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parsed records to (offers after upsert, products with price statistics
    and active offers, brands).  Records without a brand or a known active
    category (category_id, name, slug, is_active) are left out."""
    feed = stage(feed, "offer-feed")
    brands = stage(resolve_brands(feed, brands), "offer-brands")
    keyed = resolve_products(category_lookup(brand_of(feed, brands), categories).filter("brand_id is not null and category_id is not null"), "name")
    keyed = keyed.withColumn("variant_id", variant_key()).withColumn("url", rules.url_or_placeholder(F.col("url"), F.col("store_name"), F.col("store_product_id")))
    keyed = stage(keyed.select(*current.columns, "product_key"), "offer-records")
    after = stage(upsert_offers(current, keyed.select(*current.columns)), "offers-after")
    of = keyed.select("variant_id", "product_key").distinct().join(after, "variant_id")
    stats = of.filter("price is not null").groupBy("product_key").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), (F.sum(F.col("price").cast("decimal(18,4)")).cast("double") / F.count("price")).alias("avg_price"), F.count("*").alias("offers"))
    products = products.join(stats, "product_key", "left")
    counted = refresh_counts(products.withColumn("product_id", F.col("product_key")), of.withColumn("product_id", F.col("product_key")).select("product_id", "is_active"))
    return after, counted.drop("product_id"), brands


def ingestion_summary(result: Catalog) -> DataFrame:
    """Rows by entity and state."""
    flag = F.when(F.col("is_new"), "created").otherwise("existing")
    out = result.brands.groupBy(flag.alias("state")).count().withColumn("entity", F.lit("brand"))
    out = out.unionByName(result.variants.groupBy(flag.alias("state")).count().withColumn("entity", F.lit("variant")))
    out = out.unionByName(result.listings.groupBy(F.col("change").alias("state")).count().withColumn("entity", F.lit("listing")))
    return out.unionByName(result.rejects.groupBy(F.col("reject_reason").alias("state")).count().withColumn("entity", F.lit("reject"))).select("entity", "state", F.col("count").alias("n"))


def ingestion_report(result: Catalog) -> DataFrame:
    """A15 in full: the summary, products by state, records by category and match
    type, deduplicated records (pct of all), and processed and skipped by source."""
    out = result.products.groupBy(F.when(F.col("is_new"), "created").otherwise("existing").alias("state")).agg(F.count("*").alias("n")).withColumn("entity", F.lit("product"))
    parts = [("category", result.categories.select(F.lit("existing").alias("state"))), ("category_match", result.labels.select(F.col("category_match").alias("state"))), ("product_match", result.labels.select(F.col("product_match").alias("state")))]
    parts += [("processed", result.labels.select(F.col("store_name").alias("state"))), ("skipped", result.rejects.select(F.col("store_name").alias("state")))]
    for entity, rows in parts:
        out = out.unionByName(rows.groupBy("state").agg(F.count("*").alias("n")).withColumn("entity", F.lit(entity)))
    out = ingestion_summary(result).unionByName(out).withColumn("pct", F.lit(None).cast("double"))
    matched = F.count_if(F.col("product_match") != "new_product")
    rate = result.labels.agg(matched.alias("n"), F.count("*").alias("_all")).select(F.lit("deduplicated").alias("entity"), F.lit("records").alias("state"), "n", F.when(F.col("_all") > 0, F.floor(F.col("n") * 1000 / F.col("_all") + 0.5) / 10).alias("pct"))
    return out.unionByName(rate)


def missing_value_report(df: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """Null or blank values per source and field, in one aggregation."""
    blank = [F.count_if(F.col(f).isNull() | (F.trim(F.col(f).cast("string")) == "")).alias(f) for f in fields]
    return df.groupBy(source).agg(*blank).unpivot([source], fields, "field", "missing")


def identifier_quality(df: DataFrame, source: str) -> DataFrame:
    """Records without brand or model and records to review, with shares."""
    out = df.groupBy(source).agg(F.count("*").alias("n"), F.count_if(F.col("brand").isNull()).alias("no_brand"), F.count_if(F.col("model_name").isNull()).alias("no_model"), F.count_if("needs_manual_review").alias("to_review"))
    return out.withColumn("review_pct", F.floor(F.col("to_review") * 10000 / F.col("n") + 0.5) / 100)


def extraction_completeness(df: DataFrame, source: str, fields: list[str]) -> DataFrame:
    """Share of records with all fields."""
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.col(f).isNotNull()
    return df.groupBy(source).agg(F.count("*").alias("n"), F.count_if(whole).alias("complete")).withColumn("complete_pct", F.floor(F.col("complete") * 10000 / F.col("n") + 0.5) / 100)


def processing_stats(df: DataFrame, top: int = 10) -> DataFrame:
    """Category distribution and the most frequent brands, as (kind, name, n); rows
    without one count as unknown."""
    of = lambda c: df.groupBy(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")).alias("name")).agg(F.count("*").alias("n"))
    brands = of("brand").orderBy(F.desc("n"), "name").limit(top)
    return of("category").select(F.lit("category").alias("kind"), "name", "n").union(brands.select(F.lit("brand"), "name", "n"))


def attribute_completion(df: DataFrame) -> DataFrame:
    """One row: all products, those with brand and model, and their share in
    percent to two places, null without products."""
    known = (F.coalesce("brand", F.lit("")) != "") & (F.coalesce("model_name", F.lit("")) != "")
    out = df.agg(F.count("*").alias("total_products"), F.count_if(known).alias("products_with_attributes"))
    return out.withColumn("completion_pct", F.floor(F.col("products_with_attributes") * 10000 / F.nullif(F.col("total_products"), F.lit(0)) + 0.5) / 100)
