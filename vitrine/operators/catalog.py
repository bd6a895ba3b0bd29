"""Affiliate catalogue: filters, mapping, dedup against stored products."""

from pyspark.sql import functions as F

from ..functions import non_empty, text
from .grouping import spread_lookup, top_in_group

# Fixed value: the store left out of catalogue requests.
EXCLUDED_STORES = ["5030"]
# Fixed value: the network of the catalogue.
NETWORK = "pepper"


def exclude_stores(stores, codes=EXCLUDED_STORES):
    """Drop the given store codes; a null code stays."""
    return stores.where(F.col("code").isNull() | ~F.col("code").isin(list(codes)))


def has_required_urls(catalog):
    return catalog.where((F.length("image_url") > 0) & (F.length("buy_url") > 0))


def attach_cashback(catalog, stores):
    """Store rate by programme name, any case; 0.0 when there is none.

    The lookup key is the name UUID of the lower-case name. Equal names and
    equal UUIDs are the same test, so the names are joined and no hash is computed.
    """
    rates = top_in_group(
        stores.select(F.lower("name").alias("_program"), "id", "cashback_rate"),
        ["_program"],
        ["id"],
    ).drop("id")
    joined = spread_lookup(
        catalog.withColumn("_program", F.lower("program_name")),
        rates,
        ["_program"],
        spread_by=["sku", "name"],
    )
    return joined.withColumn("cashback_rate", F.coalesce("cashback_rate", F.lit(0.0))).drop(
        "_program"
    )


def mappable(catalog):
    """Rows the full mapping accepts: every text it reads is there and the price parses."""
    needed = ["program_name", "name", "manufacturer", "image_url", "in_stock", "color"]
    keep = text.price_of("price").isNotNull()
    for column in needed:
        keep = keep & F.col(column).isNotNull()
    return catalog.where(keep)


def catalog_to_product(catalog, loaded_at, passthrough=()):
    """Full product row; expects ``cashback_rate`` from ``attach_cashback``."""
    price = text.price_of("price")
    token = text.image_token("image_url")
    product_slug = text.slug("program_name", "name")
    now = F.lit(loaded_at).cast("timestamp")
    return mappable(catalog).select(
        *passthrough,
        F.col("sku"),
        text.clean_string("program_name").alias("program_name"),
        text.clean_string(text.remove_size_patterns("name")).alias("product_name"),
        text.availability("in_stock").alias("available"),
        F.col("description_long").alias("product_details"),
        F.col("currency"),
        F.col("buy_url").alias("payment_url"),
        F.array(token).alias("image_urls"),
        token.alias("thumbnail"),
        text.shipping_price("price_shipping").alias("shipping_price"),
        text.cashback_amount("cashback_rate", "price").alias("cashback"),
        text.store_name("program_name").alias("store_name"),
        text.brand("manufacturer", "program_name").alias("brand_name"),
        F.lit(NETWORK).alias("affiliate_name"),
        text.lower_color("color").alias("color"),
        price.alias("price"),
        price.alias("price_old"),
        text.name_uuid(product_slug).alias("uuid_identifier"),
        product_slug.alias("slug"),
        now.alias("created_at"),
        now.alias("update_at"),
    )


def catalog_minimal(catalog, loaded_at, passthrough=()):
    """Short product row of the feed fetch, marked as not yet used for a video."""
    now = F.lit(loaded_at).cast("timestamp")
    return catalog.where(text.price_of("price").isNotNull()).select(
        *passthrough,
        F.col("sku"),
        F.col("name").alias("product_name"),
        F.col("program_name"),
        F.col("buy_url").alias("payment_url"),
        F.col("image_url").alias("thumbnail"),
        text.price_of("price").alias("price"),
        F.col("currency"),
        F.col("color"),
        F.col("manufacturer").alias("brand_name"),
        F.lit(False).alias("video_generated"),
        now.alias("created_at"),
        now.alias("update_at"),
    )


def first_per_sku(catalog):
    """First row of each SKU in page order."""
    return top_in_group(catalog, ["sku"], ["pos"])


def new_skus(catalog, products):
    """Rows whose SKU is not stored; the first occurrence wins."""
    stored = products.select("sku").distinct()
    return first_per_sku(catalog).join(stored, "sku", "left_anti")


def lookup_sku(products, skus):
    """Products with one of the given SKUs."""
    return spread_lookup(
        products, skus.select("sku").distinct(), ["sku"], how="left_semi", salts=1
    )


def accept_limit(accepted, n=10):
    """First ``n`` rows in page order, after all filters."""
    return accepted.orderBy("pos").limit(n)


def ingest_summary(accepted, n=10):
    """Number and names of the products a fetch added, at most ``n`` by its limit."""
    added = accept_limit(accepted, n).agg(
        F.count(F.lit(1)).alias("products_added"),
        F.sort_array(F.collect_list(F.struct("pos", "product_name"))).alias("_rows"),
    )
    return added.select(
        "products_added", F.transform("_rows", lambda r: r["product_name"]).alias("products")
    )


def enrich_with_tags(products, tags):
    """Tag struct per product; products without a result are left out."""
    return products.join(tags.select("id", "tags"), "id")


def unused_products(products):
    """Products marked as not used; an unknown mark counts as used."""
    return products.where(~F.col("video_generated"))


def generation_requests(products):
    """Video request per product with defaults for missing description and type."""
    return products.select(
        F.col("id").alias("product_id"),
        "product_name",
        F.coalesce(
            non_empty("product_details"),
            F.concat(F.lit("Official styled look for "), F.col("product_name")),
        ).alias("product_description"),
        F.col("thumbnail").alias("product_image_url"),
        F.coalesce(non_empty("category"), F.lit("fashion")).alias("product_type"),
        F.col("payment_url").alias("affiliate_link"),
    )


# Defaults of a request map.
REQUEST_DEFAULTS = {
    "productName": "Test Product",
    "productDescription": "Test Description",
    "productImageUrl": "https://example.com/test.jpg",
    "productType": "test",
    "affiliateLink": "https://example.com/product",
}


def parse_generation_requests(raw):
    """Requests from JSON text in ``value``; a bad product id becomes 0."""
    fields = F.from_json("value", "MAP<STRING, STRING>")
    parsed = raw.withColumn("_m", fields).where(F.col("_m").isNotNull())

    def get(key):
        given = F.col("_m")[key]
        return F.when(F.map_contains_key("_m", key), given).otherwise(F.lit(REQUEST_DEFAULTS[key]))

    digits = F.col("_m")["productId"]
    product_id = F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint"))
    return parsed.select(
        *[c for c in raw.columns if c != "value"],
        F.coalesce(product_id, F.lit(0).cast("bigint")).alias("product_id"),
        get("productName").alias("product_name"),
        get("productDescription").alias("product_description"),
        get("productImageUrl").alias("product_image_url"),
        get("productType").alias("product_type"),
        get("affiliateLink").alias("affiliate_link"),
    )
