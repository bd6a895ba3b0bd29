"""Landed catalogue pages to stored products, coupons to deals."""

from ..operators.catalog import (
    EXCLUDED_STORES,
    accept_limit,
    attach_cashback,
    catalog_minimal,
    catalog_to_product,
    exclude_stores,
    has_required_urls,
    new_skus,
)
from ..operators.deals import coupon_to_deal
from ..operators.images import valid_images
from ..sources.sinks import batched_upsert
from ..sources.versions import publish


def catalogue_job(spark, catalog, stores, path, loaded_at, images=None, excluded=EXCLUDED_STORES):
    """Map the catalogue of all but the excluded stores and store it by SKU.

    With ``images`` only rows whose landed image is a real one are kept.
    """
    rows = valid_images(catalog, images) if images is not None else catalog
    kept = exclude_stores(stores, excluded)
    products = catalog_to_product(attach_cashback(rows, kept), loaded_at)
    return batched_upsert(spark, products, path)


def fetch_new_products(catalog, products, loaded_at, n=10):
    """First ``n`` rows with both urls whose SKU is new."""
    fresh = accept_limit(new_skus(has_required_urls(catalog), products), n)
    return catalog_minimal(fresh, loaded_at, passthrough=("pos",))


def deals_job(coupons, stores, out):
    """Write the deals of all stores' coupons as a new version; returns the written table."""
    return publish(coupon_to_deal(coupons, stores), out)
