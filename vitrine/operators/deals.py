"""Coupons to deals."""

from pyspark.sql import functions as F

from ..functions.text import deal_timestamp
from .grouping import spread_lookup


def coupons_with_store(coupons, stores):
    """Each coupon with the store whose programme it was requested for.

    Coupons of a hot store are spread; the store side is the one repeated.
    """
    keyed = stores.select(
        F.col("code").alias("program_id"),
        F.col("id").alias("store_id"),
        F.col("name").alias("store_name"),
    )
    return spread_lookup(coupons, keyed, ["program_id"], how="inner", spread_by=["id", "name"])


def coupon_to_deal(coupons, stores):
    """Deal row with both dates read and the store attached."""
    return coupons_with_store(coupons, stores).select(
        "name",
        "program_name",
        deal_timestamp("end_date").alias("end_date"),
        deal_timestamp("start_date").alias("start_date"),
        "exclusive",
        "description",
        "status",
        "code",
        "program_id",
        "coupon",
        "category_name",
        "store_id",
    )
