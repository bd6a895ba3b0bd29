"""Catalogue, products, deals."""

import base64

import pytest
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.operators import catalog as C
from vitrine.operators import deals as D
from vitrine.operators import images as G
from vitrine.operators.calls import pause
from vitrine.operators.tagging import KeywordTagger, tag_products, tag_results
from vitrine.plans.catalogue import catalogue_job, fetch_new_products
from vitrine.operators.upsert import read_current
from vitrine.session import run_dir
from vitrine.sources.files import scan_catalog_pages

AT = "2024-01-31 00:00:00"
ITEM = schemas.CATALOG_ITEM + ", pos BIGINT"


def items(spark, *changes):
    base = {
        "sku": "s", "name": "Silk Top, Small", "program_name": "Shop.Com", "manufacturer": "",
        "price": "10.0", "currency": "USD", "in_stock": "yes", "color": "RED",
        "image_url": "https://i", "buy_url": "https://b", "price_shipping": None,
        "description_long": "d", "pos": 0,
    }
    rows = [{**base, "pos": i, **c} for i, c in enumerate(changes)]
    names = [f.strip().split(" ")[0] for f in ITEM.split(",")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ITEM)


def stores(spark, *rows):
    return spark.createDataFrame(
        rows, "id BIGINT, name STRING, code STRING, cashback_rate DOUBLE"
    )


def test_mapping(spark):
    rows = items(spark, {}, {"price": "free"}, {"color": None}, {"manufacturer": "Brand & Co"})
    known = stores(spark, (1, "SHOP.com", "1", 0.5), (2, "shop.com", "2", 0.9))
    got = C.catalog_to_product(C.attach_cashback(rows, known), AT).collect()
    assert len(got) == 2
    one = next(r for r in got if r.brand_name == "shopcom")
    assert one.product_name == "silk top" and one.slug == "shopcom-silk-top-small"
    assert (one.cashback, one.price, one.shipping_price) == (5.0, 10.0, "0.0")
    assert one.store_name == "shop" and one.color == "red" and one.available == "on sale"
    assert one.image_urls == [base64.urlsafe_b64encode(b"https://i").decode()]
    assert len(one) == 21


def test_no_rate_means_zero(spark):
    got = C.attach_cashback(items(spark, {"program_name": None}, {}), stores(spark)).collect()
    assert [r.cashback_rate for r in got] == [0.0, 0.0]


def test_excluded_store_and_null_code(spark):
    known = stores(spark, (1, "a", "5030", 0.1), (2, "b", None, 0.1), (3, "c", "1", 0.1))
    assert {r.id for r in C.exclude_stores(known).collect()} == {2, 3}


def test_new_skus_once_and_stored_never(spark):
    rows = items(spark, {"sku": "a"}, {"sku": "a"}, {"sku": "b"}, {"sku": "c", "buy_url": ""})
    stored = spark.createDataFrame([("b",)], "sku STRING")
    got = fetch_new_products(rows, stored, AT).collect()
    assert [(r.sku, r.pos, r.video_generated) for r in got] == [("a", 0, False)]


def test_limit_counts_accepted_rows_only(spark):
    rows = items(spark, *[{"sku": f"s{i:02}", "image_url": "" if i % 2 else "u"} for i in range(40)])
    stored = spark.createDataFrame([("s00",), ("s02",)], "sku STRING")
    fresh = fetch_new_products(rows, stored, AT)
    assert sorted(r.pos for r in fresh.collect()) == list(range(4, 24, 2))
    summary = C.ingest_summary(fresh).first()
    assert summary.products_added == 10 and len(summary.products) == 10


def test_pages_and_stored_products(spark, tmp_path):
    page = (
        '{{"meta":{{"pagination":{{"next":{}}}}},"data":[{{"sku":"{}","name":"N","program_name":"P",'
        '"manufacturer":"m","price":"{}","in_stock":"no","color":"C","image_url":"u"}}]}}\n'
    )
    (tmp_path / "p.json").write_text(
        page.format('{"href":"p2"}', "a", "1.5") + "broken\n" + page.format("null", "b", "2.5")
    )
    rows = scan_catalog_pages(spark, str(tmp_path))
    assert {(r.sku, r.at) for r in rows.collect()} == {("a", 0), ("b", 0)}
    path = run_dir(spark, "products")
    catalogue_job(spark, rows, stores(spark), path, AT)
    catalogue_job(spark, rows.withColumn("price", F.lit("9")), stores(spark), path, AT)
    assert {(r.sku, r.price) for r in read_current(spark, path).collect()} == {
        ("a", 9.0), ("b", 9.0)
    }


def test_requests(spark):
    raw = spark.createDataFrame(
        [('{"productId":"not_a_number"}',), ('{"productId":"12","productType":"dress"}',),
         ('{"productId":"99999999999999999999"}',), ("{",)],
        "value STRING",
    )
    got = C.parse_generation_requests(raw).collect()
    assert [r.product_id for r in got] == [0, 12, 0]
    assert [r.product_type for r in got] == ["test", "dress", "test"]
    assert got[0].product_name == "Test Product"


def test_deals_of_a_hot_store(spark):
    coupons = spark.range(500).select(
        F.col("id").cast("string").alias("id"),
        F.lit("n").alias("name"),
        F.when(F.col("id") % 3 == 0, None).when(F.col("id") % 5 == 0, "2").otherwise("1")
        .alias("program_id"),
    )
    known = stores(spark, (1, "a", "1", 0.0), (2, "b", "2", 0.0), (3, "b2", "2", 0.0))
    got = D.coupons_with_store(coupons, known).groupBy("store_id").count().collect()
    expected = coupons.groupBy("program_id").count().collect()
    counts = {r.program_id: r["count"] for r in expected}
    assert {r.store_id: r["count"] for r in got} == {1: counts["1"], 2: counts["2"], 3: counts["2"]}


def test_flags_differ_for_products(spark):
    rows = spark.createDataFrame(
        [(1, None), (2, True), (3, False)], "id BIGINT, video_generated BOOLEAN"
    )
    assert [r.id for r in C.unused_products(rows).collect()] == [3]


def test_tagger(spark):
    class Flaky(KeywordTagger):
        def tag(self, image_url, description):
            if "bad" in description:
                raise RuntimeError("service down")
            return super().tag(image_url, description)

    rows = spark.createDataFrame(
        [(1, "t", "red dress"), (2, "t", "bad"), (3, None, "x"), (4, "t", None), (5, "t", "hat")],
        "id BIGINT, thumbnail STRING, product_details STRING",
    )
    tags = tag_products(rows, Flaky, "https://proxy", first=0.01)
    got = {r.id: r.tags for r in tags.collect()}
    assert set(got) == {1, 5}
    assert got[1].category == "dress" and got[1].color == "red"
    assert got[1].sub_categories == ["dress"]
    assert C.enrich_with_tags(rows, tags).count() == 2
    results = tag_results(rows, Flaky, "https://proxy", first=0.01).collect()
    assert {(r.id, r.error) for r in results if r.error} == {(2, "RuntimeError: service down")}


def test_failed_calls_are_repeated_with_growing_waits():
    assert [pause(turn) for turn in range(3)] == [2.0, 4.0, 8.0]
    assert max(pause(turn) for turn in range(7)) == 30.0


def test_image_headers():
    jpeg = bytes.fromhex("FFD8FFE000104A46494600010100000100010000FFC000110800200040030122")
    assert G.image_size(jpeg) == (64, 32)
    assert G.image_size(bytes.fromhex("89504E470D0A1A0A0000000D494844520000000500000006")) == (5, 6)
    assert G.image_size(b"GIF89a" + bytes([3, 0, 4, 0])) == (3, 4)
    bmp = b"BM" + bytes(16) + bytes([7, 0, 0, 0, 0xF8, 0xFF, 0xFF, 0xFF])
    assert G.image_size(bmp) == (7, 8)
    for bad in (None, b"", b"<html>", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"):
        assert G.image_size(bad) is None
