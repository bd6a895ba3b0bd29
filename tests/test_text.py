"""Catalogue text functions, literal cases."""

import base64
import uuid

import pytest
from pyspark.sql import functions as F

from vitrine.functions import scoring, text


@pytest.mark.parametrize(
    "given, expected",
    [
        ("Women's Top, Small", "Women' Top,"),
        ("Dress M/L red", "Dress / red"),
        ("XXL Shirt 2x", "Shirt"),
        ("xsmall   Jacket", "Jacket"),
        ("Smaller Medium-size", "Smaller -size"),
    ],
)
def test_size_words(one, given, expected):
    assert one(text.remove_size_patterns("c"), c=given) == expected


def test_clean_string(one):
    assert one(text.clean_string("c"), c="  Café & Co. 24/7 ") == "caf  co 247"


def test_slug_keeps_sizes(one):
    assert one(text.slug("p", "n"), p="Shop.com", n="Small  Top!") == "shopcom-small-top"


@pytest.mark.parametrize("name", ["", "shop", "ümlaut ß", "a much longer programme name, 2024"])
def test_name_uuid_is_version_3(one, name):
    import hashlib

    expected = uuid.UUID(bytes=hashlib.md5(name.encode()).digest(), version=3)
    assert one(text.name_uuid("c"), c=name) == str(expected)


def test_image_token_has_no_line_breaks(one):
    url = "https://img.example.com/" + "ü?>/" * 60
    assert one(text.image_token("c"), c=url) == base64.urlsafe_b64encode(url.encode()).decode()


@pytest.mark.parametrize(
    "given, expected",
    [
        (None, "2300-01-01 00:00:00"),
        ("", "2300-01-01 00:00:00"),
        ("0000-00-00 00:00:00", "2300-01-01 00:00:00"),
        ("soon", "2300-01-01 00:00:00"),
        ("2023-02-30 00:00:00", "2300-01-01 00:00:00"),
        ("2024-05-06 07:08:09", "2024-05-06 07:08:09"),
    ],
)
def test_deal_timestamp(one, given, expected):
    assert one(text.deal_timestamp("c").cast("string"), c=given) == expected


def test_prices(one):
    assert one(text.cashback_amount("r", "p"), r=0.5, p="10.0") == 5.0
    assert one(text.cashback_amount("r", "p"), r=0.5, p="free") is None
    assert one(text.shipping_price("c"), c=None) == "0.0"


def test_names(one):
    assert one(text.store_name("c"), c="Big.Shop.com") == "big"
    assert one(text.brand("m", "p"), m="", p="Shop!") == "shop"
    assert one(text.availability("c"), c="YES") == "on sale"
    assert one(text.simple_slug("c"), c="A b!C") == "a-b!c"
    assert one(text.first_alnum("c"), c="--ab_1 x") == "ab_1"
    assert one(text.first_alnum("c"), c="--") == "--"


def test_months_clamp(one):
    pair = one(text.months_from(F.lit("2024-01-31"), 1))
    assert (pair.start, pair.end) == ("2024-01-31", "2024-02-29")
    back = one(text.months_from(F.lit("2024-03-31"), -1))
    assert (back.start, back.end) == ("2024-02-29", "2024-03-31")


@pytest.mark.parametrize(
    "age, weight",
    [(-5.0, 1.0), (0.99, 1.0), (1.0, 0.8), (24.0, 0.5), (168.0, 0.2), (720.0, 0.1), (None, 0.1)],
)
def test_age_weight(one, age, weight):
    assert one(scoring.age_weight(F.lit(age).cast("double"))) == weight


def test_checkout_counts_for_ratings_only(one):
    assert one(scoring.type_score("t"), t="CHECKOUT") == 0.0
    assert one(scoring.type_rating("t"), t="CHECKOUT") == 5.0
    assert one(scoring.type_score("t", {"CHECKOUT": 2.0}), t="CHECKOUT") == 2.0
