"""Choice of the next post, paging, flags."""

import pytest
from pyspark.sql import functions as F

from vitrine.functions import social
from vitrine.operators import feed as V

VIDEO = "id BIGINT, url STRING, published BOOLEAN, item_name STRING, created_at STRING"
PRODUCT = "id BIGINT, product_name STRING, video_generated BOOLEAN"

OLD = (1, "a.mp4", True, "old", "2024-01-01 00:00:00")
NEW = (2, "b.mp4", False, "new", "2024-01-03 00:00:00")
NULL = (3, "c.mp4", None, "unknown", "2024-01-02 00:00:00")
SAMPLE = (4, "https://w3schools.com/x.mp4", False, "sample", "2023-01-01 00:00:00")
IMAGE = (5, "d.jpg", False, "image", "2023-01-01 00:00:00")


def choose(spark, videos, products, succeeded=None):
    v, p = spark.createDataFrame(videos, VIDEO), spark.createDataFrame(products, PRODUCT)
    choice = V.next_post(v, p, seed=1)
    if succeeded is not None:
        choice = V.after_generation(choice, v, succeeded, seed=1)
    return [(r.action, r.id) for r in choice.collect()]


@pytest.mark.parametrize(
    "videos, products, succeeded, expected",
    [
        ([OLD, NEW, NULL, SAMPLE, IMAGE], [(9, "p", False)], None, [("publish", 3)]),
        ([OLD, SAMPLE, IMAGE], [(9, "p", False), (8, "q", None)], None, [("generate", 9)]),
        ([OLD, SAMPLE], [(9, "p", True), (8, "q", None)], None, [("repost", 1)]),
        ([OLD, SAMPLE], [(9, "p", False)], False, [("repost", 1)]),
        ([OLD, SAMPLE], [(9, "p", False)], True, [("generate", 9)]),
        ([OLD, NEW], [(9, "p", False)], False, [("publish", 2)]),
        ([SAMPLE], [], None, []),
    ],
)
def test_next_post(spark, videos, products, succeeded, expected):
    assert choose(spark, videos, products, succeeded) == expected


def test_placeholders_leave_out_null_urls(spark):
    rows = spark.createDataFrame([OLD, IMAGE, (6, None, None, "x", None)], VIDEO)
    assert [r.id for r in V.placeholder_videos(rows).collect()] == [5]


def test_pages_are_disjoint_and_complete(small):
    videos = small.videos
    size = 400
    ids = []
    for page in range(5):
        ids += [r.id for r in V.feed_page(videos, page, size).collect()]
    assert len(ids) == len(set(ids)) == videos.count()
    assert ids[:10] == [r.id for r in V.latest_videos(videos).limit(10).collect()]


def test_draw_is_uniform_enough(spark):
    rows = spark.range(5)
    picks = [V.pick_one(rows, seed).first().id for seed in range(40)]
    assert set(picks) == set(range(5))
    assert V.pick_one(rows, 3).first() == V.pick_one(rows.repartition(3), 3).first()


def test_captions(spark):
    row = spark.range(1).select(
        social.video_captions(F.lit(None).cast("string"), F.lit("Nova"), F.lit("L")).alias("c")
    ).first()
    assert set(row.c) == {"instagram", "twitter", "tiktok", "pinterest"}
    assert row.c["twitter"].startswith("Obsessed with this null!") and row.c["twitter"].endswith("L")


def test_publish_state(one):
    def state(published, stored, new, pin):
        column = social.publish_state("p", "s", F.lit(new).cast("string"), F.lit(pin))
        return tuple(one(column, p=published, s=stored))

    assert state(False, None, "n", False) == (True, "n")
    assert state(False, "s", None, True) == (True, "s")
    assert state(False, "s", None, False) == (False, "s")


def test_cards_and_media(spark):
    rows = spark.createDataFrame(
        [(1, None, None, None, None), (2, "output_assets/x.mp4", "m", "i", "l")],
        "id BIGINT, url STRING, model_name STRING, item_name STRING, affiliate_link STRING",
    )
    cards = V.feed_card(rows, "http://h", item="Fashion Item", model="House").collect()
    assert tuple(cards[0]) == (1, "", "House", "Fashion Item", "")
    assert cards[1].url == "http://h/output_assets/x.mp4"
    assert [r.is_image for r in V.classify_media(rows).collect()] == [False, False]
