"""Cases that earlier forms of these steps got wrong or slow."""

import time

from pyspark.sql import functions as F

from vitrine.operators import content, news, upsert


def test_resume_state_takes_null_scenes_and_equal_times(spark):
    requests = spark.createDataFrame([("p", "m", 2), ("q", "m", 2)], "product_id STRING, model_id STRING, scene_count INT")
    cache = spark.createDataFrame([], "product_id STRING, model_id STRING, vton_image STRING, storyboard_images ARRAY<STRING>")
    rows = [
        ("p", "m", "s1", "t1", 5), ("p", "m", "s1", "t3", 5), ("p", "m", "s1", "t2", 5), ("p", "m", None, "t9", 9),
        ("p", "m", "s2", None, 9), ("p", "m", "s2", "t4", None),
    ]
    inflight = spark.createDataFrame(rows, "product_id STRING, model_id STRING, scene STRING, task_id STRING, ts INT")
    for repeated in (inflight, inflight.orderBy(F.desc("task_id")).repartition(3)):
        found = {r.product_id: r.open_tasks for r in content.resume_state(requests, cache, repeated).collect()}
        assert found == {"p": {"s1": "t3", "s2": "t4"}, "q": None}


def test_long_galleries_keep_first_places(spark):
    """20 000 images of a page; each image once, in the order of the page."""
    token = lambda i: f"{i % 7001:024x}"
    urls = [f"https://assets.vogue.com/photos/{token(i * 13)}/w_{i}/a.jpg" for i in range(20_000)]
    html = "".join(f'<img src="{u}">' for u in urls)
    row = spark.createDataFrame([(1, None, "https://www.vogue.com/x", html, None)], "id INT, m STRING, l STRING, h STRING, d STRING")
    start = time.monotonic()
    found = news.gallery(row, "m", "l", "h", "d").first()["gallery"]
    took = time.monotonic() - start
    assert [u.split("/")[4] for u in found] == list(dict.fromkeys(u.split("/")[4] for u in urls))
    assert len(found) == 7001 and took < 30


def test_latest_changes_with_ties_and_maps(spark):
    rows = [(1, 5, 9, {"a": "x"}), (1, 5, 10, {"a": "b"}), (1, 4, 99, None), (2, None, 1, None), (2, None, 1, {"z": "1"})]
    changes = spark.createDataFrame(rows, "k INT, at INT, n INT, m MAP<STRING, STRING>")
    for spread in (changes, changes.repartition(5)):
        found = {r.k: (r.n, r.m) for r in upsert.latest_changes(spread, ["k"], ["at"]).collect()}
        assert found == {1: (10, {"a": "b"}), 2: (1, {"z": "1"})}
    assert upsert.latest_changes(changes.select("k").distinct(), ["k"], ["k"]).count() == 2
