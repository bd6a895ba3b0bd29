"""Comments: link choice against brute force, payloads, replies."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vitrine.functions import payload, social
from vitrine.operators import comments as M
from vitrine.plans.replies import answer_comments

BASE = "https://base"
VIDEOS = (
    "id BIGINT, item_name STRING, affiliate_link STRING, instagram_post_id STRING, "
    "created_at STRING"
)
COMMENTS = (
    "comment_id STRING, platform STRING, post_id STRING, username STRING, comment_text STRING, "
    "received_at STRING"
)


def videos(spark, rows):
    return spark.createDataFrame(rows, VIDEOS).withColumn(
        "created_at", F.col("created_at").cast("timestamp")
    )


def comments(spark, rows):
    full = [(*r, "2024-01-01 00:00:00")[: 6] if len(r) == 5 else r for r in rows]
    return spark.createDataFrame(full, COMMENTS).withColumn(
        "received_at", F.col("received_at").cast("timestamp")
    )


def utf16(word):
    return len(word.encode("utf-16-be")) // 2


def brute_link(comment, vids):
    """The rule, one comment at a time."""
    _, platform, post, _, text = comment[:5]
    newest = sorted(vids, key=lambda v: (v[4] is not None, v[4] or "", v[0]), reverse=True)
    if platform.lower() == "instagram" and post:
        for v in newest:
            if v[3] == post:
                if v[2]:
                    return v[2]
                break
    lower = (text or "").lower()
    for v in newest:
        for word in (v[1] or "").lower().split():
            if utf16(word) > 3 and word in lower:
                return v[2]
    return newest[0][2] if newest else BASE


def check_links(spark, comment_rows, video_rows):
    chosen = M.choose_links(comments(spark, comment_rows), videos(spark, video_rows), BASE)
    got = {r.comment_id: r.product_link for r in chosen.collect()}
    assert got == {c[0]: brute_link(c, video_rows) for c in comment_rows}


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    words = ["ring", "gold", "silk", "top", "jacket", "jack", "wool", "x" * 90, "😀😀", "ab😀"]
    for _ in range(4):
        video_rows = [
            (
                i,
                None if rng.random() < 0.1 else " ".join(rng.sample(words, rng.randint(1, 3))),
                rng.choice([None, "", f"https://v{i}"]),
                rng.choice([None, f"post{rng.randint(0, 5)}"]),
                rng.choice([None, "2024-01-01 00:00:00", f"2024-01-0{rng.randint(1, 9)} 00:00:00"]),
            )
            for i in range(12)
        ]
        comment_rows = [
            (
                f"c{i}",
                rng.choice(["instagram", "Instagram", "tiktok"]),
                rng.choice([None, "", f"post{rng.randint(0, 7)}"]),
                "u",
                rng.choice([None, ""])
                if rng.random() < 0.2
                else "".join(
                    rng.choice([*words, "Bringing", "JACKETS", " ", "\n", "y" * 200, "é"])
                    for _ in range(rng.randint(1, 6))
                ),
            )
            for i in range(40)
        ]
        check_links(spark, comment_rows, video_rows)


def test_traps(spark):
    vids = [
        (1, "silver ring", "https://ring", "p1", "2024-01-01 00:00:00"),
        (2, "velvet coat", None, "p2", "2024-01-02 00:00:00"),
        (3, "cap", "https://cap", "p3", "2024-01-03 00:00:00"),
    ]
    rows = [
        ("a", "instagram", "p1", "u", "velvet"),  # by post
        ("b", "instagram", "p2", "u", "bringing"),  # post without link, then keyword
        ("c", "tiktok", "p1", "u", "VELVET!"),  # keyword of a video without link
        ("d", "tiktok", "p1", "u", "cap"),  # too short a word: newest
    ]
    got = {
        r.comment_id: r.product_link
        for r in M.choose_links(comments(spark, rows), videos(spark, vids), BASE).collect()
    }
    assert got == {"a": "https://ring", "b": "https://ring", "c": None, "d": "https://cap"}
    check_links(spark, rows, [])


def test_hot_post_and_hot_word(spark):
    vids = [(i, f"item{i} popular", f"https://v{i}", f"p{i}", "2024-01-01 00:00:00")
            for i in range(20)]
    rows = [
        (f"c{i}", "instagram" if i % 2 else "x", "p7" if i % 3 else None, "u", "popular item3")
        for i in range(300)
    ]
    check_links(spark, rows, vids)


def payload_of(one, platform, body):
    row = one(payload.normalize_webhook(F.lit(platform), "p"), p=json.dumps(body))
    return tuple(row)


@pytest.mark.parametrize(
    "platform, body, expected",
    [
        ("x", {"commentId": 5, "text": "hi"}, ("5", "unknown", "unknown", "hi")),
        ("x", {"entry": []}, ("unknown", "unknown", "unknown", "")),
        ("x", {"username": None}, ("unknown", "unknown", "null", "")),
        ("Instagram", {"commentId": "c", "postId": "p"}, ("c", "p", "unknown", "")),
        ("instagram", {"entry": []}, ("unknown", "unknown", "unknown", "")),
        ("instagram", {"entry": None, "commentId": "c"}, ("unknown", "unknown", "unknown", "")),
        (
            "instagram",
            {"entry": [{"changes": [{"value": {"text": "t"}}]}]},
            (None, "unknown", "unknown", "t"),
        ),
        (
            "instagram",
            {"entry": [{"changes": [{"value": {
                "id": "i", "text": "t", "from": {"username": "n"}, "media": {"id": "m"}}}]}]},
            ("i", "m", "n", "t"),
        ),
        (
            "instagram",
            {"entry": [{"changes": [{"value": {"id": "i", "from": {}, "media": {}}}]}]},
            ("i", None, None, None),
        ),
    ],
)
def test_webhooks(one, platform, body, expected):
    assert payload_of(one, platform, body) == expected


def test_channels(one):
    def channel(platform):
        return one(social.reply_channel(F.lit(platform), F.lit("bob"), F.lit("hey"), F.lit("L")))

    assert channel("pinterest").status == "queued" and channel("pinterest").channel is None
    assert channel("Unknown").status == "queued"
    assert channel("X").message == "@bob hey" and channel("X").status == "pending"
    assert channel("tiktok").message == "hey" and channel("tiktok").dm_text is None
    assert channel("Instagram").dm_text.endswith("item: L")


def test_replies_are_repeatable_and_varied(spark):
    rows = spark.range(200).select(
        social.reply_text("id", F.lit("LINK"), F.lit("x")).alias("a"),
        social.reply_text("id", F.lit("LINK"), F.lit("instagram")).alias("b"),
        social.reply_text("id", F.lit(None).cast("string"), F.lit("x")).alias("c"),
    )
    first, second = rows.collect(), rows.collect()
    assert first == second
    assert len({r.a for r in first}) == 8 and all(r.a.endswith("LINK") for r in first)
    assert len({r.b for r in first}) == 5 and not any("LINK" in r.b for r in first)
    assert all(r.c.endswith("null") for r in first)


def test_answers(spark):
    rows = comments(
        spark,
        [
            ("1", "x", None, " OWN ", "mine", "2024-01-01 00:00:00"),
            ("2", "x", None, None, "late copy", "2024-01-01 00:02:00"),
            ("2", "x", None, "a", "first", "2024-01-01 00:01:00"),
            ("3", "x", None, "b", "seen", "2024-01-01 00:01:00"),
            ("3", "y", None, "b", "other platform", "2024-01-01 00:01:00"),
        ],
    )
    history = spark.createDataFrame([("3", "x")], "comment_id STRING, platform STRING")
    got = answer_comments(rows, videos(spark, []), history, "own", BASE).collect()
    assert {(r.comment_id, r.platform, r.comment_text) for r in got} == {
        ("2", "x", "first"),
        ("3", "y", "other platform"),
    }
    assert all(r.status == "pending" and r.product_link == BASE for r in got)
