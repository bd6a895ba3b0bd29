"""The kept link index, filters of stored keys, and merging of the comment store."""

import pytest
from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.operators import comments as M
from vitrine.operators.links import KeptLinks, update_links
from vitrine.operators.membership import build_filter, merge_filters, might_contain
from vitrine.plans.replies import answer_comments
from vitrine.session import list_folders, run_dir
from vitrine.streaming import comments as S


def test_filter_finds_every_key_and_few_others(spark):
    known = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("a"), (F.col("id") % 3).alias("b"))
    odd = spark.createDataFrame([(None, 1), ("x", None), (None, None), ("", 0)], "a STRING, b BIGINT")
    first = build_filter(known, ["a", "b"], 4)
    both = merge_filters(first.unionByName(build_filter(odd, ["a", "b"], 4)))
    assert both.count() == 4
    every = known.unionByName(odd)
    assert might_contain(every, ["a", "b"], both, 4).count() == 3004
    others = spark.range(3000).select(F.concat(F.lit("z"), "id").alias("a"), F.lit(0).cast("bigint").alias("b"))
    assert might_contain(others, ["a", "b"], both, 4).count() < 60
    by = build_filter(known.withColumn("part", F.col("b")), ["a", "b"], 4, by=["part"])
    hits = might_contain(known, ["a", "b"], by, 4)
    assert hits.where("part = b").count() == 3000 and hits.count() < 3300


@pytest.fixture(scope="module")
def replies(spark, small):
    videos = small.videos.select("id", "affiliate_link", "item_name", "instagram_post_id", "created_at").persist()
    return small.comments.persist(), videos


def answers(rows):
    return sorted(rows.select("comment_id", "platform", "product_link", "reply_text").collect())


def test_index_answers_as_all_videos_do(spark, replies):
    comments, videos = replies
    index = run_dir(spark, "index")
    history = spark.createDataFrame([], schemas.COMMENT)
    kept = KeptLinks(spark, index)
    empty = answers(answer_comments(comments, kept, history, "ownhandle", "https://base"))
    assert empty == answers(answer_comments(comments, videos.limit(0), history, "ownhandle", "https://base"))
    for part in range(3):  # videos arrive in parts, some of them twice
        update_links(spark, index, videos.where((F.col("id") % 3 == part) | (F.col("id") % 50 == 0)), M.MIN_WORD)
    want = answers(answer_comments(comments, videos, history, "ownhandle", "https://base"))
    assert answers(answer_comments(comments, kept, history, "ownhandle", "https://base")) == want
    assert len({r.product_link for r in want}) > 3
    # a changed link replaces the one known
    newest = videos.orderBy(F.desc("created_at"), F.desc("id")).limit(1)
    changed = newest.withColumn("affiliate_link", F.lit("a new link"))
    update_links(spark, index, changed, M.MIN_WORD)
    found = kept._find(spark.createDataFrame([("n:",)], "key STRING")).first()["video"]
    assert found["affiliate_link"] == "a new link"


def test_a_batch_opens_only_buckets_of_its_own_keys(spark, replies):
    _, videos = replies
    index = run_dir(spark, "index")
    named = spark.range(3000).select(
        F.col("id"), F.lit("l").alias("affiliate_link"), F.concat(F.lit("thing"), "id").alias("item_name"),
        F.concat(F.lit("post"), "id").alias("instagram_post_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"),
    )
    update_links(spark, index, named, M.MIN_WORD)
    kept = KeptLinks(spark, index)
    pieces = spark.createDataFrame([("thing17",), ("thing2999",), ("absent",), ("hing17",)], "word STRING")
    words = kept.words(pieces)
    assert {r["word"] for r in words.collect()} == {"thing17", "thing2999"}
    every = spark.read.parquet(f"{index}/entries/rows").inputFiles()
    assert len(words.inputFiles()) <= 4 and len(every) > 200
    assert videos is not None


def hook(n, batch):
    return ("x", f'{{"commentId": "c{n}", "username": "u", "text": "hello {n}"}}', f"2024-01-01T00:{batch:02}:00Z")


def test_folders_stay_few_and_answers_right(spark):
    """20 batches, each with a repeat from long ago, merged by fours."""
    store = run_dir(spark, "store")
    videos = spark.createDataFrame([], schemas.VIDEO)
    process = S.comment_batch(spark, videos, store, "own", "https://base", fan=4)
    most = 0
    for batch in range(20):
        hooks = [hook(3 * batch + i, batch) for i in range(3)] + [hook(batch, batch), hook(0, batch)]
        rows = spark.createDataFrame(hooks, "platform STRING, payload STRING, received_at STRING")
        rows = rows.withColumn("received_at", F.to_timestamp("received_at"))
        process(rows, batch)
        if batch % 7 == 3:
            process(rows, batch)  # repeated
        live = S.live_folders(spark, store)
        most = max(most, len(live))
        assert sorted(x for a, b in live for x in range(a, b + 1)) == list(range(batch + 1))
    assert most <= 7
    assert len(list_folders(spark, store)) <= most + 5 and len(list_folders(spark, f"{store}-filters")) <= most + 5
    found = S.stored_comments(spark, store).collect()
    assert sorted(r.comment_id for r in found) == sorted(f"c{n}" for n in range(60))
    assert {r.comment_id: r.received_at.minute for r in found} == {f"c{n}": n // 3 for n in range(60)}
    # keys that no folder holds open nothing, known ones only their own places
    keys = lambda *names: spark.createDataFrame([(n, "x") for n in names], "comment_id STRING, platform STRING")
    assert S.likely_history(spark, store, keys("new1", "new2"), 20).inputFiles() == []
    some = S.likely_history(spark, store, keys("c1", "new3"), 20)
    assert "c1" in {r.comment_id for r in some.collect()} and len(some.inputFiles()) == 1


def test_an_unfinished_merge_does_not_count(spark):
    store = run_dir(spark, "store")
    row = spark.createDataFrame([("c1", "x")], "comment_id STRING, platform STRING")
    every = spark.createDataFrame([], schemas.COMMENT).unionByName(row, allowMissingColumns=True)
    S.store_rows(spark, every, store, "batch_id=0")
    every.write.parquet(f"{store}/batch_id=0-3/bucket=1")  # no mark of its own: the run died
    assert S.live_folders(spark, store) == {(0, 0): "batch_id=0"}
