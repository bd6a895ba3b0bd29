"""Streams, small cases."""

import json
import time

from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.session import ROCKSDB, list_folders, run_dir, shared_dir
from vitrine.sources.models import latest_model, load_model
from vitrine.streaming import comments, ratings, signups, tasks
from vitrine.streaming.progress import ProgressListener


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))


def event(product, model, scene, task, kind, second):
    return {
        "product_id": product, "model_id": model, "scene": scene, "task_id": task, "kind": kind,
        "ts": f"2024-01-01T00:00:{second:02}Z",
    }


def test_task_state(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    source = tmp_path / "events"
    write(source, "1.json", [
        event("test_in_flight", "model_2", "scene_0", "task_vton_123", "started", 1),
        event("other", "model_1", "scene_0", "t0", "started", 1),
        event("other", "model_1", "scene_0", "t1", "started", 3),
        event("other", "model_1", "scene_0", "late", "started", 2),
    ])
    out, checkpoint = run_dir(spark, "out"), run_dir(spark, "checkpoint")

    def run():
        stream = spark.readStream.schema(schemas.TASK_EVENT).json(str(source))
        query = (
            tasks.track_tasks(stream).writeStream.format("parquet")
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        )
        query.awaitTermination()
        rows = spark.read.parquet(out).collect()
        return {(r.product_id, r.model_id, r.scene, r.task_id, r.open) for r in rows}

    opened = {
        ("test_in_flight", "model_2", "scene_0", "task_vton_123", True),
        ("other", "model_1", "scene_0", "t1", True),
    }
    assert run() == opened
    write(source, "2.json", [event("other", None, None, None, "finished", 9),
                             event("other", "model_1", "scene_1", "stale", "started", 5)])
    assert run() == opened | {("other", "model_1", "scene_0", "t1", False)}
    events = spark.read.schema(schemas.TASK_EVENT).json(str(source))
    assert [r.task_id for r in tasks.open_tasks(events).collect()] == ["task_vton_123"]


def test_task_state_goes_by_event_time(spark, tmp_path):
    """Open tasks are given up and finishes forgotten once the watermark has passed them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    source, out, checkpoint = tmp_path / "events", run_dir(spark, "out"), run_dir(spark, "checkpoint")

    def run():
        stream = spark.readStream.schema(schemas.TASK_EVENT).json(str(source))
        tracked = tasks.track_tasks(stream, shards=2, keep_ms=20_000, late="5 seconds")
        query = (
            tracked.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(out)
        )
        assert query.awaitTermination(120)
        state = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        return {(r.product_id, r.scene, r.task_id, r.open) for r in spark.read.parquet(out).collect()}, state[-1]

    write(source, "1.json", [
        event("a", "m", "s1", "t1", "started", 1), event("b", "m", "s1", "t2", "started", 2),
        event("b", None, None, None, "finished", 4),
    ])
    opened = {("a", "s1", "t1", True)}
    rows, state = run()
    assert rows == opened and state > 0
    # within the watermark a late start is still told to be over
    write(source, "2.json", [event("b", "m", "s2", "t3", "started", 3), event("a", "m", "s2", "t4", "started", 8)])
    opened |= {("a", "s2", "t4", True)}
    assert run()[0] == opened
    write(source, "3.json", [event("c", None, None, None, "finished", 50)])
    rows, state = run()
    assert rows == opened | {("a", "s1", "t1", False), ("a", "s2", "t4", False)}
    write(source, "4.json", [{**event("d", None, None, None, "finished", 0), "ts": "2024-01-01T00:05:00Z"}])
    write(source, "5.json", [{**event("d", None, None, None, "finished", 0), "ts": "2024-01-01T00:04:00Z"}])
    rows, last = run()
    assert rows == opened | {("a", "s1", "t1", False), ("a", "s2", "t4", False)}
    # both times only the newest finish is left: a, b and later c are gone
    assert last == state


def test_comment_stream_is_repeatable(spark, tmp_path):
    source = tmp_path / "hooks"

    def hook(n, minute):
        return {
            "platform": "x",
            "payload": json.dumps({"commentId": f"c{n}", "username": "u", "text": "hello"}),
            "received_at": f"2024-01-01T00:{minute:02}:00Z",
        }

    videos = spark.createDataFrame([], schemas.VIDEO)
    store, checkpoint = run_dir(spark, "store"), run_dir(spark, "checkpoint")

    def run(where=checkpoint):
        stream = spark.readStream.schema(schemas.WEBHOOK).json(str(source))
        comments.run_comment_stream(
            stream, videos, store, where, "own", "https://base", once=True
        ).awaitTermination()
        return sorted(r.comment_id for r in comments.stored_comments(spark, store).collect())

    write(source, "1.json", [hook(1, 1), hook(2, 2), hook(1, 3)])
    assert run() == ["c1", "c2"]
    write(source, "2.json", [hook(2, 4), hook(3, 5)])
    assert run() == ["c1", "c2", "c3"]
    before = list_folders(spark, shared_dir(spark))
    process = comments.comment_batch(spark, videos, store, "own", "https://base")
    again = spark.read.schema(schemas.WEBHOOK).json(str(source / "2.json"))
    process(again, 1)
    assert sorted(r.comment_id for r in comments.stored_comments(spark, store).collect()) == [
        "c1", "c2", "c3"
    ]
    # intermediates go with the batch
    assert list_folders(spark, shared_dir(spark)) == before
    own = [r.bucket for r in comments.with_bucket(spark.createDataFrame(
        [("x", "c1")], "platform STRING, comment_id STRING")).collect()]
    history = comments.stored_comments(spark, store, before=9, buckets=own)
    assert [r.comment_id for r in history.collect()] == ["c1"]
    # only the folders of the batch's own buckets are read
    scan = history._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]


def test_ratings_train_once_enough_have_come(spark):
    rows = [(u, p, float(1 + (u * p) % 5)) for u in range(8) for p in range(1, 6)]
    schema = "user INT, product INT, rating DOUBLE"
    model, store, recs = (run_dir(spark, n) for n in ("model", "store", "recs"))
    handle = ratings.rating_batch(spark, model, store, recs, min_rows=10)
    handle(spark.createDataFrame(rows[:5], schema), 0)
    assert load_model(spark, model) is None and ratings.stored_recs(spark, recs) is None
    handle(spark.createDataFrame(rows[5:], schema), 1)
    first = latest_model(spark, model)
    assert first["version"] == 1
    users = {r.user_id for r in ratings.stored_recs(spark, recs).collect()}
    assert users <= set(range(8)) and len(users) > 4
    # too few new ratings: no training, and only the batch's user is renewed
    handle(spark.createDataFrame([(3, 2, 4.0)], schema), 2)
    assert latest_model(spark, model)["version"] == 1
    log = spark.read.parquet(f"{recs}/commits").where("version = 2")
    assert log.count() == 1
    assert {r.user_id for r in ratings.stored_recs(spark, recs).collect()} == users


def test_signups_and_progress(spark, tmp_path):
    source = tmp_path / "users"
    write(source, "1.json", [{"id": 5}, {"id": 6}])
    listener = ProgressListener()
    spark.streams.addListener(listener)
    try:
        out, checkpoint = run_dir(spark, "seeds"), run_dir(spark, "checkpoint")
        stream = spark.readStream.schema("id BIGINT").json(str(source)).observe(
            "signups", F.count(F.lit(1)).alias("rows")
        )
        signups.run_signup_seed_stream(stream, out, checkpoint, once=True).awaitTermination()
        for _ in range(50):
            if any(kind == "ended" for kind, _ in listener.events):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    seeds = spark.read.schema("user INT, rating DOUBLE").json(out).collect()
    assert sorted((r.user, r.rating) for r in seeds) == [(5, 0.0), (6, 0.0)]
    kinds = [kind for kind, _ in listener.events]
    assert kinds[0] == "started" and kinds[-1] == "ended"
    seen = [d["metrics"]["signups"]["rows"] for k, d in listener.events
            if k == "progress" and d["metrics"]]
    assert sum(seen) == 2
