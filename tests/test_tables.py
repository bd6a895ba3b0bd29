"""Upserts, models, connectors, sinks."""

import pytest
from pyspark.sql import functions as F

from vitrine.operators import ratings as R
from vitrine.operators import upsert as K
from vitrine.plans import recommendations as P
from vitrine.session import delete_folder, list_folders, run_dir, shared_dir
from vitrine.sources import files, jdbc, sinks
from vitrine.sources.models import latest_model, load_model


def table(spark, rows):
    return spark.createDataFrame(rows, "id BIGINT, value STRING")


def test_upsert_versions(spark):
    path = run_dir(spark, "t")
    assert K.read_current(spark, path) is None
    assert K.write_upsert(spark, path, table(spark, []), ["id"]) == 0
    assert K.read_current(spark, path) is None
    first = table(spark, [(i, "a") for i in range(50)])
    assert K.write_upsert(spark, path, first, ["id"], buckets=8) == 1
    assert K.write_upsert(spark, path, table(spark, [(3, "b"), (99, "c")]), ["id"], buckets=8) == 2
    assert K.write_upsert(spark, path, table(spark, []), ["id"], buckets=8) == 2
    got = {r.id: r.value for r in K.read_current(spark, path).collect()}
    assert len(got) == 51 and got[3] == "b" and got[99] == "c" and got[4] == "a"


def test_half_written_version_does_not_count(spark):
    path = run_dir(spark, "t")
    K.write_upsert(spark, path, table(spark, [(1, "a"), (2, "a")]), ["id"], buckets=2)
    lost = table(spark, [(1, "lost")]).withColumn("bucket", F.lit(0))
    lost.write.partitionBy("bucket").parquet(f"{path}/rows/version=2")
    assert {r.value for r in K.read_current(spark, path).collect()} == {"a"}
    K.write_upsert(spark, path, table(spark, [(1, "b")]), ["id"], buckets=2)
    assert {(r.id, r.value) for r in K.read_current(spark, path).collect()} == {(1, "b"), (2, "a")}


def test_bucket_count_is_kept_and_can_change(spark):
    path = run_dir(spark, "t")
    K.write_upsert(spark, path, table(spark, [(i, "a") for i in range(20)]), ["id"], buckets=8)
    K.write_upsert(spark, path, table(spark, [(i, "b") for i in range(0, 20, 2)]), ["id"])
    assert K.read_current(spark, path).count() == 20
    K.write_upsert(spark, path, table(spark, [(i, "c") for i in range(0, 20, 5)]), ["id"], buckets=32)
    got = {r.id: r.value for r in K.read_current(spark, path).collect()}
    want = {i: "c" if i % 5 == 0 else "b" if i % 2 == 0 else "a" for i in range(20)}
    assert got == want and K.read_current(spark, path).count() == 20
    assert K.remove_superseded(spark, path) > 0
    assert {r.id: r.value for r in K.read_current(spark, path).collect()} == want
    assert list_folders(spark, f"{path}/rows") == ["version=3"]
    assert K.remove_superseded(spark, path) == 0


def test_null_keys_replace_each_other(spark):
    path = run_dir(spark, "t")
    K.write_upsert(spark, path, table(spark, [(None, "a"), (1, "a")]), ["id"])
    K.write_upsert(spark, path, table(spark, [(None, "b")]), ["id"])
    assert {(r.id, r.value) for r in K.read_current(spark, path).collect()} == {(None, "b"), (1, "a")}


def test_missing_log_never_leads_to_an_overwrite(spark):
    path = run_dir(spark, "t")
    K.write_upsert(spark, path, table(spark, [(i, "a") for i in range(20)]), ["id"])
    delete_folder(spark, f"{path}/commits")
    with pytest.raises(RuntimeError):
        K.write_upsert(spark, path, table(spark, [(1, "b")]), ["id"])
    with pytest.raises(RuntimeError):
        K.read_current(spark, path)
    assert spark.read.parquet(f"{path}/rows").count() == 20


def test_dead_first_write_can_be_repeated(spark):
    path = run_dir(spark, "t")
    spark.createDataFrame([], K.COMMIT).write.parquet(f"{path}/commits")
    table(spark, [(1, "lost")]).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(
        f"{path}/rows/version=1"
    )
    assert K.read_current(spark, path) is None
    assert K.write_upsert(spark, path, table(spark, [(1, "a")]), ["id"]) == 1
    assert [r.value for r in K.read_current(spark, path).collect()] == ["a"]


def test_repeated_keys_need_an_order(spark):
    path = run_dir(spark, "t")
    rows = [(1, "b"), (1, "c"), (1, "a"), (2, "z")]
    with pytest.raises(ValueError):
        K.write_upsert(spark, path, table(spark, rows), ["id"])
    for parts in (1, 2, 4):
        K.write_upsert(spark, path, table(spark, rows).repartition(parts), ["id"], order=["value"])
        assert {(r.id, r.value) for r in K.read_current(spark, path).collect()} == {(1, "c"), (2, "z")}
    left = [f for f in list_folders(spark, shared_dir(spark)) if f.startswith("changes-")]
    assert left == []


def test_untouched_buckets_are_not_rewritten(spark):
    path = run_dir(spark, "t")
    rows = table(spark, [(i, "a") for i in range(100)])
    K.write_upsert(spark, path, rows, ["id"], buckets=16)
    K.write_upsert(spark, path, table(spark, [(5, "b")]), ["id"], buckets=16)
    second = spark.read.parquet(f"{path}/rows/version=2").select("bucket").distinct().count()
    assert second == 1


class Session:
    """Just enough of a session to ask for its folder."""

    def __init__(self, setting, master):
        self.setting, self.master, self.folder = setting, master, None
        self.conf = self.sparkContext = self

    def get(self, key, default):
        return self.setting or default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(Session("hdfs://n/place/", "spark://m")) == "hdfs://n/place"
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared_dir(Session(None, "spark://m"))
    local = Session(None, "local[2]")
    assert shared_dir(local) == shared_dir(local) == local.folder
    assert run_dir(spark, "a") != run_dir(spark, "a")


def rating_rows(spark):
    """Two tastes: even users like even products."""
    return spark.range(30 * 20).select(
        (F.col("id") % 30).cast("int").alias("user"),
        F.floor(F.col("id") / 30).cast("int").alias("product"),
    ).withColumn("rating", F.when((F.col("user") + F.col("product")) % 2 == 0, 5.0).otherwise(1.0))


def test_models(spark):
    path = run_dir(spark, "model")
    assert load_model(spark, path) is None
    ratings = rating_rows(spark).persist()
    model = R.train_als(ratings)
    first = P.champion_challenger(spark, model, ratings, path)
    assert first["version"] == 1 and first["old"] is None
    weak = R.train_als(ratings, {"maxIter": 1, "regParam": 20.0, "rank": 1})
    assert P.champion_challenger(spark, weak, ratings, path)["version"] is None
    strong = R.train_als(ratings, {"maxIter": 10, "regParam": 0.01, "rank": 4})
    assert P.champion_challenger(spark, strong, ratings, path)["version"] == 2
    assert latest_model(spark, path)["version"] == 2
    mean = ratings.withColumn("prediction", F.lit(3.0))
    assert R.rmse_value(R.score(load_model(spark, path), ratings)) < R.rmse_value(mean)
    nothing = ratings.select(F.lit(999).alias("user"), "product", "rating")
    outcome = P.champion_challenger(spark, model, nothing, path)
    assert outcome["new"] is None and outcome["version"] is None


def test_recommendations(spark):
    model = R.train_als(rating_rows(spark))
    top = R.recommend_user(model, 4, 3).first()
    assert top.user == 4 and len(top.recommendations) == 3
    scores = [r.rating for r in top.recommendations]
    assert scores == sorted(scores, reverse=True)
    everyone = R.recommend_all(model, 5)
    assert everyone.count() == 30 and R.flatten_recs(everyone).count() == 150
    repeated = [r.product_id for r in R.top_products_global(everyone).collect()]
    single = [r.product_id for r in R.top_products_global(everyone, distinct=True).collect()]
    assert len(repeated) == 10 and len(set(single)) == len(single) == 10


def test_split_is_stable(spark):
    ratings = rating_rows(spark).withColumn("id", F.monotonically_increasing_id())
    sides = [R.split_ratings(r) for r in (ratings, ratings.repartition(7))]
    rows = [sorted(s[0].drop("id").collect()) for s in sides]
    share = sides[0][0].count() / ratings.count()
    assert 0.7 < share < 0.9
    assert len(rows[0]) + sides[0][1].count() == ratings.count()


def test_dense_ids(spark):
    wide = spark.range(1000).select((F.col("id") * 10**12).alias("key"))
    rows = R.dense_ids(wide.unionByName(wide), "key", "dense").orderBy("key").collect()
    assert [r.dense for r in rows] == list(range(1000))


def test_seeds(spark):
    users = spark.createDataFrame([(1,), (2,)], "id BIGINT")
    given = spark.createDataFrame([(1, 7, 5.0), (1, 7, 3.0)], "user INT, product INT, rating DOUBLE")
    pairs = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (3, 7)], "user INT, product INT")
    got = R.seeded_ratings(pairs, given, R.seed_users(users)).collect()
    assert sorted(tuple(r) for r in got) == [
        (1, 7, 3.0), (1, 7, 5.0), (1, 8, 0.0), (2, 7, 0.0)
    ]


def test_connector_options():
    options = jdbc.read_options("jdbc:x", "product", user="u", password="p")
    assert options == {
        "url": "jdbc:x", "dbtable": "product", "fetchsize": "1000", "user": "u", "password": "p"
    }
    assert jdbc.split_options("id", 0, 100, 4)["numPartitions"] == "4"
    assert files.kafka_options("h:1", "t", "earliest") == {
        "kafka.bootstrap.servers": "h:1", "subscribe": "t", "startingOffsets": "earliest"
    }
    assert "startingOffsets" not in files.kafka_options("h:1", "t")


def test_high_water_mark(spark):
    rows = spark.createDataFrame([("2024-01-02",), ("2024-01-01",)], "update_at STRING")
    assert jdbc.high_water_mark(rows).first().mark == "2024-01-02"


def test_batches_to_a_service(spark, tmp_path):
    folder = str(tmp_path)

    def factory():
        import json
        import uuid

        def send(batch):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
                json.dump(batch, out)

        return send

    sinks.send_in_batches(spark.range(25).coalesce(1), factory)
    import json

    sizes = sorted(len(json.loads(f.read_text())) for f in tmp_path.iterdir())
    assert sizes == [5, 10, 10]


def test_asset_cache(spark, tmp_path):
    (tmp_path / "cache_p1.json").write_text(
        '{"model_1": {"vton_image": "i", "storyboard_images": ["a", "b"]}, "model_2": {}}'
    )
    (tmp_path / "cache_p2.json").write_text("{cut")
    rows = files.scan_asset_cache(spark, f"{tmp_path}/*.json").collect()
    assert {(r.product_id, r.model_id, r.vton_image) for r in rows} == {
        ("p1", "model_1", "i"), ("p1", "model_2", None)
    }


def test_images_from_files(spark, tmp_path):
    (tmp_path / "a.gif").write_bytes(b"GIF89a" + bytes([3, 0, 4, 0]))
    (tmp_path / "b.gif").write_bytes(b"not an image")
    from vitrine.operators.images import valid_images

    images = files.scan_images(spark, str(tmp_path))
    rows = images.select(F.col("path").alias("image_path"))
    kept = valid_images(rows, images).collect()
    assert [r.image_path.rsplit("/", 1)[1] for r in kept] == ["a.gif"]


@pytest.mark.parametrize("n", [10, 11])
def test_gate(spark, n):
    from vitrine.streaming.ratings import batch_gate

    assert batch_gate(spark.range(n)) is (n > 10)
