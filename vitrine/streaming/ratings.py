"""Rating stream: store, train, keep the better model, recommend."""

from pyspark.sql import functions as F

from ..operators.factors import add_sums, normal_sums, solve_sums, top_items
from ..operators.ratings import (
    STREAM_PARAMS,
    flatten_recs,
    split_ratings,
    train_als,
)
from ..operators.upsert import read_current, read_keys, write_upsert
from ..plans.recommendations import champion_challenger
from ..schemas import RATING
from ..session import materialize, read_if_present, scratch
from ..sources.models import latest_model, load_model

# Rows a batch must exceed, trigger, and recommendations kept per user.
MIN_ROWS = 10
TRIGGER = "10 seconds"
TOP = 100
TRAINED = "batch_id BIGINT"


def batch_gate(batch, min_rows=MIN_ROWS):
    """True when the batch holds more than ``min_rows`` rows; reads no more than needed."""
    return batch.limit(min_rows + 1).count() > min_rows


def precompute_recs(model, n=TOP):
    """Flat top ``n`` of every user, exact, without trying all products."""
    return flatten_recs(top_items(model.userFactors, model.itemFactors, n)[0])


def recommendations_of(model, users, n=TOP):
    """Top ``n`` of the given users only."""
    return model.recommendForUserSubset(users.select("user").distinct(), n)


def stored_recs(spark, recs_path):
    """The flat recommendations as last committed, or None."""
    table = read_current(spark, recs_path)
    return None if table is None else flatten_recs(table)


def _trained_until(spark, model_dir):
    log = read_if_present(spark, f"{model_dir}/trained", TRAINED)
    last = None if log is None else log.agg(F.max("batch_id")).first()[0]
    return -1 if last is None else last


def rating_batch(spark, model_dir, store, recs_path, params=None, min_rows=MIN_ROWS):
    """Handler of one micro-batch.

    Every batch is stored under its id, so a repeated batch replaces itself. Training
    uses all stored ratings and runs once more than ``min_rows`` have come since the
    last training; give a stream with a long history a larger number. Other batches
    only renew the recommendations of their own users. Recommendations are a
    versioned table by user.
    """

    def handle(batch, batch_id):
        batch.na.drop().write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")
        stored = spark.read.schema(RATING + ", batch_id BIGINT").parquet(store)
        stored = stored.where(F.col("batch_id") <= batch_id)
        fresh = stored.where(F.col("batch_id") > _trained_until(spark, model_dir))
        if batch_gate(fresh, min_rows):
            ratings = stored.select("user", "product", "rating").persist()
            try:
                training, test = split_ratings(ratings)
                model = train_als(training, params or STREAM_PARAMS)
                saved = champion_challenger(spark, model, test, model_dir)["version"]
            finally:
                ratings.unpersist()
            mark = spark.createDataFrame([(batch_id,)], TRAINED).coalesce(1)
            mark.write.mode("append").parquet(f"{model_dir}/trained")
        else:
            saved = None
        best = load_model(spark, model_dir)
        if best is not None:
            # a new model renews all users, otherwise only those of the batch have changed
            own = stored.where(F.col("batch_id") == batch_id)
            if saved:
                recs, _ = top_items(best.userFactors, best.itemFactors, TOP)
            else:
                recs = recommendations_of(best, own, TOP)
            write_upsert(spark, recs_path, recs, ["user"])

    return handle


def stored_ratings(spark, store, until):
    """Ratings of the stored batches up to one, in long form of the batch number."""
    stored = spark.read.schema(RATING + ", batch_id BIGINT").parquet(store)
    return stored.where(F.col("batch_id") <= until)


def sums_of(spark, sums_path, version):
    """Where the sums of the users against one model's products are kept."""
    return f"{sums_path}/model={version}"


def _dated(sums, batch_id):
    return sums.withColumn("batch_id", F.lit(batch_id).cast("bigint"))


def fold_in_batch(spark, model_dir, store, sums_path, factors_path, recs_path, params=None, n=TOP):
    """Handler of one micro-batch that trains nothing.

    The batch's ratings are added to the stored sums of its users (``normal_sums``), their
    factors are solved anew against the products' factors of the stored model, and their
    best products follow from these. Read are the batch and its users' buckets of the sums,
    not the history. Sums name the last batch they hold, so a repeated batch adds nothing.
    A new model (``train_stored``) has sums of its own: the first batch after it takes them
    once from the stored ratings before it. Sums, factors and recommendations are versioned tables by user.
    """
    reg = (params or STREAM_PARAMS)["regParam"]

    def handle(batch, batch_id):
        batch.na.drop().write.mode("overwrite").parquet(f"{store}/batch_id={batch_id}")
        model = load_model(spark, model_dir)
        if model is None:
            return
        with scratch(spark):
            kept = sums_of(spark, sums_path, latest_model(spark, model_dir)["version"])
            if read_current(spark, kept) is None:
                before = stored_ratings(spark, store, batch_id - 1)
                history = normal_sums(before, model.itemFactors, model.rank)
                write_upsert(spark, kept, _dated(history, batch_id - 1), ["user"])
            own = spark.read.schema(RATING).parquet(f"{store}/batch_id={batch_id}")
            fresh = materialize(normal_sums(own, model.itemFactors, model.rank), "fresh")
            known = read_keys(spark, kept, fresh, ["user"])
            if known is not None:
                known = known.select("user", F.col("sums").alias("old"), F.col("batch_id").alias("held"))
                done = F.col("held") >= batch_id
                added = F.when(done, F.col("old")).otherwise(add_sums(F.col("sums"), F.col("old")))
                fresh = fresh.join(known, "user", "left").select(
                    "user", F.when(F.col("held").isNull(), F.col("sums")).otherwise(added).alias("sums")
                )
            now = materialize(_dated(fresh, batch_id), "sums")
            write_upsert(spark, kept, now, ["user"])
            factors = materialize(solve_sums(now, model.rank, reg), "factors")
            write_upsert(spark, factors_path, factors, ["id"])
            recs, _ = top_items(factors, model.itemFactors, n)
            write_upsert(spark, recs_path, recs, ["user"])

    return handle


def train_stored(spark, model_dir, store, params=None):
    """Full training on all stored ratings, as a job of its own next to ``fold_in_batch``; the
    better model is kept. Returns what ``champion_challenger`` does."""
    ratings = spark.read.schema(RATING + ", batch_id BIGINT").parquet(store)
    ratings = ratings.select("user", "product", "rating").persist()
    try:
        training, test = split_ratings(ratings)
        model = train_als(training, params or STREAM_PARAMS)
        return champion_challenger(spark, model, test, model_dir)
    finally:
        ratings.unpersist()


def run_rating_stream(stream, model_dir, store, recs_path, checkpoint, once=False, **options):
    handle = rating_batch(stream.sparkSession, model_dir, store, recs_path, **options)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": TRIGGER}
    return writer.trigger(**trigger).start()


def run_fold_in_stream(stream, model_dir, store, sums_path, factors_path, recs_path, checkpoint,
                       once=False, **options):
    handle = fold_in_batch(stream.sparkSession, model_dir, store, sums_path, factors_path, recs_path, **options)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": TRIGGER}
    return writer.trigger(**trigger).start()
