"""Streams run to the end over landed files, compared with the batch answer."""

from pyspark.sql import functions as F

from vitrine import schemas
from vitrine.operators.ratings import train_als
from vitrine.operators.tagging import KeywordTagger
from vitrine.operators.upsert import read_current
from vitrine.session import ROCKSDB, materialize, run_dir
from vitrine.sources.files import scan_interactions, stream_ratings
from vitrine.sources.models import latest_model, save_model
from vitrine.streaming import comments, enrichment, ratings, signups, tasks

from .base import check, stamp
from .catalog import TAGGED
from .comments import ANSWERS, BASE, HANDLE, LINKED, N
from .interactions import DECODED, log_text, shown
from .ratings import RATED, SOLVED, bought, part_factors, rated, rounded_factors


def landed(df, name, kind="json"):
    """Rows written as they are spread."""
    path = run_dir(df.sparkSession, name)
    df.write.format(kind).save(path)
    return path


def folders(t, *names):
    return [run_dir(t.spark, n) for n in names]


@check("stream_interactions", DECODED, "interactions")
def stream_interactions(t):
    """The interaction log read as a stream."""
    from vitrine.operators.interactions import fill_interaction_nulls

    source = landed(log_text(t), "log", kind="text")
    out, checkpoint = folders(t, "out", "checkpoint")
    stream = fill_interaction_nulls(scan_interactions(t.spark, source, mode="stream"))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return shown(t.spark.read.parquet(out))


@check(
    "stream_ratings",
    f'SELECT CAST("user" AS INTEGER) AS "user", CAST(product AS INTEGER) AS product, rating '
    f"FROM ({RATED})",
    "interactions",
)
def read_ratings(t):
    source = landed(rated(t, keep=()), "ratings")
    out, checkpoint = folders(t, "out", "checkpoint")
    query = (
        stream_ratings(t.spark, source, files_per_trigger=2)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    return t.spark.read.parquet(out)


@check(
    "rating_stream",
    f"""
    SELECT true AS some_users, true AS known_users, true AS known_products, true AS descending,
      CAST(count(*) AS BIGINT) AS stored
    FROM ({RATED})""",
    "interactions",
)
def rating_stream(t):
    """Ratings stored, model kept, top products of every user written."""
    source = landed(rated(t, keep=()), "ratings")
    model, store, recs, checkpoint = folders(t, "model", "store", "recs", "checkpoint")
    query = ratings.run_rating_stream(
        stream_ratings(t.spark, source, files_per_trigger=2), model, store, recs, checkpoint,
        once=True,
    )
    query.awaitTermination()
    rows = rated(t, keep=())
    found = ratings.stored_recs(t.spark, recs)
    users = rows.select(F.col("user").alias("user_id")).distinct()
    products = rows.select(F.col("product").alias("product_id")).distinct()
    nested = read_current(t.spark, recs).select(F.expr(
        "forall(sequence(1, size(recommendations) - 1), i -> i < 1 OR "
        "recommendations[i - 1].rating >= recommendations[i].rating)").alias("ok"))  # fmt: skip
    return t.spark.range(1).select(
        F.lit(found.count() > 0).alias("some_users"),
        F.lit(found.join(users, "user_id", "left_anti").isEmpty()).alias("known_users"),
        F.lit(found.join(products, "product_id", "left_anti").isEmpty()).alias("known_products"),
        F.lit(nested.where("NOT ok").isEmpty()).alias("descending"),
        F.lit(t.spark.read.parquet(store).count()).alias("stored"),
    )


def model_of_parts(t, ratings):
    """A stored model of rank 2 whose products are the parts, with their fixed factors.

    ``ratings`` are read several times by the training, so they should be stored ones.
    """
    path = run_dir(t.spark, "model")
    some = ratings.limit(50)
    save_model(t.spark, train_als(some, {"maxIter": 1, "rank": 2}), path, 1.0)
    folder = latest_model(t.spark, path)["folder"]
    floats = part_factors(t).withColumn("features", F.col("features").cast("array<float>"))
    floats.write.mode("overwrite").parquet(f"{folder}/itemFactors")
    return path


@check("fold_in_stream", SOLVED)
def fold_in_stream(t):
    """Ratings in several batches, one of them twice, leave the factors that all give at once."""
    store, sums, kept, recs, checkpoint = folders(t, "store", "sums", "factors", "recs", "checkpoint")
    source = landed(bought(t).repartition(4, "product"), "ratings")
    model = model_of_parts(t, t.spark.read.schema(schemas.RATING).json(source))
    options = {"params": {"regParam": 0.1}, "n": 3}
    query = ratings.run_fold_in_stream(
        stream_ratings(t.spark, source, files_per_trigger=2), model, store, sums, kept, recs, checkpoint, once=True,
        **options,
    )
    query.awaitTermination()
    last = t.spark.read.parquet(store).agg(F.max("batch_id")).first()[0]
    again = t.spark.read.parquet(f"{store}/batch_id={last}").persist()
    again.count()
    ratings.fold_in_batch(t.spark, model, store, sums, kept, recs, **options)(again, last)
    again.unpersist()
    return rounded_factors(read_current(t.spark, kept))


@check("comment_stream", ANSWERS.replace(f"AND {N} % 4 <> 0", ""), "comments", "videos")
def comment_stream(t):
    """Comments in arrival order over several batches; one reply each."""
    flat = F.to_json(
        F.struct(
            F.col("comment_id").alias("commentId"), F.col("post_id").alias("postId"), "username",
            F.col("comment_text").alias("text"),
        )
    )
    hooks = t.comments.select("platform", flat.alias("payload"), "received_at")
    source = landed(hooks.unionByName(hooks), "webhooks")
    store, checkpoint = folders(t, "store", "checkpoint")
    # each batch reads the videos several times, so they are a stored table
    videos = materialize(t.videos.select(*LINKED), "videos")
    stream = (
        t.spark.readStream.schema(schemas.WEBHOOK).option("maxFilesPerTrigger", 2).json(source)
    )
    query = comments.run_comment_stream(
        stream, videos, store, checkpoint, HANDLE, BASE, once=True
    )
    query.awaitTermination()
    rows = comments.stored_comments(t.spark, store).drop("replied_at")
    return rows.withColumn("received_at", stamp("received_at"))


OPEN = """
    WITH f AS (SELECT product_id, max(ts) AS done FROM tasks WHERE kind = 'finished' GROUP BY 1)
    SELECT product_id, model_id, scene, task_id FROM (
      SELECT s.*, row_number() OVER (PARTITION BY s.product_id, model_id, scene
        ORDER BY ts DESC, task_id DESC) AS rn
      FROM tasks s LEFT JOIN f ON s.product_id = f.product_id
      WHERE kind = 'started' AND (done IS NULL OR ts > done)) WHERE rn = 1"""


@check("open_tasks", OPEN, "tasks")
def open_tasks(t):
    return tasks.open_tasks(t.tasks)


@check("track_tasks", OPEN, "tasks")
def track_tasks(t):
    """Keyed state over several batches; what is still open at the end."""
    source = landed(t.tasks, "tasks", kind="parquet")
    out, checkpoint = folders(t, "out", "checkpoint")
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    events = (
        t.spark.readStream.schema(schemas.TASK_EVENT).option("maxFilesPerTrigger", 2)
        .parquet(source)
    )
    query = (
        tasks.track_tasks(events)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(out)
    )
    query.awaitTermination()
    changes = t.spark.read.parquet(out)
    closed = changes.where(~F.col("open")).select("product_id", "model_id", "scene", "task_id")
    started = changes.where("open").groupBy("product_id", "model_id", "scene").agg(
        F.max(F.struct("at", "task_id")).alias("last")
    )
    newest = started.select("product_id", "model_id", "scene", "last.task_id")
    return newest.join(closed, ["product_id", "model_id", "scene", "task_id"], "left_anti")


@check("enrichment_stream", TAGGED, "products")
def enrichment_stream(t):
    rows = t.products.withColumn(
        "product_details", F.concat("product_name", F.lit(" "), "product_details")
    ).select("id", "thumbnail", "product_details")
    source = landed(rows, "products")
    store, checkpoint = folders(t, "tags", "checkpoint")
    stream = (
        t.spark.readStream.schema("id BIGINT, thumbnail STRING, product_details STRING")
        .option("maxFilesPerTrigger", 2)
        .json(source)
    )
    query = enrichment.run_enrichment_stream(
        stream, KeywordTagger, "https://img.example.com", store, checkpoint, once=True,
        partitions=t.cores,
    )
    query.awaitTermination()
    return read_current(t.spark, store).select("id", "tags.category", "tags.color")


@check(
    "signup_seed_stream",
    """SELECT CAST(c_custkey AS INTEGER) AS "user", 0.0::DOUBLE AS rating FROM customer""",
)
def signup_seed_stream(t):
    source = landed(t.customer.select(F.col("c_custkey").alias("id")), "users")
    out, checkpoint = folders(t, "seeds", "checkpoint")
    stream = t.spark.readStream.schema("id BIGINT").json(source)
    signups.run_signup_seed_stream(stream, out, checkpoint, once=True).awaitTermination()
    return t.spark.read.schema("user INT, rating DOUBLE").json(out)
