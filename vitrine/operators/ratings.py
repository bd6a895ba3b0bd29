"""Recommendation steps around MLlib's ALS."""

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.recommendation import ALS
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialize
from .grouping import spread_lookup

# Training parameters of the scheduled and of the streaming model.
BATCH_PARAMS = {"maxIter": 5, "regParam": 0.1, "rank": 2}
STREAM_PARAMS = {"maxIter": 5, "regParam": 0.01}
SEED = 42
INT_MAX = 2**31 - 1


def split_ratings(ratings, seed=SEED, tenths=8):
    """80/20 split by a hash of the row, the same on every retry.

    Equal rows fall on one side together; carry the interaction id along to part them.
    """
    part = F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in ratings.columns]), F.lit(10))
    return ratings.where(part < tenths), ratings.where(part >= tenths)


def dense_ids(df, column, name):
    """(column, name): a dense integer per distinct value, for ids beyond 32 bits.

    Values are range-partitioned and numbered inside their partition; the offset of a
    partition is the count of those before it. Only one row per partition is ordered
    in one place.
    """
    keys = df.select(column).distinct().repartitionByRange(column)
    keys = materialize(keys.withColumn("_part", F.spark_partition_id()), "keys")
    counts = keys.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    numbered = keys.withColumn("_at", within).join(offsets, "_part")
    return numbered.select(column, (F.col("start") + F.col("_at")).cast("int").alias(name))


def id_maps(ratings):
    """{column: (value, index)} if any id is beyond 32 bits, which ALS can't take; else None."""
    most = ratings.agg(
        F.max(F.greatest(F.abs("user"), F.abs("product")).cast("decimal(20,0)"))
    ).first()[0]
    if most is None or most <= INT_MAX:
        return None
    return {c: dense_ids(ratings, c, f"{c}_index") for c in ("user", "product")}


def with_indices(ratings, ids):
    """Ratings with the maps' indices for ids; rows with unknown ids go. Without maps the
    ids are cast."""
    if ids is None:
        fits = F.greatest(F.abs("user"), F.abs("product")) <= INT_MAX
        return ratings.where(fits).withColumns({c: F.col(c).cast("int") for c in ("user", "product")})
    for column, table in ids.items():
        ratings = spread_lookup(ratings, table, [column], how="inner", salts=1)
        ratings = ratings.drop(column).withColumnRenamed(f"{column}_index", column)
    return ratings


def with_ids(flat, ids):
    """Flat recommendations with the ids that the indices stand for."""
    if ids is None:
        return flat
    for column, table in (("user_id", ids["user"]), ("product_id", ids["product"])):
        value, index = table.columns
        named = table.select(F.col(index).alias(column), F.col(value).alias("_value"))
        flat = flat.join(named, column).drop(column).withColumnRenamed("_value", column)
    return flat.select("user_id", "product_id", "rating")


def train_als(ratings, params=None, seed=SEED):
    als = ALS(
        userCol="user",
        itemCol="product",
        ratingCol="rating",
        coldStartStrategy="drop",
        seed=seed,
        **(params or BATCH_PARAMS),
    )
    return als.fit(ratings)


def score(model, ratings):
    return model.transform(ratings)


def rmse(predictions):
    """Root mean squared error as a one-row frame; null without predictions."""
    error = F.col("rating") - F.col("prediction").cast("double")
    return predictions.agg(F.sqrt(F.avg(error * error)).alias("rmse"))


def rmse_value(predictions):
    """The error as a number, or None when nothing could be predicted."""
    if predictions.isEmpty():
        return None
    return RegressionEvaluator(
        labelCol="rating", predictionCol="prediction", metricName="rmse"
    ).evaluate(predictions)


def recommend_user(model, user_id, n=10):
    """Top ``n`` products of one user."""
    spark = model.userFactors.sparkSession
    user = spark.createDataFrame([(user_id,)], f"{model.getUserCol()} INT")
    return model.recommendForUserSubset(user, n)


def recommend_all(model, n=20):
    """Top ``n`` products of every user."""
    return model.recommendForAllUsers(n)


def flatten_recs(recs):
    """One row per recommendation."""
    return recs.select(
        F.col("user").alias("user_id"),
        F.inline("recommendations").alias("product_id", "rating"),
    )


def top_products_global(recs, n=10, distinct=False):
    """Best-rated recommendations over all users; ``distinct`` lists each product once."""
    flat = flatten_recs(recs)
    if distinct:
        flat = flat.groupBy("product_id").agg(F.max("rating").alias("rating"))
        order = [F.desc("rating"), F.asc("product_id")]
    else:
        order = [F.desc("rating"), F.asc("product_id"), F.asc("user_id")]
    return flat.orderBy(*order).limit(n).select("product_id", "rating")


def recommendation_payload(recs):
    """One JSON text per user."""
    return recs.select(F.to_json(F.struct("user", "recommendations")).alias("value"))


def to_json_rows(df):
    """Every row as JSON text."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def seed_users(users):
    """One zero-rating seed per new user, standing for every product.

    Writing users times products would be a cross join whose rows all say 0.0; the seed
    is kept once and applied to the pairs asked for, by ``seeded_ratings``.
    """
    return users.select(F.col("id").cast("int").alias("user"), F.lit(0.0).alias("rating"))


def seeded_ratings(pairs, ratings, seeds):
    """Rating of each asked (user, product): the given ones, else the user's seed."""
    known = ratings.select("user", "product", F.col("rating").alias("_given"))
    seed = seeds.groupBy("user").agg(F.max("rating").alias("_seed"))
    given = pairs.join(known, ["user", "product"], "left")
    return (
        spread_lookup(given, seed, ["user"], salts=1)
        .withColumn("rating", F.coalesce("_given", "_seed"))
        .where(F.col("rating").isNotNull())
        .select("user", "product", "rating")
    )
