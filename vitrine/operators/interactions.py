"""Interaction log: decode, clean, rate, score popularity."""

from pyspark.sql import functions as F

from .. import schemas
from ..functions import scoring


def decode_interactions(raw):
    """JSON text in ``value`` to the five interaction columns."""
    parsed = F.from_json(F.col("value").cast("string"), schemas.INTERACTION)
    return raw.select(parsed.alias("v")).select("v.*")


def fill_interaction_nulls(df):
    """Null ids become 0 and a null type ``Unknown``; malformed rows stay, as such."""
    return df.na.fill(0, ["id", "userId", "productId"]).na.fill(
        "Unknown", ["interactionType"]
    ).withColumn("createdAt", F.to_timestamp("createdAt"))


def valid_interactions(df):
    return df.where((F.col("productId") > 0) & (F.col("userId") > 0))


def interactions_to_ratings(df, rating_map=None, keep=()):
    """(user, product, rating) with positive ratings; repeats are kept."""
    return df.select(
        F.col("userId").alias("user"),
        F.col("productId").alias("product"),
        scoring.type_rating("interactionType", rating_map).alias("rating"),
        *keep,
    ).where(F.col("rating") > 0)


def popularity_raw(interactions, as_of, score_map=None):
    """Sum of age weight times type score per product; partial sums before the shuffle."""
    age = scoring.interaction_age_hours("createdAt", F.lit(as_of).cast("timestamp"))
    score = scoring.age_weight(age) * scoring.type_score("interactionType", score_map)
    return interactions.groupBy("productId").agg(F.sum(score).alias("popularity_score"))


def minmax(df, column):
    """Global minimum and maximum in one aggregate."""
    return df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))


def popularity_scores(interactions, as_of, score_map=None, drop_invalid=False):
    """Raw popularity and its min-max scaling; 1.0 everywhere when all are equal."""
    source = valid_interactions(interactions) if drop_invalid else interactions
    return scaled(popularity_raw(source, as_of, score_map))


def scaled(raw):
    """Adds the min-max scaling of the popularity; 1.0 everywhere when all are equal."""
    bounds = minmax(raw, "popularity_score").select(F.struct("lo", "hi").alias("b")).scalar()
    score, lo, hi = F.col("popularity_score"), F.col("_b.lo"), F.col("_b.hi")
    scaled = F.when(hi == lo, F.lit(1.0)).otherwise((score - lo) / F.nullif(hi - lo, F.lit(0.0)))
    return raw.withColumn("_b", bounds).select(
        "productId", "popularity_score", scaled.alias("popularity_score_normal")
    )


def row_counts(df, names):
    """Rows and rows passing each named predicate, in one pass."""
    counts = [F.count_if(predicate).alias(name) for name, predicate in names.items()]
    return df.agg(F.count(F.lit(1)).alias("rows"), *counts)


def observed(df, name):
    """The frame with its row count observed while it is used, without an extra job."""
    from pyspark.sql import Observation

    observation = Observation(name)
    return df.observe(observation, F.count(F.lit(1)).alias("rows")), observation


def popularity_payload(scores):
    """One JSON text per product."""
    return scores.select(
        F.format_string(
            '{"productId": %d, "popularity": %.4f}',
            F.col("productId"),
            F.col("popularity_score_normal"),
        ).alias("value")
    )
