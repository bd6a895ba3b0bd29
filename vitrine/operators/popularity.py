"""Popularity for any instant from hourly partials, with few rows of the log read again."""

from pyspark.sql import functions as F

from ..functions import scoring
from ..session import list_folders
from .interactions import popularity_raw, scaled

HOUR = 3600
PARTIALS = "productId BIGINT, interactionType STRING, hour BIGINT, n BIGINT, batch STRING"
LOG = "id BIGINT, userId BIGINT, productId BIGINT, interactionType STRING, createdAt TIMESTAMP, batch STRING, day DATE"


def hour_of(time):
    return F.floor(F.unix_timestamp(time) / HOUR)


def hourly_partials(interactions):
    """(productId, interactionType, hour, n): mergeable by adding n; unknown times have no hour."""
    keys = ["productId", "interactionType", hour_of("createdAt").alias("hour")]
    return interactions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def boundary_hours(as_of):
    """One column per age bound: the hour in which rows are partly on either side of it."""
    return [F.floor((F.unix_timestamp(as_of) - bound * HOUR) / HOUR) for bound, _ in scoring.AGE_WEIGHTS]


def add_interactions(interactions, path, batch):
    """Store a batch of the log, by day and time, and its partials; a repeat replaces itself."""
    rows = interactions.select("id", "userId", "productId", "interactionType", "createdAt")
    by_day = rows.withColumn("day", F.to_date("createdAt"))
    by_day = by_day.repartitionByRange("day", "createdAt").sortWithinPartitions("day", "createdAt")
    by_day.write.mode("overwrite").partitionBy("day").parquet(f"{path}/log/batch={batch}")
    hourly_partials(rows).write.mode("overwrite").parquet(f"{path}/partials/batch={batch}")


def boundary_rows(spark, path, as_of):
    """Log rows of the hours that an age bound falls into: from their days' folders only."""
    instant = F.lit(as_of).cast("timestamp")
    near = F.lit(False)
    for hour in boundary_hours(instant):
        start = F.timestamp_seconds(hour * HOUR)
        day = F.col("day").between(F.to_date(start), F.to_date(F.timestamp_seconds(hour * HOUR + HOUR - 1)))
        inside = (F.col("createdAt") >= start) & (F.col("createdAt") < F.timestamp_seconds((hour + 1) * HOUR))
        near = near | (day & inside)
    rows = spark.read.schema(LOG).parquet(f"{path}/log")
    return rows.where(near).drop("batch", "day")


def popularity_at(spark, path, as_of, score_map=None):
    """``popularity_scores`` at any instant over what ``add_interactions`` stored.

    Whole hours on one side of every age bound take their weight from the hour; only rows
    of the hours that hold a bound, at most one a bound, are read from the log.
    """
    if not list_folders(spark, f"{path}/partials"):
        raise ValueError(f"nothing stored at {path}")
    instant = F.lit(as_of).cast("timestamp")
    hours = boundary_hours(instant)
    hour, weight = F.col("hour"), F
    for edge, (_, value) in zip(hours, scoring.AGE_WEIGHTS):
        weight = weight.when(hour > edge, F.lit(value))
    weight = weight.otherwise(F.lit(scoring.OLDEST_WEIGHT))
    whole = spark.read.schema(PARTIALS).parquet(f"{path}/partials")
    whole = whole.where(hour.isNull() | ~hour.isin(*hours))
    score = F.col("n") * weight * scoring.type_score("interactionType", score_map)
    sums = whole.groupBy("productId").agg(F.sum(score).alias("popularity_score"))
    split = popularity_raw(boundary_rows(spark, path, as_of), as_of, score_map)
    raw = sums.unionByName(split).groupBy("productId").agg(F.sum("popularity_score").alias("popularity_score"))
    return scaled(raw)
