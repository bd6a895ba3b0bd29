"""Group helpers that hold up when one key owns a large share of the rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialize

SALTS = 8


def spread_rows(df, partitions):
    """The rows dealt out to so many tasks, or as they come for None.

    For heavy expressions on texts that few row groups hold: Spark reads a row group in
    one task. The rows are shuffled once, so a caller asks for it where they are worth that.
    """
    return df if partitions is None else df.repartition(partitions)


def top_in_group(df, keys, order, n=1):
    """First ``n`` rows of each group in the given order, all columns kept.

    The filter on ``row_number`` lets Spark limit each group inside every map task
    before the shuffle, so a hot group sends at most ``n`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop(
        "_rank"
    )


def spread_lookup(left, right, on, how="left", spread_by=None, salts=SALTS):
    """Join many rows to a lookup table although one key may own a third of them.

    The many side is spread over ``salts`` buckets by a hash of ``spread_by`` (all its
    columns unless given) and the lookup side is repeated once per bucket. Rows without
    a key cannot match, so they are spread over all partitions. Both sides are then
    shuffled right before the join, so AQE can also split what one hash value still
    holds, such as exact copies. When the lookup side turns out small, AQE broadcasts
    it instead.

    A lookup side that may rival the many side in size takes ``salts=1``: nothing is
    repeated, and splitting is left to AQE, which could not split a side that comes
    straight from an aggregation by the same key.
    """
    by = spread_by or [c for c, t in left.dtypes if not t.startswith("map")]
    spread = F.xxhash64(*[F.col(c) for c in by])
    keyless = F.lit(False)
    for key in on:
        keyless = keyless | F.col(key).isNull()
    bucket = F.when(keyless, spread).otherwise(F.pmod(spread, F.lit(salts).cast("bigint")))
    every_bucket = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    return (
        left.withColumn("_salt", bucket)
        .join(right.withColumn("_salt", every_bucket), [*on, "_salt"], how)
        .drop("_salt")
    )


def written_lookup(left, right, on, how="left", spread_by=None):
    """Like ``spread_lookup``, but the lookup side is computed once, into the shared folder.

    Spark then knows its size before the join and broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold``: the many side is not shuffled at all.
    """
    return spread_lookup(left, materialize(right, "lookup"), on, how, spread_by)
