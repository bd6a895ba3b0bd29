"""Database tables. The driver jar must be on the class path."""

from pyspark.sql import functions as F


def read_options(url, table, fetchsize=1000, user=None, password=None, driver=None):
    options = {"url": url, "dbtable": table, "fetchsize": str(fetchsize)}
    for key, value in (("user", user), ("password", password), ("driver", driver)):
        if value is not None:
            options[key] = value
    return options


def split_options(column, lower, upper, partitions):
    """Parallel read by ranges of a numeric key."""
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def scan_products_jdbc(spark, url, table, fetchsize=1000, split=None, where=None, **login):
    """Product table with 0 for null numbers.

    ``split`` is ``(column, lower, upper, partitions)``; without it one task reads all.
    ``where`` is applied before the nulls are filled, so that the database can run it.
    """
    reader = spark.read.format("jdbc").options(**read_options(url, table, fetchsize, **login))
    if split:
        reader = reader.options(**split_options(*split))
    rows = reader.load()
    return (rows if where is None else rows.where(where)).na.fill(0)


def scan_products_incremental(spark, url, table, since, column="update_at", split=None, **login):
    """Rows changed at or after ``since``; the predicate runs in the database.

    Spark has no streaming JDBC source, so a job keeps the last mark and reads on from it.
    Rows at the mark come again, as others may have been committed at the same time since;
    upserts by key take them as they are.
    """
    reader = spark.read.format("jdbc").options(**read_options(url, table, **login))
    if split:
        reader = reader.options(**split_options(*split))
    return reader.load().where(F.col(column) >= F.lit(since).cast("timestamp"))


def high_water_mark(rows, column="update_at"):
    """The newest change time read, for the next incremental read."""
    return rows.agg(F.max(column).alias("mark"))


def write_recommendations_jdbc(df, url, table="recommended_product", **login):
    """Replace the table's rows, keeping its definition."""
    options = read_options(url, table, **login)
    options.pop("fetchsize")
    df.write.format("jdbc").mode("overwrite").option("truncate", "true").options(**options).save()
