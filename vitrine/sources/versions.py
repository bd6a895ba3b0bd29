"""Whole outputs in version folders: readers see the last complete one, never half of one."""

from pyspark.sql import functions as F

from ..session import delete_folder, list_folders, read_if_present

LOG = "version INT"


def _last(spark, path):
    log = read_if_present(spark, f"{path}/commits", LOG)
    newest = None if log is None else log.agg(F.max("version")).first()[0]
    if log is None and list_folders(spark, f"{path}/versions"):
        raise RuntimeError(f"{path} has versions but no commit log")
    return newest


def publish(df, path):
    """Write the next version and commit it; returns it as read back."""
    spark = df.sparkSession
    last = _last(spark, path)
    if last is None and not list_folders(spark, path):
        spark.createDataFrame([], LOG).write.parquet(f"{path}/commits")
    version = (last or 0) + 1
    folder = f"{path}/versions/{version:06d}"
    df.write.mode("overwrite").parquet(folder)
    row = spark.createDataFrame([(version,)], LOG).coalesce(1)
    row.write.mode("append").parquet(f"{path}/commits")
    return spark.read.schema(df.schema).parquet(folder)


def published(spark, path):
    """The last version committed, or None."""
    last = _last(spark, path)
    return None if last is None else spark.read.parquet(f"{path}/versions/{last:06d}")


def remove_old(spark, path):
    """Delete all versions but the last; returns how many. Not while others read them."""
    last = _last(spark, path)
    old = [v for v in list_folders(spark, f"{path}/versions") if last and int(v) < last]
    for version in old:
        delete_folder(spark, f"{path}/versions/{version}")
    return len(old)
