"""Versioned model folders with a commit log."""

from pyspark.ml.recommendation import ALSModel
from pyspark.sql import functions as F

from ..session import list_folders, read_if_present

COMMIT = "version INT, folder STRING, rmse DOUBLE"


def _commits(spark, path):
    log = read_if_present(spark, f"{path}/commits", COMMIT)
    if log is None and list_folders(spark, f"{path}/versions"):
        raise RuntimeError(f"{path} has models but no commit log")
    return log


def latest_model(spark, path):
    """(version, folder, rmse) of the newest committed model, or None."""
    log = _commits(spark, path)
    return None if log is None else log.orderBy(F.desc("version")).limit(1).first()


def load_model(spark, path):
    """The newest committed model, or None when there is none."""
    newest = latest_model(spark, path)
    return None if newest is None else ALSModel.load(newest["folder"])


def load_ids(spark, path):
    """The maps of ids to indices that the newest model was trained with, or None."""
    newest = latest_model(spark, path)
    if newest is None:
        return None
    tables = {}
    for column in ("user", "product"):
        schema = f"{column} BIGINT, {column}_index INT"
        tables[column] = read_if_present(spark, f"{newest['folder']}-ids/{column}", schema)
    return None if None in tables.values() else tables


def save_model(spark, model, path, rmse, ids=None):
    """Save a new version, with its id maps; it counts once its commit row is written."""
    newest = latest_model(spark, path)
    version = 1 if newest is None else newest["version"] + 1
    folder = f"{path}/versions/{version:06d}"
    model.write().overwrite().save(folder)
    for column, table in (ids or {}).items():
        table.write.mode("overwrite").parquet(f"{folder}-ids/{column}")
    row = spark.createDataFrame([(version, folder, rmse)], COMMIT)
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version
