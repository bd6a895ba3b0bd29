"""Session building and the shared scratch folder."""

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name="vitrine", master=None, shuffle_partitions=None, extra=None):
    """A session with the settings the jobs rely on.

    Shuffle partitions are left to the cluster unless given: AQE merges small
    ones and splits skewed ones at run time.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark):
    """The folder every executor can reach, as the session names it.

    Only a local session without the setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vitrine-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def run_dir(spark, name):
    """A fresh path below the shared folder for one run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


_made = threading.local()


@contextmanager
def scratch(spark):
    """Removes what ``materialize`` writes inside, once the block has used it."""
    outer, own = getattr(_made, "paths", None), []
    _made.paths = own
    try:
        yield
    finally:
        _made.paths = outer
        for path in own:
            delete_folder(spark, path)


def materialize(df, name):
    """Write a frame to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and later reads take only the columns
    they need.
    """
    path = run_dir(df.sparkSession, name)
    if getattr(_made, "paths", None) is not None:
        _made.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_if_present(spark, path, schema):
    """The Parquet table at the path, or None if there is no such path; other faults raise."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _path(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def place_of(spark, path):
    """The full path without its store, or None if there is none such."""
    where, files = _path(spark, path)
    return files.makeQualified(where).toUri().getPath() if files.exists(where) else None


def list_folders(spark, path):
    """Names of the folders below a path, sorted; none if there is no such path."""
    where, files = _path(spark, path)
    if not files.exists(where):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(where) if f.isDirectory())


def delete_folder(spark, path):
    """Remove a folder in whatever store it lies."""
    where, files = _path(spark, path)
    files.delete(where, True)
