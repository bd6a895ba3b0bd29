"""Insert-or-replace by key, as a join and as a versioned table of Parquet folders."""

from pyspark.sql import functions as F

from ..session import delete_folder, list_folders, materialize, read_if_present, scratch
from .grouping import top_in_group

BUCKETS = 32
#: Rows that one bucket should hold when the table's first load decides on the count.
ROWS_PER_BUCKET = 2_000_000
COMMIT = "bucket INT, version INT, buckets INT, base INT"


def upsert(target, changes, keys):
    """Target rows without a change, and the changes; null keys match each other."""
    renamed = changes.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = F.lit(True)
    for key in keys:
        same = same & target[key].eqNullSafe(renamed[f"_{key}"])
    kept = target.join(renamed, same, "left_anti")
    return kept.unionByName(changes.select(*target.columns))


def latest_changes(changes, keys, order):
    """One row per key: the last in the given order, ties going to the largest row.

    Rows compare column by column as they stand; only columns that hold maps, which have
    no order, compare as text.
    """
    mapped = {f.name for f in changes.schema if "map<" in f.dataType.simpleString()}
    row = F.struct(*[F.to_json(c).alias(c) if c in mapped else F.col(c) for c in changes.columns if c not in keys])
    ties = [F.desc(row)] if len(changes.columns) > len(keys) else []
    return top_in_group(changes, keys, [*[F.desc(c) for c in order], *ties])


def _with_bucket(df, keys, buckets):
    return df.withColumn(
        "bucket", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(buckets)).cast("int")
    )


def _commits(spark, path):
    """(commit log, its last row), both None before the first write began.

    The log is there, if empty, before any rows are. Rows without a log mean that it was
    lost: starting anew would overwrite them.
    """
    log = read_if_present(spark, f"{path}/commits", COMMIT)
    if log is None:
        if list_folders(spark, f"{path}/rows"):
            raise RuntimeError(f"{path} has rows but no commit log")
        return None, None
    return log, log.orderBy(F.desc("version")).first()


def _newest(log, last):
    """(bucket, version) of the newest folder of each bucket since the last full rewrite."""
    rows = log.where(F.col("base") == last["base"])
    return rows.groupBy("bucket").agg(F.max("version").alias("version"))


def _rows(spark, path, newest):
    """Rows in the committed folders; Spark prunes the others at run time."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.join(newest, ["bucket", "version"], "left_semi").drop("version")


def read_current(spark, path):
    """The table as last committed, or None before the first write."""
    log, last = _commits(spark, path)
    return None if last is None else _rows(spark, path, _newest(log, last)).drop("bucket")


def read_keys(spark, path, wanted, keys):
    """Rows of the table whose keys are among ``wanted``, or None before the first write.

    Only the folders of those keys' buckets are opened; they are listed, at most one a bucket.
    """
    log, last = _commits(spark, path)
    if last is None:
        return None
    wanted = _with_bucket(wanted.select(*keys).distinct(), keys, last["buckets"])
    touched = _newest(log, last).join(wanted.select("bucket").distinct(), "bucket", "left_semi")
    folders = [f"{path}/rows/version={r.version}/bucket={r.bucket}" for r in touched.collect()]
    if not folders:
        return spark.createDataFrame([], spark.read.parquet(f"{path}/rows").drop("bucket", "version").schema)
    rows = spark.read.parquet(*folders)
    return rows.join(wanted.select(*keys), keys, "left_semi")


def write_upsert(spark, path, changes, keys, buckets=None, order=None):
    """Upsert ``changes`` into the table at ``path``; returns the version.

    Of changes with equal keys the last by ``order`` counts; without an order they must be
    unique. The changes are computed once, into the shared folder, and removed at the end.
    Only buckets that receive changes are rewritten, into new folders, and they count once
    the commit rows are written. A run that dies before leaves the table as it was, and
    can be repeated. Without changes nothing happens. One writer at a time.

    The bucket count is kept in the log. The first load sets it by its size unless
    ``buckets`` is given; a later call with another count rewrites the whole table by it.
    """
    if order is not None:
        changes = latest_changes(changes, keys, order)
    with scratch(spark):
        changed = materialize(changes, "changes")
        if order is None:
            twice = changed.groupBy(*keys).count().where("count > 1").limit(1).collect()
            if twice:
                raise ValueError(f"changes repeat a key, and no order is given: {twice[0]}")
        return _commit(spark, path, changed, keys, buckets)


def _commit(spark, path, changed, keys, buckets):
    log, last = _commits(spark, path)
    count = changed.count()
    if not count:
        return 0 if last is None else last["version"]
    if last is None:
        if log is None:
            spark.createDataFrame([], COMMIT).write.parquet(f"{path}/commits")
        buckets = buckets or max(BUCKETS, -(-count // ROWS_PER_BUCKET))
        version = base = 1
        merged = _with_bucket(changed, keys, buckets)
    else:
        version = last["version"] + 1
        if buckets in (None, last["buckets"]):
            buckets, base = last["buckets"], last["base"]
            changed = _with_bucket(changed, keys, buckets)
            touched = _newest(log, last).join(changed.select("bucket").distinct(), "bucket", "left_semi")
            merged = upsert(_rows(spark, path, touched), changed, keys)
        else:
            base = version
            whole = upsert(_rows(spark, path, _newest(log, last)).drop("bucket"), changed, keys)
            merged = _with_bucket(whole, keys, buckets)
    folder = f"{path}/rows/version={version}"
    # AQE merges small buckets into one task and splits large ones.
    balanced = merged.hint("rebalance", F.col("bucket"))
    balanced.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    written = spark.read.schema(merged.schema).parquet(folder).select("bucket").distinct()
    row = written.select(
        "bucket", F.lit(version).alias("version"), F.lit(buckets).alias("buckets"),
        F.lit(base).alias("base"),
    )
    row.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def remove_superseded(spark, path):
    """Delete the folders that no longer count; returns how many. Not while others read them."""
    log, last = _commits(spark, path)
    if last is None:
        return 0
    kept = {f"version={r.version}/bucket={r.bucket}" for r in _newest(log, last).collect()}
    gone = 0
    for version in list_folders(spark, f"{path}/rows"):
        own = [f"{version}/{b}" for b in list_folders(spark, f"{path}/rows/{version}")]
        old = [b for b in own if b not in kept]
        targets = [version] if len(old) == len(own) else old
        for target in targets:
            delete_folder(spark, f"{path}/rows/{target}")
        gone += len(old)
    return gone
