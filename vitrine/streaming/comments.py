"""Webhook stream to stored replies."""

import re

from pyspark.sql import functions as F

from .. import schemas
from ..operators.comments import KEYS, MIN_WORD, normalize_webhooks
from ..operators.links import update_links
from ..operators.membership import FILTER, build_filter, merge_filters, might_contain
from ..plans.replies import answer_comments
from ..session import delete_folder, list_folders, materialize, place_of, scratch

BUCKETS = 256
#: Blocks of the filter of a folder's keys (for about 130 000 comments; more are let through).
BLOCKS = 32
#: Folders of one size that are merged into one.
FAN = 16
RANGE = re.compile(r"batch_id=(\d+)(?:-(\d+))?$")


def with_bucket(rows):
    """Adds the folder that a comment is stored in, by its key."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int"))


def _complete(spark, store):
    """{(first, last batch): folder} of the folders that are wholly written."""
    found = {}
    for name in list_folders(spark, store):
        part = RANGE.fullmatch(name)
        if part and place_of(spark, f"{store}/{name}/_SUCCESS"):
            found[int(part[1]), int(part[2] or part[1])] = name
    return found


def live_folders(spark, store, before=None):
    """The same for the folders that count: no other holds their batches too.

    A merged folder counts once it is complete, and its sources no longer do, so a reader
    sees each batch once whenever it looks. With ``before`` only earlier batches.
    """
    known = {r: n for r, n in _complete(spark, store).items() if before is None or r[1] < before}
    return {
        (a, b): name for (a, b), name in known.items()
        if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in known)
    }


def _read(spark, paths):
    if not paths:
        return spark.createDataFrame([], schemas.COMMENT)
    return spark.read.schema(schemas.COMMENT).parquet(*paths)


def stored_comments(spark, store, before=None, buckets=None):
    """Comments stored so far, optionally those of earlier batches or some buckets only."""
    folders = [f"{store}/{name}" for name in live_folders(spark, store, before).values()]
    schema = f"{schemas.COMMENT}, batch_id STRING, bucket INT"
    if not folders:
        return spark.createDataFrame([], schemas.COMMENT)
    rows = spark.read.schema(schema).option("basePath", store).parquet(*folders)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    return rows.drop("batch_id", "bucket")


def filters_of(spark, store, names):
    """(folder, block, bits) of the filters kept for some folders."""
    parts = spark.createDataFrame([], f"folder STRING, {FILTER}")
    for name in names:
        own = spark.read.schema(FILTER).parquet(f"{store}-filters/{name}")
        parts = parts.unionByName(own.withColumn("folder", F.lit(name)))
    return parts


def likely_history(spark, store, comments, before):
    """Stored comments among which those of the batch are, if they are stored at all.

    Each folder's filter is asked for the batch's keys; only buckets of folders that may
    hold one are opened. The filter never misses a stored key, so what is told by the
    exact comparison with these rows holds for all.
    """
    names = list(live_folders(spark, store, before).values())
    keys = with_bucket(comments.select(*KEYS).distinct())
    likely = might_contain(keys, KEYS, filters_of(spark, store, names), BLOCKS)
    # at most BUCKETS places in each of some folders
    places = likely.select("folder", "bucket").distinct().collect()
    return _read(spark, [f"{store}/{p.folder}/bucket={p.bucket}" for p in places])


def store_rows(spark, rows, store, name, filters=None):
    """Write rows as a folder of the store by bucket; the filter of their keys comes first."""
    own = build_filter(rows, KEYS, BLOCKS) if filters is None else filters
    own.coalesce(1).write.mode("overwrite").parquet(f"{store}-filters/{name}")
    bucketed = with_bucket(rows).hint("rebalance", F.col("bucket"))
    bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/{name}")


def merge_folders(spark, store, before, fan=FAN):
    """Merge each ``fan`` neighbouring live folders of one size into one of the next.

    A batch is rewritten once per size, and folders grow in number with the logarithm of
    that of batches. Spark packs a bucket's rows into files of its target size. Sources
    stay until the next call, so that readers who listed them go on. Batches from ``before`` on may still be repeated and are left alone.
    """
    live = live_folders(spark, store, before)
    for ranges, name in _complete(spark, store).items():
        if ranges[1] < before and ranges not in live:
            delete_folder(spark, f"{store}/{name}")
            delete_folder(spark, f"{store}-filters/{name}")
    size = 1
    while True:
        order = sorted(live)
        fits = [size < (b - a + 1) * fan <= size * fan for a, b in order]
        group = next((order[i : i + fan] for i in range(len(order) - fan + 1) if all(fits[i : i + fan])), None)
        if group is None:
            return
        name = f"batch_id={group[0][0]}-{group[-1][1]}"
        names = [live.pop(r) for r in group]
        paths = [f"{store}/{n}/{b}" for n in names for b in list_folders(spark, f"{store}/{n}")]
        filters = merge_filters(filters_of(spark, store, names).drop("folder"))
        store_rows(spark, _read(spark, paths), store, name, filters)
        live[group[0][0], group[-1][1]] = name
        size *= fan


def comment_batch(spark, videos, store, handle, base_url, seed=0, fan=FAN):
    """Handler of one micro-batch: one plan for the whole batch, one folder per batch.

    Repeats are found in the stored comments, not in a watermarked state: a watermark
    would drop late comments, and the table answers the same question exactly. Folders
    whose filter holds none of the batch's keys are not opened. A repeated batch reads only
    earlier batches and replaces its own folder. Intermediates go once the batch is stored.
    ``videos`` is a table, or a ``KeptLinks`` so that a batch reads only the index buckets
    of its own words and posts.
    """

    def process(batch, batch_id):
        with scratch(spark):
            merge_folders(spark, store, batch_id, fan)
            comments = materialize(normalize_webhooks(batch), "batch")
            history = likely_history(spark, store, comments, batch_id)
            rows = answer_comments(comments, videos, history, handle, base_url, seed)
            store_rows(spark, materialize(rows, "answers"), store, f"batch_id={batch_id}")

    return process


def run_comment_stream(stream, videos, store, checkpoint, handle, base_url, seed=0, once=False):
    process = comment_batch(stream.sparkSession, videos, store, handle, base_url, seed)
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def video_batch(spark, index):
    """Handler of a micro-batch of new or changed videos: brings them into the link index."""

    def process(batch, batch_id):
        with scratch(spark):
            update_links(spark, index, materialize(batch, "videos"), MIN_WORD)

    return process


def run_video_stream(stream, index, checkpoint, once=False):
    """Keeps the index at ``index`` for ``KeptLinks``."""
    process = video_batch(stream.sparkSession, index)
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


