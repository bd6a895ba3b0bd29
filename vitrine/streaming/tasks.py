"""Open generation tasks per product: keyed state, and the same as a batch query."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.grouping import spread_lookup

SHARDS = 4
OUTPUT = (
    "product_id STRING, model_id STRING, scene STRING, task_id STRING, at BIGINT, open BOOLEAN"
)
STATE = (
    "finishes ARRAY<STRUCT<product_id: STRING, at: BIGINT>>, "
    "tasks ARRAY<STRUCT<product_id: STRING, model_id: STRING, scene: STRING, task_id: STRING, at: BIGINT>>"
)
#: Keys of the state: products that hash alike are tracked together. Fixed once a stream runs.
BUCKETS = 4096


class TaskTracker(StatefulProcessor):
    """Keeps the open tasks and last finishes of a bucket of products; a finish clears its product.

    Event times decide, so rows are taken in any order: a start counts if it is later than
    the last finish and than the scene's stored start. A bucket is one value of the state, read
    and written once a batch, since each access is a call to the JVM. With ``keep_ms`` a
    timer in event time, at the first time that is due in the bucket, closes tasks
    that are still open so long after their start, and drops finishes once the watermark has
    passed them: what they could still close is late by then, and dropped before it comes here.
    """

    def __init__(self, ttl_ms=None, keep_ms=None):
        self.ttl_ms, self.keep_ms = ttl_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", STATE, ttlDurationMs=self.ttl_ms)

    def _read(self):
        """({product: last finish}, {product: {(model, scene): (start, task)}})"""
        finishes, rows = self.kept.get() or ([], [])
        tasks = {}
        for product, model, scene, task, at in rows:
            tasks.setdefault(product, {})[model, scene] = (at, task)
        return {product: at for product, at in finishes}, tasks

    def _write(self, finished, tasks):
        rows = [(p, *scene, task, at) for p, own in tasks.items() for scene, (at, task) in own.items()]
        if not finished and not rows:
            self.kept.clear()
            return
        self.kept.update((list(finished.items()), rows))
        if self.keep_ms is not None:
            due = [at // 1000 + 1 for at in finished.values()]
            due += [row[-1] // 1000 + self.keep_ms + 1 for row in rows]
            self.handle.registerTimer(min(due))

    def handleInputRows(self, key, rows, timerValues):
        last, newest = {}, {}
        for frame in rows:
            columns = (frame[c] for c in ("product_id", "kind", "at", "model_id", "scene", "task_id"))
            for product, kind, at, model, scene, task in zip(*columns, strict=True):
                if kind == "finished":
                    last[product] = max(last.get(product, -1), int(at))
                else:
                    own, start = newest.setdefault(product, {}), (int(at), task)
                    own[model, scene] = max(own.get((model, scene), (-1, "")), start)
        finished, tasks = self._read()
        out = []
        for product, at in last.items():
            if at > finished.get(product, -1):
                finished[product] = at
                own = tasks.get(product, {})
                closed = [scene for scene, (started, _) in own.items() if started <= at]
                out += [self._change(product, scene, own.pop(scene), False) for scene in closed]
        for product, starts in newest.items():
            for scene, start in starts.items():
                own = tasks.setdefault(product, {})
                if start[0] > finished.get(product, -1) and (scene not in own or own[scene] < start):
                    own[scene] = start
                    out.append(self._change(product, scene, start, True))
        self._write(finished, tasks)
        yield self._frame(out)

    @staticmethod
    def _change(product, scene, start, opened):
        return (product, *scene, start[1], start[0], opened)

    @staticmethod
    def _frame(rows):
        columns = ["product_id", "model_id", "scene", "task_id", "at", "open"]
        return pd.DataFrame(rows, columns=columns).astype({"at": "int64", "open": "bool"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        finished, tasks = self._read()
        finished = {product: at for product, at in finished.items() if at // 1000 >= passed}
        out = []
        for product, own in tasks.items():
            late = [scene for scene, (at, _) in own.items() if at // 1000 + self.keep_ms < passed]
            out += [self._change(product, scene, own.pop(scene), False) for scene in late]
        self._write(finished, tasks)
        if out:
            yield self._frame(out)

    def close(self) -> None:
        pass


def sharded(events, shards=SHARDS):
    """Adds ``shard``, so that a busy product is tracked by several tasks.

    Starts go to the shard of their (model, scene); a finish goes to every shard.
    """
    own = F.pmod(F.xxhash64("model_id", "scene"), F.lit(shards).cast("bigint"))
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))
    targets = F.when(F.col("kind") == "finished", every).otherwise(F.array(own))
    return events.withColumn("shard", F.explode(targets))


def track_tasks(events, ttl_ms=None, shards=SHARDS, keep_ms=None, late="10 minutes"):
    """Stream of task changes; ``open`` tells started from cleared tasks.

    State must not grow for ever. With ``keep_ms`` it goes by event time: a task still open so
    long after its start is given up (``open`` false), and a finish goes once the watermark,
    ``late`` behind the newest event, has passed it. Events older than the watermark are
    dropped. A run over what is available now ends and leaves only what is still due.
    ``ttl_ms`` lets a bucket's state go by processing time instead, by which such a run
    would not end. With neither, state stays. Products are tracked in buckets, so what
    Python costs per key does not grow with the number of products.

    ``shards`` is how many tasks may track one product: about the events of the busiest
    product in a batch over those that one task should take.
    """
    if ttl_ms and keep_ms is not None:
        raise ValueError("state goes by event time or by processing time, not both")
    timed = events.withColumn("at", F.unix_micros("ts"))
    timed = timed.drop("ts") if keep_ms is None else timed.withWatermark("ts", late)
    mode = "ProcessingTime" if ttl_ms else "None" if keep_ms is None else "EventTime"
    return (
        sharded(timed, shards)
        .withColumn("bucket", F.pmod(F.xxhash64("product_id", "shard"), F.lit(BUCKETS)))
        .groupBy("bucket")
        .transformWithStateInPandas(
            TaskTracker(ttl_ms, keep_ms), outputStructType=OUTPUT, outputMode="Append", timeMode=mode
        )
    )


def open_tasks(events):
    """Open tasks after all events: the newest start per scene later than the last finish.

    Both aggregates combine before the shuffle, so a busy product stays cheap.
    """
    finished = (
        events.where(F.col("kind") == "finished")
        .groupBy("product_id")
        .agg(F.max("ts").alias("finished_at"))
    )
    started = (
        events.where(F.col("kind") == "started")
        .groupBy("product_id", "model_id", "scene")
        .agg(F.max(F.struct("ts", "task_id")).alias("last"))
    )
    return (
        spread_lookup(started, finished, ["product_id"], salts=1)
        .where(F.col("finished_at").isNull() | (F.col("last.ts") > F.col("finished_at")))
        .select("product_id", "model_id", "scene", F.col("last.task_id").alias("task_id"))
    )
