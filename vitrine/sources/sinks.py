"""Writers. All rows are written by the executors."""

from ..operators.content import REQUEST, cache_rows
from ..operators.interactions import popularity_payload
from ..operators.ratings import to_json_rows
from ..operators.upsert import write_upsert


def write_popularity(scores, path):
    """JSON lines, one product each."""
    popularity_payload(scores).write.mode("overwrite").text(path)


def write_seed_ratings(seeds, path=None, servers=None, topic=None):
    """Zero ratings as JSON events, to a folder or a Kafka topic."""
    events = to_json_rows(seeds)
    if servers:
        events.write.format("kafka").options(
            **{"kafka.bootstrap.servers": servers, "topic": topic}
        ).save()
    else:
        events.write.mode("append").text(path)


def send_in_batches(df, sender_factory, batch_size=10):
    """Hand rows to an outside service in lists of ``batch_size``, from every partition.

    A retried task sends its rows again, so the service must accept repeats.
    """

    def run(rows):
        send = sender_factory()
        batch = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == batch_size:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(run)


def batched_upsert(spark, products, path, keys=("sku",), order=("update_at", "pos")):
    """Store mapped catalogue rows by SKU; of a repeated SKU the last load and place count.

    Columns of ``order`` that the rows don't have are left out.
    """
    order = [c for c in order if c in products.columns]
    return write_upsert(spark, path, products, list(keys), order=order)


def write_tags(spark, tags, path, order=()):
    """Store tags by product id; of a repeated id the last by ``order`` counts."""
    return write_upsert(spark, path, tags, ["id"], order=list(order))


def write_asset_cache(spark, outputs, path, order=()):
    """Store images of outputs that are at least partly done, by product and persona."""
    return write_upsert(spark, path, cache_rows(outputs), REQUEST, order=list(order))
