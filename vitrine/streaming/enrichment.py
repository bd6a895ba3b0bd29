"""Product stream to stored tags."""

from ..operators.tagging import tag_results
from ..session import materialize, scratch
from ..sources.sinks import write_tags

# Fixed value: trigger of the enrichment stream.
TRIGGER = "5 seconds"


def enrichment_batch(spark, client_factory, image_base, store, rejects=None, partitions=None):
    """Handler of one micro-batch: tag its products and upsert the tags by product id.

    The client is called once; with ``rejects`` the products whose calls failed are kept
    there with their errors, a folder per batch. ``partitions`` as in ``tag_results``.
    """

    def process(batch, batch_id):
        with scratch(spark):
            results = materialize(tag_results(batch, client_factory, image_base, partitions=partitions), "tagged")
            write_tags(spark, results.where("error IS NULL").select("id", "tags"), store)
            if rejects:
                failed = results.where("error IS NOT NULL").select("id", "error")
                failed.write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")

    return process


def run_enrichment_stream(stream, client_factory, image_base, store, checkpoint, once=False,
                          rejects=None, partitions=None):
    process = enrichment_batch(stream.sparkSession, client_factory, image_base, store, rejects, partitions)
    writer = stream.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": TRIGGER}
    return writer.trigger(**trigger).start()
