"""Interaction log to product popularity."""

from ..operators.interactions import fill_interaction_nulls, popularity_scores
from ..sources.files import scan_interactions
from ..sources.sinks import write_popularity


def popularity_job(spark, path_or_topic, out, as_of, servers=None):
    """Read the whole log, score it and write one JSON line per product."""
    log = fill_interaction_nulls(scan_interactions(spark, path_or_topic, servers=servers))
    write_popularity(popularity_scores(log, as_of), out)
    return spark.read.schema("productId BIGINT, popularity DOUBLE").json(out)
