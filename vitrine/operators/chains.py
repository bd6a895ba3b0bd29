"""Chains of pages by their links to the next one, ranked without trusting numbers."""

from pyspark.sql import functions as F

from ..session import materialize


def links(pages, node, following):
    """(node, following, copies): one row per page; of a repeated page the least link counts."""
    own = pages.select(F.col(node).alias("node"), F.col(following).alias("following"))
    return own.where("node IS NOT NULL").groupBy("node").agg(
        F.min("following").alias("following"), F.count(F.lit(1)).alias("copies")
    )


def chain_places(pages, node, following):
    """(node, following, copies, head, place): each page's chain, named by its first page.

    A page without a page that links to it is a first one, at place 0. Every other
    points to the one that links to it, of several to the least, and each round makes
    the pointers reach twice as far: log n rounds for a chain of n pages, each written to
    the shared folder. Only pages that have not reached a first page are joined again, and
    of a chain no two of them point to the same page, so there is no hot key. Pages on a
    circle never reach one: their head and place are null.
    """
    own = materialize(links(pages, node, following), "links")
    before = own.where("following <> node").groupBy("following").agg(F.min("node").alias("up"))
    hops = own.select("node").join(before.withColumnRenamed("following", "node"), "node", "left").select(
        "node", F.coalesce("up", "node").alias("up"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("bigint").alias("place"), F.col("up").isNull().alias("settled"),
    )
    hops = materialize(hops, "hops")
    for _ in range(hops.count().bit_length() + 1):
        if hops.where("NOT settled").isEmpty():
            break
        reached = hops.select(
            F.col("node").alias("up"), F.col("up").alias("over"), F.col("place").alias("more"),
            F.col("settled").alias("there"),
        )
        moved = hops.where("NOT settled").join(reached, "up").select(
            "node", F.col("over").alias("up"), (F.col("place") + F.col("more")).alias("place"),
            F.col("there").alias("settled"),
        )
        hops = materialize(hops.where("settled").unionByName(moved), "hops")
    return own.join(hops, "node").select(
        "node", "following", "copies", F.when(F.col("settled"), F.col("up")).alias("head"),
        F.when(F.col("settled"), F.col("place")).alias("place"),
    )


def chain_report(places):
    """(head, pages, repeats, last, ends) of each chain of ``chain_places``.

    A chain ends with ``end`` if its last page names no next one, ``gap`` if that one is
    missing, ``fork`` if it belongs to another chain or to an earlier place of its own. Pages on circles are one row
    without a head for each, ending with ``circle``.
    """
    known = places.select(F.col("node").alias("following"), F.lit(True).alias("known"))
    last = places.where("head IS NOT NULL").groupBy("head").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.col("copies") - 1).alias("repeats"),
        F.max(F.struct("place", "node", "following")).alias("last"),
    )
    last = last.select("head", "pages", "repeats", F.col("last.node").alias("last"), F.col("last.following").alias("following"))
    how = F.when(F.col("following").isNull(), "end").when(F.col("known").isNull(), "gap").otherwise("fork")
    chains = last.join(known, "following", "left").select("head", "pages", "repeats", "last", how.alias("ends"))
    circles = places.where("head IS NULL").select(
        "head", F.lit(1).cast("bigint").alias("pages"), (F.col("copies") - 1).alias("repeats"),
        F.col("node").alias("last"), F.lit("circle").alias("ends"),
    )
    return chains.unionByName(circles)
