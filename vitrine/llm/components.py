"""Connected components by alternating star contraction, on DataFrames."""

from pyspark.sql import functions as F

from .common import stage

ROUNDS = 60


def _mark(edges):
    """Count and checksum of an edge table, equal for equal tables."""
    row = edges.agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
    ).first()
    return row["n"], row["x"]


def _large_star(edges):
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def _small_star(edges):
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    heads = least.select("u", F.col("m").alias("v"))
    return moved.union(heads).where("u <> v").distinct()


def connected_components(pairs, left="a", right="b", rounds=ROUNDS):
    """(node, root) of every node that occurs in a pair; the root is the least node.

    Nodes are of any ordered type. Each round hangs every node on the least node around
    it, first its larger and then its smaller neighbours, and is written to the shared
    folder; minima are combined before the shuffle, and a busy node's edges are a join
    that Spark can split. It ends when a round changes nothing, after a number of rounds
    logarithmic in practice. Pairs with a null or of a node with itself link nothing.
    """
    low, high = F.least(left, right), F.greatest(left, right)
    edges = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull())
    edges = stage(
        edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), "edges"
    )
    mark = _mark(edges)
    for _ in range(rounds):
        if not mark[0]:
            break
        edges = stage(_small_star(_large_star(edges)), "edges")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
