"""Work on fixed item factors: folding users in, and exact top items without trying all."""

import numpy as np
from pyspark.sql import functions as F

from ..session import materialize
from .grouping import spread_lookup, top_in_group

#: Items of the largest norms that every user is compared with first.
HEAD = 4096
#: Items in each of the blocks that the others make.
BLOCK = 4096
#: Users that meet one block in one task, about.
USERS_PER_TASK = 2**16
#: Users compared with the head at once.
CHUNK = 256
#: Room for rounding when a bound is compared with a score.
SLACK = 1e-9


def normal_sums(ratings, item_factors, rank):
    """(user, sums): what the normal equations of each user need, as one array of doubles.

    In order: the number of ratings, the upper triangle of the sum of outer products of the
    rated items' factors by rows, and the sum of ratings times factors. Sums of parts of the
    ratings add up to those of all. Ratings with a null or of an unknown product count
    nothing. Combined before the shuffle, so a busy user sends one row per task.
    """
    known = item_factors.select(F.col("id").alias("product"), F.col("features").alias("_f"))
    rows = ratings.select("user", "product", "rating").na.drop()
    rows = spread_lookup(rows, known, ["product"], how="inner", salts=1)
    factor = [F.col("_f")[i].cast("double") for i in range(rank)]
    terms = [F.lit(1.0)]
    terms += [factor[i] * factor[j] for i in range(rank) for j in range(i, rank)]
    terms += [factor[i] * F.col("rating").cast("double") for i in range(rank)]
    sums = rows.groupBy("user").agg(*[F.sum(t).alias(f"s{i}") for i, t in enumerate(terms)])
    return sums.select("user", F.array(*[f"s{i}" for i in range(len(terms))]).alias("sums"))


def add_sums(left, right):
    """Two arrays of sums added; a null one counts nothing."""
    both = F.zip_with(left, right, lambda a, b: a + b)
    return F.coalesce(both, left, right)


def solve_sums(sums, rank, reg):
    """(id, features) from (user, sums): the ridge solution of each user's equations.

    The penalty is ``reg`` times the number of ratings, as in the training. The small
    systems are solved a batch of users at a time.
    """
    if reg <= 0:
        raise ValueError("the penalty must be positive")
    upper = np.triu_indices(rank)

    @F.pandas_udf("array<double>")
    def solve(sums):
        import pandas as pd

        if not len(sums):
            return pd.Series([], dtype=object)
        rows = np.stack(sums.to_numpy())
        matrix = np.zeros((len(rows), rank, rank))
        matrix[:, upper[0], upper[1]] = matrix[:, upper[1], upper[0]] = rows[:, 1:-rank]
        matrix += reg * rows[:, 0, None, None] * np.eye(rank)
        return pd.Series(list(np.linalg.solve(matrix, rows[:, -rank:, None])[:, :, 0]))

    return sums.select(F.col("user").alias("id"), solve("sums").alias("features"))


def fold_in(ratings, item_factors, rank, reg):
    """(id, features) of the users in the ratings, against item factors that stay fixed."""
    return solve_sums(normal_sums(ratings, item_factors, rank), rank, reg)


def norm(features):
    return F.sqrt(F.aggregate(features, F.lit(0.0), lambda a, x: a + x.cast("double") * x))


def _blocks(items, block):
    """(bound, ids, values) rows of up to ``block`` items, similar norms together."""

    def gather(batches):
        import pyarrow as pa

        ids, values, norms = [], [], []

        def send():
            row = [pa.array([norms[0]]), pa.array([ids], pa.list_(pa.int64())), pa.array([np.concatenate(values)], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(row, names=["bound", "ids", "values"])

        for batch in batches:
            for i, f, n in zip(*(batch.column(c).to_pylist() for c in ("id", "features", "norm"))):
                ids.append(i)
                values.append(f)
                norms.append(n)
                if len(ids) == block:
                    yield send()
                    ids, values, norms = [], [], []
        if ids:
            yield send()

    # partitions of sixteen blocks or so; the norms within one are in order
    count = items.count()
    parts = items.repartitionByRange(max(1, -(-count // (16 * block))), F.desc("norm"))
    sorted_ = parts.sortWithinPartitions(F.desc("norm")).select("id", "features", "norm")
    return sorted_.mapInArrow(gather, "bound DOUBLE, ids ARRAY<BIGINT>, values ARRAY<DOUBLE>")


def best(scores, ids, n, floor=-np.inf):
    """Places of the ``n`` best scores of at least ``floor``, best first, ties by id."""
    if len(scores) > n:
        floor = max(floor, np.partition(scores, len(scores) - n)[len(scores) - n])
    at = np.flatnonzero(scores >= floor)
    return at[np.lexsort((ids[at], -scores[at]))][:n]


FOUND = "user BIGINT, features ARRAY<DOUBLE>, ids ARRAY<BIGINT>, scores ARRAY<DOUBLE>, floor DOUBLE, needed INT"


def _against_head(users, ids, values, bounds, n):
    """FOUND rows: each user's best of the head, and how many further blocks could do better."""

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            users, features = batch.column("user"), batch.column("features").to_pylist()
            for at in range(0, len(features), CHUNK):
                own = np.array(features[at : at + CHUNK], np.float64)
                length = np.sqrt((own * own).sum(axis=1))
                scores = own @ values.T
                found = [best(row, ids, n) for row in scores]
                floor = np.array([row[f[-1]] if len(f) == n else -np.inf for row, f in zip(scores, found)])
                # bounds fall, so the blocks that may hold better items come first
                reach = length[:, None] * bounds[None, :] * (1 + SLACK) + SLACK >= floor[:, None]
                yield pa.RecordBatch.from_arrays(
                    [
                        users[at : at + CHUNK], pa.array(list(own), pa.list_(pa.float64())),
                        pa.array([ids[f] for f in found], pa.list_(pa.int64())),
                        pa.array([row[f] for row, f in zip(scores, found)], pa.list_(pa.float64())),
                        pa.array(floor), pa.array(reach.sum(axis=1).astype(np.int32)),
                    ],
                    names=["user", "features", "ids", "scores", "floor", "needed"],
                )

    return users.mapInArrow(compare, FOUND)


def _against_blocks(active, blocks, n):
    """(user, product, rating): the best of each block for the users that need it."""
    tasks = max(1, -(-active.count() // USERS_PER_TASK))
    salt = F.pmod(F.xxhash64("user"), F.lit(tasks)).alias("salt")
    pairs = active.select("user", "features", "floor", salt, F.explode(F.expr("sequence(0, needed - 1)")).alias("place"))
    spread = blocks.select("place", "ids", "values", F.explode(F.expr(f"sequence(0L, {tasks - 1}L)")).alias("salt"))

    def compare(users, block):
        import pandas as pd

        out = {"user": [], "product": [], "rating": []}
        if len(users) and len(block):
            ids = np.asarray(block["ids"].iloc[0])
            values = np.asarray(block["values"].iloc[0]).reshape(len(ids), -1)
            for at in range(0, len(users), CHUNK):
                some = users.iloc[at : at + CHUNK]
                scores = np.stack(some["features"].to_numpy()) @ values.T
                for user, floor, row in zip(some["user"], some["floor"], scores):
                    found = best(row, ids, n, floor)
                    out["user"] += [user] * len(found)
                    out["product"] += ids[found].tolist()
                    out["rating"] += row[found].tolist()
        return pd.DataFrame(out).astype({"user": "int64", "product": "int64", "rating": "float64"})

    both = pairs.groupBy("place", "salt").cogroup(spread.groupBy("place", "salt"))
    return both.applyInPandas(compare, "user BIGINT, product BIGINT, rating DOUBLE")


def top_items(user_factors, item_factors, n, head=HEAD, block=BLOCK):
    """(recommendations, report): the exact ``n`` best items of every user, and what it took.

    Where most items repeat the factors of others, only the ``n`` of the least ids are compared
    of each, since every user scores them alike. Items go by falling norm. Each user is compared with the ``head`` longest; a block of others
    can only hold a better item if the product of its longest norm and the user's reaches the
    n-th score found so far (Cauchy-Schwarz), so a user meets no block beyond the first that
    fails this. Only those (user, block) pairs are shuffled. What every task holds
    is the head and one bound per block of ``block`` items.

    Recommendations are (user, recommendations) as MLlib gives them, equal ratings by product.
    The report has per user the ``blocks`` there are and the number ``compared``. Both read
    tables in the shared folder. Users or items without factors are left out.
    """
    ready = [F.col("id").cast("bigint").alias("id"), F.col("features").cast("array<double>").alias("features")]
    known = item_factors.where("features IS NOT NULL").select(*ready)
    # equal factors score alike for every user, and ties go by id
    items = materialize(top_in_group(known, ["features"], ["id"], n).withColumn("norm", norm(F.col("features"))), "items")
    if items.count() * 2 > known.count():
        items = materialize(known.withColumn("norm", norm(F.col("features"))), "items")
    first = items.orderBy(F.desc("norm"), "id").limit(head).collect()
    edge = first[-1] if len(first) == head else None
    rest = items.where(F.lit(False)) if edge is None else items.where(
        (F.col("norm") < edge["norm"]) | ((F.col("norm") == edge["norm"]) & (F.col("id") > edge["id"]))
    )
    blocks = materialize(_blocks(rest, block), "blocks")
    bounds = sorted((r["bound"], r["least"]) for r in blocks.select("bound", F.array_min("ids").alias("least")).collect())
    bounds.reverse()
    spark = items.sparkSession
    places = spark.createDataFrame([(*b, i) for i, b in enumerate(bounds)], "bound DOUBLE, least BIGINT, place INT")
    blocks = blocks.withColumn("least", F.array_min("ids")).join(places, ["bound", "least"])
    ids = np.array([r["id"] for r in first], np.int64)
    values = np.array([r["features"] for r in first], np.float64).reshape(len(first), -1 if first else 0)
    users = user_factors.where("features IS NOT NULL").select(ready[0].alias("user"), ready[1])
    users = users if first else users.where(F.lit(False))
    found = materialize(_against_head(users, ids, values, np.array([b for b, _ in bounds]), n), "found")
    active = found.where("needed > 0")
    listed = F.transform(F.arrays_zip("ids", "scores"), lambda x: F.struct(
        x["ids"].cast("int").alias("product"), x["scores"].cast("float").alias("rating")))
    settled = found.where("needed = 0").select(F.col("user").cast("int").alias("user"), listed.alias("recommendations"))
    own = active.select("user", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    rows = own.select("user", F.col("x.ids").alias("product"), F.col("x.scores").alias("rating"))
    rows = rows.unionByName(_against_blocks(active, blocks, n))
    kept = top_in_group(rows, ["user"], [F.desc("rating"), F.asc("product")], n)
    order = F.array_sort(F.collect_list(F.struct((-F.col("rating")).alias("order"), "product")))
    merged = kept.groupBy("user").agg(order.alias("best")).select(
        F.col("user").cast("int").alias("user"),
        F.transform("best", lambda x: F.struct(
            x["product"].cast("int").alias("product"), (-x["order"]).cast("float").alias("rating")
        )).alias("recommendations"),
    )
    report = found.select(
        F.col("user").cast("int").alias("user"), F.lit(len(bounds)).alias("blocks"), F.col("needed").alias("compared")
    )
    return settled.unionByName(merged), report
