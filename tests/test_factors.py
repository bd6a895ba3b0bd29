"""Folding users in and exact top items, against plain numpy."""

import numpy as np
import pytest

from vitrine.operators import factors as X
from vitrine.operators import ratings as R


def frames(spark, users, items):
    schema = "id INT, features ARRAY<FLOAT>"
    as_rows = lambda table: [(i, [float(x) for x in f]) for i, f in enumerate(table)]
    return spark.createDataFrame(as_rows(users), schema), spark.createDataFrame(as_rows(items), schema)


def plain_top(users, items, n):
    scores = users @ items.T
    return {
        u: sorted(((-s, i) for i, s in enumerate(row)))[:n] for u, row in enumerate(scores.astype(float))
    }


def listed(recs):
    return {r["user"]: [(-x["rating"], x["product"]) for x in r["recommendations"]] for r in recs.collect()}


@pytest.mark.parametrize("spread", [0.2, 3.0])
def test_top_items_equal_all_pairs(spark, spread):
    rng = np.random.default_rng(5)
    users = rng.integers(-8, 9, (70, 4))
    users[3] = 0  # every item scores the same
    items = np.rint(rng.integers(-9, 10, (400, 4)) * rng.lognormal(0, spread, (400, 1)))
    recs, report = X.top_items(*frames(spark, users, items), n=6, head=30, block=16)
    assert listed(recs) == plain_top(users, items, 6)
    counts = report.collect()
    assert len(counts) == 70 and {r["blocks"] for r in counts} <= set(range(24, 40))
    skipped = sum(r["blocks"] - r["compared"] for r in counts)
    if spread == 3.0:
        assert skipped > 0.8 * sum(r["blocks"] for r in counts)
    assert all(r["compared"] == r["blocks"] for r in counts if r["user"] == 3)


def test_top_items_of_few_and_none(spark):
    users, items = frames(spark, np.array([[1, 2], [0, 1]]), np.array([[3, 1], [1, 3], [2, 2]]))
    recs, _ = X.top_items(users, items, n=9, head=2, block=2)
    assert listed(recs) == plain_top(np.array([[1, 2], [0, 1]]), np.array([[3, 1], [1, 3], [2, 2]]), 9)
    for a, b in ((users.limit(0), items), (users, items.limit(0))):
        recs, report = X.top_items(a, b, n=3)
        assert recs.count() == report.count() == 0
    assert recs.dtypes == [("user", "int"), ("recommendations", "array<struct<product:int,rating:float>>")]


def rated(spark, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(int(u), int(p), float(rng.integers(1, 6))) for u in range(40) for p in rng.choice(60, 12, False)]
    return rows, spark.createDataFrame(rows, "user INT, product INT, rating DOUBLE")


def test_top_items_equal_those_of_the_model(spark):
    _, ratings = rated(spark)
    model = R.train_als(ratings, {"maxIter": 3, "rank": 4, "regParam": 0.1})
    recs, _ = X.top_items(model.userFactors, model.itemFactors, n=7, head=16, block=8)
    want = {r["user"]: [x["rating"] for x in r["recommendations"]] for r in model.recommendForAllUsers(7).collect()}
    got = {r["user"]: [x["rating"] for x in r["recommendations"]] for r in recs.collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[u], want[u], atol=1e-5) for u in want)


def test_fold_in_solves_the_ridge_equations(spark):
    rows, ratings = rated(spark)
    rng = np.random.default_rng(2)
    items = rng.normal(size=(55, 3)).astype(np.float32)  # products 55 to 59 are unknown
    odd = spark.createDataFrame([(1, None, 2.0), (None, 3, 2.0), (2, 4, None), (99, 58, 1.0)], ratings.schema)
    _, item_factors = frames(spark, items[:1], items)
    found = {r["id"]: r["features"] for r in X.fold_in(ratings.union(odd), item_factors, 3, 0.1).collect()}
    assert set(found) == set(range(40))
    for user, got in found.items():
        y = np.array([items[p] for u, p, _ in rows if u == user and p < 55], float)
        r = np.array([x for u, p, x in rows if u == user and p < 55])
        want = np.linalg.solve(y.T @ y + 0.1 * len(r) * np.eye(3), y.T @ r)
        assert np.allclose(got, want)
    with pytest.raises(ValueError):
        X.fold_in(ratings, item_factors, 3, 0.0)


def test_folding_in_the_training_ratings_nears_the_model(spark):
    """One more half step of the training from its item factors moves users little."""
    _, ratings = rated(spark)
    model = R.train_als(ratings, {"maxIter": 15, "rank": 3, "regParam": 0.1})
    folded = {r["id"]: r["features"] for r in X.fold_in(ratings, model.itemFactors, 3, 0.1).collect()}
    for row in model.userFactors.collect():
        assert np.allclose(folded[row["id"]], row["features"], atol=0.15)


def test_fold_in_stream_follows_a_newly_trained_model(spark, tmp_path):
    """Without a model batches are only stored; a new model takes the history in once."""
    from pyspark.sql import functions as F

    from vitrine.operators.upsert import read_current
    from vitrine.sources.models import load_model
    from vitrine.streaming import ratings as S

    places = [str(tmp_path / n) for n in ("model", "store", "sums", "factors", "recs")]
    options = {"params": {"regParam": 0.1}, "n": 3}
    handle = S.fold_in_batch(spark, *places, **options)
    _, all_ratings = rated(spark)
    parts = [all_ratings.where((F.col("product") + F.col("user")) % 3 == i) for i in range(3)]
    handle(parts[0], 0)
    assert read_current(spark, places[3]) is None
    handle(parts[1], 1)
    S.train_stored(spark, places[0], places[1], {"maxIter": 3, "rank": 2, "regParam": 0.1})
    busy = parts[2].where("user < 20")
    handle(busy, 2)
    handle(busy, 2)
    items = load_model(spark, places[0]).itemFactors
    so_far = parts[0].union(parts[1]).union(busy)
    want = {r["id"]: r["features"] for r in X.fold_in(so_far, items, 2, 0.1).collect()}
    got = {r["id"]: r["features"] for r in read_current(spark, places[3]).collect()}
    known = {r["user"] for r in busy.join(items, F.col("id") == F.col("product")).collect()}
    assert set(got) == known
    assert all(np.allclose(got[u], want[u], atol=1e-6) for u in got)
    assert set(r["user"] for r in read_current(spark, places[4]).collect()) == set(got)
