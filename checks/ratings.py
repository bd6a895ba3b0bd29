"""Ratings, models, recommendations."""

from functools import cache

from pyspark.sql import functions as F

from vitrine.operators import factors as X
from vitrine.operators import interactions as I
from vitrine.operators import ratings as R
from vitrine.plans import recommendations as P
from vitrine.session import run_dir
from vitrine.sources.models import latest_model, load_model

from .base import check
from .interactions import RATING

RATED = (
    f'SELECT userId AS "user", productId AS product, {RATING} AS rating, id FROM interactions '
    f"WHERE ({RATING}) > 0 AND productId > 0 AND userId > 0"
)


def rated(t, keep=("id",)):
    return I.interactions_to_ratings(I.valid_interactions(t.interactions), keep=keep)


@check("split_ratings", RATED, "interactions")
def split_ratings(t):
    """Both sides together are the ratings again."""
    training, test = R.split_ratings(rated(t))
    return training.unionByName(test)


@check(
    "split_share",
    f"""
    WITH r AS ({RATED})
    SELECT side, true AS in_bounds, count(*) AS all_rows
    FROM r CROSS JOIN (VALUES ('test'), ('training')) s(side) GROUP BY side""",
    "interactions",
)
def split_share(t):
    """A fifth of the rows, give or take, is the test side."""
    training, test = R.split_ratings(rated(t))
    sides = training.withColumn("side", F.lit("training")).unionByName(
        test.withColumn("side", F.lit("test"))
    )
    counts = sides.groupBy("side").agg(F.count(F.lit(1)).alias("rows"))
    every = rated(t).agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.col("rows") / every
    wanted = F.when(F.col("side") == "test", 0.2).otherwise(0.8)
    return counts.select("side", (F.abs(share - wanted) < 0.1).alias("in_bounds"), every.alias("all_rows"))


@cache
def trained(spark, folder):
    """One model per folder, trained and committed once; returns its path."""
    from .base import Tables

    path = run_dir(spark, "model")
    P.train_job(spark, Tables(spark, folder).interactions, path)
    return path


def model(t):
    return load_model(t.spark, trained(t.spark, t.folder))


@cache
def _fitted(spark, folder):
    from .base import Tables

    return R.train_als(rated(Tables(spark, folder), keep=()))


def fitted(t):
    """A model of all ratings, so that every user and product is known."""
    return _fitted(t.spark, t.folder)


USERS = 'SELECT DISTINCT "user" FROM (' + RATED + ")"


@check("train_als", f'SELECT count(DISTINCT "user") AS users, 2 AS rank FROM ({RATED})', "interactions")
def train_als(t):
    """Every rated user has a factor of the set rank."""
    fitted = R.train_als(rated(t, keep=()))
    return fitted.userFactors.agg(
        F.count(F.lit(1)).alias("users"), F.max(F.size("features")).alias("rank")
    )


@check("score", f"SELECT *, true AS predicted FROM ({RATED})", "interactions")
def score(t):
    """Every rating of known users and products gets a number."""
    rows = R.score(fitted(t), rated(t))
    number = F.col("prediction").isNotNull() & ~F.isnan("prediction")
    return rows.select("id", "user", "product", "rating", number.alias("predicted"))


@check("model_rmse", "SELECT true AS better")
def model_rmse(t):
    """Error of the model next to that of always guessing the mean."""
    predictions = R.score(model(t), rated(t))
    mean = predictions.agg(F.avg("rating").alias("m")).scalar()
    baseline = R.rmse(predictions.withColumn("prediction", mean))
    return R.rmse(predictions).select((F.col("rmse") < baseline.scalar()).alias("better"))


@check(
    "rmse",
    """
    SELECT round(sqrt(avg(power(l_quantity - CAST(l_extendedprice / 2000 AS DOUBLE), 2))), 6) AS rmse
    FROM lineitem""",
)
def rmse(t):
    rows = t.lineitem.select(
        F.col("l_quantity").alias("rating"), (F.col("l_extendedprice") / 2000).alias("prediction")
    )
    return R.rmse(rows).select(F.round("rmse", 6).alias("rmse"))


@check(
    "champion_challenger",
    "SELECT * FROM (VALUES ('first', true, 1, true), ('worse', false, 1, true)) "
    "t(model, saved, newest, first_is_better)",
)
def champion_challenger(t):
    """A second model trained worse on purpose is not saved over the first."""
    spark = t.spark
    path = run_dir(spark, "model")
    ratings = rated(t, keep=()).persist()
    first = P.champion_challenger(spark, R.train_als(ratings), ratings, path)
    worse = R.train_als(ratings, {"maxIter": 1, "regParam": 10.0, "rank": 1})
    second = P.champion_challenger(spark, worse, ratings, path)
    ratings.unpersist()
    newest = latest_model(spark, path)["version"]
    again = abs(second["old"] - first["new"]) <= 1e-9 * first["new"]
    better = first["new"] < second["new"] and again
    rows = [("first", first["version"] == 1), ("worse", second["version"] is not None)]
    return spark.createDataFrame(rows, "model STRING, saved BOOLEAN").withColumns(
        {"newest": F.lit(newest), "first_is_better": F.lit(better)}
    )


@check(
    "load_model",
    f'SELECT count(DISTINCT "user") AS users FROM ({RATED})',
    "interactions",
)
def load(t):
    """The model saved last predicts for every rated user of the training part."""
    path = run_dir(t.spark, "model")
    ratings = rated(t, keep=())
    P.champion_challenger(t.spark, R.train_als(ratings), ratings, path)
    return load_model(t.spark, path).userFactors.agg(F.count(F.lit(1)).alias("users"))


def best_first(ratings):
    """Whether an array of ratings never rises."""
    return F.expr(f"forall(sequence(0, size({ratings}) - 1), i -> i = 0 OR {ratings}[i - 1] >= {ratings}[i])")


@check(
    "recommend_user",
    f"""
    WITH r AS ({RATED}), u AS (SELECT min("user") AS "user" FROM r)
    SELECT CAST(min(u."user") AS INTEGER) AS user_id, least(10, count(DISTINCT r.product)) AS n,
      least(10, count(DISTINCT r.product)) AS known_products, true AS descending
    FROM r CROSS JOIN u""",
    "interactions",
)
def recommend_user(t):
    """Ten different rated products of one user, best first."""
    rows = rated(t, keep=())
    user = rows.agg(F.min("user")).first()[0]
    recs = R.recommend_user(fitted(t), user, 10)
    flat = R.flatten_recs(recs).join(
        rows.select(F.col("product").alias("product_id")).distinct(), "product_id"
    )
    known = flat.select("product_id").distinct().agg(F.count(F.lit(1))).scalar()
    return recs.select(
        F.col("user").alias("user_id"), F.size("recommendations").cast("bigint").alias("n"),
        known.alias("known_products"), best_first("recommendations.rating").alias("descending"),
    )


@check(
    "recommend_all",
    f"""
    WITH r AS ({RATED}), i AS (SELECT count(DISTINCT product) AS items FROM r)
    SELECT CAST("user" AS INTEGER) AS "user", least(20, min(items)) AS recommended,
      true AS descending
    FROM r CROSS JOIN i GROUP BY 1""",
    "interactions",
)
def recommend_all(t):
    """Number of recommendations per user, best first."""
    recs = R.recommend_all(R.train_als(rated(t, keep=())), 20)
    by_rating = F.array_sort(
        "recommendations", lambda a, b: F.when(a["rating"] > b["rating"], -1)
        .when(a["rating"] < b["rating"], 1).otherwise(0),
    )
    return recs.select(
        "user",
        F.size("recommendations").cast("bigint").alias("recommended"),
        (F.transform(by_rating, lambda r: r["rating"])
         == F.transform("recommendations", lambda r: r["rating"])).alias("descending"),
    )


def line_recs(t):
    """Recommendations made of order lines: per order its parts with the quantities."""
    rec = F.struct(
        F.col("l_partkey").cast("int").alias("product"), F.col("l_quantity").alias("rating")
    )
    return t.lineitem.groupBy(F.col("l_orderkey").cast("int").alias("user")).agg(
        F.collect_list(rec).alias("recommendations")
    )


@check(
    "flatten_recs",
    """
    SELECT CAST(l_orderkey AS INTEGER) AS user_id, CAST(l_partkey AS INTEGER) AS product_id,
      l_quantity AS rating FROM lineitem""",
)
def flatten_recs(t):
    return R.flatten_recs(line_recs(t))


@check(
    "top_products_global",
    """
    SELECT CAST(l_partkey AS INTEGER) AS product_id, l_quantity AS rating FROM lineitem
    ORDER BY l_quantity DESC, l_partkey, l_orderkey LIMIT 10""",
)
def top_products_global(t):
    return R.top_products_global(line_recs(t))


@check(
    "top_products_distinct",
    """
    SELECT CAST(l_partkey AS INTEGER) AS product_id, max(l_quantity) AS rating FROM lineitem
    GROUP BY 1 ORDER BY rating DESC, product_id LIMIT 10""",
)
def top_products_distinct(t):
    return R.top_products_global(line_recs(t), distinct=True)


@check(
    "top_recommendations",
    """
    SELECT CAST(l_partkey AS INTEGER) AS product_id, l_quantity AS rating FROM lineitem
    ORDER BY l_quantity DESC, l_partkey, l_orderkey LIMIT 10""",
)
def top_recommendations(t):
    """The global ranking on recommendations made of order lines."""
    rec = F.struct(
        F.col("l_partkey").cast("int").alias("product"), F.col("l_quantity").alias("rating")
    )
    recs = t.lineitem.select(
        F.col("l_orderkey").cast("int").alias("user"), F.array(rec).alias("recommendations")
    )
    return R.top_products_global(recs)


@check(
    "recommendation_payload",
    """
    SELECT printf('{"user":%d,"recommendations":[{"product":%d,"rating":%d}]}', l_orderkey,
      l_partkey, CAST(l_quantity AS INTEGER)) AS value FROM lineitem""",
)
def recommendation_payload(t):
    rec = F.struct(
        F.col("l_partkey").alias("product"), F.col("l_quantity").cast("int").alias("rating")
    )
    recs = t.lineitem.select(
        F.col("l_orderkey").alias("user"), F.array(rec).alias("recommendations")
    )
    return R.recommendation_payload(recs)


@check("recommendations_table", "SELECT true AS ten_or_fewer, true AS known_users, true AS known_products")
def recommendations_table(t):
    """The job's table names rated users and products only, ten a user at most."""
    out = run_dir(t.spark, "recs")
    flat = P.recommendations_job(t.spark, trained(t.spark, t.folder), out, n=10)
    rows = rated(t, keep=())
    users = rows.select(F.col("user").alias("user_id")).distinct()
    products = rows.select(F.col("product").alias("product_id")).distinct()
    most = flat.groupBy("user_id").count().agg(F.max("count")).first()[0]
    return t.spark.range(1).select(
        F.lit(most is not None and 0 < most <= 10).alias("ten_or_fewer"),
        F.lit(flat.join(users, "user_id", "left_anti").isEmpty()).alias("known_users"),
        F.lit(flat.join(products, "product_id", "left_anti").isEmpty()).alias("known_products"),
    )


LARGE = 10_000_000_000


@check(
    "train_large_ids",
    f"""
    SELECT count(DISTINCT "user") * 0 + 1 AS model_version, true AS known_users,
      true AS known_products FROM ({RATED})""",
    "interactions",
)
def train_large_ids(t):
    """Training and recommending with ids beyond 32 bits."""
    path, out = run_dir(t.spark, "model"), run_dir(t.spark, "recs")
    wide = t.interactions.withColumns(
        {c: F.col(c) * F.lit(LARGE) for c in ("userId", "productId")}
    )
    outcome = P.train_job(t.spark, wide, path)
    flat = P.recommendations_job(t.spark, path, out, n=5)
    rows = rated(t, keep=())
    users = rows.select((F.col("user") * F.lit(LARGE)).alias("user_id")).distinct()
    products = rows.select((F.col("product") * F.lit(LARGE)).alias("product_id")).distinct()
    return t.spark.range(1).select(
        F.lit(outcome["version"]).cast("bigint").alias("model_version"),
        F.lit(not flat.isEmpty() and flat.join(users, "user_id", "left_anti").isEmpty()).alias("known_users"),
        F.lit(flat.join(products, "product_id", "left_anti").isEmpty()).alias("known_products"),
    )


@check(
    "batch_gate",
    """
    SELECT o_orderpriority AS batch, count(*) > 10 AS large FROM orders GROUP BY 1
    UNION ALL SELECT 'none', false""",
)
def batch_gate(t):
    """Whether the orders of each priority, and no orders, are enough to train on."""
    from vitrine.streaming.ratings import batch_gate as gate

    kinds = [r[0] for r in t.orders.select("o_orderpriority").distinct().collect()]
    batches = [(k, gate(t.orders.where(F.col("o_orderpriority") == k))) for k in kinds]
    batches.append(("none", gate(t.orders.where(F.lit(False)))))
    return t.spark.createDataFrame(batches, "batch STRING, large BOOLEAN")


# factors of parts and customers, whole numbers so that every engine sums them alike
PART_FACTORS = """
    SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, floor(p_retailprice / 100) AS y FROM part"""
BOUGHT = """
    SELECT o_custkey AS u, l_partkey AS p, l_quantity AS q FROM orders
    JOIN lineitem ON l_orderkey = o_orderkey"""
# the two normal equations of each customer, solved by determinants
SOLVED = f"""
    WITH s AS (
      SELECT u, count(*) AS n, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(q * x) AS qx,
        sum(q * y) AS qy
      FROM ({BOUGHT}) JOIN ({PART_FACTORS}) ON id = p GROUP BY u),
    r AS (SELECT *, xx + 0.1::DOUBLE * n AS a, yy + 0.1::DOUBLE * n AS d FROM s)
    SELECT CAST(u AS INTEGER) AS id, round((qx * d - qy * xy) / (a * d - xy * xy), 6) AS first,
      round((qy * a - qx * xy) / (a * d - xy * xy), 6) AS second
    FROM r"""


def part_factors(t):
    return t.part.select(
        F.col("p_partkey").cast("int").alias("id"),
        F.array(F.col("p_size").cast("double"), F.floor(F.col("p_retailprice") / 100).cast("double")).alias("features"),
    )


def bought(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").cast("int").alias("user"), F.col("l_partkey").cast("int").alias("product"),
        F.col("l_quantity").cast("double").alias("rating"),
    )


def rounded_factors(factors):
    return factors.select(
        "id", F.round(F.col("features")[0], 6).alias("first"), F.round(F.col("features")[1], 6).alias("second")
    )


@check("fold_in", SOLVED)
def fold_in(t):
    """Factors of every customer against fixed factors of the parts, by ridge regression."""
    return rounded_factors(X.fold_in(bought(t), part_factors(t), 2, 0.1))


@check(
    "top_items",
    f"""
    WITH i AS ({PART_FACTORS}),
    u AS (SELECT c_custkey AS u, floor(c_acctbal / 100) AS x, c_nationkey - 12 AS y FROM customer),
    s AS (SELECT u, id, u.x * i.x + u.y * i.y AS score FROM u CROSS JOIN i)
    SELECT CAST(u AS INTEGER) AS user_id, CAST(id AS INTEGER) AS product_id, CAST(score AS DOUBLE) AS rating,
      row_number() OVER (PARTITION BY u ORDER BY score DESC, id) AS place
    FROM s QUALIFY place <= 10""",
)
def top_items(t):
    """The ten best parts of every customer, by blocks that can still hold better ones."""
    recs, _ = X.top_items(account_factors(t), part_factors(t), 10, head=128, block=128)
    return recs.select(
        F.col("user").alias("user_id"), F.posexplode("recommendations").alias("at", "r")
    ).select(
        "user_id", F.col("r.product").alias("product_id"), F.col("r.rating").cast("double").alias("rating"),
        (F.col("at") + 1).cast("bigint").alias("place"),
    )


def account_factors(t):
    return t.customer.select(
        F.col("c_custkey").cast("int").alias("id"),
        F.array(F.floor(F.col("c_acctbal") / 100).cast("double"), (F.col("c_nationkey") - 12).cast("double")).alias("features"),
    )


@check(
    "top_items_skipped",
    "SELECT count(*) AS users, true AS within, true AS some_skipped, count(*) AS whole FROM customer",
)
def top_items_skipped(t):
    """How many blocks the bound spares: some, and no user is left out."""
    recs, report = X.top_items(account_factors(t), part_factors(t), 10, head=128, block=128)
    whole = recs.where(F.size("recommendations") == 10).count()
    return report.agg(
        F.count(F.lit(1)).alias("users"), F.min(F.col("compared") <= F.col("blocks")).alias("within"),
        (F.sum("compared") < F.sum("blocks")).alias("some_skipped"),
    ).withColumn("whole", F.lit(whole).cast("bigint"))


@check(
    "to_json_rows",
    """
    SELECT printf('{"o_orderkey":%d,"o_orderstatus":"%s","o_orderpriority":"%s"}', o_orderkey,
      o_orderstatus, o_orderpriority) AS value FROM orders""",
)
def to_json_rows(t):
    return R.to_json_rows(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@check(
    "write_seed_ratings",
    """SELECT CAST(c_custkey AS INTEGER) AS "user", 0.0::DOUBLE AS rating FROM customer""",
)
def seeds(t):
    from vitrine.sources.sinks import write_seed_ratings

    path = run_dir(t.spark, "seeds")
    write_seed_ratings(R.seed_users(t.customer.select(F.col("c_custkey").alias("id"))), path)
    return t.spark.read.schema("user INT, rating DOUBLE").json(path)


@check(
    "seeded_ratings",
    """
    WITH pairs AS (SELECT DISTINCT o_custkey AS u, l_partkey AS p FROM orders
                   JOIN lineitem ON l_orderkey = o_orderkey),
    given AS (SELECT o_custkey AS u, l_partkey AS p, l_quantity AS q FROM orders
              JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
    SELECT CAST(pairs.u AS INTEGER) AS "user", CAST(pairs.p AS INTEGER) AS product,
      coalesce(q, 0.0) AS rating
    FROM pairs LEFT JOIN given ON pairs.u = given.u AND pairs.p = given.p
    WHERE q IS NOT NULL OR pairs.u IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""",
)
def seeded_ratings(t):
    bought = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").cast("int").alias("user"),
        F.col("l_partkey").cast("int").alias("product"),
        F.col("l_quantity").alias("rating"),
        "l_returnflag",
    )
    pairs = bought.select("user", "product").distinct()
    users = t.customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("id"))
    given = bought.where(F.col("l_returnflag") == "R")
    return R.seeded_ratings(pairs, given, R.seed_users(users))


@check(
    "dense_ids",
    """
    SELECT k AS product, CAST(dense_rank() OVER (ORDER BY k) - 1 AS INTEGER) AS dense FROM
      (SELECT DISTINCT l_partkey * 10000000000 AS k FROM lineitem)""",
)
def dense_ids(t):
    keys = t.lineitem.select((F.col("l_partkey") * F.lit(10000000000)).alias("product"))
    return R.dense_ids(keys, "product", "dense")
