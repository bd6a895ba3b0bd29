"""Interaction log: decoding, ratings, popularity."""

from pyspark.sql import functions as F

from vitrine.functions import scoring
from vitrine.operators import interactions as I
from vitrine.operators import popularity as Q
from vitrine.session import run_dir
from vitrine.sources.files import scan_interactions

from .base import AS_OF, check, sql_stamp, stamp

COLUMNS = ["id", "userId", "interactionType", "productId"]

AGE = f"CAST(epoch(TIMESTAMP '{AS_OF}') - floor(epoch(createdAt)) AS DOUBLE) / 3600"
WEIGHT = f"""(CASE WHEN {AGE} < 1 THEN 1.0::DOUBLE WHEN {AGE} < 24 THEN 0.8::DOUBLE
    WHEN {AGE} < 168 THEN 0.5::DOUBLE WHEN {AGE} < 720 THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END)"""
SCORE = """(CASE interactionType WHEN 'CLICK' THEN 1.0::DOUBLE WHEN 'VIEW' THEN 0.8::DOUBLE
    WHEN 'WISH' THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END)"""
RATING = """CASE interactionType WHEN 'CLICK' THEN 5.0::DOUBLE WHEN 'VIEW' THEN 3.0::DOUBLE
    WHEN 'WISH' THEN 5.0::DOUBLE WHEN 'CHECKOUT' THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END"""
SUMS = f"s AS (SELECT productId, sum({WEIGHT} * {SCORE}) AS p FROM interactions GROUP BY 1)"
BOUNDS = "m AS (SELECT min(p) AS lo, max(p) AS hi FROM s)"
NORMAL = "CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (p - lo) / (hi - lo) END"


def log_text(t):
    """The log as JSON text; every 97th row is cut off."""
    whole = F.to_json(F.struct("*"))
    broken = F.col("id") % 97 == 0
    return t.interactions.select(
        F.when(broken, F.lit('{"id": 5, "us')).otherwise(whole).alias("value")
    )


def shown(df):
    return df.select(*COLUMNS, stamp("createdAt").alias("createdAt"))


DECODED = f"""
    SELECT CASE WHEN id % 97 = 0 THEN 0 ELSE id END AS id,
      CASE WHEN id % 97 = 0 THEN 0 ELSE userId END AS userId,
      CASE WHEN id % 97 = 0 THEN 'Unknown' ELSE interactionType END AS interactionType,
      CASE WHEN id % 97 = 0 THEN 0 ELSE productId END AS productId,
      CASE WHEN id % 97 = 0 THEN NULL ELSE {sql_stamp("createdAt")} END AS createdAt
    FROM interactions"""


@check(
    "decode_interactions",
    f"SELECT id, userId, interactionType, productId, {sql_stamp('createdAt')} AS createdAt "
    "FROM interactions WHERE id % 97 <> 0",
    "interactions",
)
def decode_interactions(t):
    return shown(I.decode_interactions(log_text(t)).where(F.col("id").isNotNull()))


@check("fill_interaction_nulls", DECODED, "interactions")
def fill_interaction_nulls(t):
    return shown(I.fill_interaction_nulls(I.decode_interactions(log_text(t))))


@check("scan_interactions", DECODED, "interactions")
def scan_log(t):
    path = run_dir(t.spark, "log")
    log_text(t).write.text(path)
    return shown(I.fill_interaction_nulls(scan_interactions(t.spark, path)))


@check(
    "valid_interactions",
    "SELECT id, userId, productId FROM interactions WHERE productId > 0 AND userId > 0",
    "interactions",
)
def valid_interactions(t):
    return I.valid_interactions(t.interactions).select("id", "userId", "productId")


@check(
    "interactions_to_ratings",
    f'SELECT userId AS "user", productId AS product, {RATING} AS rating '
    f"FROM interactions WHERE ({RATING}) > 0",
    "interactions",
)
def interactions_to_ratings(t):
    return I.interactions_to_ratings(t.interactions)


@check(
    "interaction_age_hours",
    f"SELECT id, round({AGE}, 6) AS age FROM interactions",
    "interactions",
)
def interaction_age_hours(t):
    age = scoring.interaction_age_hours("createdAt", F.lit(AS_OF).cast("timestamp"))
    return t.interactions.select("id", F.round(age, 6).alias("age"))


@check("age_weight", f"SELECT id, {WEIGHT} AS weight FROM interactions", "interactions")
def age_weight(t):
    age = scoring.interaction_age_hours("createdAt", F.lit(AS_OF).cast("timestamp"))
    return t.interactions.select("id", scoring.age_weight(age).alias("weight"))


@check("type_score", f"SELECT id, {SCORE} AS score FROM interactions", "interactions")
def type_score(t):
    return t.interactions.select("id", scoring.type_score("interactionType").alias("score"))


@check(
    "popularity_raw",
    f"WITH {SUMS} SELECT productId, round(p, 6) AS popularity_score FROM s",
    "interactions",
)
def popularity_raw(t):
    raw = I.popularity_raw(t.interactions, AS_OF)
    return raw.select("productId", F.round("popularity_score", 6).alias("popularity_score"))


@check(
    "minmax",
    f"WITH {SUMS} SELECT round(min(p), 6) AS lo, round(max(p), 6) AS hi FROM s",
    "interactions",
)
def minmax(t):
    bounds = I.minmax(I.popularity_raw(t.interactions, AS_OF), "popularity_score")
    return bounds.select(F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


@check(
    "popularity_scores",
    f"""WITH {SUMS}, {BOUNDS}
    SELECT productId, round(p, 6) AS popularity_score,
      round({NORMAL}, 6) AS popularity_score_normal FROM s CROSS JOIN m""",
    "interactions",
)
def popularity_scores(t):
    return rounded(I.popularity_scores(t.interactions, AS_OF))


@check(
    "popularity_scores_valid_only",
    f"""WITH {SUMS.replace("FROM interactions", "FROM interactions WHERE productId > 0 AND userId > 0")},
    {BOUNDS}
    SELECT productId, round(p, 6) AS popularity_score,
      round({NORMAL}, 6) AS popularity_score_normal FROM s CROSS JOIN m""",
    "interactions",
)
def popularity_scores_valid(t):
    return rounded(I.popularity_scores(t.interactions, AS_OF, drop_invalid=True))


INSTANTS = ["2024-01-31 00:00:00", "2024-01-17 13:37:11", "2024-03-05 06:00:00"]


def sql_at(instant):
    sums = SUMS.removeprefix("s AS (").removesuffix(")").replace(AS_OF, instant)
    return f"""SELECT '{instant}' AS as_of, productId, round(p, 6) AS popularity_score,
      round({NORMAL}, 6) AS popularity_score_normal
      FROM ({sums}) CROSS JOIN (SELECT min(p) AS lo, max(p) AS hi FROM ({sums}))"""


@check("popularity_at", " UNION ALL ".join(map(sql_at, INSTANTS)), "interactions")
def popularity_at(t):
    """Scores at three instants from the same hourly partials, stored in three batches."""
    path = run_dir(t.spark, "popularity")
    third = F.pmod(F.xxhash64("id"), F.lit(3))
    for batch in (0, 1, 2, 1):  # one of them twice
        Q.add_interactions(t.interactions.where(third == batch), path, batch)
    parts = [
        rounded(Q.popularity_at(t.spark, path, instant)).withColumn("as_of", F.lit(instant)) for instant in INSTANTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def rounded(scores):
    return scores.select(
        "productId",
        F.round("popularity_score", 6).alias("popularity_score"),
        F.round("popularity_score_normal", 6).alias("popularity_score_normal"),
    )


@check(
    "popularity_payload",
    f"""WITH {SUMS}, {BOUNDS}
    SELECT printf('{{"productId": %d, "popularity": %.4f}}', productId, {NORMAL}) AS value
    FROM s CROSS JOIN m""",
    "interactions",
)
def popularity_payload(t):
    return I.popularity_payload(I.popularity_scores(t.interactions, AS_OF))


@check(
    "write_popularity",
    f"""WITH {SUMS}, {BOUNDS}
    SELECT productId, round({NORMAL}, 4) AS popularity FROM s CROSS JOIN m""",
    "interactions",
)
def write_popularity(t):
    from vitrine.plans.popularity import popularity_job

    source, out = run_dir(t.spark, "log"), run_dir(t.spark, "popularity")
    t.interactions.select(F.to_json(F.struct("*")).alias("value")).write.text(source)
    return popularity_job(t.spark, source, out, AS_OF)


@check(
    "row_counts",
    f"""SELECT count(*) AS rows, count(*) FILTER (WHERE productId > 0 AND userId > 0) AS clean,
      count(*) FILTER (WHERE ({RATING}) > 0) AS rated FROM interactions""",
    "interactions",
)
def row_counts(t):
    return I.row_counts(
        t.interactions,
        {
            "clean": (F.col("productId") > 0) & (F.col("userId") > 0),
            "rated": scoring.type_rating("interactionType") > 0,
        },
    )
