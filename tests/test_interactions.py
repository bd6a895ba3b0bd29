"""Interaction log, edge cases."""

from pyspark.sql import functions as F

from vitrine.operators import interactions as I

AS_OF = "2024-01-31 00:00:00"


def log(spark, *lines):
    return spark.createDataFrame([(line,) for line in lines], "value STRING")


def test_created_at_forms(spark):
    rows = I.fill_interaction_nulls(
        I.decode_interactions(
            log(
                spark,
                '{"id":1,"userId":2,"interactionType":"CLICK","productId":3,'
                '"createdAt":"2024-01-30T23:30:00Z"}',
                '{"id":2,"createdAt":1706659200}',
                "not json",
            )
        )
    ).collect()
    assert str(rows[0].createdAt) == "2024-01-30 23:30:00"
    assert str(rows[1].createdAt) == "2024-01-31 00:00:00"
    assert (rows[1].userId, rows[1].interactionType) == (0, "Unknown")
    assert tuple(rows[2]) == (0, 0, "Unknown", 0, None)


def interactions(spark, rows):
    return spark.createDataFrame(
        rows, "id BIGINT, userId BIGINT, interactionType STRING, productId BIGINT, createdAt STRING"
    ).withColumn("createdAt", F.col("createdAt").cast("timestamp"))


def test_popularity(spark):
    rows = interactions(
        spark,
        [
            (1, 1, "CLICK", 10, "2024-01-30 23:30:00"),
            (2, 1, "VIEW", 10, "2024-01-30 12:00:00"),
            (3, 2, "CHECKOUT", 11, "2024-01-30 23:30:00"),
            (4, 2, "WISH", 12, None),
            (5, 0, "CLICK", 0, "2024-01-30 23:59:59"),
        ],
    )
    got = {r[0]: r[1:] for r in I.popularity_scores(rows, AS_OF).collect()}
    assert round(got[10][0], 6) == 1.64
    assert got[11] == (0.0, 0.0)
    assert round(got[12][0], 6) == 0.07
    assert round(got[0][1], 6) == round(1 / 1.64, 6)
    valid = I.popularity_scores(rows, AS_OF, drop_invalid=True)
    assert {r[0] for r in valid.collect()} == {10, 11, 12}


def test_equal_scores_are_one_and_nothing_gives_nothing(spark):
    same = interactions(spark, [(1, 1, "CLICK", p, "2024-01-30 23:30:00") for p in (1, 2)])
    assert [r[2] for r in I.popularity_scores(same, AS_OF).collect()] == [1.0, 1.0]
    assert I.popularity_scores(same.limit(0), AS_OF).count() == 0


def test_payload_rounds_half_up(spark):
    scores = spark.createDataFrame(
        [(7, 1.0, 0.00005)],
        "productId BIGINT, popularity_score DOUBLE, popularity_score_normal DOUBLE",
    )
    assert I.popularity_payload(scores).first()[0] == '{"productId": 7, "popularity": 0.0001}'


def test_observed_counts_without_another_job(spark):
    frame, observation = I.observed(spark.range(17), "seen")
    frame.collect()
    assert observation.get["rows"] == 17
