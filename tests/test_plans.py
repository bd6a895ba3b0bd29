"""Shapes of physical plans that matter at scale, and answers under skew."""

from pyspark.sql import functions as F

from checks import CHECKS
from vitrine.operators import catalog as C
from vitrine.operators import feed as V
from vitrine.operators.grouping import spread_lookup, top_in_group, written_lookup
from vitrine.operators.interactions import popularity_scores

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    text = plan(df)
    return text[: text.index("== Initial Plan ==")] if "== Initial Plan ==" in text else text


def test_filters_and_columns_reach_the_scan(spark, tmp_path, small):
    path = str(tmp_path / "products")
    small.products.write.parquet(path)
    text = plan(C.unused_products(spark.read.parquet(path)).select("id"))
    assert "PushedFilters: [IsNotNull(video_generated), Not(EqualTo(video_generated,true))]" in text
    assert "ReadSchema: struct<id:bigint,video_generated:boolean>" in text


def test_popularity_scans_the_log_once(spark, small):
    text = final_plan(popularity_scores(small.interactions, "2024-01-31 00:00:00"))
    assert "ReusedExchange" in text or "ReusedSubquery" in text
    assert "BroadcastNestedLoopJoin" not in text and "Cartesian" not in text


def test_group_limits_run_before_the_shuffle(small):
    text = plan(C.first_per_sku(small.repeats))
    partial, exchange = text.index("Partial"), text.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in text and partial > exchange  # printed from the top down


def test_pages_use_top_k(small):
    assert "TakeOrderedAndProject" in plan(V.feed_page(small.videos, 3, 10))
    assert "TakeOrderedAndProject" in plan(V.next_unpublished(small.videos))


def test_keyword_match_has_no_nested_loop(spark):
    for name in ("match_keywords", "match_keywords_documents", "choose_links"):
        text = plan(CHECKS[name][0](spark, SMALL))
        assert "NestedLoop" not in text and "Cartesian" not in text, name


def test_no_python_in_column_functions(spark):
    for name in ("catalog_to_product", "direct_story", "gallery", "planned_scenes", "reply_text"):
        text = plan(CHECKS[name][0](spark, SMALL))
        assert "Python" not in text and "Arrow" not in text, name


def hot(spark, rows=3000):
    """A third of the rows share one key, a third have none, exact copies included."""
    return spark.range(rows).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).when(F.col("id") % 3 == 1, F.col("id")).alias("k"),
        (F.col("id") % 7).alias("v"),
    )


def without_broadcast(spark, run):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    try:
        return run()
    finally:
        for name in names:
            spark.conf.unset(name)


def test_lookups_equal_plain_joins(spark):
    left = hot(spark)
    right = spark.range(0, 3000, 2).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("w"))
    right = right.withColumn("k", F.col("k") + 1)

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    def compare():
        for how in ("left", "inner", "left_semi"):
            wanted = rows(left.join(right, "k", how).select("k", "v"))
            for salts in (1, 8):
                got = spread_lookup(left, right, ["k"], how, salts=salts)
                assert rows(got.select("k", "v")) == wanted
            got = written_lookup(left, right, ["k"], how)
            assert rows(got.select("k", "v")) == wanted

    compare()
    without_broadcast(spark, compare)


def test_hot_key_is_spread_over_partitions(spark):
    def largest_share():
        left = hot(spark)
        right = spark.createDataFrame([(1, "x")], "k BIGINT, w STRING")
        joined = spread_lookup(left, right, ["k"], "inner", spread_by=["v"])
        counts = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
        return max(counts) / sum(counts)

    def run():
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            return largest_share()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")

    assert without_broadcast(spark, run) < 0.8


def test_top_in_group_of_a_hot_group(spark):
    rows = top_in_group(hot(spark), ["k"], ["v"], 2)
    counts = {r.k: r["count"] for r in rows.groupBy("k").count().collect()}
    assert counts[1] == 2 and counts[None] == 2 and counts[4] == 1
