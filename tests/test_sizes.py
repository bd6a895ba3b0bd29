"""Cases that only larger tables showed."""

from pyspark.sql import functions as F

from checks import CHECKS
from checks.base import Tables


def tables(spark, folder, **frames):
    for name, df in frames.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def parts(spark, n, first=0):
    return spark.range(first, first + n).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("hot bolt "), F.col("id")).alias("p_name"), F.lit("Brand#1").alias("p_brand"),
        F.lit("ECONOMY").alias("p_type"), F.lit(3).alias("p_size"), F.lit(900.5).alias("p_retailprice"),
    )


def suppliers(spark, n, balance=1000.0):
    return spark.range(n).select(
        F.col("id").alias("s_suppkey"), F.concat(F.lit("Supplier#"), F.col("id")).alias("s_name"),
        F.lit(1).alias("s_nationkey"), F.lit(balance).alias("s_acctbal"),
    )


def test_batched_upsert_takes_every_store(spark, tmp_path):
    """With more than 5030 suppliers there is a store of the code that requests leave out."""
    folder = tables(spark, tmp_path, part=parts(spark, 4, 5028), supplier=suppliers(spark, 5032))
    rows = CHECKS["batched_upsert"][0](spark, folder).collect()
    assert {r.sku: r.cashback for r in rows} == {str(k): 9.005 for k in range(5028, 5032)}


def test_rates_of_ties_are_those_of_the_sql(spark, tmp_path):
    """Balances whose rate lies between two round ones; the engines round some of them apart."""
    import duckdb

    balances = [15.0, 145.0, 25.0, 1235.0, -465.0, 1245.0, 9985.0, 0.0]
    held = suppliers(spark, len(balances)).withColumn(
        "s_acctbal", F.element_at(F.array(*map(F.lit, balances)), (F.col("s_suppkey") + 1).cast("int"))
    )
    folder = tables(spark, tmp_path, part=parts(spark, len(balances)), supplier=held)
    with duckdb.connect() as c:
        for name in ("part", "supplier"):
            c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
        want = dict(c.execute(f"SELECT sku, cashback FROM ({CHECKS['catalog_to_product'][1]})").fetchall())
    rows = CHECKS["catalog_to_product"][0](spark, folder).collect()
    assert {r.sku: r.cashback for r in rows} == want and len(want) == len(balances)


def test_task_state_holds_buckets_of_products(spark, tmp_path, monkeypatch):
    """Products share the keys of the state, which were four for each of them."""
    from vitrine import schemas
    from vitrine.session import ROCKSDB
    from vitrine.streaming import tasks

    monkeypatch.setattr(tasks, "BUCKETS", 8, raising=False)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = spark.range(200).selectExpr(
        "concat('p', id % 100) AS product_id", "'m' AS model_id", "'s' AS scene", "concat('t', id) AS task_id",
        "CASE WHEN id < 100 THEN 'started' ELSE 'finished' END AS kind", "timestamp_seconds(id * (id % 3)) AS ts",
    )
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schemas.TASK_EVENT).parquet(f"{tmp_path}/in")
    query = tasks.track_tasks(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c")
    query = query.trigger(availableNow=True).start(f"{tmp_path}/out")
    assert query.awaitTermination(120)
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 8
    found = {r.task_id for r in spark.read.parquet(f"{tmp_path}/out").where("open").collect()}
    assert found == {r.task_id for r in tasks.open_tasks(rows).collect()} and 20 < len(found) < 80


def test_equal_factors_make_no_blocks(spark):
    """A thousand items of one vector hold no more than the least ids for anyone."""
    from vitrine.operators import factors as X

    items = spark.range(1000).select(F.col("id").cast("int").alias("id"), F.expr("array(1D + id % 2, -3D)").alias("features"))
    users = spark.createDataFrame([(7, [-1.0, 0.0]), (8, [1.0, 0.0])], "id INT, features ARRAY<DOUBLE>")
    recs, report = X.top_items(users, items, n=3, head=4, block=2)
    found = {r["user"]: [(x["product"], x["rating"]) for x in r["recommendations"]] for r in recs.collect()}
    assert found == {7: [(0, -1.0), (2, -1.0), (4, -1.0)], 8: [(1, 2.0), (3, 2.0), (5, 2.0)]}
    assert {r["blocks"] for r in report.collect()} == {1}


def test_calls_share_threads():
    """Many short calls are served by as many threads as may run at once, not by one each."""
    import threading

    from vitrine.operators.calls import windowed

    served = set()
    found = list(windowed(range(3000), lambda i: served.add(threading.current_thread()) or i, width=4))
    assert sorted(i for i, _, _ in found) == list(range(3000)) and len(served) <= 4
    for thread in served:
        thread.join(5)
    assert not any(thread.is_alive() for thread in served)


def test_tagging_is_dealt_out(spark, small):
    """One row group of products is tagged by every task there is."""
    from checks.catalog import tagged

    rows, tags = tagged(small)
    assert rows.rdd.getNumPartitions() == 1 and tags.rdd.getNumPartitions() == small.cores


def test_selections_shuffle_first_stories_only(small):
    """The ranks that choices are made of are limited within the tasks that read the stories."""
    from checks.news import selections

    plan = selections(small)[1]._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan


def captured(monkeypatch, module, name, place):
    """Frames that a step is called with; the first call ends the query."""
    frames = []

    def stop(*args, **options):
        frames.append(args[place])
        raise StopIteration

    monkeypatch.setattr(module, name, stop)
    return frames


def test_batches_of_comments_read_stored_videos(spark, small, monkeypatch):
    """The orders and parts that videos are made of are joined once, not several times in each batch."""
    import pytest
    from checks import streams

    frames = captured(monkeypatch, streams.comments, "run_comment_stream", 1)
    with pytest.raises(StopIteration):
        CHECKS["comment_stream"][0](spark, small.folder)
    assert "Join" not in frames[0]._jdf.queryExecution().optimizedPlan().toString()
    assert frames[0].count() == small.videos.count()


def test_index_of_links_is_made_of_stored_videos(spark, small, monkeypatch):
    """The same for the index: its entries are taken from one stored table."""
    import pytest
    from checks import comments

    frames = captured(monkeypatch, comments, "update_links", 2)
    with pytest.raises(StopIteration):
        CHECKS["answer_comments_indexed"][0](spark, small.folder)
    assert "Join" not in frames[0]._jdf.queryExecution().optimizedPlan().toString()


def test_first_model_of_the_fold_in_stream_reads_stored_ratings(spark, small, monkeypatch):
    """Training reads its ratings several times, so they are not the join of orders and lineitem."""
    import pytest
    from checks import streams

    frames = captured(monkeypatch, streams, "train_als", 0)
    with pytest.raises(StopIteration):
        CHECKS["fold_in_stream"][0](spark, small.folder)
    assert "Join" not in frames[0]._jdf.queryExecution().optimizedPlan().toString()
