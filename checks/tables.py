"""Tables: scans, upserts, images."""

from pyspark.sql import functions as F

from vitrine.operators import images as G
from vitrine.operators import upsert as K
from vitrine.session import run_dir
from vitrine.sources.files import scan_table
from vitrine.sources.sinks import batched_upsert

from .base import check


@check("scan_table", "SELECT doc_id, lang, source, n_chars FROM documents")
def table(t):
    return scan_table(t.spark, t.folder, "documents").select("doc_id", "lang", "source", "n_chars")


CHANGED = """
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'changed' ELSE o_orderstatus END
      AS status FROM orders
    UNION ALL SELECT -1 - o_orderkey, 'new' FROM orders WHERE o_orderkey % 5 = 0"""


def target(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


def changes(t):
    old = t.orders.where(F.col("o_orderkey") % 3 == 0).select(
        F.col("o_orderkey").alias("id"), F.lit("changed").alias("status")
    )
    new = t.orders.where(F.col("o_orderkey") % 5 == 0).select(
        (F.lit(-1) - F.col("o_orderkey")).alias("id"), F.lit("new").alias("status")
    )
    return old.unionByName(new)


@check("upsert", CHANGED)
def upsert(t):
    return K.upsert(target(t), changes(t), ["id"])


@check("write_upsert", CHANGED)
def write_upsert(t):
    path = run_dir(t.spark, "orders")
    K.write_upsert(t.spark, path, target(t), ["id"], buckets=8)
    K.write_upsert(t.spark, path, changes(t), ["id"], buckets=8)
    return K.read_current(t.spark, path)


@check(
    "write_upsert_rebucketed",
    """
    SELECT l_orderkey AS id, CASE WHEN l_orderkey % 2 = 0 THEN max(l_linenumber) ELSE 0 END AS n
    FROM lineitem GROUP BY l_orderkey""",
)
def write_upsert_rebucketed(t):
    """Repeated keys, then a change of the bucket count."""
    path = run_dir(t.spark, "lines")
    rows = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"))
    K.write_upsert(t.spark, path, rows.withColumn("n", F.lit(0)), ["id"], 8, order=["n"])
    K.write_upsert(t.spark, path, rows.where("id % 2 = 0"), ["id"], 32, order=["n"])
    K.remove_superseded(t.spark, path)
    return K.read_current(t.spark, path)


@check(
    "write_upsert_null_keys",
    """
    SELECT CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS id,
      max(o_orderkey) AS last
    FROM orders GROUP BY 1""",
)
def write_upsert_null_keys(t):
    path = run_dir(t.spark, "customers")
    key = F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey"))
    rows = t.orders.select(key.alias("id"), F.col("o_orderkey").alias("last"))
    for part in (rows.where("last % 2 = 0"), rows):
        K.write_upsert(t.spark, path, part, ["id"], order=["last"])
    return K.read_current(t.spark, path)


@check(
    "batched_upsert_repeats",
    """
    SELECT CAST(l_partkey AS VARCHAR(20)) AS sku, max(l_orderkey * 10 + l_linenumber) AS pos
    FROM lineitem GROUP BY 1""",
)
def batched_upsert_repeats(t):
    """Several rows of a SKU in one load: the last place counts."""
    path = run_dir(t.spark, "repeats")
    rows = t.repeats.select("sku", "pos", F.lit("2024-01-31").alias("update_at"))
    batched_upsert(t.spark, rows, path)
    return K.read_current(t.spark, path).select("sku", "pos")


@check(
    "latest_changes",
    """
    SELECT l_orderkey, l_linenumber, l_partkey FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn
      FROM lineitem) WHERE rn = 1""",
)
def latest_changes(t):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = K.latest_changes(t.lineitem, ["l_orderkey"], order)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey")


def landed(t):
    """Image files of documents: headers of all kinds, some broken, some of no size."""
    n = F.col("doc_id")
    width = F.lpad(F.hex(F.when(n % 7 == 0, 0).otherwise(n + 1)), 8, "0")
    short = F.lpad(F.hex(n % 200 + 1), 4, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), width, F.lit("00000010"))
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), short, short,
                    F.lit("030122"))
    gif = F.concat(F.lit("4749463839610A000A00"), short)
    content = (
        F.when(n % 4 == 0, png).when(n % 4 == 1, jpeg).when(n % 4 == 2, gif)
        .otherwise(F.lit("3C68746D6C3E"))
    )
    return t.documents.select(
        F.concat(F.lit("img/"), n.cast("string")).alias("path"),
        F.unhex(content).alias("content"),
    )


@check(
    "image_sizes",
    """
    SELECT concat('img/', doc_id) AS path,
      CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id + 1 END
        WHEN 1 THEN doc_id % 200 + 1 WHEN 2 THEN 10 ELSE 0 END AS width,
      CASE doc_id % 4 WHEN 0 THEN 16 WHEN 1 THEN doc_id % 200 + 1 WHEN 2 THEN 10 ELSE 0 END
        AS height
    FROM documents""",
)
def image_sizes(t):
    return G.image_sizes(landed(t))


@check(
    "valid_images",
    """
    SELECT doc_id FROM documents
    WHERE doc_id % 4 <> 3 AND NOT (doc_id % 4 = 0 AND doc_id % 7 = 0)""",
)
def valid_images(t):
    rows = t.documents.select("doc_id", F.concat(F.lit("img/"), "doc_id").alias("image_path"))
    return G.valid_images(rows, landed(t)).select("doc_id")
