"""From raw documents to sharded training data in five stages.

Quality classifier, near-copy removal, benchmark decontamination, mixing to target weights,
sharding. Each stage gets what its predecessor kept, written as Parquet and read again.
"""

from pyspark import cloudpickle
from pyspark.sql import functions as F

import vitrine
from vitrine.llm import classifier, decontam, forest, mixing, shards
from vitrine.llm.common import packed, same, stage

# Python workers get the package with the tasks and need no copy of their own.
cloudpickle.register_pickle_by_value(vitrine)

LEAST_QUALITY = 0.3
SHARDS = 24


def quality(spark, docs, sf_dir):
    """Documents that the byte network gives at least LEAST_QUALITY; it learns from the
    labelled ones among them."""
    network = classifier.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classifier.score_quality(docs, network, score="_score")
    return scored.where(F.col("_score") >= LEAST_QUALITY).drop("_score")


def near_copies(spark, docs, sf_dir):
    """One document of each class of near copies, that with the least id."""
    return forest.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    """Documents that benchmark passages don't contaminate."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontam.decontaminate(docs, benchmark)
    return judged.where(~F.col("contaminated")).select(*docs.columns)


def mixing_stage(spark, docs, sf_dir):
    """Documents as often as the mix reads them: once for each time that it takes at least
    half of the words. Documents without words, or beyond their source's target, go."""
    placed, _, pieces = mixing.mix_sources(docs)
    place = ["doc_id", "source", "size", "start"]
    sums = pieces.groupBy(*place).agg(F.sum("words").alias("_taken"))
    times = sums.select("doc_id", "source", "size", F.round(F.col("_taken") / F.col("size")).cast("int").alias("_times"))
    # rows alike in id, source and size are told apart by nothing else: they share the times
    alike = ["doc_id", "source", "size"]
    times = times.groupBy(*alike).agg(F.sum("_times").alias("_times"), F.count("*").alias("_rows"))
    size = F.size(mixing.words(F.col("text"))).cast("bigint").alias("size")
    sized = docs.select(packed(docs, docs.columns), "doc_id", "source", size)
    joined = sized.join(times, same(sized, times, alike)).select("_row", "_times", "_rows")
    each = F.greatest(F.round(F.col("_times") / F.col("_rows")).cast("int"), F.lit(0))
    return joined.withColumn("_copy", F.explode(F.expr("sequence(1, 2)"))).where(
        F.col("_copy") <= each
    ).select("_row.*")


def sharding(spark, docs, sf_dir):
    """(doc_id, text, lang, source, size, shard, slot) with slots gapless in each shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id", "text", "lang", "source", (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("_crc"),
    )
    placed = shards.assign_shards(sized, [1.0] * SHARDS)
    return shards.number_slots(placed, ["doc_id", "_crc", "size"]).drop("_crc")


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("sharding", sharding),
]

#: The network and the join can't be written in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
