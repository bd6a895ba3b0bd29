"""Sharding by weighted rendezvous hashing of record keys."""

from pyspark.sql import Window
from pyspark.sql import functions as F

HASH_BITS = 60
RANGES = 1024


def shard_score(key, shard, weight, seed=0):
    """Score of a shard for a key, lowest wins: ``-ln(u) / weight`` with a uniform hash ``u``."""
    name = F.concat_ws("|", F.lit(str(seed)), F.lit(str(shard)), key)
    u = (point(name) + 0.5) / float(2**HASH_BITS)
    return -F.log(u) / float(weight)


def point(name):
    """The first 60 bits of the MD5 of a string, as a bigint."""
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def key_text(column):
    """A key as text; null is a key of its own."""
    return F.coalesce(column.cast("string"), F.lit("\\N"))


def rendezvous_shard(key, weights, seed=0):
    """The shard of a key: each shard draws its own score, so one shard more or less
    moves only the keys that it wins or held. Ties go to the lower shard.

    ``weights`` lists one positive weight per shard; a shard gets rows in proportion.
    """
    scores = [
        F.struct(shard_score(key, i, w, seed).alias("score"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)
    ]
    return F.array_min(F.array(*scores)).getField("shard")


def assign_shards(docs, weights, key="doc_id", grown=None, seed=0):
    """Rows with ``shard``, and with ``grown_shard`` under the ``grown`` weights if given.

    The key column alone decides: equal keys share a shard, a null key is a key too, and
    the text is never looked at. Columns of those names in the input are replaced.
    """
    added = {"shard": rendezvous_shard(key_text(docs[key]), weights, seed)}
    if grown is not None:
        added["grown_shard"] = rendezvous_shard(key_text(docs[key]), grown, seed)
    return docs.withColumns(added)


def number_slots(rows, order, shard="shard", spread_by=None, ranges=RANGES):
    """Rows with ``slot``, gapless from 0 within each shard.

    A shard is cut into ``ranges`` by a hash of ``spread_by`` (the order columns unless
    given). Ranges are numbered on their own and shifted by the sizes of those before,
    so that no task holds a shard. The shift table has shards x ranges rows at most.
    """
    by = [key_text(F.col(c)) for c in spread_by or order]
    cut = F.pmod(point(F.concat_ws("|", *by)), F.lit(ranges)).cast("int")
    rows = rows.withColumn("_range", cut)
    shift = Window.partitionBy(shard).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sizes = rows.groupBy(shard, "_range").count()
    starts = sizes.select(
        shard, "_range", F.coalesce(F.sum("count").over(shift), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(shard, "_range").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    return (
        ranked.join(F.broadcast(starts), [shard, "_range"])
        .withColumn("slot", (F.col("_start") + F.col("_rank")).cast("bigint"))
        .drop("_range", "_rank", "_start")
    )
