"""Where a comment's product link comes from: all videos, or an index that is kept of them."""

from pyspark.sql import functions as F

from ..functions import non_empty
from ..session import materialize, read_if_present
from .membership import FILTER, build_filter, merge_filters, might_contain
from .upsert import read_keys, write_upsert

#: Buckets of an index, and blocks of its filter (for about a million keys).
BUCKETS = 256
BLOCKS = 256
LENGTH = "length INT"


def newest_video():
    """The newest video wins; ids settle equal times, unknown times come last."""
    return F.max(F.struct("created_at", "id", "affiliate_link")).alias("video")


def item_words(videos, least):
    """Every item word of at least ``least`` UTF-16 units with its newest video; two emoji
    make four units."""
    words = videos.where(F.col("item_name").isNotNull()).select(
        F.explode_outer(F.array_distinct(F.split(F.lower("item_name"), r"\s+"))).alias("word"),
        "created_at", "id", "affiliate_link",
    )
    units = F.octet_length(F.encode("word", "UTF-16BE")) / 2
    return words.where(units >= least).groupBy("word").agg(newest_video())


def posted_videos(videos):
    """The newest video of each post."""
    posted = videos.where(F.col("instagram_post_id").isNotNull())
    return posted.groupBy(F.col("instagram_post_id").alias("post")).agg(newest_video())


def entries(videos, least):
    """(key, video): what the index keeps of some videos, under ``w:`` and a word, ``p:`` and a
    post, and ``n:`` for the newest of all."""
    words = item_words(videos, least).select(F.concat(F.lit("w:"), "word").alias("key"), "video")
    posts = posted_videos(videos).select(F.concat(F.lit("p:"), "post").alias("key"), "video")
    newest = videos.agg(newest_video()).where("video IS NOT NULL").select(F.lit("n:").alias("key"), "video")
    return words.unionByName(posts).unionByName(newest)


def update_links(spark, path, videos, least):
    """Bring new or changed videos into the index at ``path``; returns its version.

    Only the buckets of their own words and posts are read and rewritten. A video that is
    known under a key replaces itself there. Words that a renamed or removed video no longer
    has keep it until the index is built anew elsewhere. The filter and the word lengths are
    written first, so a run that dies leaves at worst a filter that lets more keys through.
    """
    fresh = materialize(entries(videos, least), "entries")
    keys = fresh.select("key")
    build_filter(keys, ["key"], BLOCKS).coalesce(1).write.mode("append").parquet(f"{path}/filter")
    lengths = keys.where("key LIKE 'w:%'").select((F.length("key") - 2).alias("length")).distinct()
    lengths.coalesce(1).write.mode("append").parquet(f"{path}/lengths")
    known = read_keys(spark, f"{path}/entries", fresh, ["key"])
    if known is not None:
        old = known.select("key", F.col("video").alias("old"))
        same = F.col("video.id") == F.col("old.id")
        video = F.when(same | F.col("old").isNull(), F.col("video")).otherwise(F.greatest("video", "old"))
        fresh = fresh.join(old, "key", "left").select("key", video.alias("video"))
    return write_upsert(spark, f"{path}/entries", fresh, ["key"], buckets=BUCKETS)


class AllVideos:
    """Answers from a table of videos, read whole."""

    def __init__(self, videos, least):
        self.videos, self.least = videos, least

    def posts(self, comments):
        return posted_videos(self.videos)

    def lengths(self):
        """Words for ``words``, and the lengths of all words."""
        self._words = materialize(item_words(self.videos, self.least), "words")
        return self._words.agg(F.collect_set(F.length("word"))).first()[0]

    def words(self, pieces):
        return self._words

    def newest(self, base_url):
        """Scalar column: the newest video's link, or the base url when there is no video."""
        return _link(self.videos.agg(newest_video()), base_url)


def _link(newest, base_url):
    link = F.when(F.col("video").isNull(), F.lit(base_url)).otherwise(F.col("video.affiliate_link"))
    return newest.select(link.alias("link")).scalar()


class KeptLinks:
    """Answers from the index at ``path``, without the videos.

    Keys that are asked for pass the index's filter first; only the buckets of those that
    may be known are opened.
    """

    def __init__(self, spark, path):
        self.spark, self.path = spark, path

    def _find(self, wanted):
        """(key, video) of the wanted keys that are known."""
        filters = read_if_present(self.spark, f"{self.path}/filter", FILTER)
        if filters is None:
            filters = self.spark.createDataFrame([], FILTER)
        likely = might_contain(wanted.select("key").distinct(), ["key"], merge_filters(filters), BLOCKS)
        likely = materialize(likely, "likely")
        found = read_keys(self.spark, f"{self.path}/entries", likely, ["key"])
        if found is None:
            schema = "key STRING, video STRUCT<created_at: TIMESTAMP, id: BIGINT, affiliate_link: STRING>"
            return self.spark.createDataFrame([], schema)
        return found

    def posts(self, comments):
        wanted = comments.where(F.col("post_id").isNotNull()).select(F.concat(F.lit("p:"), "post_id").alias("key"))
        return self._find(wanted).select(F.expr("substring(key, 3)").alias("post"), "video")

    def lengths(self):
        kept = read_if_present(self.spark, f"{self.path}/lengths", LENGTH)
        return [] if kept is None else kept.agg(F.collect_set("length")).first()[0]

    def words(self, pieces):
        wanted = pieces.select(F.concat(F.lit("w:"), "word").alias("key"))
        return self._find(wanted).select(F.expr("substring(key, 3)").alias("word"), "video")

    def newest(self, base_url):
        wanted = self.spark.range(1).select(F.lit("n:").alias("key"))
        return _link(self._find(wanted).agg(F.max("video").alias("video")), base_url)


def link_of(video):
    return non_empty(F.col(video)["affiliate_link"])
