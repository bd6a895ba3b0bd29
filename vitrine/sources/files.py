"""Readers of landed files and tables."""

import logging

from pyspark.sql import functions as F

from .. import schemas
from ..functions import non_empty
from ..functions.news import story_image
from ..operators.interactions import decode_interactions
from ..session import place_of

log = logging.getLogger(__name__)


def kafka_options(servers, topic, starting=None):
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic}
    if starting:
        options["startingOffsets"] = starting
    return options


def scan_interactions(spark, path_or_topic, mode="batch", servers=None):
    """Whole interaction log from its start, decoded.

    With ``servers`` the log is a Kafka topic (the connector must be on the class path);
    otherwise a folder of JSON lines. ``mode`` is ``batch`` or ``stream``.
    """
    reader = spark.readStream if mode == "stream" else spark.read
    if servers:
        raw = (
            reader.format("kafka").options(**kafka_options(servers, path_or_topic, "earliest"))
            .load()
        )
    else:
        raw = reader.format("text").load(path_or_topic)
    return decode_interactions(raw.select("value"))


def stream_ratings(spark, path_or_topic, servers=None, files_per_trigger=None):
    """Continuous rating events; from Kafka new ones only."""
    if servers:
        raw = (
            spark.readStream.format("kafka").options(**kafka_options(servers, path_or_topic))
            .load()
        )
        parsed = F.from_json(F.col("value").cast("string"), schemas.RATING)
        return raw.select(parsed.alias("v")).select("v.*")
    reader = spark.readStream.schema(schemas.RATING)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path_or_topic)


def scan_pages(spark, path, item, multiline=False):
    """Rows of all landed pages, one page per line, or one per file with ``multiline``.

    ``pos`` orders the rows as the service pages them, however files are packed: by the
    number of the page (one before that in its link to the next page, the last page by the
    total), then the place on it. ``page``, the file, parts pages of equal number. A page
    that cannot be read gives no rows.
    """
    pages = spark.read.schema(schemas.page_of(item)).option("multiLine", multiline).json(path)
    paging = F.col("meta.pagination")
    following = F.regexp_extract(paging["next"]["href"], r"[?&]page=([0-9]+)", 1)
    number = F.coalesce(
        F.expr("try_cast(_next AS INT)") - 1, F.col("meta.pagination.totalPages"), F.lit(0)
    )
    numbered = pages.withColumn("_next", following).select(
        F.input_file_name().alias("page"), number.alias("number"), F.posexplode("data").alias("at", "c")
    )
    place = F.struct("number", "page", "at")
    return numbered.select("page", "number", "at", place.alias("pos"), "c.*")


def scan_catalog_pages(spark, path, multiline=False):
    return scan_pages(spark, path, schemas.CATALOG_ITEM, multiline)


def scan_coupon_pages(spark, path, multiline=False):
    return scan_pages(spark, path, schemas.COUPON, multiline)


def scan_stores(spark, path, network="pepper"):
    return spark.read.parquet(path).where(F.col("network_name") == network)


def scan_rss(spark, paths):
    """Items of all feeds, those with a title and a link, in one scan.

    ``feed`` is the feed's place among the paths, ``pos`` the item's place in its file. The
    image is the first media element with an address in the order of the text, content or
    thumbnail. A missing feed, and one that isn't closed, add no rows.
    """
    places = {}
    for i, path in enumerate(paths):
        place = place_of(spark, path)
        if place is None:
            log.warning("feed %s skipped: no such path", path)
        else:
            places.setdefault(place, i)
    if not places:
        raise ValueError("no feed could be read")
    files = spark.read.text([paths[i] for i in places.values()], wholetext=True)
    name = F.regexp_replace(F.input_file_name(), r"^[A-Za-z0-9+.\-]+:(//[^/]*)?", "")
    feed = F.coalesce(
        *[F.when((name == p) | name.startswith(p + "/"), F.lit(i)) for p, i in places.items()]
    )
    closed = F.col("value").rlike(r"</(rss|rdf:RDF|channel)\s*>\s*$")
    raw = F.regexp_extract_all("value", F.lit(r"(?s)<item[\s>].*?</item\s*>"), F.lit(0))
    items = files.where(closed).select(feed.alias("feed"), F.posexplode(raw).alias("pos", "raw"))
    items = items.select(
        "feed", F.col("pos").cast("bigint").alias("pos"), "raw",
        F.from_xml("raw", schemas.RSS_ITEM).alias("i"),
    )
    media = F.regexp_extract(
        "raw", r"""(?s)<media:(?:content|thumbnail)\b[^>]*?\burl\s*=\s*["']\s*([^"'\s][^"']*)["']""", 1
    )
    for code, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        media = F.replace(media, F.lit(code), F.lit(char))
    image = story_image(non_empty(media), "i.description", F.col("i.enclosure")["_url"])
    return items.select(
        "feed",
        "pos",
        F.coalesce("i.title", F.lit("")).alias("title"),
        F.coalesce("i.link", F.lit("")).alias("link"),
        F.coalesce("i.description", F.lit("")).alias("description"),
        image.alias("image_url"),
    ).where((F.col("title") != "") & (F.col("link") != ""))


def scan_table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scan_asset_cache(spark, path):
    """(product_id, model_id, vton_image, storyboard_images) from ``cache_<product>.json``,
    files or folders of files.

    An unreadable file counts as empty.
    """
    files = spark.read.text(path, wholetext=True).select("value")
    product = F.regexp_extract(F.input_file_name(), r"cache_([^/]*)\.json(?:/[^/]*)?$", 1)
    entries = F.from_json("value", schemas.CACHE_ENTRY)
    rows = files.select(
        product.alias("product_id"), F.explode_outer(entries).alias("model_id", "e")
    )
    return rows.where(F.col("model_id").isNotNull()).select(
        "product_id", "model_id", "e.vton_image", "e.storyboard_images"
    )


def scan_images(spark, path):
    """Landed image files with their bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
