"""Video feed: filters, paging, choice of the next post."""

from pyspark.sql import functions as F

from ..functions.picks import draw_key
from ..functions.urls import client_url
from .catalog import unused_products

# Marks of generated videos, placeholders and still images.
VIDEO_SUFFIX = "%.mp4"
PLACEHOLDER_HOST = "%w3schools%"
IMAGE_MARKS = [".jpg", ".jpeg", ".png", ".webp", "unsplash.com", "promodirect.com"]


def generated_videos(videos):
    url = F.col("url")
    return videos.where(url.like(VIDEO_SUFFIX) & ~url.like(PLACEHOLDER_HOST))


def placeholder_videos(videos):
    return videos.where(~F.col("url").like(VIDEO_SUFFIX))


def unpublished_videos(videos):
    """Generated videos not published; an unknown flag counts as not published."""
    return generated_videos(videos).where(F.col("published").isNull() | ~F.col("published"))


def video_by_id(videos, video_id):
    return videos.where(F.col("id") == video_id)


def newest_first(df, time="created_at", tie="id"):
    """Total order, newest first; the id settles equal times."""
    return df.orderBy(F.desc_nulls_last(time), F.desc(tie))


def latest_videos(videos):
    return newest_first(videos)


def latest_posts(posts):
    return newest_first(posts)


def feed_page(videos, page=0, size=10):
    return newest_first(videos).offset(page * size).limit(size)


def next_unpublished(videos):
    """Oldest unpublished video."""
    return unpublished_videos(videos).orderBy("created_at", "id").limit(1)


def pick_one(df, seed, key="id"):
    """One row drawn by a seeded hash of its key."""
    return df.orderBy(draw_key(key, seed), key).limit(1)


def classify_media(videos):
    """Adds ``is_image``: the url carries an image extension or a known image host."""
    is_image = F.lit(False)
    for mark in IMAGE_MARKS:
        is_image = is_image | F.col("url").contains(mark)
    return videos.withColumn("is_image", F.coalesce(is_image, F.lit(False)))


def feed_card(videos, host, item="Item", model="Model"):
    """Display fields with defaults for missing ones."""
    return videos.select(
        "id",
        client_url(F.coalesce("url", F.lit("")), host).alias("url"),
        F.coalesce("model_name", F.lit(model)).alias("model_name"),
        F.coalesce("item_name", F.lit(item)).alias("item_name"),
        F.coalesce("affiliate_link", F.lit("")).alias("affiliate_link"),
    )


def next_post(videos, products, seed):
    """What to post next: an unpublished video, else a product to generate, else an old video."""

    def branch(rows, priority, action, item):
        return rows.select(
            F.lit(priority).alias("priority"),
            F.lit(action).alias("action"),
            F.col("id").cast("bigint").alias("id"),
            F.col(item).alias("item_name"),
        )

    publish = branch(next_unpublished(videos), 1, "publish", "item_name")
    generate = branch(pick_one(unused_products(products), seed), 2, "generate", "product_name")
    repost = branch(pick_one(generated_videos(videos), seed), 3, "repost", "item_name")
    return publish.unionByName(generate).unionByName(repost).orderBy("priority").limit(1)


def after_generation(choice, videos, succeeded, seed):
    """The post once a generation ended: a failed one falls back to an old video."""
    if succeeded:
        return choice
    kept = choice.where(F.col("action") != "generate")
    fallback = pick_one(generated_videos(videos), seed).select(
        F.lit(3).alias("priority"),
        F.lit("repost").alias("action"),
        F.col("id").cast("bigint").alias("id"),
        "item_name",
    )
    return kept.unionByName(fallback).orderBy("priority").limit(1)
