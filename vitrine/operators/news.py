"""News items: feeds, candidates, galleries, posts."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions import as_col, non_empty
from ..functions import news as N
from ..functions.payload import parse_news_result
from ..functions.urls import join_urls
from .grouping import spread_rows, top_in_group

# Candidates shown for choice, and images that make a gallery full.
CANDIDATES = 15
ENOUGH_IMAGES = 3


def complete_stories(stories):
    return stories.where((F.col("title") != "") & (F.col("link") != ""))


def union_feeds(feeds):
    """Feeds one after the other; ``feed`` holds their order, ``pos`` the place within."""
    numbered = [feed.withColumn("feed", F.lit(i)) for i, feed in enumerate(feeds)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def first_stories(stories, n=CANDIDATES, order=("pos",)):
    return stories.orderBy(*order).limit(n)


def candidate_block(stories, n=CANDIDATES):
    """Text listing the first ``n`` stories for an editor to choose from."""
    first = first_stories(stories, n).agg(
        F.sort_array(
            F.collect_list(F.struct("pos", "title", "link", "description", "image_url"))
        ).alias("rows")
    )
    entry = F.transform(
        "rows",
        lambda s, i: F.concat(
            F.lit("["),
            i.cast("string"),
            F.lit("] TITLE: "),
            s["title"],
            F.lit("\nLINK: "),
            s["link"],
            F.lit("\nDESC: "),
            N.candidate_text(s["description"]),
            F.lit("\nIMAGE: "),
            F.coalesce(non_empty(s["image_url"]), F.lit("None")),
        ),
    )
    return first.select(F.array_join(entry, "\n\n").alias("block"))


def match_selected_story(selections, stories, default_image, n=CANDIDATES):
    """Selection completed from the first of its batch's candidates that fits.

    A candidate fits by equal link or by a title contained in the selected one.
    Only ``n`` candidates per batch enter the join.
    """
    candidates = top_in_group(stories, ["batch"], ["pos"], n).select(
        "batch",
        "pos",
        "title",
        "link",
        F.col("description").alias("story_description"),
        F.col("image_url").alias("story_image"),
    )
    fits = (F.col("s.link") == F.col("c.original_link")) | F.coalesce(
        F.col("c.original_title"), F.lit("")
    ).contains(F.col("s.title"))
    same = (F.col("c.batch") == F.col("s.batch")) & fits
    found = (
        selections.alias("c")
        .join(candidates.alias("s"), same)
        .groupBy(F.col("c.batch").alias("_batch"))
        .agg(F.min(F.struct("pos", "s.link", "s.title", "story_description", "story_image"))
             .alias("story"))
    )
    story = F.col("story")
    image = F.coalesce(
        non_empty(story["story_image"]),
        F.when(F.col("image_url") != "None", non_empty("image_url")),
        F.lit(default_image),
    )
    return (
        selections.join(found, selections["batch"] == F.col("_batch"), "left")
        .select(
            selections["batch"],
            F.coalesce(story["link"], F.col("original_link")).alias("original_link"),
            F.coalesce(story["title"], F.col("original_title")).alias("original_title"),
            story["story_description"].alias("rss_description"),
            image.alias("image_url"),
            story.isNotNull().alias("matched"),
        )
    )


def direct_story(stories, brand_tag, default_image, partitions=None):
    """Post texts straight from story rows, for when no editor's choice is at hand.

    ``partitions`` deals the stories out to so many tasks before their texts are worked on.
    """
    stories = spread_rows(stories, partitions)
    head = N.headline("title")
    tags = N.hashtags(head)
    slides = N.slide_texts("description")
    return stories.select(
        "pos",
        N.display_headline("title").alias("headline"),
        slides["slide2_text"].alias("slide2_text"),
        slides["slide3_text"].alias("slide3_text"),
        N.news_caption(head, tags, brand_tag).alias("social_caption"),
        F.col("link").alias("original_link"),
        F.col("title").alias("original_title"),
        F.coalesce(non_empty("image_url"), F.lit(default_image)).alias("image_url"),
        F.col("description").alias("rss_description"),
    )


def first_image(images, group="article"):
    """First occurrence of each image of an article; of equal places the least url."""
    return top_in_group(
        images.withColumn("image_id", N.image_id("url")), [group, "image_id"], ["pos", "url"]
    )


def _first_of_each(urls):
    """Urls with an image id not seen before, in order.

    Sorted by id and place, so that a long list costs n log n: the first of each run of
    equal ids stays. Urls without an id all stay.
    """
    entries = F.transform(
        urls, lambda u, i: F.struct(N.image_id(u).alias("id"), i.alias("at"), u.alias("url"))
    )

    def firsts(rows):
        return F.filter(
            rows,
            lambda e, i: (i == 0) | e["id"].isNull() | ~e["id"].eqNullSafe(F.get(rows, i - 1)["id"]),
        )

    # the sorted list is bound to a name, or it would be sorted again for each entry
    kept = F.transform(F.array(F.array_sort(entries)), firsts)[0]
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["at"], e["url"]))), lambda e: e["url"])


def gallery(articles, main, link, html, description, name="gallery"):
    """Adds the article's gallery: main image, page photos, then, while fewer than
    three, images of the description; http urls only, each image once.
    """
    none = F.array().cast("array<string>")
    head = F.when(non_empty(main).isNotNull(), F.array(as_col(main))).otherwise(none)
    photos = F.when(as_col(link).contains("vogue.com"), N.page_images(html))
    own = F.concat(head, F.coalesce(photos, none))
    extra = F.coalesce(N.description_images(description), none)
    return (
        articles.withColumn("_own", _first_of_each(own))
        .withColumn(
            "_all",
            F.when(F.size("_own") < ENOUGH_IMAGES, _first_of_each(F.concat("_own", extra)))
            .otherwise(F.col("_own")),
        )
        .withColumn(name, F.array_distinct(F.filter("_all", lambda u: u.startswith("http"))))
        .drop("_own", "_all")
    )


def news_post(logs, created_at, passthrough=()):
    """Post rows from generator logs whose result reports success.

    Where the logs have an ``exit_code``, only runs that ended with 0 count.
    """
    result = parse_news_result("log")
    if "exit_code" in logs.columns:
        logs = logs.where(F.col("exit_code") == 0)
    return (
        logs.select(*passthrough, result.alias("r"))
        .where(F.col("r").isNotNull())
        .select(
            *passthrough,
            join_urls("r.final_graphic_urls").alias("image_urls"),
            F.col("r.headline").alias("title"),
            F.col("r.slide2_text").alias("summary_text"),
            F.col("r.social_caption").alias("social_caption"),
            F.col("r.original_url").alias("source_url"),
            F.col("r.monetized_url").alias("monetized_url"),
            F.lit(created_at).cast("timestamp").alias("created_at"),
            F.lit(False).alias("published"),
        )
    )
