"""Captions, replies and publishing state."""

from pyspark.sql import functions as F

from ..dims.texts import INSTAGRAM_REPLIES, LINK_REPLIES
from . import as_col, shown
from .picks import draw_from
from .urls import absolute_url, split_urls


def video_captions(item, model, link):
    """Caption per channel, as a map."""
    item, model, link = shown(item), shown(model), shown(link)
    styled = F.concat(
        F.lit("Obsessed with this "), item, F.lit("! 💅 Styled by AI Model "), model, F.lit(". ")
    )
    plain = F.concat(
        F.lit("Obsessed with this "), item, F.lit("! Styled by AI Model "), model, F.lit(".")
    )
    return F.create_map(
        F.lit("instagram"),
        F.concat(styled, F.lit("Comment \"FIT\" and I'll DM you the link!")),
        F.lit("twitter"),
        F.concat(styled, F.lit("Shop the look here: "), link),
        F.lit("tiktok"),
        F.concat(styled, F.lit("Link in bio!")),
        F.lit("pinterest"),
        plain,
    )


def news_captions(caption, title, monetized):
    caption, title, monetized = shown(caption), shown(title), shown(monetized)
    return F.create_map(
        F.lit("instagram"),
        F.concat(caption, F.lit(" 💅 Read the full details via the link below!")),
        F.lit("twitter"),
        F.concat(title, F.lit("\n\nRead more: "), monetized),
        F.lit("pinterest"),
        F.concat(caption, F.lit(". Read full details: "), monetized),
    )


def post_layout(image_urls, base):
    """Absolute image list, cover and layout of a post; no images, no layout."""
    urls = F.transform(
        F.coalesce(split_urls(image_urls), F.array().cast("array<string>")),
        lambda u: absolute_url(u, base),
    )
    return F.struct(
        urls.alias("urls"),
        F.get(urls, F.lit(0)).alias("cover"),
        F.when(F.size(urls) > 1, "carousel").when(F.size(urls) == 1, "single").alias("layout"),
    )


def reply_text(comment_id, link, platform, seed=0):
    """Reply line: Instagram announces a direct message, others carry the link."""
    public = F.array(*[F.lit(t) for t in INSTAGRAM_REPLIES])
    linked = F.array(*[F.lit(t) for t in LINK_REPLIES])
    return F.when(
        F.lower(as_col(platform)) == "instagram", draw_from(public, comment_id, seed, "ig")
    ).otherwise(
        F.replace(draw_from(linked, comment_id, seed, "link"), F.lit("%s"), shown(link))
    )


def reply_channel(platform, username, reply, link):
    """How a reply goes out: channel, status before sending, message, direct message."""
    platform = F.lower(as_col(platform))
    channel = (
        F.when(platform == "instagram", "instagram")
        .when(platform.isin("twitter", "x"), "twitter")
        .when(platform == "tiktok", "tiktok")
    )
    return F.struct(
        channel.alias("channel"),
        F.when(channel.isNull(), "queued").otherwise("pending").alias("status"),
        F.when(channel == "twitter", F.concat(F.lit("@"), shown(username), F.lit(" "), reply))
        .otherwise(as_col(reply))
        .alias("message"),
        F.when(
            channel == "instagram",
            F.concat(F.lit("Hey! Here is the direct link to the item: "), shown(link)),
        ).alias("dm_text"),
    )


def publish_state(published, stored_post_id, new_post_id, pin_ok):
    """Published once either channel took it; a new post id replaces the stored one."""
    new_id = as_col(new_post_id)
    done = new_id.isNotNull() | F.coalesce(as_col(pin_ok), F.lit(False))
    return F.struct(
        F.when(done, F.lit(True)).otherwise(as_col(published)).alias("published"),
        F.coalesce(new_id, as_col(stored_post_id)).alias("instagram_post_id"),
    )
