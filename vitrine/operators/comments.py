"""Comments: filters, dedup, product link choice, replies."""

from pyspark.sql import functions as F

from ..functions import non_empty
from ..functions.payload import normalize_webhook
from ..functions.social import reply_channel, reply_text
from ..functions.text import trim_controls
from ..session import materialize
from .feed import newest_first
from .grouping import spread_lookup, spread_rows, top_in_group, written_lookup
from .links import AllVideos, KeptLinks, link_of, newest_video

KEYS = ["comment_id", "platform"]
# Fixed value: shorter item words never match.
MIN_WORD = 4
# Long tokens are searched in overlapping windows of this step.
WINDOW_STEP = 64


def normalize_webhooks(webhooks):
    """Webhook rows to comment rows."""
    rest = [c for c in webhooks.columns if c != "payload"]
    return webhooks.select(*rest, normalize_webhook("platform", "payload").alias("_c")).select(
        *rest, "_c.*"
    )


def comments_by_status(comments, status):
    return comments.where(F.col("status") == status)


def comments_by_platform(comments, platform):
    return newest_first(
        comments.where(F.col("platform") == platform), time="received_at", tie="comment_id"
    )


def drop_self_comments(comments, handle):
    """Drop the own account's comments, any case and padding; unknown names stay."""
    name = F.lower(trim_controls("username"))
    return comments.where(F.col("username").isNull() | (name != handle.lower()))


def drop_seen_comments(comments, history, order=("received_at",)):
    """First arrival of each comment that is not stored yet."""
    fresh = top_in_group(comments, KEYS, list(order))
    seen = history.select(*[F.col(k).alias(f"_{k}") for k in KEYS]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS]
    return fresh.join(seen, same[0] & same[1], "left_anti")


def _source(videos):
    """Where links come from: the given index, or the given table of videos."""
    return videos if isinstance(videos, KeptLinks) else AllVideos(videos, MIN_WORD)


def match_post(comments, videos):
    """Adds ``post_link``: the link of the video posted under the comment's post id.

    Instagram only; an empty link does not count. ``videos`` is a table or a ``KeptLinks``.
    """
    eligible = (F.lower("platform") == "instagram") & (F.col("post_id") != "")
    posted = (
        _source(videos).posts(comments.where(eligible))
        .select(F.col("post").alias("_post"), link_of("video").alias("post_link"))
        .where(F.col("post_link").isNotNull())
    )
    keyed = comments.withColumn("_post", F.when(eligible, F.col("post_id")))
    return spread_lookup(keyed, posted, ["_post"], spread_by=KEYS, salts=1).drop("_post")


def match_keywords(comments, videos, keys=KEYS, partitions=None):
    """Newest video with an item word found anywhere in the comment text.

    Item words hold no white space, so each hit lies within one token of the comment.
    Distinct tokens are cut to the lengths that item words have and joined to the
    words by equality: every joined pair is a true hit, and no pair of a comment and
    a word that merely look alike is ever produced. The matched tokens are computed
    and measured first, so that the comments' tokens need no shuffle while they fit.
    ``partitions`` deals the comments out to so many tasks first, for texts that come in
    few large row groups. ``videos`` is a table or a ``KeptLinks``.
    """
    comments = spread_rows(comments.select(*keys, "comment_text"), partitions)
    source = _source(videos)
    lengths = sorted(source.lengths())
    window = F.lit(max(lengths, default=0) + WINDOW_STEP - 1)
    token = F.col("token")

    tokens = F.array_distinct(F.split(F.lower("comment_text"), r"\s+"))
    windows = F.when(F.length(token) <= window, F.array(token)).otherwise(
        F.transform(
            F.sequence(F.lit(1), F.length(token), F.lit(WINDOW_STEP)),
            lambda i: F.substr(token, i, window),
        )
    )
    # Inner explodes make Spark test the array's size first, computing it once more;
    # outer ones do not, and the null rows they add have no length.
    pairs = (
        comments.select(*keys, F.explode_outer(tokens).alias("token"))
        .where(F.length(token) >= min(lengths, default=0))
        .select(*keys, F.explode_outer(windows).alias("token"))
    )
    every_length = F.explode(F.array(*map(F.lit, lengths)).cast("array<int>"))
    pieces = (
        pairs.select("token")
        .distinct()
        .select("token", every_length.alias("n"))
        .where(F.col("n") <= F.length("token"))
        .select(
            "token",
            "n",
            F.explode_outer(F.sequence(F.lit(1), F.length("token") - F.col("n") + 1)).alias("at"),
        )
        .select("token", F.substr("token", F.col("at"), F.col("n")).alias("word"))
    )
    found = spread_lookup(pieces, source.words(pieces), ["word"], how="inner")
    by_token = found.groupBy("token").agg(F.max("video").alias("video"))
    hits = written_lookup(pairs, by_token, ["token"], how="inner", spread_by=keys)
    return hits.groupBy(*keys).agg(F.max("video").alias("video"))


def best_video(matches, keys=KEYS):
    """Newest video of each comment's candidate matches."""
    return matches.groupBy(*keys).agg(newest_video()).select(*keys, "video.*")


def fallback_latest(comments, videos, base_url):
    """Adds ``fallback_link``, the same for every comment."""
    return comments.withColumn("fallback_link", _source(videos).newest(base_url))


def choose_links(comments, videos, base_url, keys=KEYS):
    """Adds ``product_link``: by post, else by keyword, else the newest video's.

    A keyword match ends the search even if its video has no link; a post match
    without a link does not. Comments must be unique by ``keys``. They are written
    out once, because the search reads them three times.
    """
    posted = materialize(match_post(comments, videos), "comments")
    searched = posted.where(F.col("post_link").isNull())
    found = match_keywords(searched, videos, keys).select(
        *[F.col(k).alias(f"_{k}") for k in keys], "video"
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = posted.join(found, same, "left")
    link = (
        F.when(F.col("post_link").isNotNull(), F.col("post_link"))
        .when(F.col("video").isNotNull(), F.col("video.affiliate_link"))
        .otherwise(F.col("fallback_link"))
    )
    return (
        fallback_latest(joined, videos, base_url)
        .withColumn("product_link", link)
        .drop("post_link", "video", "fallback_link", *[f"_{k}" for k in keys])
    )


def comment_row(comments, seed=0):
    """Stored form of a new comment with its reply, waiting to be sent."""
    return comments.select(
        "platform",
        "comment_id",
        "post_id",
        "username",
        "comment_text",
        reply_text("comment_id", F.col("product_link"), "platform", seed).alias("reply_text"),
        "product_link",
        F.lit("pending").alias("status"),
        "received_at",
        F.lit(None).cast("timestamp").alias("replied_at"),
    )


def outgoing(rows):
    """How each stored comment's reply is to be sent."""
    sent = reply_channel("platform", "username", F.col("reply_text"), F.col("product_link"))
    return rows.select(*KEYS, sent.alias("_o")).select(*KEYS, "_o.*")


def settle_replies(rows, results, on_failure="queued"):
    """Status after sending: replied, ``on_failure``, or still pending without a result."""
    taken = top_in_group(
        results.select(*KEYS, "ok", "at"), KEYS, [F.desc("ok"), F.asc("at")]
    )
    return (
        rows.drop("replied_at", "status")
        .join(taken, KEYS, "left")
        .withColumn("replied_at", F.when(F.col("ok"), F.col("at")))
        .withColumn(
            "status",
            F.when(F.col("ok"), "replied").when(~F.col("ok"), on_failure).otherwise("pending"),
        )
        .drop("ok", "at")
    )


def retry_pending(comments, results):
    """Pending comments after another send; those that failed stay pending."""
    return settle_replies(comments_by_status(comments, "pending"), results, on_failure="pending")
