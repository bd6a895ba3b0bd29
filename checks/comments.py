"""Comments: normalising, dedup, link choice, replies."""

from pyspark.sql import functions as F

from vitrine.dims.texts import INSTAGRAM_REPLIES, LINK_REPLIES
from vitrine.functions import social
from vitrine.operators import comments as M
from vitrine.operators.links import KeptLinks, update_links
from vitrine.operators.membership import build_filter, might_contain
from vitrine.plans.replies import answer_comments
from vitrine.session import materialize, run_dir

from .base import check, sql_draw, sql_list, sql_stamp, stamp

BASE = "https://www.example.com"
HANDLE = "OwnHandle"

FOREIGN = "foreign_rows AS (SELECT * FROM comments WHERE lower(trim(username)) <> 'ownhandle')"
NEWEST = "ORDER BY created_at DESC, id DESC"
LINKS = f"""
    posted AS (
      SELECT instagram_post_id, affiliate_link FROM (
        SELECT *, row_number() OVER (PARTITION BY instagram_post_id {NEWEST}) AS rn FROM videos
        WHERE instagram_post_id IS NOT NULL) WHERE rn = 1 AND affiliate_link <> ''),
    item_words AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY word {NEWEST}) AS rn FROM (
          SELECT id, created_at, affiliate_link,
            unnest(string_split_regex(lower(item_name), '\\s+')) AS word FROM videos)
        WHERE length(word) > 3) WHERE rn = 1),
    hits AS (
      SELECT comment_id, platform, id, affiliate_link FROM (
        SELECT c.comment_id, c.platform, w.id, w.affiliate_link,
          row_number() OVER (PARTITION BY c.comment_id, c.platform
                             ORDER BY w.created_at DESC, w.id DESC) AS rn
        FROM comments c JOIN item_words w ON contains(lower(c.comment_text), w.word))
      WHERE rn = 1),
    latest AS (SELECT affiliate_link FROM videos {NEWEST} LIMIT 1)"""
POST_LINK = "CASE WHEN c.platform = 'instagram' AND c.post_id <> '' THEN p.affiliate_link END"
LINK = f"""CASE WHEN {POST_LINK} IS NOT NULL THEN p.affiliate_link
      WHEN h.id IS NOT NULL THEN h.affiliate_link ELSE (SELECT affiliate_link FROM latest) END"""
CHOSEN = f"""
    {LINKS},
    chosen AS (
      SELECT c.*, {LINK} AS product_link FROM comments c
      LEFT JOIN posted p ON c.post_id = p.instagram_post_id
      LEFT JOIN hits h ON c.comment_id = h.comment_id AND c.platform = h.platform)"""
REPLY = (
    "CASE WHEN platform = 'instagram' THEN "
    f"({sql_list(INSTAGRAM_REPLIES)})[{sql_draw(len(INSTAGRAM_REPLIES), 'comment_id', 'ig')} + 1] "
    f"ELSE replace(({sql_list(LINK_REPLIES)})"
    f"[{sql_draw(len(LINK_REPLIES), 'comment_id', 'link')} + 1], '%s', "
    "coalesce(product_link, 'null')) END"
)


def webhooks(t):
    """Comments as payloads: nested for Instagram, flat elsewhere, some parts left out."""
    value = F.struct(
        F.when(F.col("n") % 7 != 0, F.col("comment_id")).alias("id"),
        F.col("comment_text").alias("text"),
        F.when(F.col("n") % 3 != 0, F.struct("username")).alias("from"),
        F.when(F.col("n") % 2 != 0, F.struct(F.col("post_id").alias("id"))).alias("media"),
    )
    nested = F.struct(F.array(F.struct(F.array(F.struct(value.alias("value"))).alias("changes")))
                      .alias("entry"))
    flat = F.struct(
        F.when(F.col("n") % 7 != 0, F.col("comment_id")).alias("commentId"),
        F.col("post_id").alias("postId"),
        F.when(F.col("n") % 3 != 0, F.col("username")).alias("username"),
        F.col("comment_text").alias("text"),
    )
    numbered = t.comments.withColumn("n", F.split("comment_id", "-")[0].cast("bigint"))
    payload = F.when(F.col("platform") == "instagram", F.to_json(nested)).otherwise(F.to_json(flat))
    return numbered.select("platform", payload.alias("payload"), "received_at")


N = "CAST(split_part(comment_id, '-', 1) AS BIGINT)"


@check(
    "normalize_webhooks",
    f"""
    SELECT platform,
      CASE WHEN {N} % 7 <> 0 THEN comment_id WHEN platform = 'instagram' THEN NULL
           ELSE 'unknown' END AS comment_id,
      CASE WHEN platform = 'instagram' AND {N} % 2 = 0 THEN 'unknown' ELSE post_id END AS post_id,
      CASE WHEN {N} % 3 = 0 THEN 'unknown' ELSE username END AS username, comment_text,
      {sql_stamp("received_at")} AS received_at
    FROM comments""",
    "comments",
)
def normalize_webhooks(t):
    return M.normalize_webhooks(webhooks(t)).withColumn("received_at", stamp("received_at"))


def stored(t):
    """Comments as stored rows of all three states."""
    n = F.split("comment_id", "-")[0].cast("bigint") % 3
    status = F.when(n == 0, "pending").when(n == 1, "queued").otherwise("replied")
    return t.comments.withColumns(
        {
            "status": status,
            "replied_at": F.lit(None).cast("timestamp"),
            "product_link": F.lit("https://x"),
        }
    )


@check(
    "comments_by_status",
    f"SELECT comment_id, platform FROM comments WHERE {N} % 3 = 0",
    "comments",
)
def comments_by_status(t):
    return M.comments_by_status(stored(t), "pending").select("comment_id", "platform")


@check(
    "comments_by_platform",
    f"SELECT comment_id, {sql_stamp('received_at')} AS received_at FROM comments "
    "WHERE platform = 'tiktok' ORDER BY comments.received_at DESC, comment_id DESC",
    "comments",
)
def comments_by_platform(t):
    return M.comments_by_platform(t.comments, "tiktok").select(
        "comment_id", stamp("received_at").alias("received_at")
    )


@check(
    "drop_self_comments",
    f"WITH {FOREIGN} SELECT comment_id, platform, username FROM foreign_rows",
    "comments",
)
def drop_self_comments(t):
    return M.drop_self_comments(t.comments, HANDLE).select("comment_id", "platform", "username")


@check(
    "drop_seen_comments",
    f"SELECT comment_id, platform, username FROM comments WHERE {N} % 4 <> 0",
    "comments",
)
def drop_seen_comments(t):
    n = F.split("comment_id", "-")[0].cast("bigint")
    later = t.comments.withColumns(
        {"received_at": F.col("received_at") + F.expr("INTERVAL 1 DAY"), "username": F.lit("copy")}
    )
    fresh = M.drop_seen_comments(
        later.unionByName(t.comments), t.comments.where(n % 4 == 0)
    )
    return fresh.select("comment_id", "platform", "username")


@check(
    "match_post",
    f"""
    WITH {LINKS}
    SELECT c.comment_id, c.platform, {POST_LINK} AS post_link FROM comments c
    LEFT JOIN posted p ON c.post_id = p.instagram_post_id""",
    "comments",
    "videos",
)
def match_post(t):
    return M.match_post(t.comments, t.videos).select("comment_id", "platform", "post_link")


@check(
    "match_keywords",
    f"WITH {LINKS} SELECT comment_id, platform, id, affiliate_link FROM hits",
    "comments",
    "videos",
)
def match_keywords(t):
    found = M.match_keywords(t.comments, t.videos)
    return found.select("comment_id", "platform", "video.id", "video.affiliate_link")


@check(
    "match_keywords_documents",
    """
    WITH item_words AS (
      SELECT DISTINCT unnest(string_split_regex(lower(p_name), '\\s+')) AS word FROM part),
    hits AS (SELECT d.doc_id, max(w.word) AS word FROM documents d
             JOIN item_words w ON length(w.word) > 3 AND contains(lower(d.text), w.word) GROUP BY 1)
    SELECT doc_id, word FROM hits""",
)
def match_keywords_documents(t):
    """Whole documents searched for item words; the link carries the word itself."""
    words = t.part.select(F.explode(F.split("p_name", r"\s+")).alias("item_name")).distinct()
    videos = words.select(
        "item_name",
        F.lit("2024-01-01").cast("timestamp").alias("created_at"),
        F.col("item_name").alias("id"),
        F.lit("x").alias("affiliate_link"),
    )
    texts = t.documents.select("doc_id", F.col("text").alias("comment_text"))
    found = M.match_keywords(texts, videos, keys=["doc_id"], partitions=t.cores)
    return found.select("doc_id", F.col("video.id").alias("word"))


@check(
    "best_video",
    f"""
    SELECT comment_id, platform, id FROM (
      SELECT c.comment_id, c.platform, v.id, row_number() OVER (
        PARTITION BY c.comment_id, c.platform ORDER BY v.created_at DESC, v.id DESC) AS rn
      FROM comments c JOIN videos v ON v.id = {N} OR v.id = {N} * 2) WHERE rn = 1""",
    "comments",
    "videos",
)
def best_video(t):
    n = F.split("comment_id", "-")[0].cast("bigint")
    wanted = t.comments.select(
        "comment_id", "platform", F.explode(F.array(n, n * 2)).alias("id")
    )
    return M.best_video(wanted.join(t.videos, "id")).select("comment_id", "platform", "id")


@check(
    "fallback_latest",
    f"WITH {LINKS} SELECT comment_id, platform, "
    "(SELECT affiliate_link FROM latest) AS fallback_link FROM comments",
    "comments",
    "videos",
)
def fallback_latest(t):
    return M.fallback_latest(t.comments, t.videos, BASE).select(
        "comment_id", "platform", "fallback_link"
    )


@check(
    "fallback_base_url",
    f"SELECT comment_id, platform, '{BASE}' AS fallback_link FROM comments",
    "comments",
)
def fallback_base_url(t):
    none = t.videos.where(F.col("id") < 0)
    return M.fallback_latest(t.comments, none, BASE).select(
        "comment_id", "platform", "fallback_link"
    )


@check(
    "choose_links",
    f"WITH {CHOSEN} SELECT comment_id, platform, product_link FROM chosen",
    "comments",
    "videos",
)
def choose_links(t):
    return M.choose_links(t.comments, t.videos, BASE).select(
        "comment_id", "platform", "product_link"
    )


@check(
    "reply_text",
    f"SELECT comment_id, platform, {REPLY} AS reply FROM "
    "(SELECT *, concat('https://x/', post_id) AS product_link FROM comments)",
    "comments",
)
def reply_text(t):
    link = F.concat(F.lit("https://x/"), "post_id")
    return t.comments.select(
        "comment_id", "platform", social.reply_text("comment_id", link, "platform").alias("reply")
    )


@check(
    "reply_channel",
    """
    SELECT comment_id, platform,
      CASE platform WHEN 'instagram' THEN 'instagram' WHEN 'twitter' THEN 'twitter'
                    WHEN 'tiktok' THEN 'tiktok' END AS channel,
      CASE WHEN platform IN ('instagram', 'twitter', 'tiktok') THEN 'pending' ELSE 'queued' END
        AS status,
      CASE WHEN platform = 'twitter' THEN concat('@', username, ' ', comment_text)
           ELSE comment_text END AS message,
      CASE WHEN platform = 'instagram'
           THEN concat('Hey! Here is the direct link to the item: ', post_id) END AS dm_text
    FROM comments""",
    "comments",
)
def reply_channel(t):
    sent = social.reply_channel("platform", "username", F.col("comment_text"), "post_id")
    return t.comments.select("comment_id", "platform", sent.alias("o")).select(
        "comment_id", "platform", "o.*"
    )


ANSWERS = f"""
    WITH {CHOSEN}
    SELECT platform, comment_id, post_id, username, comment_text, {REPLY} AS reply_text,
      product_link, 'pending' AS status, {sql_stamp("received_at")} AS received_at
    FROM chosen WHERE lower(trim(username)) <> 'ownhandle' AND {N} % 4 <> 0"""


@check("answer_comments", ANSWERS, "comments", "videos")
def answers(t):
    n = F.split("comment_id", "-")[0].cast("bigint")
    rows = answer_comments(t.comments, t.videos, t.comments.where(n % 4 == 0), HANDLE, BASE)
    return rows.drop("replied_at").withColumn("received_at", stamp("received_at"))


#: Columns of a video that links are found by.
LINKED = ["id", "affiliate_link", "item_name", "instagram_post_id", "created_at"]


@check("answer_comments_indexed", ANSWERS, "comments", "videos")
def answers_indexed(t):
    """The same answers from an index of the videos that was kept as they came, in two parts."""
    index = run_dir(t.spark, "links")
    second = F.col("published").isNull() | F.col("published")
    # an index reads its videos several times, so they are a stored table
    videos = materialize(t.videos.select("published", *LINKED), "videos")
    for part in (videos.where(~second), videos.where(second)):
        update_links(t.spark, index, part, M.MIN_WORD)
    n = F.split("comment_id", "-")[0].cast("bigint")
    history = t.comments.where(n % 4 == 0)
    rows = answer_comments(t.comments, KeptLinks(t.spark, index), history, HANDLE, BASE)
    return rows.drop("replied_at").withColumn("received_at", stamp("received_at"))


@check(
    "likely_comments",
    f"SELECT platform, count(*) AS stored, true AS few_others FROM comments WHERE {N} % 4 = 0 GROUP BY 1",
    "comments",
)
def likely_comments(t):
    """A filter of stored keys finds every stored comment and few others."""
    stored = F.split("comment_id", "-")[0].cast("bigint") % 4 == 0
    filters = build_filter(t.comments.where(stored), M.KEYS, 32)
    likely = might_contain(t.comments.withColumn("_stored", stored), M.KEYS, filters, 32)
    return likely.groupBy("platform").agg(
        F.count_if("_stored").alias("stored"), (F.count_if(~F.col("_stored")) <= F.count("*") * 0.1).alias("few_others")
    )


@check(
    "comment_row",
    f"""
    SELECT platform, comment_id, {REPLY} AS reply_text, 'pending' AS status FROM
      (SELECT *, 'https://x' AS product_link FROM comments)""",
    "comments",
)
def comment_row(t):
    return M.comment_row(stored(t)).select("platform", "comment_id", "reply_text", "status")


SENT = "2024-02-01 00:00:00"


def results(t):
    """Send results for some comments: every second one taken."""
    n = F.split("comment_id", "-")[0].cast("bigint")
    return t.comments.where(n % 5 != 0).select(
        "comment_id", "platform", (n % 2 == 0).alias("ok"), F.lit(SENT).cast("timestamp").alias("at")
    )


def settled_sql(failure, only):
    return f"""
    SELECT comment_id, platform,
      CASE WHEN {N} % 5 = 0 THEN 'pending' WHEN {N} % 2 = 0 THEN 'replied' ELSE '{failure}' END
        AS status,
      CASE WHEN {N} % 5 <> 0 AND {N} % 2 = 0 THEN '{SENT}' END AS replied_at
    FROM comments WHERE {only}"""


@check("settle_replies", settled_sql("queued", "true"), "comments")
def settle_replies(t):
    rows = M.settle_replies(stored(t), results(t))
    return rows.select("comment_id", "platform", "status", stamp("replied_at").alias("replied_at"))


@check("retry_pending", settled_sql("pending", f"{N} % 3 = 0"), "comments")
def retry_pending(t):
    rows = M.retry_pending(stored(t), results(t))
    return rows.select("comment_id", "platform", "status", stamp("replied_at").alias("replied_at"))
