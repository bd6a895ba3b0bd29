"""Videos, posts, captions, urls."""

from pyspark.sql import functions as F

from vitrine.functions import social, urls
from vitrine.operators import feed as V

from .base import check, sql_stamp, stamp

BASE = "https://www.example.com"
GENERATED = "url LIKE '%.mp4' AND url NOT LIKE '%w3schools%'"


def sql_absolute(c):
    return (
        f"CASE WHEN {c} IS NULL OR {c} = '' OR starts_with({c}, 'http://') "
        f"OR starts_with({c}, 'https://') THEN {c} "
        f"WHEN starts_with({c}, '/') THEN concat('{BASE}/', substr({c}, 2)) "
        f"ELSE concat('{BASE}/', {c}) END"
    )


@check("generated_videos", f"SELECT id, url FROM videos WHERE {GENERATED}", "videos")
def generated_videos(t):
    return V.generated_videos(t.videos).select("id", "url")


@check("placeholder_videos", "SELECT id, url FROM videos WHERE url NOT LIKE '%.mp4'", "videos")
def placeholder_videos(t):
    return V.placeholder_videos(t.videos).select("id", "url")


UNPUBLISHED = f"{GENERATED} AND (published IS NULL OR NOT published)"


@check("unpublished_videos", f"SELECT id, url FROM videos WHERE {UNPUBLISHED}", "videos")
def unpublished_videos(t):
    return V.unpublished_videos(t.videos).select("id", "url")


@check("video_by_id", "SELECT id, url, item_name FROM videos WHERE id = 42", "videos")
def video_by_id(t):
    return V.video_by_id(t.videos, 42).select("id", "url", "item_name")


@check(
    "latest_videos",
    f"SELECT id, {sql_stamp('created_at')} AS created_at FROM videos "
    "ORDER BY videos.created_at DESC, id DESC",
    "videos",
)
def latest_videos(t):
    return V.latest_videos(t.videos).select("id", stamp("created_at").alias("created_at"))


@check(
    "latest_posts",
    f"SELECT id, {sql_stamp('created_at')} AS created_at, title FROM posts "
    "ORDER BY posts.created_at DESC, id DESC",
    "posts",
)
def latest_posts(t):
    return V.latest_posts(t.posts).select("id", stamp("created_at").alias("created_at"), "title")


@check(
    "feed_page",
    "SELECT id, url FROM videos ORDER BY created_at DESC, id DESC LIMIT 10 OFFSET 20",
    "videos",
)
def feed_page(t):
    return V.feed_page(t.videos, page=2, size=10).select("id", "url")


@check(
    "next_unpublished",
    f"SELECT id, url FROM videos WHERE {UNPUBLISHED} ORDER BY created_at, id LIMIT 1",
    "videos",
)
def next_unpublished(t):
    return V.next_unpublished(t.videos).select("id", "url")


DRAW = "md5(concat_ws('|', '7', '', CAST(id AS VARCHAR)))"


@check("pick_one", f"SELECT id, url FROM videos ORDER BY {DRAW}, id LIMIT 1", "videos")
def pick_one(t):
    return V.pick_one(t.videos, seed=7).select("id", "url")


@check(
    "classify_media",
    """
    SELECT id, contains(url, '.jpg') OR contains(url, '.jpeg') OR contains(url, '.png')
      OR contains(url, '.webp') OR contains(url, 'unsplash.com')
      OR contains(url, 'promodirect.com') AS is_image
    FROM videos""",
    "videos",
)
def classify_media(t):
    return V.classify_media(t.videos).select("id", "is_image")


@check(
    "feed_card",
    """
    SELECT id, CASE WHEN starts_with(url, 'output_assets/')
                 THEN concat('http://localhost:8080/', url) ELSE url END AS url,
      coalesce(model_name, 'Model') AS model_name, coalesce(item_name, 'Item') AS item_name,
      coalesce(affiliate_link, '') AS affiliate_link
    FROM videos""",
    "videos",
)
def feed_card(t):
    return V.feed_card(t.videos, "http://localhost:8080")


@check(
    "next_post",
    f"""
    WITH u AS (SELECT 1 AS priority, 'publish' AS action, id, item_name FROM videos
               WHERE {UNPUBLISHED} ORDER BY created_at, id LIMIT 1)
    SELECT * FROM u""",
    "videos",
)
def next_post(t):
    return V.next_post(t.videos, t.products, seed=7)


@check(
    "next_post_generate",
    f"""
    SELECT 2 AS priority, 'generate' AS action, id, product_name AS item_name FROM products
    WHERE NOT video_generated ORDER BY {DRAW}, id LIMIT 1""",
    "products",
)
def next_post_generate(t):
    return V.next_post(t.videos.where(F.col("published")), t.products, seed=7)


REPOST = f"""
    SELECT 3 AS priority, 'repost' AS action, id, item_name FROM videos
    WHERE {GENERATED} AND published ORDER BY {DRAW}, id LIMIT 1"""


@check("next_post_repost", REPOST, "videos")
def next_post_repost(t):
    used = t.products.withColumn("video_generated", F.lit(True))
    return V.next_post(t.videos.where(F.col("published")), used, seed=7)


@check("next_post_after_failure", REPOST, "videos")
def next_post_after_failure(t):
    published = t.videos.where(F.col("published"))
    choice = V.next_post(published, t.products, seed=7)
    return V.after_generation(choice, published, succeeded=False, seed=7)


@check(
    "video_captions",
    """
    WITH c AS (SELECT id, coalesce(item_name, 'null') AS i, coalesce(model_name, 'null') AS m,
                 coalesce(affiliate_link, 'null') AS l FROM videos)
    SELECT id,
      concat('Obsessed with this ', i, '! 💅 Styled by AI Model ', m,
             '. Comment "FIT" and I''ll DM you the link!') AS instagram,
      concat('Obsessed with this ', i, '! 💅 Styled by AI Model ', m,
             '. Shop the look here: ', l) AS twitter,
      concat('Obsessed with this ', i, '! 💅 Styled by AI Model ', m, '. Link in bio!') AS tiktok,
      concat('Obsessed with this ', i, '! Styled by AI Model ', m, '.') AS pinterest
    FROM c""",
    "videos",
)
def video_captions(t):
    captions = social.video_captions("item_name", "model_name", "affiliate_link")
    channels = ["instagram", "twitter", "tiktok", "pinterest"]
    return t.videos.select("id", captions.alias("c")).select(
        "id", *[F.col("c")[n].alias(n) for n in channels]
    )


@check(
    "news_captions",
    """
    SELECT id, concat(social_caption, ' 💅 Read the full details via the link below!') AS instagram,
      concat(title, chr(10), chr(10), 'Read more: ', coalesce(monetized_url, 'null')) AS twitter,
      concat(social_caption, '. Read full details: ', coalesce(monetized_url, 'null'))
        AS pinterest
    FROM posts""",
    "posts",
)
def news_captions(t):
    captions = social.news_captions("social_caption", "title", "monetized_url")
    return t.posts.select("id", captions.alias("c")).select(
        "id", *[F.col("c")[n].alias(n) for n in ["instagram", "twitter", "pinterest"]]
    )


@check(
    "post_layout",
    f"""
    SELECT id,
      CASE id % 6 WHEN 2 THEN '{BASE}/a/1.jpg'
        WHEN 3 THEN concat('{BASE}/b/', id, '.jpg|{BASE}/c.jpg')
        WHEN 4 THEN 'https://x.example.com/1.jpg' ELSE '' END AS urls,
      CASE id % 6 WHEN 1 THEN '' WHEN 2 THEN '{BASE}/a/1.jpg'
        WHEN 3 THEN concat('{BASE}/b/', id, '.jpg') WHEN 4 THEN 'https://x.example.com/1.jpg'
      END AS cover,
      CASE id % 6 WHEN 1 THEN 'single' WHEN 2 THEN 'single' WHEN 3 THEN 'carousel'
        WHEN 4 THEN 'single' END AS layout
    FROM posts""",
    "posts",
)
def post_layout(t):
    layout = social.post_layout("image_urls", BASE)
    return t.posts.select("id", layout.alias("p")).select(
        "id", F.array_join("p.urls", "|").alias("urls"), "p.cover", "p.layout"
    )


@check(
    "absolute_url",
    f"SELECT id, {sql_absolute('url')} AS url, {sql_absolute('path')} AS path FROM "
    "(SELECT id, url, CASE WHEN affiliate_link IS NULL THEN '' ELSE concat('/', url) END AS path "
    "FROM videos)",
    "videos",
)
def absolute_url(t):
    path = F.when(F.col("affiliate_link").isNull(), "").otherwise(F.concat(F.lit("/"), "url"))
    return t.videos.select(
        "id",
        urls.absolute_url("url", BASE).alias("url"),
        urls.absolute_url(path, BASE).alias("path"),
    )


@check(
    "client_url",
    "SELECT id, CASE WHEN starts_with(url, 'output_assets/') THEN concat('http://h/', url) "
    "ELSE url END AS url FROM videos",
    "videos",
)
def client_url(t):
    return t.videos.select("id", urls.client_url("url", "http://h").alias("url"))


@check(
    "post_link",
    "SELECT id, coalesce(nullif(monetized_url, ''), nullif(source_url, ''), 'https://d') AS link "
    "FROM posts",
    "posts",
)
def post_link(t):
    return t.posts.select(
        "id", urls.post_link("monetized_url", "source_url", "https://d").alias("link")
    )


@check(
    "monetized_url",
    "SELECT id, concat('https://go.redirectingat.com/?id=1X2&url=', source_url) AS url FROM posts",
    "posts",
)
def monetized_url(t):
    return t.posts.select("id", urls.monetized_url("1X2", "source_url").alias("url"))


@check(
    "join_urls",
    "SELECT id, CASE WHEN affiliate_link IS NULL THEN '' ELSE concat(url, ',', affiliate_link) END "
    "AS joined FROM videos",
    "videos",
)
def join_urls(t):
    both = F.when(F.col("affiliate_link").isNotNull(), F.array("url", "affiliate_link"))
    return t.videos.select("id", urls.join_urls(both).alias("joined"))


@check(
    "relative_asset",
    "SELECT id, url AS path FROM videos",
    "videos",
)
def relative_asset(t):
    local = F.when(F.col("url").startswith("http"), F.col("url")).otherwise(
        F.concat(F.lit("/srv/scripts/"), "url")
    )
    return t.videos.select("id", urls.relative_asset(local, "/srv/scripts").alias("path"))


@check(
    "publish_state",
    """
    SELECT id, CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN 'true'
                 ELSE coalesce(CAST(published AS VARCHAR), 'unknown') END AS published,
      CASE WHEN id % 3 = 0 THEN concat('new-', id) ELSE instagram_post_id END
        AS instagram_post_id
    FROM videos""",
    "videos",
)
def publish_state(t):
    new_id = F.when(F.col("id") % 3 == 0, F.concat(F.lit("new-"), "id"))
    state = social.publish_state("published", "instagram_post_id", new_id, F.col("id") % 5 == 0)
    return t.videos.select("id", state.alias("s")).select(
        "id",
        F.coalesce(F.col("s.published").cast("string"), F.lit("unknown")).alias("published"),
        "s.instagram_post_id",
    )
