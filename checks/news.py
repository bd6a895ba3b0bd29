"""News: feeds, images, texts, posts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from vitrine.functions import news as N
from vitrine.functions import payload
from vitrine.operators import news as W
from vitrine.operators.grouping import spread_rows, top_in_group
from vitrine.session import run_dir
from vitrine.sources.files import scan_rss

from .base import check, quoted

DEFAULT_IMAGE = "https://images.example.com/default.jpg"
BRAND = "#StyleDesk"
CREATED = "2024-01-31 00:00:00"

SPACE = (
    "[\\t\\n\\x{0B}\\f\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# Titles with both separators.
TITLED = """titled AS (
      SELECT *, CASE pos % 3 WHEN 0 THEN concat(title, ' - The Desk - Print')
                             WHEN 1 THEN concat('  ', title, ' | Desk') ELSE title END AS headed
      FROM stories)"""


def titled(t):
    headed = (
        F.when(F.col("pos") % 3 == 0, F.concat("title", F.lit(" - The Desk - Print")))
        .when(F.col("pos") % 3 == 1, F.concat(F.lit("  "), "title", F.lit(" | Desk")))
        .otherwise(F.col("title"))
    )
    return t.stories.withColumn("headed", headed)


def sql_strip(c):
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_words(c):
    return f"list_filter(string_split_regex({c}, '{SPACE}+'), lambda w: w <> '')"


def sql_bare(c):
    return sql_strip(f"regexp_replace({c}, '<[^<]+?>', '', 'g')")


def sql_headline(c):
    s = sql_strip(c)
    return (
        f"CASE WHEN contains({s}, ' - ') THEN split_part({s}, ' - ', 1) "
        f"WHEN contains({s}, ' | ') THEN split_part({s}, ' | ', 1) ELSE {s} END"
    )


def sql_upper(c):
    """Upper case with the sharp s as SS."""
    return f"upper(replace({c}, 'ß', 'ss'))"


def sql_image_id(u):
    return (
        f"coalesce(nullif(regexp_extract({u}, {quoted(N.PHOTO_ID)}, 1), ''), "
        f"nullif(regexp_extract({u}, {quoted(N.FEED_IMAGE_ID)}, 1), ''), "
        f"nullif(list_last(string_split(split_part({u}, '?', 1), '/')), ''), {u})"
    )


def sql_capitals(c):
    plain = f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_{SPACE[1:-1]}]', '', 'g')"
    return (
        f"list_filter({sql_words(plain)}, "
        "lambda w: regexp_matches(w, '^\\p{Lu}') AND length(w) >= 3)"
    )


def sql_hashtags(c, words=None):
    words = words or sql_capitals(c)
    first = f"list_filter({words}, lambda w, i: list_position({words}, w) = i)"
    return f"list_transform(({first})[1:3], lambda w: concat('#', w))"


BARE = f"bare AS (SELECT pos, {sql_words(sql_bare('description'))} AS w FROM stories)"
SLIDES = f"""{BARE}, slides AS (
      SELECT pos, array_to_string(w[1:20], ' ') AS slide2_text,
        concat(array_to_string(w[21:40], ' '),
               CASE WHEN len(w) > 40 THEN '...' ELSE ' Tap below to read more.' END)
          AS slide3_text FROM bare)"""


@check(
    "complete_stories",
    "SELECT pos, link FROM stories WHERE title <> '' AND link <> ''",
    "stories",
)
def complete_stories(t):
    return W.complete_stories(t.stories).select("pos", "link")


@check(
    "first_stories",
    "SELECT pos, link FROM stories WHERE title <> '' AND link <> '' ORDER BY pos LIMIT 15",
    "stories",
)
def first_stories(t):
    return W.first_stories(W.complete_stories(t.stories)).select("pos", "link")


@check(
    "union_feeds",
    "SELECT pos, CASE WHEN pos % 2 = 0 THEN 0 ELSE 1 END AS feed, link FROM stories",
    "stories",
)
def union_feeds(t):
    even, odd = (t.stories.where(F.col("pos") % 2 == i) for i in (0, 1))
    return W.union_feeds([even, odd]).select("pos", "feed", "link")


@check(
    "candidate_block",
    f"""
    WITH c AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i FROM
               (SELECT * FROM stories WHERE title <> '' AND link <> '' ORDER BY pos LIMIT 15))
    SELECT string_agg(concat('[', i, '] TITLE: ', title, chr(10), 'LINK: ', link, chr(10),
      'DESC: ', left({sql_bare("description")}, 200), chr(10), 'IMAGE: ',
      coalesce(nullif(image_url, ''), 'None')), chr(10) || chr(10) ORDER BY i) AS block
    FROM c""",
    "stories",
)
def candidate_block(t):
    return W.candidate_block(W.complete_stories(t.stories))


SELECTED = """
    batched AS (SELECT *, source AS batch FROM stories WHERE title <> '' AND link <> ''),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY pos) AS rn FROM batched),
    picks AS (
      SELECT batch,
        CASE WHEN rn = 3 THEN link ELSE 'https://elsewhere' END AS original_link,
        CASE WHEN rn = 3 THEN 'other' ELSE concat('About ', title, '!') END AS original_title,
        CASE WHEN rn % 2 = 0 THEN 'None' ELSE 'https://given/i.jpg' END AS image_url
      FROM ranked WHERE rn IN (3, 5, 20) AND batch IN (
        SELECT batch FROM ranked WHERE rn = 3) ),
    selections AS (
      SELECT batch, min(original_link) AS original_link, min(original_title) AS original_title,
        min(image_url) AS image_url FROM picks GROUP BY batch)"""


#: Ranks of the stories that are chosen, as in ``SELECTED``.
RANKS = (3, 5, 20)


def selections(t):
    """One choice per source: some by link, some by title, some beyond the candidates."""
    batched = W.complete_stories(t.stories).withColumn("batch", F.col("source"))
    # no story behind the last of the ranks is shuffled
    first = top_in_group(batched.select("batch", "pos", "title", "link"), ["batch"], ["pos"], max(RANKS))
    rank = F.row_number().over(Window.partitionBy("batch").orderBy("pos"))
    rn = F.col("rn")
    other = F.concat(F.lit("About "), F.col("title"), F.lit("!"))
    picks = first.withColumn("rn", rank).where(rn.isin(*RANKS)).select(
        "batch", "rn",
        F.when(rn == 3, F.col("link")).otherwise("https://elsewhere").alias("original_link"),
        F.when(rn == 3, "other").otherwise(other).alias("original_title"),
        F.when(rn % 2 == 0, "None").otherwise("https://given/i.jpg").alias("image_url"),
    )
    chosen = picks.groupBy("batch").agg(
        F.max(rn == 3).alias("third"), *[F.min(c).alias(c) for c in ("original_link", "original_title", "image_url")]
    )
    # a null source is in no list of batches
    return batched, chosen.where("third AND batch IS NOT NULL").drop("third")


@check(
    "match_selected_story",
    f"""
    WITH {SELECTED.strip()},
    fit AS (
      SELECT c.batch, r.link, r.title, r.image_url,
        row_number() OVER (PARTITION BY c.batch ORDER BY r.pos) AS k
      FROM selections c JOIN ranked r ON c.batch = r.batch AND r.rn <= 15
        AND (r.link = c.original_link OR contains(c.original_title, r.title)))
    SELECT c.batch, coalesce(f.link, c.original_link) AS original_link,
      coalesce(f.title, c.original_title) AS original_title,
      coalesce(nullif(f.image_url, ''), CASE WHEN c.image_url <> 'None' THEN c.image_url END,
               '{DEFAULT_IMAGE}') AS image_url,
      f.batch IS NOT NULL AS matched
    FROM selections c LEFT JOIN fit f ON c.batch = f.batch AND f.k = 1""",
    "stories",
)
def match_selected_story(t):
    batched, chosen = selections(t)
    return W.match_selected_story(chosen, batched, DEFAULT_IMAGE).drop("rss_description")


@check(
    "direct_story",
    f"""
    WITH {TITLED}, {SLIDES}, h AS (SELECT *, {sql_headline("headed")} AS head FROM titled)
    SELECT pos, {sql_upper("head")} AS headline, slide2_text, slide3_text,
      {sql_strip(f"concat('Breaking: ', head, ' 💅 Swipe to read details & click below for full story! {BRAND} #FashionNews ', array_to_string({sql_hashtags('head')}, ' '))")}
        AS social_caption,
      link AS original_link, coalesce(nullif(image_url, ''), '{DEFAULT_IMAGE}') AS image_url
    FROM h JOIN slides USING (pos)""",
    "stories",
)
def direct_story(t):
    rows = titled(t).drop("title").withColumnRenamed("headed", "title")
    return W.direct_story(rows, BRAND, DEFAULT_IMAGE, t.cores).drop("original_title", "rss_description")


@check(
    "strip_html",
    f"SELECT pos, {sql_bare('description')} AS bare FROM stories",
    "stories",
)
def strip_html(t):
    return t.stories.select("pos", N.strip_html("description").alias("bare"))


@check(
    "strip_html_pages",
    f"SELECT page_id, {sql_bare('html')} AS bare FROM pages",
)
def strip_html_pages(t):
    return t.pages.select("page_id", N.strip_html("html").alias("bare"))


@check(
    "candidate_text",
    f"SELECT page_id, left({sql_bare('html')}, 200) AS bare FROM pages",
)
def candidate_text(t):
    return t.pages.select("page_id", N.candidate_text("html").alias("bare"))


@check("slide_texts", f"WITH {SLIDES} SELECT * FROM slides", "stories")
def slide_texts(t):
    return t.stories.select("pos", N.slide_texts("description").alias("s")).select("pos", "s.*")


@check(
    "headline",
    f"WITH {TITLED} SELECT pos, {sql_headline('headed')} AS head, "
    f"{sql_upper(sql_headline('headed'))} AS display FROM titled",
    "stories",
)
def headline(t):
    return titled(t).select(
        "pos", N.headline("headed").alias("head"), N.display_headline("headed").alias("display")
    )


@check(
    "hashtags",
    f"WITH c AS (SELECT doc_id, {sql_capitals('text')} AS caps FROM documents) "
    f"SELECT doc_id, array_to_string({sql_hashtags('text', 'caps')}, ' ') AS tags FROM c",
)
def hashtags(t):
    rows = spread_rows(t.documents, t.cores)
    return rows.select("doc_id", F.array_join(N.hashtags("text"), " ").alias("tags"))


@check(
    "news_caption",
    f"SELECT id, {sql_strip(f'''concat('Breaking: ', title, ' 💅 Swipe to read details & click below for full story! {BRAND} #FashionNews ', '#A #B')''')} AS caption FROM posts",
    "posts",
)
def news_caption(t):
    tags = F.array(F.lit("#A"), F.lit("#B"))
    return t.posts.select("id", N.news_caption("title", tags, BRAND).alias("caption"))


@check("image_id", f"SELECT article, pos, {sql_image_id('url')} AS image_id FROM images", "images")
def image_id(t):
    return t.images.select("article", "pos", N.image_id("url").alias("image_id"))


@check(
    "first_image",
    f"""
    SELECT article, image_id, pos, url FROM (
      SELECT *, row_number() OVER (PARTITION BY article, image_id ORDER BY pos, url) AS rn
      FROM (SELECT *, {sql_image_id("url")} AS image_id FROM images)) WHERE rn = 1""",
    "images",
)
def first_image(t):
    return W.first_image(t.images).select("article", "image_id", "pos", "url")


IDS = f"regexp_extract_all(html, {quoted(N.PHOTO_ID)}, 1)"
REBUILT = (
    f"list_transform(list_filter({IDS}, lambda x, i: list_position({IDS}, x) = i), lambda x: "
    "concat('https://assets.vogue.com/photos/', x, '/master/w_1280,c_limit/image.jpg'))"
)
FOUND = (
    "list_transform(regexp_extract_all(description, "
    "'(?i)src=\"([^\"]+\\.(?:jpg|jpeg|png|webp)[^\"]*)\"', 1), "
    "lambda u: replace(u, '&amp;', '&'))"
)


@check(
    "page_images",
    f"SELECT id, array_to_string({REBUILT}, '|') AS urls FROM articles",
    "articles",
)
def page_images(t):
    return t.articles.select("id", F.array_join(N.page_images("html"), "|").alias("urls"))


@check(
    "description_images",
    f"SELECT id, array_to_string({FOUND}, '|') AS urls FROM articles",
    "articles",
)
def description_images(t):
    return t.articles.select(
        "id", F.array_join(N.description_images("description"), "|").alias("urls")
    )


@check(
    "story_image",
    """
    SELECT id, coalesce(nullif(main_image, ''),
      CASE WHEN contains(description, '<img')
           THEN nullif(regexp_extract(description, 'src="([^"]*)"', 1), '') END,
      enclosure) AS image FROM articles""",
    "articles",
)
def story_image(t):
    return t.articles.select(
        "id", N.story_image("main_image", "description", "enclosure").alias("image")
    )


@check(
    "gallery",
    f"""
    WITH own AS (
      SELECT id, description, list_concat(
        CASE WHEN main_image <> '' THEN [main_image] ELSE [] END,
        CASE WHEN contains(link, 'vogue.com') THEN {REBUILT} ELSE [] END) AS l FROM articles),
    ids AS (SELECT *, list_transform(l, lambda u: {sql_image_id("u")}) AS k FROM own),
    one AS (SELECT id, description,
              list_filter(l, lambda u, i: list_position(k, k[i]) = i) AS l FROM ids),
    both_lists AS (SELECT id, CASE WHEN len(l) < 3
              THEN list_concat(l, coalesce({FOUND}, [])) ELSE l END AS l FROM one),
    ids2 AS (SELECT *, list_transform(l, lambda u: {sql_image_id("u")}) AS k FROM both_lists),
    two AS (SELECT id, list_filter(list_filter(l, lambda u, i: list_position(k, k[i]) = i),
              lambda u: starts_with(u, 'http')) AS l FROM ids2)
    SELECT id, array_to_string(l, '|') AS urls FROM two""",
    "articles",
)
def gallery(t):
    rows = W.gallery(t.articles, "main_image", "link", "html", "description")
    return rows.select("id", F.array_join("gallery", "|").alias("urls"))


@check(
    "slide_plan",
    f"""
    WITH g AS (SELECT l_orderkey AS id, list(concat('u', l_linenumber) ORDER BY l_linenumber,
                 l_partkey, l_suppkey) AS l, count(*) AS n FROM lineitem GROUP BY 1),
    p AS (SELECT id, n, CASE WHEN n = 1 THEN '{DEFAULT_IMAGE}' ELSE l[1] END AS image1,
      CASE WHEN n >= 6 THEN l[n // 3 + 1] WHEN n >= 3 THEN l[2]
           WHEN n = 1 THEN '{DEFAULT_IMAGE}' ELSE l[1] END AS image2,
      CASE WHEN n >= 6 THEN l[2 * n // 3 + 1] WHEN n >= 3 THEN l[3]
           WHEN n = 1 THEN '{DEFAULT_IMAGE}' ELSE l[1] END AS image3 FROM g)
    SELECT id, image1, image2, image3,
      CASE WHEN image2 = image1 THEN 1.35::DOUBLE ELSE 1.0::DOUBLE END AS zoom2,
      CASE WHEN image3 = image1 THEN 1.65::DOUBLE ELSE 1.0::DOUBLE END AS zoom3 FROM p""",
)
def slide_plan(t):
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lists = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(
        F.transform(
            F.array_sort(F.collect_list(place)),
            lambda s: F.concat(F.lit("u"), s["l_linenumber"].cast("string")),
        ).alias("l")
    )
    images = F.when(F.size("l") == 1, F.array().cast("array<string>")).otherwise(F.col("l"))
    return lists.select("id", N.slide_plan(images, DEFAULT_IMAGE).alias("p")).select("id", "p.*")


def news_logs(t):
    """Generator logs: mostly successes, some failures, some without a result."""
    n = F.col("id")
    result = F.to_json(
        F.struct(
            F.when(n % 7 == 0, "failed").otherwise("Success").alias("status"),
            F.col("title").alias("headline"),
            F.col("social_caption").alias("slide2_text"),
            F.col("source_url").alias("original_url"),
            "monetized_url",
            F.when(n % 3 != 0, F.array(F.lit("/a.jpg"), F.concat(F.lit("/"), n.cast("string"))))
            .alias("final_graphic_urls"),
        )
    )
    log = F.concat(
        F.lit("[RSS] reading\n--- JSON OUTPUT START ---\n"),
        result,
        F.when(n % 5 == 0, "").otherwise("\n--- JSON OUTPUT END ---\nbye"),
    )
    return t.posts.select("id", log.alias("log"))


@check(
    "news_post",
    f"""
    SELECT id, CASE WHEN id % 3 <> 0 THEN concat('/a.jpg,/', id) ELSE '' END AS image_urls, title,
      social_caption AS summary_text, source_url, monetized_url, '{CREATED}' AS created_at,
      false AS published
    FROM posts WHERE id % 7 <> 0 AND id % 5 <> 0 AND id % 11 <> 0""",
    "posts",
)
def news_post(t):
    logs = news_logs(t).withColumn("exit_code", F.when(F.col("id") % 11 == 0, 1).otherwise(0))
    rows = W.news_post(logs, CREATED, passthrough=("id",)).drop("social_caption")
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@check(
    "extract_marked_json",
    "SELECT id, CASE WHEN id % 5 = 0 THEN 'none' ELSE concat(id, ' ok') END AS body FROM posts",
    "posts",
)
def extract_marked_json(t):
    log = F.concat(
        F.col("social_caption"),
        F.lit("--- JSON OUTPUT START ---\n "),
        F.col("id").cast("string"),
        F.lit(" ok\n"),
        F.when(F.col("id") % 5 == 0, "").otherwise("--- JSON OUTPUT END ---"),
        F.lit("--- JSON OUTPUT END"),
    )
    return t.posts.select(
        "id", F.coalesce(payload.extract_marked_json(log), F.lit("none")).alias("body")
    )


@check(
    "scan_rss",
    """
    SELECT CAST(id % 2 AS INTEGER) AS feed, concat('T', id) AS title, link,
      CASE WHEN id % 3 <> 0 THEN main_image WHEN id % 6 = 0 THEN enclosure END AS image_url
    FROM articles""",
    "articles",
)
def rss(t):
    paths = [run_dir(t.spark, "feed") for _ in range(2)]
    for i, path in enumerate(paths):
        parts = [
            F.format_string("<item><title>T%d</title><link>%s</link>", "id", "link"),
            F.format_string('<media:content url="%s"/>', "main_image"),
            F.format_string('<enclosure url="%s"/></item>', "enclosure"),
        ]
        tags = [F.when(F.col(c).isNotNull(), p) for c, p in
                zip(["id", "main_image", "enclosure"], parts, strict=True)]
        item = F.concat(tags[0], F.coalesce(tags[1], F.lit("")),
                        F.coalesce(tags[2], F.lit("</item>")))
        documents = (
            t.articles.where(F.col("id") % 2 == i)
            .groupBy(F.floor(F.col("id") / 100).alias("document"))
            .agg(F.array_sort(F.collect_list(item)).alias("items"))
        )
        whole = F.concat(
            F.lit('<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>'),
            F.array_join("items", "\n"),
            F.lit("</channel></rss>"),
        )
        documents.select(whole.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    missing = f"{paths[0]}-none"
    return scan_rss(t.spark, [*paths, missing]).select("feed", "title", "link", "image_url")
