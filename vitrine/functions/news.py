"""News items: image ids, slide texts, headlines, hashtags."""

from pyspark.sql import functions as F

from . import as_col, first_non_empty, non_empty
from .text import UNICODE_SPACE_RUN, trim_unicode

# Patterns of image ids, image urls and the rebuilt photo url.
PHOTO_ID = r"assets\.vogue\.com/photos/([a-f0-9]+)"
FEED_IMAGE_ID = r"\.image/([^/?]+/[^/?]+)"
DESCRIPTION_IMAGE = r'(?i)src="([^"]+\.(?:jpg|jpeg|png|webp)[^"]*)"'
PHOTO_URL = ("https://assets.vogue.com/photos/", "/master/w_1280,c_limit/image.jpg")

# Closing texts and limits of the slides.
MORE_TEXT = "..."
CLOSING_TEXT = " Tap below to read more."
SLIDE_WORDS = 20
CANDIDATE_CHARS = 200


def image_id(url):
    """Photo hash, else feed image path, else file name without query, else the url."""
    url = as_col(url)
    file_name = F.substring_index(F.substring_index(url, "?", 1), "/", -1)
    return first_non_empty(
        F.regexp_extract(url, PHOTO_ID, 1),
        F.regexp_extract(url, FEED_IMAGE_ID, 1),
        file_name,
        url,
    )


def photo_url(photo_id):
    return F.concat(F.lit(PHOTO_URL[0]), photo_id, F.lit(PHOTO_URL[1]))


def page_images(html):
    """Rebuilt urls of all photos on a page, distinct, in page order."""
    ids = F.array_distinct(F.regexp_extract_all(as_col(html), F.lit(PHOTO_ID), F.lit(1)))
    return F.transform(ids, photo_url)


def description_images(html):
    """Image urls in a description, entities resolved, repeats kept."""
    found = F.regexp_extract_all(as_col(html), F.lit(DESCRIPTION_IMAGE), F.lit(1))
    return F.transform(found, lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def story_image(media_url, description, enclosure_url):
    """Media url, else the first source in a description with an image, else the enclosure."""
    d = as_col(description)
    embedded = F.when(d.contains("<img"), F.regexp_extract(d, 'src="([^"]*)"', 1))
    return F.coalesce(non_empty(media_url), non_empty(embedded), as_col(enclosure_url))


def strip_html(c):
    return trim_unicode(F.regexp_replace(as_col(c), "<[^<]+?>", ""))


def candidate_text(c):
    """Stripped text cut to the length shown in a candidate list."""
    return F.left(strip_html(c), F.lit(CANDIDATE_CHARS))


def words_of(c, limit=-1):
    """Words of a text; with a limit the last one holds the rest."""
    return F.filter(F.split(as_col(c), UNICODE_SPACE_RUN, limit), lambda w: w != "")


def slide_texts(description):
    """Words 1-20 and 21-40 of the stripped text, the second with its closing."""
    words = words_of(strip_html(description), 2 * SLIDE_WORDS + 1)
    second = F.array_join(F.slice(words, SLIDE_WORDS + 1, SLIDE_WORDS), " ")
    closing = F.when(F.size(words) > 2 * SLIDE_WORDS, MORE_TEXT).otherwise(CLOSING_TEXT)
    return F.struct(
        F.array_join(F.slice(words, 1, SLIDE_WORDS), " ").alias("slide2_text"),
        F.concat(second, closing).alias("slide3_text"),
    )


def headline(title):
    """Title cut at the first dash separator, else at the first bar."""
    t = trim_unicode(title)
    return (
        F.when(t.contains(" - "), F.substring_index(t, " - ", 1))
        .when(t.contains(" | "), F.substring_index(t, " | ", 1))
        .otherwise(t)
    )


def display_headline(title):
    return F.upper(headline(title))


def hashtags(head, limit=3):
    """First distinct capitalised words of at least three characters, as tags."""
    plain = F.regexp_replace(
        as_col(head), r"[^\p{L}\p{N}_" + UNICODE_SPACE_RUN[1:-2] + "]", ""
    )
    capital = F.filter(words_of(plain), lambda w: w.rlike(r"^\p{Lu}") & (F.length(w) >= 3))
    tags = F.transform(capital, lambda w: F.concat(F.lit("#"), w))
    return F.slice(F.array_distinct(tags), 1, limit)


def news_caption(head, tags, brand_tag):
    """Caption of a news post; ``brand_tag`` is the account's own hashtag."""
    return trim_unicode(
        F.concat(
            F.lit("Breaking: "),
            as_col(head),
            F.lit(" 💅 Swipe to read details & click below for full story! "),
            F.lit(f"{brand_tag} #FashionNews "),
            F.array_join(as_col(tags), " "),
        )
    )


def slide_plan(images, fallback):
    """Three slide images spread over the gallery, and the zoom of repeated ones."""
    images = as_col(images)
    n = F.coalesce(F.size(images), F.lit(0))
    cover = F.coalesce(F.get(images, F.lit(0)), F.lit(fallback))
    third = F.floor(n / 3).cast("int")
    two_thirds = F.floor(n * 2 / 3).cast("int")

    def spread(far, near):
        return (
            F.when(n >= 6, F.get(images, far)).when(n >= 3, F.get(images, near)).otherwise(cover)
        )

    second, third_image = spread(third, F.lit(1)), spread(two_thirds, F.lit(2))
    return F.struct(
        cover.alias("image1"),
        second.alias("image2"),
        third_image.alias("image3"),
        F.when(second == cover, F.lit(1.35)).otherwise(F.lit(1.0)).alias("zoom2"),
        F.when(third_image == cover, F.lit(1.65)).otherwise(F.lit(1.0)).alias("zoom3"),
    )
