"""Declared schemas, as Spark DDL. Reading with a schema avoids an inference pass."""

INTERACTION = (
    "id BIGINT, userId BIGINT, interactionType STRING, productId BIGINT, createdAt TIMESTAMP"
)

RATING = "user INT, product INT, rating DOUBLE"

CATALOG_ITEM = (
    "sku STRING, name STRING, program_name STRING, manufacturer STRING, price STRING, "
    "currency STRING, in_stock STRING, color STRING, image_url STRING, buy_url STRING, "
    "price_shipping STRING, description_long STRING"
)

COUPON = (
    "id STRING, name STRING, code STRING, description STRING, start_date STRING, "
    "end_date STRING, status STRING, exclusive STRING, coupon STRING, program_id STRING, "
    "program_name STRING, category_name STRING, category_names ARRAY<STRING>"
)

PAGINATION = (
    "pagination: STRUCT<totalResults: INT, totalPages: INT, "
    "next: STRUCT<rel: STRING, href: STRING, description: STRING>>"
)


def page_of(item):
    """Schema of one landed API page holding an array of ``item`` rows."""
    fields = ", ".join(f.strip().replace(" ", ": ", 1) for f in item.split(","))
    return f"meta STRUCT<{PAGINATION}>, data ARRAY<STRUCT<{fields}>>"


TAGS = (
    "gender STRING, category STRING, sub_categories ARRAY<STRING>, color STRING, material STRING"
)

TAGGED_PRODUCT = f"id BIGINT, tags STRUCT<{TAGS}>"

VIDEO = (
    "id BIGINT, url STRING, affiliate_link STRING, model_name STRING, item_name STRING, "
    "vton_image_url STRING, script STRING, created_at TIMESTAMP, published BOOLEAN, "
    "instagram_post_id STRING, product_id BIGINT"
)

COMMENT = (
    "platform STRING, comment_id STRING, post_id STRING, username STRING, comment_text STRING, "
    "reply_text STRING, product_link STRING, status STRING, received_at TIMESTAMP, "
    "replied_at TIMESTAMP"
)

WEBHOOK = "platform STRING, payload STRING, received_at TIMESTAMP"

RSS_ITEM = (
    "title STRING, link STRING, description STRING, enclosure STRUCT<_url: STRING>"
)

GENERATED_ASSET = (
    "backend STRING, final_video_url STRING, model_name STRING, script STRING, "
    "vton_image STRING, model_id STRING, status STRING"
)

NEWS_RESULT = (
    "status STRING, headline STRING, slide2_text STRING, slide3_text STRING, "
    "social_caption STRING, original_url STRING, monetized_url STRING, original_title STRING, "
    "final_graphic_urls ARRAY<STRING>"
)

CACHE_ENTRY = "MAP<STRING, STRUCT<vton_image: STRING, storyboard_images: ARRAY<STRING>>>"

TASK_EVENT = (
    "product_id STRING, model_id STRING, scene STRING, task_id STRING, kind STRING, ts TIMESTAMP"
)
