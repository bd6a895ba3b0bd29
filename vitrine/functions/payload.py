"""Parsing of webhook payloads, generator logs and provider results."""

from pyspark.sql import functions as F

from .. import schemas
from . import as_col, first_non_empty, non_empty

# Marks around the news generator's result.
RESULT_START = "--- JSON OUTPUT START ---"
RESULT_END = "--- JSON OUTPUT END ---"


def normalize_webhook(platform, payload):
    """(comment_id, post_id, username, comment_text) out of a nested or flat payload.

    Instagram payloads with ``entry`` are nested: values missing inside an existing
    change become null, values whose parent is missing keep their default.
    """
    payload = as_col(payload)
    keys = F.json_object_keys(payload)
    nested = (F.lower(as_col(platform)) == "instagram") & F.coalesce(
        F.array_contains(keys, "entry"), F.lit(False)
    )
    root = "$.entry[0].changes[0].value"

    def at(path):
        return F.get_json_object(payload, path)

    def inner(parent, path, default):
        return F.when(at(parent).isNotNull(), at(path)).otherwise(F.lit(default))

    def flat(key, default):
        found = at(f"$.{key}")
        return (
            F.when(found.isNotNull(), found)
            .when(F.array_contains(keys, key), F.lit("null"))
            .otherwise(F.lit(default))
        )

    def choose(nested_value, flat_value):
        return F.when(nested, nested_value).otherwise(flat_value)

    return F.struct(
        choose(inner(root, root + ".id", "unknown"), flat("commentId", "unknown")).alias(
            "comment_id"
        ),
        choose(inner(root + ".media", root + ".media.id", "unknown"), flat("postId", "unknown"))
        .alias("post_id"),
        choose(
            inner(root + ".from", root + ".from.username", "unknown"), flat("username", "unknown")
        ).alias("username"),
        choose(inner(root, root + ".text", ""), flat("text", "")).alias("comment_text"),
    )


def extract_asset_json(log):
    """From the first ``[{"`` to the last ``]``; null when there is none."""
    return non_empty(F.regexp_extract(as_col(log), r'(?s)(\[\{".*\])', 1))


def parse_assets(log):
    """Generated assets listed in a log, as an array of structs."""
    return F.from_json(extract_asset_json(log), f"ARRAY<STRUCT<{schemas.GENERATED_ASSET}>>")


def extract_marked_json(log):
    """Text between the first start mark and the first end mark; null when not there."""
    log = as_col(log)
    start = F.instr(log, RESULT_START)
    end = F.instr(log, RESULT_END)
    first = start + F.lit(len(RESULT_START))
    body = F.substr(log, first, end - first)
    return F.when((start > 0) & (end >= first), F.trim(body, F.lit(" \t\r\n")))


def parse_news_result(log):
    """The news result of a log; null unless its status is success (any case)."""
    result = F.from_json(extract_marked_json(log), schemas.NEWS_RESULT)
    return F.when(F.lower(result["status"]) == "success", result)


def result_url(result, kind):
    """First usable url in a provider's result.

    ``image``  ``video``   object or text under ``output``
    ``soft_image``         first of ``images``
    ``scene_video``        ``video``, then ``output``, then first of ``images``
    """
    result = as_col(result)

    def at(path):
        return F.get_json_object(result, path)

    output = at("$.output")
    is_object = output.startswith("{")
    is_text = ~output.startswith("{") & ~output.startswith("[")
    if kind in ("image", "video"):
        found = F.when(
            is_object, first_non_empty(at(f"$.output.{kind}_url"), at("$.output.url"))
        ).when(is_text, output)
        return F.coalesce(found, F.lit(""))
    if kind == "soft_image":
        return F.coalesce(at("$.images[0].url"), F.lit(""))
    if kind == "scene_video":
        first_image = at("$.images[0]")
        from_output = F.when(
            is_object, first_non_empty(at("$.output.video_url"), at("$.output.url"))
        ).when(output.startswith("http"), output)
        from_images = F.when(
            first_image.startswith("{"), non_empty(at("$.images[0].url"))
        ).when(first_image.startswith("http"), first_image)
        return F.coalesce(non_empty(at("$.video.url")), from_output, from_images, F.lit(""))
    raise ValueError(f"unknown result kind: {kind}")


def task_id(result):
    """First of the three id keys a provider may use."""
    result = as_col(result)
    keys = ("id", "prediction_id", "predictionID")
    return first_non_empty(*[F.get_json_object(result, f"$.{k}") for k in keys])


def backend_choice(has_first, has_second, first="eachlabs", second="higgsfield"):
    """Image and video backend: images prefer the first, videos the second; null with neither."""
    a, b = as_col(has_first), as_col(has_second)
    image = F.when(a, F.lit(first)).otherwise(F.lit(second))
    video = F.when(b, F.lit(second)).otherwise(F.lit(first))
    return F.when(
        a | b,
        F.struct(
            image.alias("image_backend"),
            video.alias("video_backend"),
            F.concat(image, F.lit("+"), video).alias("label"),
        ),
    )
