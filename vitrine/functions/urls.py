"""Url rewriting."""

from pyspark.sql import functions as F

from . import as_col, first_non_empty

# Fixed value: prefix of the monetised redirect.
REDIRECT_PREFIX = "https://go.redirectingat.com/?id="


def is_http(c):
    c = as_col(c)
    return c.startswith("http://") | c.startswith("https://")


def absolute_url(c, base):
    """Null, empty and http(s) urls stay; others go below the base, one leading slash dropped."""
    c = as_col(c)
    root = base if base.endswith("/") else base + "/"
    path = F.when(c.startswith("/"), F.substr(c, F.lit(2))).otherwise(c)
    return F.when(c.isNull() | (c == "") | is_http(c), c).otherwise(F.concat(F.lit(root), path))


def client_url(c, host):
    """Only ``output_assets/`` paths are put below the host."""
    c = as_col(c)
    return F.when(
        c.startswith("output_assets/"), F.concat(F.lit(host + "/"), c)
    ).otherwise(c)


def monetized_url(site_id, url):
    """Redirect prefix, id and the raw url."""
    return F.concat(F.lit(f"{REDIRECT_PREFIX}{site_id}&url="), as_col(url))


def post_link(monetized, source, default):
    return first_non_empty(monetized, source, F.lit(default))


def join_urls(urls):
    """Comma-joined list; a null list gives the empty string."""
    return F.coalesce(F.array_join(as_col(urls), ",", "null"), F.lit(""))


def split_urls(c):
    """Comma split that drops trailing empty parts but keeps a lone empty text."""
    c = as_col(c)
    parts = F.split(F.regexp_replace(c, ",+$", ""), ",", -1)
    return F.when(c.rlike("^,+$"), F.array().cast("array<string>")).otherwise(parts)


def relative_asset(path, root):
    """Local paths relative to the asset root; http urls and empty paths unchanged."""
    path = as_col(path)
    prefix = root.rstrip("/") + "/"
    return F.when(
        path.startswith(prefix) & ~path.startswith("http"),
        F.substr(path, F.lit(len(prefix) + 1)),
    ).otherwise(path)


def proxy_image_url(base, thumbnail):
    """Resizing proxy url of a product thumbnail."""
    return F.format_string(
        "%s/sig/resize:auto:350:500:true:true/%s.webp", F.lit(base), as_col(thumbnail)
    )


def audio_filename(url, default_url, default_name="background_music.mp3"):
    """Local file name for a music url: default name, last path node, or hash."""
    url = as_col(url)
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    path = F.regexp_replace(path, r";[^/]*$", "")
    nodes = F.filter(F.split(path, "/", -1), lambda n: n != "")
    name = F.when(
        F.size(nodes) > 0, F.concat(F.lit("bgm_"), F.get(nodes, F.size(nodes) - 1))
    ).otherwise(F.concat(F.lit("bgm_"), F.md5(F.encode(url, "UTF-8")), F.lit(".mp3")))
    return (
        F.when(url == default_url, F.lit(default_name))
        .when(url.isNull() | (url == ""), F.lit(None))
        .otherwise(name)
    )
