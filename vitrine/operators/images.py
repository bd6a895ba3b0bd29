"""Image checks over landed files, by header only."""

import struct

import pandas as pd
from pyspark.sql import functions as F

from .grouping import spread_lookup

JPEG_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def _jpeg_size(data):
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in JPEG_FRAMES:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        if 0xD0 <= marker <= 0xD9 or marker == 0x01:
            at += 2
            continue
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


def image_size(data):
    """(width, height) from a PNG, GIF, BMP or JPEG header, else None."""
    if data is None:
        return None
    data = bytes(data)
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    if data[:2] == b"\xff\xd8":
        return _jpeg_size(data)
    return None


def _sizes(batches):
    for batch in batches:
        sizes = [image_size(content) or (0, 0) for content in batch["content"]]
        yield pd.DataFrame(
            {
                "path": batch["path"],
                "width": pd.Series([s[0] for s in sizes], dtype="int64"),
                "height": pd.Series([s[1] for s in sizes], dtype="int64"),
            }
        )


def image_sizes(images):
    """(path, width, height) of landed image files; 0 by 0 when not an image."""
    return images.select("path", "content").mapInPandas(
        _sizes, "path STRING, width BIGINT, height BIGINT"
    )


def valid_images(catalog, images, key="image_path"):
    """Catalogue rows whose landed image has a width and a height."""
    good = image_sizes(images).where((F.col("width") > 0) & (F.col("height") > 0))
    paths = good.select(F.col("path").alias(key)).distinct()
    return spread_lookup(catalog, paths, [key], how="left_semi", salts=1)
