"""Bloom filters as small tables, in column expressions.

A filter is a table (block, bits): each key belongs to one block of 32 768 bits and sets
PROBES of them. Filters of parts merge to that of the whole. A key that was put in is always
found; of others few are, as long as a block holds some thousand keys.
"""

from pyspark.sql import functions as F

BLOCK_BITS = 32768
PROBES = 7
FILTER = "block INT, bits BINARY"


def _places(columns, blocks):
    """(block, bit places) of a key, nulls included."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    block = F.pmod(F.xxhash64(F.lit("block"), *parts), F.lit(blocks)).cast("int")
    places = F.array(*[F.pmod(F.xxhash64(F.lit(i), *parts), F.lit(BLOCK_BITS)) for i in range(PROBES)])
    return block, places


def build_filter(rows, columns, blocks, by=()):
    """(by..., block, bits) of the keys in ``columns``; combined before the shuffle."""
    block, places = _places(columns, blocks)
    spread = rows.select(*by, block.alias("block"), F.explode(places).alias("place"))
    return spread.groupBy(*by, "block").agg(F.bitmap_construct_agg("place").alias("bits"))


def merge_filters(filters, by=()):
    """One filter per group of filters with the same number of blocks."""
    return filters.groupBy(*by, "block").agg(F.bitmap_or_agg("bits").alias("bits"))


def might_contain(rows, columns, filters, blocks):
    """Pairs of the rows and the filters' other columns where the filter may hold the row's key.

    Each row meets the one block of a filter that its key belongs to.
    """
    block, places = _places(columns, blocks)
    # byte p / 8 of the bitmap, its bit p % 8 from the right
    byte = lambda p: F.conv(F.hex(F.substr("bits", (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    bit = lambda p: F.pow(F.lit(2), p % 8).cast("int")
    found = F.forall("_places", lambda p: byte(p).cast("int").bitwiseAND(bit(p)) != 0)
    keyed = rows.withColumns({"block": block, "_places": places})
    return keyed.join(filters, "block").where(found).drop("block", "_places", "bits")
