"""Repeatable choices in place of unseeded random ones.

MD5 of (seed, key) gives the same draw on every retry and in any engine.
"""

from pyspark.sql import functions as F

from . import as_col


def draw_key(key, seed, slot=""):
    """Hex text that orders rows at random, but always the same way."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(slot), as_col(key).cast("string")))


def draw_index(key, seed, slot, size):
    """0-based index below ``size``."""
    head = F.conv(F.substring(draw_key(key, seed, slot), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, as_col(size) if not isinstance(size, int) else F.lit(size)).cast("int")


def draw_from(options, key, seed, slot=""):
    """One element of an array column."""
    return F.get(options, draw_index(key, seed, slot, F.size(options)))
