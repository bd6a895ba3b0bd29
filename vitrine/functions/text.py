"""Catalogue text cleaning, slugs, keys."""

from pyspark.sql import functions as F

from . import as_col

# Size words removed from product names.
SIZE_WORDS = [
    "2x", "3x", "4x", "XxxSmall", "XxSmall", "XSmall", "Small", "XxxLarge", "XxLarge",
    "XLarge", "Large", "Medium", "XXS", "XS", "S", "M", "L", "XL", "XXL", "XXXL",
]

CONTROL_AND_SPACE = "".join(chr(i) for i in range(33))
UNICODE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(i) for i in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
UNICODE_SPACE_RUN = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
)


def trim_controls(c):
    """Trim every character up to and including the space."""
    return F.trim(as_col(c), F.lit(CONTROL_AND_SPACE))


def trim_unicode(c):
    """Trim every Unicode white space character."""
    return F.trim(as_col(c), F.lit(UNICODE_SPACE))


def clean_string(c):
    """Lower case, keep letters, digits and spaces, trim."""
    return F.trim(F.regexp_replace(F.lower(as_col(c)), "[^a-zA-Z0-9 ]", ""))


def remove_size_patterns(c):
    """Delete size words (any case, whole words), collapse the gaps they leave."""
    pattern = r"(?i)\b(" + "|".join(SIZE_WORDS) + r")\b"
    without = F.regexp_replace(as_col(c), pattern, "")
    return trim_controls(F.regexp_replace(without, r"\s{2,}", " "))


def slug(program, name):
    """Cleaned ``program name`` joined by dashes; size words stay in."""
    joined = F.concat(as_col(program), F.lit(" "), as_col(name))
    return F.regexp_replace(clean_string(joined), r"\s+", "-")


def name_uuid(c):
    """Name-based UUID, version 3: the MD5 of the text with version and variant bits set."""
    h = F.md5(F.encode(as_col(c), "UTF-8"))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def image_token(url):
    """URL-safe base64 with padding, on one line."""
    encoded = F.base64(F.encode(as_col(url), "UTF-8"))
    return F.translate(encoded, "+/\r\n", "-_")


def store_name(program):
    """Text before the first dot, lower case."""
    return F.substring_index(F.lower(as_col(program)), ".", 1)


def brand(manufacturer, program):
    """Cleaned manufacturer, or programme when the manufacturer is empty."""
    m = as_col(manufacturer)
    return clean_string(F.when(m == "", as_col(program)).otherwise(m))


def availability(in_stock):
    return F.when(F.lower(as_col(in_stock)) == "yes", "on sale").otherwise("out of stock")


def shipping_price(c):
    """Stays text; missing reads ``0.0``."""
    return F.coalesce(F.nullif(as_col(c), F.lit("")), F.lit("0.0"))


def price_of(c):
    """Price text as a double; null when it does not parse."""
    return as_col(c).try_cast("double")


def cashback_amount(rate, price):
    return as_col(rate) * price_of(price)


def lower_color(c):
    return F.lower(as_col(c))


def simple_slug(c):
    """Lower case with dashes for spaces; other characters stay."""
    return F.replace(F.lower(as_col(c)), F.lit(" "), F.lit("-"))


def first_alnum(c):
    """First run of letters, digits or underscores, else the input."""
    c = as_col(c)
    return F.coalesce(F.nullif(F.regexp_extract(c, "[a-zA-Z0-9_]+", 0), F.lit("")), c)


def months_from(day, months):
    """(start, end) as ``yyyy-MM-dd``, ``months`` after the day, or before it when negative."""
    day = as_col(day).cast("date")
    other = F.add_months(day, months)
    start, end = (day, other) if months >= 0 else (other, day)
    return F.struct(
        F.date_format(start, "yyyy-MM-dd").alias("start"),
        F.date_format(end, "yyyy-MM-dd").alias("end"),
    )


def deal_timestamp(c):
    """Coupon date; null, empty, zero or unreadable dates become the far future."""
    c = as_col(c)
    readable = F.when(~c.contains("0000-00-00"), c)
    return F.coalesce(
        F.try_to_timestamp(readable, F.lit("yyyy-MM-dd HH:mm:ss")),
        F.lit("2300-01-01 00:00:00").cast("timestamp"),
    )
