"""Words, row keys and written intermediates shared by the operators of this package."""

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from ..session import run_dir

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    """Words between runs of ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def lower_ascii(text):
    """The text, "" for null, with A-Z and no other letter lower-cased."""
    value = F.coalesce(text, F.lit(""))
    plain = F.octet_length(value) == F.char_length(value)
    return F.when(plain, F.lower(value)).otherwise(F.translate(value, ascii_uppercase, ascii_lowercase))


def text_key(text):
    """64-bit hash that, next to the id, tells rows with the same id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def stage(df, name):
    """Write a frame below the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than the step that reads the table.
    """
    path = run_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs, names):
    """The named columns as one struct ``_row``, so that none can clash on the way."""
    return F.struct(*[docs[c] for c in names]).alias("_row")


def same(left, right, names):
    """Null-safe equality of two frames in the named columns."""
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(right[name])
    return condition
