"""Native Column expressions; nothing here starts a Python worker."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value) -> Column:
    """A column from a column or a column name."""
    return value if isinstance(value, Column) else F.col(value)


def non_empty(value) -> Column:
    """The value, or null when it is the empty string."""
    return F.nullif(as_col(value), F.lit(""))


def first_non_empty(*values) -> Column:
    return F.coalesce(*[non_empty(v) for v in values])


def shown(value) -> Column:
    """Text as string formatting shows it: a null reads ``null``."""
    return F.coalesce(as_col(value), F.lit("null"))
