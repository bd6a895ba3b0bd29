"""Interaction weights and scores."""

from pyspark.sql import functions as F

from . import as_col

# Score per interaction type for popularity (CHECKOUT has none).
POPULARITY_SCORES = {
    "CLICK": 1.0,
    "VIEW": 0.8,
    "WISH": 0.7,
    "UNWISH": 0.2,
    "WARDROBE": 0.7,
    "UNWARDROBE": 0.2,
    "SHARED": 0.9,
}

# Rating per interaction type for recommendations.
RATINGS = {
    "CLICK": 5.0,
    "VIEW": 3.0,
    "WISH": 5.0,
    "UNWISH": 1.0,
    "WARDROBE": 5.0,
    "UNWARDROBE": 1.0,
    "CHECKOUT": 5.0,
    "SHARED": 2.0,
}

# Fixed values: (upper age bound in hours, weight), youngest first, and the weight beyond.
AGE_WEIGHTS = [(1, 1.0), (24, 0.8), (7 * 24, 0.5), (30 * 24, 0.2)]
OLDEST_WEIGHT = 0.1


def lookup(c, table, default=0.0):
    """Value of a short table as a ``when`` chain, else the default."""
    c = as_col(c)
    chain = F
    for key, value in table.items():
        chain = chain.when(c == key, F.lit(value))
    return chain.otherwise(F.lit(default))


def interaction_age_hours(created_at, as_of):
    """Whole seconds between the two instants, in hours."""
    seconds = F.unix_timestamp(as_col(as_of)) - F.unix_timestamp(as_col(created_at))
    return seconds / F.lit(3600)


def age_weight(age):
    """Weight falling with age; an unknown age weighs least, a future one most."""
    age = as_col(age)
    chain = F
    for bound, weight in AGE_WEIGHTS:
        chain = chain.when(age < bound, F.lit(weight))
    return chain.otherwise(F.lit(OLDEST_WEIGHT))


def type_score(interaction_type, score_map=None):
    return lookup(interaction_type, score_map or POPULARITY_SCORES)


def type_rating(interaction_type, rating_map=None):
    return lookup(interaction_type, rating_map or RATINGS)
