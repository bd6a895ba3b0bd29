"""Personas. Ids, names and styles are fixed values; all else is a neutral default of our own.

Tables with described people can be passed in.
"""

PERSONA_SCHEMA = (
    "model_id STRING, name STRING, style_direction STRING, demographics MAP<STRING, STRING>, "
    "appearance MAP<STRING, STRING>, photography MAP<STRING, STRING>, pose STRING, "
    "environment STRING, mood STRING"
)

# Fixed value: the persona used when none is asked for.
DEFAULT_PERSONA = "model_3"

# Id, name and style of each persona.
NAMES = [
    ("model_1", "Aria", "editorial"),
    ("model_2", "Luna", "streetwear"),
    ("model_3", "Nova", "authentic_ugc"),
    ("model_4", "Sasha", "curvy-chic"),
]

NEUTRAL = (
    {"age": "adult"},
    {"look": "natural"},
    {"frame": "whole figure", "light": "daylight"},
    "standing at ease",
    "plain background",
    "friendly",
)

PERSONAS = [(*name, *NEUTRAL) for name in NAMES]


def personas(spark):
    return spark.createDataFrame(PERSONAS, PERSONA_SCHEMA)
