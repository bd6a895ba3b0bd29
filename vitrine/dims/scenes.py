"""Scene library of our own: what the camera does, times what the garment does.

A style orders the shots, a category says how its garments move. Shoes and accessories
have no scenes in any style. Tables of another library can be passed in.
"""

from pyspark.sql import functions as F

SCENE_SCHEMA = (
    "style STRING, category STRING, pos INT, name STRING, duration INT, motion_prompt STRING"
)

# Fixed value: the street style opens tops with this shot.
OPENING = "Detail"

# Shot -> (seconds, what is seen). {garment} and {motion} come from the category.
SHOTS = {
    OPENING: (2, "the weave and seams of the {garment} fill the frame"),
    "Arrival": (3, "the model steps into the picture, the {garment} seen whole"),
    "Motion": (4, "{motion}"),
    "Stillness": (3, "the model waits, light moving slowly over the {garment}"),
    "Departure": (2, "the model leaves, the back of the {garment} last"),
    "Layering": (4, "a second piece goes on over the {garment} and off again"),
    "Daylight": (3, "the {garment} held up to a window, then worn"),
    "Question": (3, "the model talks to the viewer and points at the {garment}"),
}

# Style -> (garment words by category, surroundings, shots in order)
STYLES = {
    "streetwear": (
        {"tops": "graphic tee"},
        "outdoors after rain",
        [OPENING, "Motion", "Arrival", "Departure"],
    ),
    "editorial": (
        {"tops": "silk blouse"},
        "on a plain coloured ground",
        ["Stillness", "Motion", OPENING, "Departure"],
    ),
    "casual": (
        {"tops": "casual tee"},
        "in a garden",
        ["Arrival", "Daylight", "Motion", "Stillness"],
    ),
    "curvy-chic": (
        {"tops": "silk shirt"},
        "in a hotel hall",
        ["Arrival", "Motion", "Layering", OPENING],
    ),
    "authentic_ugc": (
        {"tops": "casual tee"},
        "filmed by the model",
        ["Question", "Daylight", "Arrival", "Motion", OPENING, "Layering", "Departure"],
    ),
}

# Category -> (garment word unless the style has its own, how such garments move, own shots
# of the self-filmed style)
CATEGORIES = {
    "dress": ("dress", "one slow turn, the hem flowing in wind", [("Stairs", 4), ("Pockets", 2)]),
    "outerwear": ("coat", "collar up, hands into the pockets", [("Buttons", 2), ("Lining", 3)]),
    "pants": ("trousers", "three steps past a low camera, the legs swaying naturally",
              [("Kneeling", 3), ("Waistband", 2)]),
    "tops": ("top", "arms up and down again, the cloth swaying naturally",
             [("Tucked", 3), ("Sleeves", 2)]),
}
SELF_FILMED = "authentic_ugc"


def scene_rows():
    rows = []
    for style, (words, place, order) in STYLES.items():
        for category, (word, motion, own) in CATEGORIES.items():
            garment = words.get(category, word)
            shots = [(n, *SHOTS[n]) for n in order]
            if style == SELF_FILMED:
                shots += [(n, s, n.lower() + " of the {garment}, close by") for n, s in own]
            for pos, (name, seconds, seen) in enumerate(shots):
                text = seen.format(garment=garment, motion=motion)
                rows.append((style, category, pos, name, seconds, f"{text}, {place}"))
    return rows


def scenes(spark):
    return spark.createDataFrame(scene_rows(), SCENE_SCHEMA)


def scene_pools(spark, scene_table=None):
    """One row per (style, category) with its scenes in order."""
    if scene_table is None:
        pools = {}
        for style, category, *scene in scene_rows():
            pools.setdefault((style, category), []).append(tuple(scene))
        rows = [(style, category, pool) for (style, category), pool in pools.items()]
        return spark.createDataFrame(
            rows,
            "style STRING, category STRING, "
            "pool ARRAY<STRUCT<pos: INT, name: STRING, duration: INT, motion_prompt: STRING>>",
        )
    scene = F.struct("pos", "name", "duration", "motion_prompt")
    return scene_table.groupBy("style", "category").agg(
        F.sort_array(F.collect_list(scene)).alias("pool")
    )
