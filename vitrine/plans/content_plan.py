"""Products to planned scenes and scripts."""

from ..functions import content as C
from ..operators.content import (
    phrases_for,
    plan_requests,
    sample_scenes,
    scene_index,
    scenes_for,
    voice_for,
)


def planned_scenes(products, model_id=None, seed=0):
    """One row per product and scene, motion text adapted to the product."""
    requests = sample_scenes(scenes_for(plan_requests(products, model_id)), seed=seed)
    scenes = scene_index(requests.drop("persona"))
    return scenes.withColumn(
        "motion_prompt",
        C.rewrite_motion("motion_prompt", "product_name", "product_description"),
    )


def planned_scripts(products, model_id=None, seed=0):
    """One row per product with its script and voices."""
    requests = voice_for(phrases_for(plan_requests(products, model_id).drop("persona")))
    return requests.withColumn(
        "script", C.video_script("product_name", "hooks", "problems", "product_id", seed)
    ).drop("hooks", "problems")
