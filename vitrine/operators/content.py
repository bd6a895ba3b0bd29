"""Content planning per product and persona."""

from pyspark.sql import functions as F

from ..dims import personas, phrases, scene_pools, texts, voices
from ..dims.personas import DEFAULT_PERSONA
from ..dims.phrases import DEFAULT_VOICES
from ..functions import content as C
from ..functions.payload import parse_assets
from ..functions.picks import draw_key
from .grouping import spread_lookup

# Fixed value: scenes used per request.
SCENES_PER_REQUEST = 3
REQUEST = ["product_id", "model_id"]


def select_personas(persona_table, model_id=None):
    return persona_table.where(F.col("model_id") == (model_id or DEFAULT_PERSONA))


def _fixed(dimension, given):
    """Broadcast our own few-row tables; leave a given one to the optimizer."""
    return F.broadcast(dimension) if given is None else dimension


def scenes_for(requests, scene_table=None):
    """Adds ``pool``: scenes of (style, category), falling back on style, then category."""
    pools = scene_pools(requests.sparkSession, scene_table)
    own_styles = pools.select(F.col("style").alias("_own")).distinct()
    exact = pools.select(
        F.col("style").alias("_s1"), F.col("category").alias("_c1"), F.col("pool").alias("_p1")
    )
    default = pools.where(F.col("category") == texts.DEFAULT_CATEGORY).select(
        F.col("style").alias("_s2"), F.col("pool").alias("_p2")
    )
    source = F.coalesce("_own", F.lit(texts.DEFAULT_STYLE))
    return (
        requests.join(_fixed(own_styles, scene_table), F.col("style") == F.col("_own"), "left")
        .withColumn("_source", source)
        .join(
            _fixed(exact, scene_table),
            (F.col("_source") == F.col("_s1")) & (F.col("category") == F.col("_c1")),
            "left",
        )
        .join(_fixed(default, scene_table), F.col("_source") == F.col("_s2"), "left")
        .withColumn("pool", F.coalesce("_p1", "_p2"))
        .drop("_own", "_source", "_s1", "_c1", "_p1", "_s2", "_p2")
    )


def sample_scenes(requests, k=SCENES_PER_REQUEST, seed=0, key="product_id"):
    """Adds ``scenes``: ``k`` drawn scenes of a larger pool, in draw order, else the pool.

    The draw orders each request's own array, so no row moves.
    """
    draws = F.transform(
        "pool",
        lambda s, i: F.struct(
            draw_key(F.concat_ws("|", F.col(key).cast("string"), s["pos"].cast("string")), seed)
            .alias("draw"),
            i.alias("at"),
        ),
    )
    first = F.slice(F.sort_array(draws), 1, k)
    drawn = F.transform(first, lambda d: F.get(F.col("pool"), d["at"]))
    return requests.withColumn(
        "scenes", F.when(F.size("pool") > k, drawn).otherwise(F.col("pool"))
    )


def scene_index(requests):
    """One row per planned scene, numbered from 1.

    The outer form keeps Spark from testing the array's size first, which would draw
    the scenes twice more.
    """
    rest = [c for c in requests.columns if c not in ("pool", "scenes")]
    exploded = requests.select(*rest, F.posexplode_outer("scenes").alias("at", "s"))
    return exploded.where(F.col("at").isNotNull()).select(
        *rest,
        (F.col("at") + 1).alias("scene_no"),
        F.col("s.name").alias("scene_name"),
        F.col("s.duration").alias("duration"),
        F.col("s.motion_prompt").alias("motion_prompt"),
    )


def phrases_for(requests, phrase_table=None):
    """Adds hooks and problems of the style, else of the default style."""
    table = phrases(requests.sparkSession) if phrase_table is None else phrase_table
    own = table.select(
        F.col("style").alias("_s"), F.col("hooks").alias("_h"), F.col("problems").alias("_p")
    )
    default = table.where(F.col("style") == texts.DEFAULT_STYLE).select(
        F.struct("hooks", "problems").alias("d")
    )
    return (
        requests.join(_fixed(own, phrase_table), F.col("style") == F.col("_s"), "left")
        .withColumn("_d", default.scalar())
        .withColumn("hooks", F.coalesce("_h", "_d.hooks"))
        .withColumn("problems", F.coalesce("_p", "_d.problems"))
        .drop("_s", "_h", "_p", "_d")
    )


def voice_for(requests, voice_table=None, name="model_name"):
    """Adds the voice id of each vendor, with the vendor's default."""
    table = voices(requests.sparkSession) if voice_table is None else voice_table
    vendors = [c for c in table.columns if c != "name"]
    own = table.select(
        F.col("name").alias("_n"), *[F.col(v).alias(f"voice_{v}") for v in vendors]
    )
    joined = requests.join(_fixed(own, voice_table), F.col(name) == F.col("_n"), "left").drop("_n")
    for v in vendors:
        joined = joined.withColumn(
            f"voice_{v}", F.coalesce(f"voice_{v}", F.lit(DEFAULT_VOICES.get(v)))
        )
    return joined


def resume_state(requests, cache, inflight):
    """Adds cached image, storyboard and open task per scene of each (product, model).

    A storyboard is reused only if it has one image per planned scene. Of a scene's open
    tasks the newest counts, of equal times the greatest id; tasks without a scene or id
    are none that could be resumed.
    """
    newest = F.max("task_id")
    if "ts" in inflight.columns:
        newest = F.max(F.struct("ts", "task_id"))["task_id"]
    tasks = (
        inflight.where(F.col("scene").isNotNull() & F.col("task_id").isNotNull())
        .groupBy(*REQUEST, "scene")
        .agg(newest.alias("task_id"))
        .groupBy(*REQUEST)
        .agg(F.map_from_entries(F.collect_list(F.struct("scene", "task_id"))).alias("open_tasks"))
    )
    joined = requests.join(cache, REQUEST, "left").join(tasks, REQUEST, "left")
    return joined.withColumn(
        "storyboard_images",
        F.when(
            F.size("storyboard_images") == F.col("scene_count"), F.col("storyboard_images")
        ),
    )


def scene_status(results, planned):
    """Outcome per product and persona from its scenes' results."""
    done = results.groupBy(*REQUEST).agg(F.count_if("ok").alias("done"))
    joined = planned.join(done, REQUEST, "left").withColumn(
        "done", F.coalesce("done", F.lit(0).cast("bigint"))
    )
    return joined.withColumn(
        "status",
        F.when(F.col("done") < F.col("scene_count"), "partial")
        .when(F.col("done") == 0, "partial")
        .otherwise("success"),
    ).withColumn("error", F.when(F.col("done") == 0, "All video scenes failed"))


def run_status(outputs, run="run_id"):
    """A run fails when every output failed; runs without outputs are absent."""
    return outputs.groupBy(run).agg(
        F.bool_and(F.col("status") == "failed").alias("_all"),
        F.count(F.lit(1)).alias("outputs"),
    ).select(run, "outputs", F.when(F.col("_all"), "failed").otherwise("success").alias("status"))


def accept_until_mock(assets, run="run_id"):
    """Rows of each run before its first mock row, and whether the run is complete.

    The first mock position comes from a pre-aggregated minimum, so that a long run is
    never gathered in one task.
    """
    is_mock = F.lower("backend") == "mock"
    first_mock = assets.where(is_mock).groupBy(run).agg(F.min("pos").alias("_mock"))
    return (
        spread_lookup(assets, first_mock, [run], salts=1)
        .where(F.col("_mock").isNull() | (F.col("pos") < F.col("_mock")))
        .withColumn("created", F.col("_mock").isNull())
        .drop("_mock")
    )


def logged_assets(logs, run="run_id"):
    """Assets listed in generator logs that ended well, in listed order."""
    rest = [c for c in logs.columns if c not in ("log", "exit_code")]
    return (
        logs.where(F.col("exit_code") == 0)
        .select(*rest, F.posexplode_outer(parse_assets("log")).alias("pos", "a"))
        .where(F.col("pos").isNotNull())
        .select(*rest, "pos", "a.*")
    )


def asset_to_video(assets, created_at):
    """Video rows of accepted assets; product fields come with the asset's run."""
    return assets.select(
        F.col("final_video_url").alias("url"),
        "affiliate_link",
        "model_name",
        F.col("product_name").alias("item_name"),
        "script",
        F.col("vton_image").alias("vton_image_url"),
        F.lit(created_at).cast("timestamp").alias("created_at"),
        "product_id",
    )


def cache_rows(outputs):
    """Outputs worth caching: image, storyboard, and at least partly done."""
    return outputs.where(
        (F.col("vton_image") != "")
        & (F.size("storyboard_images") > 0)
        & F.col("status").isin("success", "partial")
    ).select(*REQUEST, "vton_image", "storyboard_images")


def plan_requests(products, model_id=None, persona_table=None):
    """Products with their persona's fields and detected category."""
    table = personas(products.sparkSession) if persona_table is None else persona_table
    chosen = select_personas(table, model_id).select(F.struct(*table.columns).alias("p"))
    return products.withColumn("persona", chosen.scalar()).select(
        *products.columns,
        "persona",
        F.col("persona.model_id").alias("model_id"),
        F.col("persona.name").alias("model_name"),
        F.col("persona.style_direction").alias("style"),
        C.product_category("product_name", "product_description").alias("category"),
    )
