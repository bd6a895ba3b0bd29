"""Content planning, generator results, outcome states."""

from pyspark.sql import functions as F

from vitrine.dims import personas, texts
from vitrine.dims.phrases import DEFAULT_VOICES, VOICES
from vitrine.dims.scenes import scene_rows
from vitrine.functions import content as C
from vitrine.functions import payload, urls
from vitrine.operators import content as P
from vitrine.operators.grouping import spread_rows
from vitrine.operators.upsert import read_current
from vitrine.plans import content_plan
from vitrine.session import run_dir
from vitrine.sources.files import scan_asset_cache
from vitrine.sources.sinks import write_asset_cache

from .base import check, quoted, sql_draw, sql_list

CREATED = "2024-01-31 00:00:00"
DEFAULT_BGM = "https://music.example.com/default.mp3"


def sql_any(text, words):
    return "(" + " OR ".join(f"contains({text}, {quoted(w)})" for w in words) + ")"


def sql_category(name, description):
    text = f"lower(concat({name}, ' ', {description}))"
    cases = " ".join(
        f"WHEN {sql_any(text, words)} THEN '{category}'"
        for category, words in texts.CATEGORY_WORDS.items()
    )
    return f"CASE {cases} ELSE 'tops' END"


def sql_motion(prompt, name, description):
    text = prompt
    for generic in texts.GENERIC_GARMENTS:
        text = f"replace({text}, {quoted(generic)}, {name})"
    text = f"replace({text}, 'silk', 'fabric')"
    calm = text
    for old, new in texts.FITTED_MOTION:
        calm = f"replace({calm}, {quoted(old)}, {quoted(new)})"
    fitted = (
        f"{sql_any(f'lower({name})', texts.FITTED_WORDS)} OR "
        f"{sql_any(f'lower({description})', texts.FITTED_WORDS)}"
    )
    return f"CASE WHEN {fitted} THEN {calm} ELSE {text} END"


SCENES = "scenes(style, category, pos, name, duration, motion_prompt) AS (VALUES " + ", ".join(
    f"({quoted(s)}, {quoted(c)}, {p}, {quoted(n)}, {d}, {quoted(m)})"
    for s, c, p, n, d, m in scene_rows()
) + ")"
SOURCE = "CASE WHEN {style} IN (SELECT style FROM scenes) THEN {style} ELSE 'casual' END"


def sql_pool(plans):
    """Rows of ``plans`` joined to their scenes, both fallbacks applied."""
    return f"""
    sourced AS (SELECT *, {SOURCE.format(style="style")} AS src FROM {plans}),
    resolved AS (SELECT *, CASE WHEN category IN (SELECT category FROM scenes) THEN category
                   ELSE 'tops' END AS cat FROM sourced),
    pooled AS (SELECT r.*, s.pos, s.name, s.duration AS seconds, s.motion_prompt,
                 count(*) OVER (PARTITION BY r.product_id) AS pool_size
               FROM resolved r JOIN scenes s ON r.src = s.style AND r.cat = s.category),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY
                CASE WHEN pool_size > 3 THEN
                  md5(concat_ws('|', '0', '', concat_ws('|', CAST(product_id AS VARCHAR),
                                                        CAST(pos AS VARCHAR))))
                ELSE CAST(pos AS VARCHAR) END) AS scene_no FROM pooled)"""


CATEGORISED = (
    f"categorised AS (SELECT *, {sql_category('product_name', 'product_description')} AS category "
    "FROM plans)"
)


def categorised(t):
    return t.plans.withColumn(
        "category", C.product_category("product_name", "product_description")
    )


@check(
    "product_category",
    f"WITH {CATEGORISED} SELECT product_id, category FROM categorised",
    "plans",
)
def product_category(t):
    return categorised(t).select("product_id", "category")


@check(
    "product_category_documents",
    f"SELECT doc_id, {sql_category('source', 'text')} AS category FROM documents",
)
def product_category_documents(t):
    rows = spread_rows(t.documents, t.cores)
    return rows.select("doc_id", C.product_category("source", "text").alias("category"))


@check(
    "scenes_for",
    f"""WITH {CATEGORISED}, {SCENES}, {sql_pool("categorised")}
    SELECT product_id, pos, name, seconds AS duration FROM pooled""",
    "plans",
)
def scenes_for(t):
    rows = P.scenes_for(categorised(t)).select("product_id", F.explode("pool").alias("s"))
    return rows.select("product_id", "s.pos", "s.name", "s.duration")


@check(
    "sample_scenes",
    f"""WITH {CATEGORISED}, {SCENES}, {sql_pool("categorised")}
    SELECT product_id, CAST(scene_no AS INTEGER) AS scene_no, name AS scene_name,
      seconds AS duration FROM drawn
    WHERE scene_no <= 3""",
    "plans",
)
def sample_scenes(t):
    rows = P.scene_index(P.sample_scenes(P.scenes_for(categorised(t))).drop("duration"))
    return rows.select("product_id", "scene_no", "scene_name", "duration")


@check(
    "planned_scenes",
    f"""WITH styled AS (SELECT product_id, product_name, product_description,
        'authentic_ugc' AS style FROM plans),
      {CATEGORISED.replace("FROM plans", "FROM styled")}, {SCENES}, {sql_pool("categorised")}
    SELECT product_id, CAST(scene_no AS INTEGER) AS scene_no, name AS scene_name,
      'Nova' AS model_name,
      {sql_motion("motion_prompt", "product_name", "product_description")} AS motion_prompt
    FROM drawn WHERE scene_no <= 3""",
    "plans",
)
def planned_scenes(t):
    products = t.plans.select("product_id", "product_name", "product_description")
    return content_plan.planned_scenes(products).select(
        "product_id", "scene_no", "scene_name", "model_name", "motion_prompt"
    )


def sql_by_style(lists):
    cases = " ".join(f"WHEN '{s}' THEN {sql_list(v)}" for s, v in lists.items())
    return f"CASE style {cases} ELSE {sql_list(lists['casual'])} END"


SCRIPT = (
    f"concat_ws(' ', replace(({sql_by_style(texts.HOOKS)})[{sql_draw(3, 'product_id', 'hook')} + 1]"
    f", '{{name}}', product_name), "
    f"({sql_by_style(texts.PROBLEMS)})[{sql_draw(3, 'product_id', 'problem')} + 1], "
    f"({sql_list(texts.CALLS)})[{sql_draw(3, 'product_id', 'call')} + 1])"
)


@check("video_script", f"SELECT product_id, {SCRIPT} AS script FROM plans", "plans")
def video_script(t):
    rows = P.phrases_for(t.plans)
    script = C.video_script("product_name", "hooks", "problems", "product_id")
    return rows.select("product_id", script.alias("script"))


@check(
    "phrases_for",
    f"SELECT product_id, array_to_string({sql_by_style(texts.HOOKS)}, '|') AS hooks, "
    f"array_to_string({sql_by_style(texts.PROBLEMS)}, '|') AS problems FROM plans",
    "plans",
)
def phrases_for(t):
    return P.phrases_for(t.plans).select(
        "product_id",
        F.array_join("hooks", "|").alias("hooks"),
        F.array_join("problems", "|").alias("problems"),
    )


def sql_voice(vendor):
    cases = " ".join(f"WHEN '{n}' THEN '{v}'" for n, v in VOICES[vendor].items())
    return f"CASE model_name {cases} ELSE '{DEFAULT_VOICES[vendor]}' END AS voice_{vendor}"


@check(
    "voice_for",
    f"SELECT product_id, {sql_voice('elevenlabs')}, {sql_voice('edge')} FROM plans",
    "plans",
)
def voice_for(t):
    return P.voice_for(t.plans).select("product_id", "voice_elevenlabs", "voice_edge")


@check(
    "planned_scripts",
    f"""SELECT product_id, {SCRIPT} AS script, '{VOICES["edge"]["Luna"]}' AS voice_edge,
      {sql_category("product_name", "product_description")} AS category
    FROM (SELECT product_id, product_name, product_description, 'streetwear' AS style
          FROM plans)""",
    "plans",
)
def planned_scripts(t):
    products = t.plans.select("product_id", "product_name", "product_description")
    return content_plan.planned_scripts(products, model_id="model_2").select(
        "product_id", "script", "voice_edge", "category"
    )


@check(
    "rewrite_motion",
    f"SELECT product_id, {sql_motion('motion', 'product_name', 'product_description')} AS motion "
    "FROM (SELECT *, concat('silk shirt and graphic tee in ', style, ', silk flowing in wind, ',"
    " 'swaying naturally') AS motion FROM plans)",
    "plans",
)
def rewrite_motion(t):
    motion = F.concat(
        F.lit("silk shirt and graphic tee in "), "style",
        F.lit(", silk flowing in wind, swaying naturally"),
    )
    return t.plans.select(
        "product_id",
        C.rewrite_motion(motion, "product_name", "product_description").alias("motion"),
    )


def sql_fill(template, fields):
    out = quoted(template)
    for key, expression in fields.items():
        out = f"replace({out}, {quoted('{' + key + '}')}, {expression})"
    return out


@check(
    "keyframe_prompt",
    f"SELECT product_id, {sql_fill(texts.KEYFRAME, {'motion': 'product_name'})} AS prompt "
    "FROM plans",
    "plans",
)
def keyframe_prompt(t):
    return t.plans.select("product_id", C.keyframe_prompt("product_name").alias("prompt"))


def _persona_fields(persona):
    _, name, style, demographics, appearance, photography, pose, environment, mood = persona
    fields = {"pose": pose, "environment": environment, "mood": mood, "style_direction": style}
    groups = {
        "demographics": demographics, "appearance": appearance, "photography": photography
    }
    for group, values in groups.items():
        fields |= {f"{group}.{k}": v for k, v in values.items()}
    return {k: quoted(v) for k, v in fields.items()}


PROMPT = sql_fill(
    texts.PERSONA_PROMPT,
    {
        **_persona_fields(P.personas.__globals__["PERSONAS"][2]),
        "name": "product_name",
        "description": "product_description",
    },
)


@check("persona_prompt", f"SELECT product_id, {PROMPT} AS prompt FROM plans", "plans")
def persona_prompt(t):
    rows = P.plan_requests(t.plans.drop("style", "model_name"))
    prompt = C.persona_prompt("product_name", "product_description", persona="persona")
    return rows.select("product_id", prompt.alias("prompt"))


@check(
    "select_personas",
    "SELECT product_id, 'model_3' AS model_id, 'Nova' AS model_name, 'authentic_ugc' AS style "
    "FROM plans",
    "plans",
)
def select_personas(t):
    rows = P.plan_requests(t.plans.drop("style", "model_name"), persona_table=personas(t.spark))
    return rows.select("product_id", "model_id", "model_name", "style")


SHORT = " UNION ALL ".join(
    f"SELECT {i + 1} AS panel, '{s}' AS seconds, {quoted(b)} AS beat"
    for i, (s, b) in enumerate(texts.SHORT_PANELS)
)


@check(
    "storyboard_panels",
    f"""
    SELECT product_id, panel,
      CASE WHEN plans.duration <= 5 THEN seconds ELSE '1.0s' END AS duration,
      CASE WHEN plans.duration <= 5
        THEN replace(replace(beat, '{{name}}', product_name), '{{model}}', model_name)
        ELSE concat('Panel ', panel, ' action beat') END AS beat
    FROM plans CROSS JOIN ({SHORT})""",
    "plans",
)
def storyboard_panels(t):
    panels = C.storyboard_panels("product_name", "model_name", "duration")
    return t.plans.select("product_id", F.explode(panels).alias("p")).select("product_id", "p.*")


@check(
    "clip_duration",
    "SELECT product_id, CASE WHEN duration <= 5 THEN '5' WHEN duration <= 8 THEN '8' ELSE '10' END "
    "AS clip FROM plans",
    "plans",
)
def clip_duration(t):
    return t.plans.select("product_id", C.clip_duration("duration").alias("clip"))


@check(
    "tag_prompts",
    f"""SELECT product_id, {sql_fill(texts.TAG_SYSTEM, {"categories": "style"})} AS system,
      {sql_fill(texts.TAG_REQUEST, {"text": "product_name"})} AS extract,
      {sql_fill(texts.REWRITE_REQUEST, {"text": "product_name"})} AS rewrite FROM plans""",
    "plans",
)
def tag_prompts(t):
    return t.plans.select("product_id", C.tag_prompts("product_name", "style").alias("p")).select(
        "product_id", "p.*"
    )


def results(t):
    """Provider results in all shapes, as JSON text."""
    n = F.col("id")
    url = F.concat(F.lit("https://r/"), n.cast("string"))

    def js(*fields):
        return F.to_json(F.struct(*fields))

    inner = F.struct(
        F.when(n % 2 == 0, url).otherwise("").alias("image_url"),
        F.when(n % 3 == 0, url).alias("video_url"),
        F.concat(url, F.lit("/u")).alias("url"),
    )
    result = (
        F.when(n % 5 == 0, js(F.col("id").alias("id"), inner.alias("output")))
        .when(n % 5 == 1, js(url.alias("output"), F.lit("").alias("id"), url.alias("prediction_id")))
        .when(n % 5 == 2, js(F.struct(url.alias("url")).alias("video"), F.lit("x").alias("output")))
        .when(n % 5 == 3, js(F.array(F.struct(url.alias("url"))).alias("images"),
                             url.alias("predictionID")))
        .otherwise(js(F.array(url).alias("images")))
    )
    return t.products.select("id", result.alias("result"))


@check(
    "result_url",
    """
    WITH r AS (SELECT id, concat('https://r/', id) AS u, id % 5 AS k FROM products)
    SELECT id,
      CASE k WHEN 0 THEN CASE WHEN id % 2 = 0 THEN u ELSE u || '/u' END WHEN 1 THEN u
             WHEN 2 THEN 'x' ELSE '' END AS image,
      CASE k WHEN 0 THEN CASE WHEN id % 3 = 0 THEN u ELSE u || '/u' END WHEN 1 THEN u
             WHEN 2 THEN 'x' ELSE '' END AS video,
      CASE k WHEN 3 THEN u ELSE '' END AS soft_image,
      CASE k WHEN 0 THEN CASE WHEN id % 3 = 0 THEN u ELSE u || '/u' END ELSE u END AS scene_video
    FROM r""",
    "products",
)
def result_url(t):
    kinds = ["image", "video", "soft_image", "scene_video"]
    return results(t).select("id", *[payload.result_url("result", k).alias(k) for k in kinds])


@check(
    "task_id",
    """
    SELECT id, CASE id % 5 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN concat('https://r/', id)
      WHEN 3 THEN concat('https://r/', id) ELSE 'none' END AS task FROM products""",
    "products",
)
def task_id(t):
    return results(t).select("id", F.coalesce(payload.task_id("result"), F.lit("none")).alias("task"))


@check(
    "audio_filename",
    f"""
    SELECT id, CASE id % 5 WHEN 0 THEN 'background_music.mp3' WHEN 1 THEN 'none'
      WHEN 2 THEN concat('bgm_', md5(concat('https://m.example.com?', id)), '.mp3')
      WHEN 3 THEN concat('bgm_song', id, '.mp3')
      ELSE concat('bgm_t', id) END AS file FROM products""",
    "products",
)
def audio_filename(t):
    n = F.col("id").cast("string")
    url = (
        F.when(F.col("id") % 5 == 0, DEFAULT_BGM)
        .when(F.col("id") % 5 == 1, "")
        .when(F.col("id") % 5 == 2, F.concat(F.lit("https://m.example.com?"), n))
        .when(F.col("id") % 5 == 3, F.concat(F.lit("https://m.example.com/a/song"), n,
                                             F.lit(".mp3;v=1?x=/y#z")))
        .otherwise(F.concat(F.lit("https://m.example.com/a b/t"), n, F.lit("//")))
    )
    name = urls.audio_filename(url, DEFAULT_BGM)
    return t.products.select("id", F.coalesce(name, F.lit("none")).alias("file"))


@check(
    "backend_choice",
    """
    SELECT id, coalesce(CASE WHEN id % 4 = 0 THEN NULL
      ELSE concat(CASE WHEN id % 2 = 1 THEN 'eachlabs' ELSE 'higgsfield' END, '+',
                  CASE WHEN id % 4 >= 2 THEN 'higgsfield' ELSE 'eachlabs' END) END, 'none') AS label
    FROM products""",
    "products",
)
def backend_choice(t):
    chosen = payload.backend_choice(F.col("id") % 2 == 1, F.col("id") % 4 >= 2)
    return t.products.select("id", F.coalesce(chosen["label"], F.lit("none")).alias("label"))


def asset_logs(t):
    """Generator output of every run: noise around the list, some without, some failed."""
    listed = t.assets.groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "pos", "backend", "final_video_url", "model_name", "script", "vton_image"
                )
            )
        ).alias("rows")
    )
    text = F.to_json(
        F.transform(
            "rows",
            lambda r: F.struct(
                *[r[c].alias(c) for c in
                  ["backend", "final_video_url", "model_name", "script", "vton_image"]]
            ),
        )
    )
    log = F.when(F.col("run_id") % 7 == 0, F.lit("[info] nothing made")).otherwise(
        F.concat(F.lit("[info] start\n"), text, F.lit("\ndone"))
    )
    return listed.select(
        "run_id",
        (F.col("run_id") % 11 == 0).cast("int").alias("exit_code"),
        F.concat(F.lit("item "), F.col("run_id").cast("string")).alias("product_name"),
        F.col("run_id").alias("product_id"),
        F.lit("https://b").alias("affiliate_link"),
        log.alias("log"),
    )


LISTED = """listed AS (
      SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY pos, backend, final_video_url,
        model_name, script, vton_image) - 1 AS spot FROM assets
      WHERE run_id % 7 <> 0 AND run_id % 11 <> 0),
    mocked AS (SELECT run_id, min(spot) AS mock FROM listed WHERE lower(backend) = 'mock' GROUP BY 1)"""


@check(
    "logged_assets",
    f"WITH {LISTED} SELECT run_id, CAST(spot AS INTEGER) AS pos, backend, final_video_url "
    "FROM listed",
    "assets",
)
def logged_assets(t):
    return P.logged_assets(asset_logs(t)).select("run_id", "pos", "backend", "final_video_url")


@check(
    "asset_to_video",
    f"""
    WITH {LISTED}
    SELECT final_video_url AS url, 'https://b' AS affiliate_link, model_name,
      concat('item ', l.run_id) AS item_name, script, vton_image AS vton_image_url,
      '{CREATED}' AS created_at, l.run_id AS product_id
    FROM listed l LEFT JOIN mocked m ON l.run_id = m.run_id WHERE mock IS NULL OR spot < mock""",
    "assets",
)
def asset_to_video(t):
    accepted = P.accept_until_mock(P.logged_assets(asset_logs(t)))
    rows = P.asset_to_video(accepted, CREATED)
    return rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@check(
    "accept_until_mock",
    """
    WITH m AS (SELECT run_id, min(pos) AS mock FROM assets WHERE lower(backend) = 'mock' GROUP BY 1)
    SELECT a.run_id, a.pos, a.final_video_url, mock IS NULL AS created
    FROM assets a LEFT JOIN m ON a.run_id = m.run_id WHERE mock IS NULL OR a.pos < mock""",
    "assets",
)
def accept_until_mock(t):
    return P.accept_until_mock(t.assets).select("run_id", "pos", "final_video_url", "created")


PLANNED = """planned AS (SELECT product_id, model_id, count(*) + min(length(scene)) % 2 AS scene_count
      FROM results GROUP BY 1, 2)"""


def planned(t):
    return t.results.groupBy("product_id", "model_id").agg(
        (F.count(F.lit(1)) + F.min(F.length("scene")) % 2).alias("scene_count")
    )


@check(
    "scene_status",
    f"""
    WITH {PLANNED}, d AS (SELECT product_id, model_id, count(*) FILTER (WHERE ok) AS done
                          FROM results WHERE scene <> 'scene_1' GROUP BY 1, 2)
    SELECT p.product_id, p.model_id, scene_count, coalesce(done, 0) AS done,
      CASE WHEN coalesce(done, 0) < scene_count THEN 'partial' ELSE 'success' END AS status,
      CASE WHEN coalesce(done, 0) = 0 THEN 'All video scenes failed' END AS error
    FROM planned p LEFT JOIN d ON p.product_id = d.product_id AND p.model_id = d.model_id""",
    "results",
)
def scene_status(t):
    return P.scene_status(t.results.where(F.col("scene") != "scene_1"), planned(t))


@check(
    "run_status",
    """
    SELECT run_id, count(*) AS outputs,
      CASE WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'success' END AS status
    FROM assets GROUP BY 1""",
    "assets",
)
def run_status(t):
    return P.run_status(t.assets)


def cached(t):
    """Cached storyboards: one image per product and persona with an odd product."""
    return (
        t.results.where(F.col("product_id").cast("bigint") % 2 == 1)
        .groupBy("product_id", "model_id")
        .agg(
            F.concat(F.lit("img"), F.min("scene")).alias("vton_image"),
            F.array_repeat(F.min("scene"), F.count_if("ok").cast("int")).alias("storyboard_images"),
        )
    )


@check(
    "resume_state",
    f"""
    WITH {PLANNED},
    cached AS (SELECT product_id, model_id, concat('img', min(scene)) AS vton_image,
                 count(*) FILTER (WHERE ok) AS images FROM results
               WHERE CAST(product_id AS BIGINT) % 2 = 1 GROUP BY 1, 2),
    tasks AS (SELECT product_id, model_id, count(DISTINCT scene) AS open_tasks FROM results
              WHERE NOT ok GROUP BY 1, 2)
    SELECT p.product_id, p.model_id, coalesce(vton_image, 'none') AS vton_image,
      CASE WHEN images = scene_count THEN images ELSE 0 END AS reused,
      coalesce(open_tasks, 0) AS open_tasks
    FROM planned p LEFT JOIN cached USING (product_id, model_id)
      LEFT JOIN tasks USING (product_id, model_id)""",
    "results",
)
def resume_state(t):
    inflight = t.results.where(~F.col("ok")).select(
        "product_id", "model_id", "scene", F.concat(F.lit("t"), "scene").alias("task_id")
    )
    rows = P.resume_state(planned(t), cached(t), inflight)
    return rows.select(
        "product_id",
        "model_id",
        F.coalesce("vton_image", F.lit("none")).alias("vton_image"),
        F.coalesce(F.size("storyboard_images"), F.lit(0)).cast("bigint").alias("reused"),
        F.coalesce(F.size("open_tasks"), F.lit(0)).cast("bigint").alias("open_tasks"),
    )


CACHED = """
    SELECT product_id, model_id, concat('img', min(scene)) AS vton_image,
      count(*) FILTER (WHERE ok) AS images FROM results
    WHERE CAST(product_id AS BIGINT) % 2 = 1 GROUP BY 1, 2 HAVING count(*) FILTER (WHERE ok) > 0"""


@check("write_asset_cache", CACHED, "results")
def store_cache(t):
    path = run_dir(t.spark, "cache")
    outputs = cached(t).withColumn("status", F.lit("partial"))
    failed = outputs.withColumns({"status": F.lit("failed"), "vton_image": F.lit("bad")})
    write_asset_cache(t.spark, outputs, path)
    write_asset_cache(t.spark, failed, path)
    return read_current(t.spark, path).select(
        "product_id", "model_id", "vton_image",
        F.size("storyboard_images").cast("bigint").alias("images"),
    )


@check(
    "scan_asset_cache",
    """
    SELECT concat('p', n_nationkey) AS product_id, 'model_1' AS model_id, n_name AS vton_image,
      2 AS images FROM nation WHERE n_nationkey % 5 <> 0""",
)
def read_cache(t):
    path = run_dir(t.spark, "cache")
    entry = F.struct(
        F.col("n_name").alias("vton_image"), F.array("n_name", "n_name").alias("storyboard_images")
    )
    text = F.when(F.col("n_nationkey") % 5 == 0, F.lit('{"model_1": {')).otherwise(
        F.to_json(F.create_map(F.lit("model_1"), entry))
    )
    rows = t.nation.select(F.concat(F.lit("p"), "n_nationkey").alias("name"), text.alias("text"))
    # a folder per product, named like the file
    named = rows.withColumn("entry", F.concat(F.lit("cache_"), "name", F.lit(".json")))
    named.select("entry", "text").write.partitionBy("entry").text(path)
    return scan_asset_cache(t.spark, path).select(
        "product_id", "model_id", "vton_image", F.size("storyboard_images").alias("images")
    )
