"""Content planning, literal cases."""

import pytest
from pyspark.sql import functions as F

from vitrine.dims import personas, phrases, scene_pools, texts
from vitrine.dims.scenes import SCENE_SCHEMA, scene_rows
from vitrine.functions import content as C
from vitrine.functions import payload, urls
from vitrine.operators import content as P


@pytest.mark.parametrize(
    "name, description, category",
    [
        ("Beautiful Evening Dress", "A long silk gown", "dress"),
        ("Leather Jacket", "Black biker outerwear", "outerwear"),
        ("Denim Jeans", "Slim fit trousers", "pants"),
        ("Running Shoes", "Athletic sneakers", "shoes"),
        ("Leather Handbag", "Stylish accessory belt", "accessories"),
        ("Graphic Tee", "100% cotton casual shirt", "tops"),
        ("short dress", "", "dress"),
        ("that one", None, "accessories"),
    ],
)
def test_category(one, name, description, category):
    assert one(C.product_category("n", "d"), n=name, d=description) == category


def test_scene_library_shape():
    rows = scene_rows()
    sizes = {}
    for style, category, *_ in rows:
        sizes[style, category] = sizes.get((style, category), 0) + 1
    assert {c for _, c in sizes} == {"dress", "outerwear", "pants", "tops"}
    assert all(n == (9 if s == "authentic_ugc" else 4) for (s, _), n in sizes.items())
    names = {}
    for style, category, _, name, *_ in rows:
        names.setdefault((style, category), []).append(name)
    own = [frozenset(names["authentic_ugc", c]) for c in ("dress", "outerwear", "pants", "tops")]
    assert len(set(own)) == 4 and all(len(set(n)) == len(n) for n in names.values())


def requests(spark, *rows):
    return spark.createDataFrame(rows, "product_id BIGINT, style STRING, category STRING")


def test_scenes_and_fallbacks(spark):
    wanted = requests(
        spark,
        (1, "streetwear", "tops"),
        (2, "streetwear", "shoes"),
        (3, "unknown", "dress"),
        (4, "unknown", "accessories"),
        (5, "authentic_ugc", "pants"),
    )
    rows = {r.product_id: r for r in P.sample_scenes(P.scenes_for(wanted)).collect()}
    assert rows[1].pool[0].name == "Detail"
    assert rows[2].pool == rows[1].pool
    pools = {(r.style, r.category): r.pool for r in scene_pools(spark).collect()}
    assert rows[3].pool == pools["casual", "dress"]
    assert rows[4].pool == pools["casual", "tops"]
    assert len(rows[5].pool) == 9 and len(rows[5].scenes) == 3
    assert len({s.name for s in rows[5].scenes}) == 3


def test_sampling_a_given_library(spark):
    four = [("mine", "tops", i, f"s{i}", 2, "x") for i in range(4)]
    table = spark.createDataFrame(four, SCENE_SCHEMA)
    base = spark.createDataFrame([("casual", "tops", 0, "c", 2, "y")], SCENE_SCHEMA)
    rows = P.scenes_for(requests(spark, (1, "mine", "shoes")), table.unionByName(base))
    again = [P.sample_scenes(rows, seed=3).first().scenes for _ in range(2)]
    assert len(again[0]) == 3 and again[0] == again[1]
    numbered = P.scene_index(P.sample_scenes(rows, seed=3)).orderBy("scene_no").collect()
    assert [r.scene_no for r in numbered] == [1, 2, 3]


def test_persona_prompt_names_the_product(spark):
    products = spark.createDataFrame(
        [(1, "Linen Shirt", "airy weave")],
        "product_id BIGINT, product_name STRING, product_description STRING",
    )
    for model_id in ("model_1", "model_2", "model_3", "model_4"):
        row = P.plan_requests(products, model_id).select(
            C.persona_prompt("product_name", "product_description", "persona").alias("p")
        ).first()
        assert "Linen Shirt" in row.p and "airy weave" in row.p and "{" not in row.p
    assert P.select_personas(personas(spark)).first().name == "Nova"


def test_script(spark):
    rows = P.phrases_for(
        spark.createDataFrame(
            [(i, "Bomber", s) for i in range(40) for s in ("streetwear", "authentic_ugc")],
            "product_id BIGINT, name STRING, style STRING",
        )
    )
    scripts = rows.select("style", C.video_script("name", "hooks", "problems", "product_id")
                          .alias("s")).collect()
    for row in scripts:
        assert any(word in row.s for word in ("FIT", "LINK", "STYLE"))
        assert "{name}" not in row.s
        if row.style == "streetwear":
            assert "Bomber" in row.s
        else:
            assert any(p in row.s for p in texts.PROBLEMS["casual"])
    assert len({r.s for r in scripts}) > 5
    assert phrases(spark).count() == 4


@pytest.mark.parametrize("duration", [5, 10])
def test_panels(one, duration):
    panels = one(C.storyboard_panels("n", "m", "d"), n="Coat", m="Nova", d=duration)
    assert len(panels) == 9 and [p.panel for p in panels] == list(range(1, 10))
    first = panels[0].beat
    assert first == "Panel 1 action beat" if duration > 5 else "Coat" in first


def test_motion(one):
    motion = "silk blouse and silk, flowing in wind, swaying naturally"
    plain = one(C.rewrite_motion("m", "n", "d"), m=motion, n="Coat", d="warm")
    assert plain == "Coat and fabric, flowing in wind, swaying naturally"
    fitted = one(C.rewrite_motion("m", "n", "d"), m=motion, n="Coat", d="Steel TEE")
    assert fitted == "Coat and fabric, moving naturally, fitting perfectly"


def test_clip_duration(one):
    assert [one(C.clip_duration("d"), d=d) for d in (5, 6, 8, 9)] == ["5", "8", "8", "10"]


LIST = '[{"backend": "a+b", "final_video_url": "u1", "model_name": "N"}'


@pytest.mark.parametrize(
    "log, code, urls_left, created",
    [
        (f"noise [x]\n{LIST}]\nbye", 0, ["u1"], True),
        (LIST + ', {"backend": "MOCK", "final_video_url": "u2"}, {"backend": "c"}]', 0, ["u1"], False),
        (LIST.replace("a+b", "mock") + "]", 0, [], None),
        ("no list here", 0, [], None),
        (f"{LIST}]", 1, [], None),
    ],
)
def test_generator_logs(spark, log, code, urls_left, created):
    logs = spark.createDataFrame([(1, code, log)], "run_id BIGINT, exit_code INT, log STRING")
    rows = P.accept_until_mock(P.logged_assets(logs)).collect()
    assert [r.final_video_url for r in rows] == urls_left
    if rows:
        assert rows[0].created is created


def test_statuses(spark):
    planned = spark.createDataFrame(
        [("p", "a", 3), ("p", "b", 3), ("p", "c", 3)],
        "product_id STRING, model_id STRING, scene_count INT",
    )
    results = spark.createDataFrame(
        [("p", "a", True)] * 3 + [("p", "b", True), ("p", "b", False)],
        "product_id STRING, model_id STRING, ok BOOLEAN",
    )
    got = {r.model_id: (r.status, r.error) for r in P.scene_status(results, planned).collect()}
    assert got["a"] == ("success", None)
    assert got["b"] == ("partial", None)
    assert got["c"] == ("partial", "All video scenes failed")


@pytest.mark.parametrize(
    "result, kind, url",
    [
        ('{"output": {"image_url": "", "url": "u"}}', "image", "u"),
        ('{"output": "u"}', "image", "u"),
        ("{}", "image", ""),
        ('{"output": ["u"]}', "video", ""),
        ('{"images": []}', "soft_image", ""),
        ('{"images": [{"url": "u"}]}', "soft_image", "u"),
        ('{"video": {"url": "v"}, "output": "http://o"}', "scene_video", "v"),
        ('{"video": {}, "output": "http://o"}', "scene_video", "http://o"),
        ('{"output": "not a url", "images": ["http://i"]}', "scene_video", "http://i"),
        ('{"images": ["file"]}', "scene_video", ""),
    ],
)
def test_result_url(one, result, kind, url):
    assert one(payload.result_url("r", kind), r=result) == url


def test_task_id(one):
    assert one(payload.task_id("r"), r='{"id": "", "prediction_id": "p", "predictionID": "q"}') == "p"
    assert one(payload.task_id("r"), r="{}") is None


@pytest.mark.parametrize(
    "url, name",
    [
        ("https://d/x.mp3", "background_music.mp3"),
        ("https://m.com/a/b.mp3?x=/y", "bgm_b.mp3"),
        ("https://m.com/a b/c//", "bgm_c"),
        (None, None),
        ("", None),
    ],
)
def test_audio_filename(one, url, name):
    assert one(urls.audio_filename("u", "https://d/x.mp3"), u=url) == name


def test_backends(one):
    labels = {
        (a, b): one(payload.backend_choice(F.lit(a), F.lit(b))["label"])
        for a in (True, False)
        for b in (True, False)
    }
    assert labels == {
        (True, True): "eachlabs+higgsfield",
        (True, False): "eachlabs+eachlabs",
        (False, True): "higgsfield+higgsfield",
        (False, False): None,
    }


def test_resume(spark):
    wanted = spark.createDataFrame(
        [("p", "a", 2), ("p", "b", 3)], "product_id STRING, model_id STRING, scene_count INT"
    )
    cache = spark.createDataFrame(
        [("p", "a", "img", ["x", "y"]), ("p", "b", "img2", ["x", "y"])],
        "product_id STRING, model_id STRING, vton_image STRING, storyboard_images ARRAY<STRING>",
    )
    inflight = spark.createDataFrame(
        [("p", "b", "scene_0", "t1"), ("p", "b", "scene_1", "t2")],
        "product_id STRING, model_id STRING, scene STRING, task_id STRING",
    )
    got = {r.model_id: r for r in P.resume_state(wanted, cache, inflight).collect()}
    assert got["a"].storyboard_images == ["x", "y"] and got["a"].open_tasks is None
    assert got["b"].storyboard_images is None and got["b"].vton_image == "img2"
    assert got["b"].open_tasks == {"scene_0": "t1", "scene_1": "t2"}
