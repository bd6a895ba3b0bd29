"""News functions, literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from vitrine.functions import news as N
from vitrine.functions import payload, social, urls
from vitrine.operators import news as W
from vitrine.sources.files import scan_rss

PHOTO = "https://assets.vogue.com/photos/"


@pytest.mark.parametrize(
    "url, image_id",
    [
        (PHOTO + "ab12/master/x.jpg", "ab12"),
        ("https://f.com/.image/NTg6MDAw/14.jpg?profile=rss", "NTg6MDAw/14.jpg"),
        ("https://c.com/a/pic.png?v=2", "pic.png"),
        ("https://c.com/dir/", "https://c.com/dir/"),
    ],
)
def test_image_id(one, url, image_id):
    assert one(N.image_id("u"), u=url) == image_id


@pytest.mark.parametrize(
    "title, head",
    [
        ("A - B - C", "A"),
        (" A | B ", "A"),
        ("A | B - C", "A | B"),
        (" Plain ", "Plain"),
    ],
)
def test_headline(one, title, head):
    assert one(N.headline("t"), t=title) == head


def test_hashtags(one):
    head = "Dua Lipa's New-Look: Émilie, Dua at 3PM in NYC Ab"
    assert one(N.hashtags("h"), h=head) == ["#Dua", "#Lipas", "#NewLook"]
    assert one(N.hashtags("h"), h="all lower") == []


@pytest.mark.parametrize("n", [0, 1, 19, 20, 21, 40, 41, 60])
def test_slides(one, n):
    words = [f"w{i}" for i in range(n)]
    slides = one(N.slide_texts("d"), d="<p>" + " \n".join(words) + "</p>\t")
    assert slides.slide2_text == " ".join(words[:20])
    closing = "..." if n > 40 else " Tap below to read more."
    assert slides.slide3_text == " ".join(words[20:40]) + closing


def test_caption_without_tags(one):
    text = one(N.news_caption("h", F.array().cast("array<string>"), "#Brand"), h="Head")
    assert text.endswith("#Brand #FashionNews")


@pytest.mark.parametrize("n", range(9))
def test_slide_plan(one, n):
    images = [f"i{i}" for i in range(n)]
    plan = one(N.slide_plan("l", "default"), l=images)
    cover = images[0] if images else "default"
    if n >= 6:
        expected = (cover, images[n // 3], images[2 * n // 3], 1.0, 1.0)
    elif n >= 3:
        expected = (cover, images[1], images[2], 1.0, 1.0)
    else:
        expected = (cover, cover, cover, 1.35, 1.65)
    assert tuple(plan) == expected


def gallery_of(spark, main, link, html, description):
    frame = spark.createDataFrame(
        [(main, link, html, description)],
        "main STRING, link STRING, html STRING, description STRING",
    )
    return W.gallery(frame, "main", "link", "html", "description").first().gallery


def test_gallery(spark):
    html = "".join(f"<img src='{PHOTO}{i}/x.jpg'>" for i in ("a1", "b2", "a1"))
    extra = '<img src="https://c.com/p.jpg?a=1&amp;b=2"><img SRC="/rel.png">'
    photo = PHOTO + "{}/master/w_1280,c_limit/image.jpg"
    got = gallery_of(spark, PHOTO + "a1/main.jpg", "https://www.vogue.com/x", html, extra)
    assert got == [PHOTO + "a1/main.jpg", photo.format("b2"), "https://c.com/p.jpg?a=1&b=2"]
    other = gallery_of(spark, None, "https://else.com/x", html, extra)
    assert other == ["https://c.com/p.jpg?a=1&b=2"]
    full = html + f"<img src='{PHOTO}c3/x.jpg'>"
    assert len(gallery_of(spark, None, "https://vogue.com", full, extra)) == 3
    assert gallery_of(spark, "", "https://else.com", None, None) == []


def test_story_image(one):
    def image(media, description, enclosure):
        column = N.story_image("m", "d", "e")
        return one(column, m=media, d=description, e=enclosure)

    assert image("m", '<img src="d">', "e") == "m"
    assert image("", '<img src="d">', "e") == "d"
    assert image(None, '<a src="d">', "e") == "e"
    assert image(None, '<img src="">', "e") == "e"
    assert image(None, "<img", None) is None


def test_rss(spark, tmp_path):
    item = "<item><title>{}</title><link>{}</link><description>{}</description>{}</item>"
    first = (
        '<rss xmlns:media="http://search.yahoo.com/mrss/"><channel>'
        + item.format("One", "l1", "&lt;img src=\"d1\"&gt;", '<media:content url="m1"/>')
        + item.format("Two", "l2", "&lt;img src=\"d2\"&gt;", "")
        + item.format("", "l3", "", "")
        + item.format("Four", "l4", "text", '<enclosure url="e4"/>')
        + item.format("Five", "l5", "", '<media:content url=""/><media:content url="m5?a=1&amp;b"/><media:content url="m6"/>')
        + item.format("Six", "l6", "", '<media:thumbnail url="t6"/><media:content url="m7"/>')
        + "</channel></rss>"
    )
    good, broken = tmp_path / "good.xml", tmp_path / "broken.xml"
    good.write_text(first)
    broken.write_text("<rss><channel><item><title>cut")
    rows = scan_rss(spark, [str(good), str(broken), str(tmp_path / "none.xml")])
    got = [(r.feed, r.title, r.link, r.image_url) for r in rows.orderBy("feed", "pos").collect()]
    assert got == [(0, "One", "l1", "m1"), (0, "Two", "l2", "d2"), (0, "Four", "l4", "e4"),
                   (0, "Five", "l5", "m5?a=1&b"), (0, "Six", "l6", "t6")]


def test_marked_json(one):
    body = json.dumps({"status": "SUCCESS", "headline": "H", "final_graphic_urls": ["a", "b"]})
    log = f"x\n{payload.RESULT_START}\n{body}\n{payload.RESULT_END}\n"
    assert one(payload.parse_news_result("l"), l=log).headline == "H"
    assert one(payload.parse_news_result("l"), l=log.replace("SUCCESS", "failed")) is None
    assert one(payload.parse_news_result("l"), l=log.replace(payload.RESULT_END, "")) is None
    turned = f"{payload.RESULT_END}{payload.RESULT_START}{body}{payload.RESULT_END}"
    assert one(payload.parse_news_result("l"), l=turned) is None


@pytest.mark.parametrize(
    "given, base, expected",
    [
        (None, "https://b", None),
        ("", "https://b", ""),
        ("http://x/y", "https://b", "http://x/y"),
        ("/a/b", "https://b", "https://b/a/b"),
        ("//a", "https://b/", "https://b//a"),
        ("a", "https://b/", "https://b/a"),
    ],
)
def test_absolute_url(one, given, base, expected):
    assert one(urls.absolute_url("u", base), u=given) == expected


@pytest.mark.parametrize(
    "given, expected, layout",
    [
        (None, [], None),
        ("", [""], "single"),
        (",", [], None),
        ("a,,", ["https://b/a"], "single"),
        (",a", ["", "https://b/a"], "carousel"),
        ("a,http://c", ["https://b/a", "http://c"], "carousel"),
    ],
)
def test_layout(one, given, expected, layout):
    post = one(social.post_layout("u", "https://b"), u=given)
    assert (post.urls, post.layout) == (expected, layout)


def test_join_urls(one):
    assert one(urls.join_urls("l"), l=["a", "b"]) == "a,b"
    assert one(urls.join_urls(F.lit(None).cast("array<string>"))) == ""


def test_selected_story(spark):
    stories = spark.createDataFrame(
        [("b", i, f"Title {i}", f"l{i}", "d", None if i % 2 else f"img{i}") for i in range(20)],
        "batch STRING, pos BIGINT, title STRING, link STRING, description STRING, image_url STRING",
    )
    schema = "batch STRING, original_link STRING, original_title STRING, image_url STRING"

    def match(link, title, image):
        chosen = spark.createDataFrame([("b", link, title, image)], schema)
        return W.match_selected_story(chosen, stories, "default").first()

    assert match("l4", "x", "own").image_url == "img4"
    assert match("no", "About Title 3!", "own").original_link == "l3"
    assert match("no", "About Title 3!", "own").image_url == "own"
    assert match("l9", None, "None").image_url == "default"
    beyond = match("l17", "none", "own")
    assert not beyond.matched and beyond.original_link == "l17"
