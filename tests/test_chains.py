"""Page chains against following the links one by one."""

import random

from vitrine.operators.chains import chain_places, chain_report

SCHEMA = "url STRING, next STRING"


def places(spark, rows):
    found = chain_places(spark.createDataFrame(rows, SCHEMA).repartition(3), "url", "next")
    return found, {r["node"]: (r["head"], r["place"]) for r in found.collect()}


def test_long_and_short_chains(spark):
    rows = [(f"a{i:03}", f"a{i + 1:03}" if i < 299 else None) for i in range(300)]
    rows += [("b1", "b2"), ("b2", "b3")]  # b3 is missing
    rows += [("c1", None), ("c1", None)]
    random.Random(1).shuffle(rows)
    found, got = places(spark, rows)
    assert all(got[f"a{i:03}"] == ("a000", i) for i in range(300))
    assert got["b2"] == ("b1", 1) and got["c1"] == ("c1", 0)
    report = {r["head"]: (r["pages"], r["repeats"], r["last"], r["ends"]) for r in chain_report(found).collect()}
    assert report == {
        "a000": (300, 0, "a299", "end"), "b1": (2, 0, "b2", "gap"), "c1": (1, 1, "c1", "end"),
    }


def test_forks_and_circles(spark):
    rows = [("a", "m"), ("b", "m"), ("m", "n"), ("n", None)]  # two pages lead to m
    rows += [("x", "y"), ("y", "z"), ("z", "x"), ("s", "s"), (None, "a"), ("r", "t"), ("r", "b")]
    found, got = places(spark, rows)
    assert got["n"] == ("a", 2) and got["b"] == ("r", 1)
    assert [got[p] for p in "xyz"] == [(None, None)] * 3
    report = {(r["head"], r["last"]): r["ends"] for r in chain_report(found).collect()}
    assert report == {
        ("a", "n"): "end", ("r", "b"): "fork", ("s", "s"): "fork",
        (None, "x"): "circle", (None, "y"): "circle", (None, "z"): "circle",
    }


def test_no_pages(spark):
    found, got = places(spark, [])
    assert got == {} and chain_report(found).count() == 0
