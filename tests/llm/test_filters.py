"""Decontamination, quality rules and the classifier against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest

from vitrine.llm import classifier, decontam, rules

from .cases import SCHEMA, SMALL, by_row, frame, given, odd, split

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, " ".join(f"common{i}" for i in range(10, 30))),
    (2, "common5 common6 common7"),
    (3, None),
    (4, "..."),
    (5, "zebra"),
    (6, " ".join(f"Common{i}," for i in range(10, 30))),
    (7, "a"),
]


def lowered(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return WORD.findall(text)


def plain_decontamination(text, items):
    words, hit, found = lowered(text), set(), set()
    for item, value in items:
        own = lowered(value)
        if not own:
            continue
        k = min(13, len(own))
        windows = {tuple(own[i : i + k]) for i in range(max(len(own) - 12, 1))}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("rows", [given() + odd(), odd(), []])
def test_decontamination(spark, rows):
    items = spark.createDataFrame(ITEMS, "item_id INT, text STRING")
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet").unionByName(
        items.selectExpr("cast(item_id + 1000 as bigint) AS item_id", "text")
    )
    everything = [(r[0], r[1]) for r in benchmark.collect()]
    found = decontam.decontaminate(frame(spark, rows), benchmark)
    assert set(SCHEMA_NAMES) - {"spans"} <= set(found.columns)
    got = by_row(found.collect(), "doc_id", "n_words", "n_hit", "items", "contaminated")
    want = []
    for r in rows:
        n, hits, ids, bad = plain_decontamination(r[1], everything)
        want.append({"doc_id": r[0], "n_words": n, "n_hit": hits, "items": ids, "contaminated": bad})
    assert got == by_row(want, "doc_id", "n_words", "n_hit", "items", "contaminated")


SCHEMA_NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def test_decontamination_without_items(spark):
    none = spark.createDataFrame([], "item_id INT, text STRING")
    rows = decontam.decontaminate(frame(spark, odd()), none).collect()
    assert len(rows) == len(odd()) and not any(r.n_hit or r.contaminated for r in rows)


def plain_rules(text):
    words = [w.decode() for w in split(text)]
    lines = [x for x in (text or "").split("\n") if split(x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    repeat = {p for places in at.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeat),
        "base_failed": len(words) < 20 or 100 * len(repeat) > 30 * len(words),
    }


def divergence(p, q):
    def part(a, b):
        return a * math.log2(2 * a / (a + b)) if a else 0.0

    return math.sqrt(max(0.0, sum(part(a, b) + part(b, a) for a, b in zip(p, q)) / 2))


@pytest.mark.parametrize("rows", [given() + odd(), []])
def test_rules(spark, rows):
    found = rules.quality_rules(frame(spark, rows)).collect()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert by_row(found, *names) == by_row([{"doc_id": r[0], **plain_rules(r[1])} for r in rows], *names)
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        counts[r[2]].update(w.decode() for w in split(r[1]))
    for r in found:
        words = [w.decode() for w in split(r.text)]
        seen = counts[r.lang]
        if not words:
            assert r.word_distance == 0 and not r.kept
            continue
        top = sorted(seen.items(), key=lambda x: (-x[1], x[0].encode()))[: rules.COMMON_WORDS]
        total, own = sum(seen.values()), collections.Counter(words)
        q = [n / total for _, n in top]
        p = [own[w] / len(words) for w, _ in top]
        want = divergence([*p, 1 - sum(p)], [*q, 1 - sum(q)])
        assert r.word_distance == pytest.approx(want, abs=1e-5)
        assert not (r.base_failed and r.kept)


def test_rules_judge_languages_of_few_words(spark):
    """A language of under 1000 words is compared as well, by limits that rise smoothly."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(90)), "xx") for i in range(8)]
    rows.append((99, " ".join(f"|{rng.randrange(10**6)}#" for _ in range(60)), "xx"))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")
    assert sum(len(r[1].split()) for r in rows) < 1000
    kept = {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    assert kept == {**{i: True for i in range(8)}, 99: False}


def test_rules_tell_junk_from_clean_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = rules.quality_rules(docs).join(labels, "doc_id").where("NOT base_failed").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) / len(clean) > 0.98
    assert sum(junk) / len(junk) < 0.5


@pytest.mark.parametrize("least, most, junk_kept", [(20, 79, 0.5), (80, 10**9, 0.3)])
def test_rules_tell_junk_in_each_band_of_lengths(spark, least, most, junk_kept):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    judged = rules.quality_rules(docs, carry=["doc_id"]).join(labels, "doc_id")
    rows = judged.where(f"NOT base_failed AND n_words BETWEEN {least} AND {most}").collect()
    clean = [r.kept for r in rows if r.quality == 1]
    junk = [r.kept for r in rows if r.quality == 0]
    assert sum(clean) / len(clean) > 0.98
    assert sum(junk) / len(junk) < junk_kept, (sum(junk), len(junk))


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    network = classifier.fit_quality(docs, labels)
    scored = classifier.score_quality(docs, network).join(labels, "doc_id").collect()
    own = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    clean = [r.score for r in own if r.quality == 1]
    junk = [r.score for r in own if r.quality == 0]
    ahead = np.mean([c > j for c in clean for j in junk])
    assert ahead > 0.95
    assert np.mean([c >= 0.3 for c in clean]) > 0.98


def test_classifier_takes_odd_rows(spark):
    labels = spark.createDataFrame(
        [(9005, 1), (9004, 0), (9007, 1), (9009, 0), (9002, None), (None, 1)], "doc_id BIGINT, quality INT"
    )
    docs = frame(spark, odd())
    network = classifier.fit_quality(docs, labels)
    scored = classifier.score_quality(docs, network)
    rows = scored.collect()
    assert len(rows) == len(odd()) and all(0 <= r.score <= 1 for r in rows)
    assert scored.columns == [*SCHEMA_NAMES, "score"]
    assert classifier.score_quality(frame(spark, []), network).count() == 0
    none = classifier.fit_quality(docs, labels.where("quality > 1"))
    assert {round(r.score, 6) for r in classifier.score_quality(docs, none).collect()} == {0.5}


def test_whole_text_counts():
    """Every byte position lies in a chunk, and pooled responses match the plain sums."""
    network = classifier.Network(3)
    data = bytes(np.random.default_rng(1).integers(0, 256, 1000, dtype=np.uint8))
    pooled = network.pooled(data, network.tables())
    starts = classifier.chunk_starts(len(data))
    assert {p for s in starts for p in range(s, s + classifier.CHUNK)} >= set(range(len(data)))
    whole = classifier.padded(data)
    for s, got in zip(starts, pooled):
        sums = [
            sum(network.filters[k][whole[i + k]] for k in range(classifier.WIDTH))
            for i in range(s, s + classifier.CHUNK)
        ]
        assert np.allclose(got, np.maximum(np.max(sums, axis=0) + network.offset, 0), atol=1e-4)


def test_gradients_match_differences():
    network = classifier.Network(1)
    rng = np.random.default_rng(0)
    chunks = rng.integers(97, 101, (5, classifier.CHUNK + classifier.WIDTH - 1)).astype(np.uint8)
    owner, labels = np.array([0, 0, 1, 2, 2]), np.array([1, 0, 1], np.float32)

    def loss():
        response = sum(network.filters[k][chunks[:, k : k + classifier.CHUNK]] for k in range(classifier.WIDTH))
        pooled = np.maximum(response.max(axis=1) + network.offset, 0)
        score = network.head(pooled, owner, 3)[0]
        return -np.mean(labels * np.log(score) + (1 - labels) * np.log(1 - score))

    grads = network.gradients(chunks, owner, labels)
    for weight, grad in zip(network.weights()[1:], grads[1:]):
        at = tuple(0 for _ in weight.shape)
        held = weight[at]
        weight[at] = held + 1e-2
        up = loss()
        weight[at] = held - 1e-2
        down = loss()
        weight[at] = held
        assert grad[at] == pytest.approx((up - down) / 2e-2, abs=5e-3)
