"""Joins and dedup operators against plain versions; hashing and components on their own."""

import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st
from pyspark.sql import functions

from vitrine.llm import components, forest, hashing, lines, substrings

from .cases import by_row, frame, given, odd, split

LAST = 2**63 - 1


def order(doc):
    return LAST if doc is None else doc


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        self.up[self.find(a)] = self.find(b)


def shingles(text, n=5):
    words = [w.lower() for w in split(text)]
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def plain_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    union, links = Union(), collections.defaultdict(set)
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        if x and y:
            both = len(x & y)
            if both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
                union.join(a, b)
                if x != y:
                    links[a].add(y)
                    links[b].add(x)
    out = []
    for i, r in enumerate(rows):
        own = [rows[j][0] for j in range(len(rows)) if union.find(j) == union.find(i)]
        least = min(own, key=order)
        out.append(
            {
                "doc_id": r[0], "class_id": least, "n_links": len(links[i]),
                "n_copies": sum(s == sets[i] for s in sets) - 1 if sets[i] else 0,
            }
        )
    return out


def copies(seed=3):
    """A family of near copies around one text, chained beyond the threshold."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(words)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        rows.append((500 + i, " ".join(own), "en", "src0", 0, "k", "w", 7, "s", 3, "c", 1))
    return rows


@pytest.mark.parametrize("rows", [given() + odd() + copies(), []])
def test_join(spark, rows, monkeypatch):
    monkeypatch.setattr(forest, "VERIFY_BLOCK", 16)
    monkeypatch.setattr(forest, "SUBTREE_BLOCK", 16)
    got = forest.ngram_classes(frame(spark, rows)).collect()
    names = ["doc_id", "class_id", "n_links", "n_copies"]
    assert by_row(got, *names) == by_row(plain_classes(rows), *names)


def test_one_of_each_class_stays(spark):
    rows = given() + odd() + copies()
    kept = forest.keep_one(frame(spark, rows))
    ids = collections.Counter(r.doc_id for r in kept.collect())
    classes = collections.defaultdict(set)
    for r in plain_classes(rows):
        classes[r["class_id"]].add(r["doc_id"])
    assert kept.columns == frame(spark, rows).columns
    for least, members in classes.items():
        if least is not None:
            assert ids[least] == 1
            assert not any(ids[m] for m in members - {least, None} if m not in classes)


def test_prefix_is_shortened_to_the_recall():
    assert forest.prefix_length(0.8, 32, 8, 0.99) == 8
    assert forest.prefix_length(0.8, 8, 8, 0.99) < 8
    with pytest.raises(ValueError):
        forest.prefix_length(0.1, 1, 4, 0.99)


@settings(max_examples=60, deadline=None)
@cases(st.lists(st.text(alphabet="aB é\n\t\x0b😀", max_size=40), min_size=1, max_size=6))
def test_word_hashes_follow_the_words(texts):
    data = [t.encode() for t in texts]
    hashes, text, first, end = hashing.word_hashes(data)
    words = [(i, w) for i, t in enumerate(data) for w in t.split()]
    joined = b"\n".join([*data, b""])
    assert [(int(i), joined[a:b]) for i, a, b in zip(text, first, end)] == words
    known = {}
    for (_, w), h in zip(words, hashes.tolist()):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@settings(max_examples=40, deadline=None)
@cases(st.lists(st.lists(st.integers(0, 5), max_size=40), max_size=5))
def test_stretches_cover_every_window_once(texts):
    window = 4
    words = [[str(w).encode() for w in t] for t in texts]
    data = [b" ".join(t) for t in words]
    if not data:
        return
    hashes, text, first, end = hashing.word_hashes(data)
    begin, count, rank = substrings.stretches(substrings.ranks(hashes, end - first), text, window)
    seen = [b + i for b, c in zip(begin, count) for i in range(c)]
    offsets = np.cumsum([0, *[len(t) for t in words]])
    want = [o + i for o, t in zip(offsets, words) for i in range(len(t) - window + 1)]
    assert seen == want
    assert all(text[b] == text[b + c + window - 2] for b, c in zip(begin, count))


def plain_removal(rows, window=13):
    first = {}
    for r in rows:
        words = split(r[1])
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            first[w] = min(first.get(w, LAST), order(r[0]))
    out = []
    for r in rows:
        words, gone = split(r[1]), set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < order(r[0]):
                gone.update(range(i, i + window))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append(
            {"doc_id": r[0], "n_words": len(words), "n_removed": len(gone),
             "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode()}
        )
    return out


@pytest.mark.parametrize("rows", [given(100) + odd() + copies(), []])
def test_substrings(spark, rows):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"]
    got = substrings.remove_repeats(frame(spark, rows), buckets=5).collect()
    assert by_row(got, *names) == by_row(plain_removal(rows), *names)


def plain_lines(rows):
    def grams(line):
        return frozenset(line[i : i + 10] for i in range(len(line) - 9)) if len(line) >= 10 else frozenset([line])

    seen, out, union, classes = [], [], Union(), {}
    for r in rows:
        for pos, raw in enumerate((r[1] or "").split("\n")):
            line = re.sub(r"[\x20\x09-\x0D]+", " ", raw.lower()).strip(" ")
            if line:
                seen.append((order(r[0]), r[1], pos, line))
    sets = {line: grams(line) for *_, line in seen}
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        both = len(x & y)
        if both >= 0.8 * (len(x) + len(y) - both) - 1e-9:
            union.join(a, b)
    for place in sorted(set(seen), key=lambda s: (s[0], s[2])):
        root = union.find(place[3])
        classes.setdefault(root, place)
    for r in rows:
        own = [s for s in sorted(set(seen), key=lambda s: s[2]) if s[0] == order(r[0]) and s[1] == r[1]]
        gone = [s[2] for s in own if classes[union.find(s[3])] != s]
        out.append({"doc_id": r[0], "n_lines": len(own), "removed": gone})
    return out


def line_rows():
    rng = random.Random(8)
    base = [" ".join(f"word{rng.randrange(300)}" for _ in range(n)) for n in (3, 8, 19, 21, 31, 33, 60)]
    rows = []
    for i in range(30):
        own = []
        for line in base:
            words = line.split(" ")
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
            own.append(("  " if i % 3 else "\t").join(words))
        rows.append((700 + i, "\n".join(own) + "\n\n", "en", "src0", 0, "k", "w", 7, "s", 3, "c", 1))
    return rows


def test_lines(spark):
    # equal ids with other texts are left out: their order is that of a hash of the text
    rows = given(40) + [r for r in odd() if r[0] not in (None, 9011)] + line_rows()
    got = lines.dedup_lines(frame(spark, rows)).collect()
    names = ["doc_id", "n_lines", "removed"]
    assert by_row(got, *names) == by_row(plain_lines(rows), *names)
    for r in got:
        kept = [x for i, x in enumerate((r.text or "").split("\n")) if i not in set(r.removed)]
        assert r.n_removed == len(r.removed)
        assert r.kept_text == (None if r.text is None else "\n".join(kept))


def test_lines_of_any_word_count_meet(spark):
    """Lines of 11 words or fewer and the same line as one of 16 words or more, at 0.8 or above."""
    rng = random.Random(4)
    rows, pairs = [], 0
    for i in range(60):
        line = " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(rng.choice((10, 11))))
        longer = line + (" | | | | | |" if i % 2 else " a b c d e f")
        assert len(line.split(" ")) <= 11 and len(longer.split(" ")) >= 16
        x, y = ({t[j : j + 10] for j in range(len(t) - 9)} for t in (line, longer))
        assert len(x & y) >= 0.8 * len(x | y)
        rows += [(2 * i, line, "en", "src0", 0, "k", "w", 7, "s", 3, "c", 1)]
        rows += [(2 * i + 1, longer, "en", "src0", 0, "k", "w", 7, "s", 3, "c", 1)]
        pairs += 1
    found = {r.doc_id: r.removed for r in lines.dedup_lines(frame(spark, rows)).collect()}
    assert all(found[2 * i] == [] and found[2 * i + 1] == [0] for i in range(pairs))


def test_windows_are_hashed_as_they_are():
    given_lines = ["a", "0123456789", "0123456789x", "ab😀", "ab", "x0123456789", "0123456789"]
    hashes, starts = lines.window_hashes(given_lines)
    sets = [set(h.tolist()) for h in np.split(hashes, starts[1:])]
    plain = [{t[i : i + 10] for i in range(max(1, len(t) - 9))} for t in given_lines]
    for i, j in itertools.product(range(len(plain)), repeat=2):
        assert len(sets[i] & sets[j]) == len(plain[i] & plain[j])
    near = lines.alike(given_lines, given_lines[1:] + given_lines[:1], 0.5)
    want = [2 * len(x & y) >= len(x | y) for x, y in zip(plain, plain[1:] + plain[:1])]
    assert near.tolist() == want


def test_sketches_agree_as_often_as_lines_are_alike(spark):
    """Counted natively as counted in plain Python; near lines pass, unlike ones mostly don't."""
    rng = random.Random(5)
    texts = []
    for i in range(120):
        line = [rng.choice("abcdefgh ") for _ in range(200)]
        other = list(line)
        for _ in range((1, 2, 20)[i % 3]):
            other[rng.randrange(200)] = "Z"
        texts += [(2 * i, "".join(line)), (2 * i + 1, "".join(other))]
    windows, values = lines.sketched([t for _, t in texts])
    sets = [{t[j : j + 10] for j in range(len(t) - 9)} for _, t in texts]
    assert windows.tolist() == [len(s) for s in sets]
    held = lines.line_sketches(spark.createDataFrame(texts, "id BIGINT, line STRING"))
    left = held.where("id % 2 = 0").selectExpr("id div 2 AS i", "sketch AS x")
    right = held.where("id % 2 = 1").selectExpr("id div 2 AS i", "sketch AS y")
    both = left.join(right, "i")
    got = {r.i: (r.n, r.near) for r in both.select(
        "i", lines.agreement("x", "y").alias("n"), lines._may_be_alike("x", "y", 0.8).alias("near")
    ).collect()}
    bytes_of = values.copy().view(np.uint8).reshape(len(texts), -1, 8)[:, :, :7].reshape(len(texts), -1)
    for i in range(120):
        x, y = sets[2 * i], sets[2 * i + 1]
        assert got[i][0] == int((bytes_of[2 * i] == bytes_of[2 * i + 1]).sum())
        if len(x & y) >= 0.8 * len(x | y):
            assert got[i][1]
        if len(x & y) < 0.4 * len(x | y):
            assert not got[i][1]
    least = lines.least_agreement(0.8)
    below = sum(math.comb(126, k) * 0.8**k * 0.2 ** (126 - k) for k in range(least))
    assert below <= 1e-6 < below + math.comb(126, least) * 0.8**least * 0.2 ** (126 - least)


def test_only_lines_of_other_components_are_paired(spark):
    """A hot band in nearly one component makes as many rows as there are pairs across."""
    members = [(1, i, 0) for i in range(400)] + [(1, 1000 + i, 1000 + i // 2) for i in range(4)]
    members += [(2, i, 0) for i in range(200)] + [(3, 5, 5), (3, 1000, 1000)]
    held = spark.createDataFrame(members, "band BIGINT, id BIGINT, root BIGINT")
    want = {
        (a, b) for (s, a, x), (t, b, y) in itertools.product(members, repeat=2) if s == t and x != y and a < b
    }
    found = lines._across(held)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    joins, plan = [], [found._jdf.queryExecution().executedPlan()]
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if "Join" in node.nodeName():
            joins.append(node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    assert joins and max(joins) <= len(want) + 1


def test_pairs_across_are_made_once(spark):
    """A component is looked up from the smaller side, and two lines meet in one of the bands they share."""
    members = [(band, i, 0 if i < 300 else i) for band in range(3) for i in range(310)]
    held = spark.createDataFrame(members, "band BIGINT, id BIGINT, root BIGINT")
    texts = held.select("id").distinct().withColumn("line", functions.lit("one and the same line"))
    mixed = lines._of_mixed(held, lines.line_sketches(texts))
    found = lines._across(mixed, 0.8)
    want = {(a, b) for a in range(310) for b in range(max(300, a + 1), 310)}
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(want)
    joins, plan = [], [found._jdf.queryExecution().executedPlan()]
    while plan:
        node = plan.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if "Join" in node.nodeName():
            joins.append(node.metrics().apply("numOutputRows").value())
        plan += [node.children().apply(i) for i in range(node.children().size())]
    assert joins and max(joins) <= len(want)


def test_lines_take_null_ids_and_empty_tables(spark):
    assert len(lines.dedup_lines(frame(spark, odd())).collect()) == len(odd())
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    pairs += [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(200)]
    pairs += [(None, 1), (5, 5)]
    union = Union()
    for a, b in pairs:
        if a is not None and a != b:
            union.join(a, b)
    nodes = {n for p in pairs if None not in p and p[0] != p[1] for n in p}
    least = {}
    for n in nodes:
        root = union.find(n)
        least[root] = min(least.get(root, n), n)
    found = components.connected_components(spark.createDataFrame(pairs, "a BIGINT, b BIGINT"))
    assert {(r.node, r.root) for r in found.collect()} == {(n, least[union.find(n)]) for n in nodes}
    none = components.connected_components(spark.createDataFrame([], "a BIGINT, b BIGINT"))
    assert none.count() == 0


@pytest.mark.parametrize("collide", [False, True])
def test_windows_are_told_apart_by_their_bytes(monkeypatch, collide):
    """Random packed strings against a dictionary of windows, also if all hashes are equal."""
    if collide:
        windows_of = substrings.windows_of

        def equal(strings, window):
            text, first, end, hashes = windows_of(strings, window)
            return text, first, end, hashes * np.uint64(0)

        monkeypatch.setattr(substrings, "windows_of", equal)
    rng = random.Random(1)
    for _ in range(60):
        strings = [b" ".join(rng.choice([b"a", b"bb", b"c"]) for _ in range(rng.randint(3, 6))) for _ in range(rng.randint(1, 8))]
        counts = np.array([rng.randint(1, 3) for _ in strings])
        docs = np.array([rng.randint(1, 6) for _ in range(counts.sum())])
        keys, starts = docs * 10, np.arange(len(docs)) * 100
        own = [s.split() for s, c in zip(strings, counts) for _ in range(c)]
        least = {}
        for words, doc in zip(own, docs.tolist()):
            for i in range(len(words) - 2):
                w = tuple(words[i : i + 3])
                least[w] = min(least.get(w, doc), doc)
        want = sorted(
            (d, k, at + i)
            for words, d, k, at in zip(own, docs.tolist(), keys.tolist(), starts.tolist())
            for i in range(len(words) - 2)
            if least[tuple(words[i : i + 3])] < d
        )
        got = substrings.repeated(strings, counts, docs, keys, starts, 3)
        assert sorted(zip(*(x.tolist() for x in got))) == want
