"""Sharding, mixing, archives and lattice scores against plain versions and round trips."""

import base64
import collections
import hashlib
import itertools
import math
import random
import struct
import time
import zlib

import pytest
import zstandard

from vitrine.llm import lattice, mixing, shards, warc

from .cases import by_row, frame, given, odd, split


def points(key, count, seed=0):
    """-ln of each shard's hash, by shard."""
    name = "\\N" if key is None else str(key)
    out = []
    for i in range(count):
        digest = hashlib.md5(f"{seed}|{i}|{name}".encode()).hexdigest()
        out.append(-math.log((int(digest[:15], 16) + 0.5) / 2.0**60))
    return out


@pytest.mark.parametrize("rows", [given() + odd(), []])
def test_shards(spark, rows):
    weights = [1.0, 2.0, 1.0, 0.5]
    placed = shards.assign_shards(frame(spark, rows), weights, grown=[*weights, 1.0])
    got = shards.number_slots(placed, ["doc_id", "n_chars"], ranges=4).collect()
    want = []
    for r in rows:
        scores = [p / w for p, w in zip(points(r[0], 5), [*weights, 1.0])]
        want.append(
            {"doc_id": r[0], "shard": scores[:4].index(min(scores[:4])), "grown_shard": scores.index(min(scores))}
        )
    assert by_row(got, "doc_id", "shard", "grown_shard") == by_row(want, "doc_id", "shard", "grown_shard")
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_their_weights(spark):
    rows = spark.range(8000).withColumnRenamed("id", "doc_id")
    counts = dict(shards.assign_shards(rows, [1, 3]).groupBy("shard").count().collect())
    assert counts[1] / 8000 == pytest.approx(0.75, abs=0.02)


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Fill by weight, fix what is above its bound, fill again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, targets = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not above:
            targets.update({s: left * weight[s] / total for s in open_})
            break
        for s in above:
            targets[s] = float(most * sizes[s])
        left -= sum(targets[s] for s in above)
        open_ -= above
    return targets


@pytest.mark.parametrize("rows", [given(100) + odd(), odd()])
def test_mix(spark, rows):
    placed, targets, pieces = mixing.mix_sources(frame(spark, rows), block_words=64)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    want = plain_targets(sizes)
    got = {r.source: r for r in targets.collect()}
    assert {s: r.target for s, r in got.items()} == pytest.approx(want)
    taken = mixing.words_taken(placed, targets, pieces).collect()
    assert by_row(taken, "doc_id", "size") == by_row(
        [{"doc_id": r[0], "size": len(split(r[1]))} for r in rows], "doc_id", "size"
    )
    by_source = collections.Counter()
    for r in taken:
        assert 0 <= r.taken <= 2 * r["size"]
        by_source[r.source] += r.taken
    assert {s: by_source[s] for s in want} == {s: math.floor(t + 0.5) for s, t in want.items()}
    again = mixing.words_taken(*mixing.mix_sources(frame(spark, rows), block_words=64)).collect()
    assert by_row(taken, "doc_id", "size", "taken") == by_row(again, "doc_id", "size", "taken")


def test_mix_is_in_proportion_all_along(spark):
    rows = [(i, "w " * 500, "en", f"s{i % 3}", 0, "k", "w", 7, "s", 3, "c", 1) for i in range(300)]
    _, targets, pieces = mixing.mix_sources(frame(spark, rows), block_words=50, share=0.5)
    shares = {r.source: r.target for r in targets.collect()}
    total = sum(shares.values())
    slots = sorted((p.slot, p.source) for p in pieces.select("slot", "source").distinct().collect() if p.slot is not None)
    assert len({s for s, _ in slots}) == len(slots)
    for upto in (100, 300, 700):
        counts = collections.Counter(s for _, s in slots[:upto])
        for s, t in shares.items():
            assert abs(counts[s] - upto * t / total) < 12
    blocks = collections.Counter()
    for p in pieces.collect():
        blocks[p.source, p.rank] += p.words
    assert set(blocks.values()) <= {50} | {math.floor(t + 0.5) % 50 for t in shares.values()}


def test_the_schedule_decides_what_is_taken(spark, monkeypatch):
    """Without some slots their blocks are not read; small sources fill their need too."""
    rows = [(i, "w " * 100, "en", "big", 0, "k", "w", 7, "s", 3, "c", 1) for i in range(200)]
    rows += [(900 + i, "w " * 9, "en", f"small{i}", 0, "k", "w", 7, "s", 3, "c", 1) for i in range(7)]
    docs = frame(spark, rows)

    def taken():
        found = mixing.words_taken(*mixing.mix_sources(docs, block_words=50)).collect()
        return sum(r.taken for r in found if r.source == "big"), {r.source: r.taken for r in found}

    whole, of = taken()
    _, targets, pieces = mixing.mix_sources(docs, block_words=50)
    want = {r.source: math.floor(r.target + 0.5) for r in targets.collect()}
    assert whole == want["big"] and all(of[s] == n for s, n in want.items() if s != "big")
    assert all(p.slot is not None for p in pieces.collect())
    given_slots = mixing.schedule
    monkeypatch.setattr(mixing, "schedule", lambda *a: given_slots(*a).where("source <> 'big' OR rank % 10 <> 3"))
    blocks = -(-want["big"] // 50)
    assert taken()[0] == want["big"] - 50 * sum(r % 10 == 3 for r in range(blocks))


def test_empty_mix(spark):
    placed, targets, pieces = mixing.mix_sources(frame(spark, []))
    assert targets.count() == 0 and mixing.words_taken(placed, targets, pieces).count() == 0


PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"),
    (3, None, None), (4, "http://a/\r\n4", ""), (6, "http://a/6", "ü😀" * 5000),
    (None, "http://a/n", "<p>same</p>"), (7, "http://a/7", "a\r\n\r\nb\r\n\r\n"), (8, "u", "x"), (8, "u", "x"),
]


def pages_frame(spark, rows):
    schema = "page_id BIGINT, url STRING, html STRING, digest STRING, first_id INT, id INT"
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], schema).repartition(2)


def plain_pages(rows):
    last = {}
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(last.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        first = last.get(html or "")
        revisit = first is not None and page != first
        out.append(
            {
                "record_id": "null" if page is None else str(page), "payload_bytes": len(data),
                "payload_digest": base64.b32encode(hashlib.sha1(data).digest()).decode(),
                "record_type": "revisit" if revisit else "response",
                "refers_to": str(first) if revisit else None,
            }
        )
    return out


@pytest.mark.parametrize("size", [1, 10_000_000])
def test_archives(spark, size):
    names = ["record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    archives = warc.write_archives(pages_frame(spark, PAGES), archive_bytes=size)
    records = warc.read_archives(archives).collect()
    assert by_row(records, *names) == by_row(plain_pages(PAGES), *names)
    stored = {r.record_id: r.payload for r in records if r.record_type == "response"}
    assert stored["6"] == ("ü😀" * 5000).encode() and stored["7"] == b"a\r\n\r\nb\r\n\r\n"


def test_small_payloads_are_all_responses(spark):
    archives = warc.write_archives(pages_frame(spark, PAGES), least_bytes=12)
    assert {r.record_type for r in warc.read_archives(archives).collect()} == {"response"}
    assert warc.round_trip(pages_frame(spark, [])).count() == 0


def many_records():
    return [warc.record(i, f"http://h/{i}", (f"<html>{i} " + "text " * (50 + i)).encode()) for i in range(300)]


def test_dictionary_comes_first():
    content = warc.pack(many_records())
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D
    assert zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])[:4] == b"\x37\xa4\x30\xec"
    assert list(warc.frames(content)) == many_records()
    # the format allows the dictionary uncompressed as well, and none at all
    raw = zstandard.ZstdDecompressor().decompress(content[8 : 8 + size])
    plain = struct.pack("<II", 0x184D2A5D, len(raw)) + raw + content[8 + size :]
    assert list(warc.frames(plain)) == many_records()
    one = zstandard.ZstdCompressor().compress(many_records()[0])
    assert list(warc.frames(one)) == many_records()[:1]


def test_frames_are_read_in_linear_time():
    def seconds(count):
        records = [warc.record(i, "http://h/", b"<html>%d" % i + b"text " * (i % 90)) for i in range(count)]
        content = warc.pack(records)
        start = time.process_time()
        assert list(warc.frames(content)) == records
        return time.process_time() - start

    few = seconds(10_000)
    assert seconds(80_000) < 8 * 4 * few
    long = [warc.record(1, "http://h/", random.Random(3).randbytes(3 * 10**6)), warc.record(2, "http://h/", b"x")]
    assert list(warc.frames(warc.pack(long))) == long


def test_faults_are_found():
    content = warc.pack(many_records())
    size = struct.unpack_from("<I", content, 4)[0]
    for broken in (
        content[:-3],
        content[: size // 2],
        struct.pack("<II", 0x184D2A5D, 4) + b"nope" + content[8 + size :],
        content + b"\x28\xb5\x2f\xfdxxxx",
    ):
        with pytest.raises(warc.ArchiveError):
            list(warc.frames(broken))
    good = many_records()[0]
    for broken in (
        good[:-1],
        good + good,
        good.replace(b"WARC/1.1", b"WORC/1.1"),
        good.replace(b"<html>", b"<htmx>"),
        good.replace(b"WARC-Type: response", b"WARC-Type: other"),
        good.replace(b"WARC-Date", b"X-Date"),
        good.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: -"),
    ):
        with pytest.raises(warc.ArchiveError):
            warc.parse(broken)
    assert warc.parse(good)[0] == "0"


PIECES = {"▁": -2.0, "▁a": -2.5, "a": -1.5, "b": -2.0, "ab": -2.2, "▁ab": -3.0, "<0xC3>": -4.0, "<0xA9>": -5.0}


def plain_probability(text, pieces):
    """Sum over all ways to cut the text."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(text[at:i])
                at = i
        log = 0.0
        for p in parts:
            if p in pieces:
                log += pieces[p]
            elif len(p) == 1:
                log += sum(pieces.get(f"<0x{b:02X}>", min(pieces.values())) for b in p.encode())
            else:
                log = -math.inf
                break
        total += math.exp(log)
    return math.log(total)


@pytest.mark.parametrize("word", ["a", "ab", "abab", "aé", "bbab", "é"])
def test_lattice_sums_all_segmentations(word):
    model = lattice.Lattice(PIECES)
    assert model.log_probability(word) == pytest.approx(plain_probability("▁" + word, PIECES))
    best = model.best(word)
    single = sum(PIECES.get(p, min(PIECES.values())) for p in best)
    assert single <= model.log_probability(word) + 1e-9


def test_long_words_do_not_underflow():
    assert math.isfinite(lattice.Lattice(PIECES).log_probability("ab" * 20_000))


@pytest.mark.parametrize("frequent", [lattice.FREQUENT, 50])
def test_scores(spark, frequent):
    rows = given(100) + odd()
    got = lattice.score_documents(frame(spark, rows), frequent=frequent).collect()
    held = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 == 2
    tokens = [[w.lower() for w in split(r[1])] + [None] for r in rows]
    counts = collections.Counter(t for r, ts in zip(rows, tokens) if not held(r) for t in ts)
    n, v = sum(counts.values()), len(counts)
    want = []
    for r, ts in zip(rows, tokens):
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts)
        known = sum(counts[t] > 0 for t in ts)
        want.append((r[0], held(r), len(ts), known, n, round(base, 4)))
    found = [
        (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got
    ]
    key = lambda t: [(x is None, x) for x in t]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_scores_of_held_out_rows_beat_an_untrained_vocabulary(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = lattice.score_documents(docs).collect()
    own = [r for r in rows if r.held_out]
    per_token = sum(r.score for r in own) / sum(r.n_tokens for r in own)
    assert per_token > -5.5
    none = lattice.score_documents(docs.where("doc_id < 0"))
    assert none.count() == 0
