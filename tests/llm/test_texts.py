"""Fill-in-middle, SimHash and phrases against plain versions."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import xxhash
from hypothesis import given as cases
from hypothesis import settings
from hypothesis import strategies as st

from vitrine.llm import middle, phrases, simhash

from .cases import SCHEMA, by_row, frame, given, odd, split

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_middle(key, text):
    text = text or ""
    u = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(u), "plain", None, None, text
    a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h4 % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def marked():
    rows = [(9101, "a <M> mark"), (9102, "<" * 500), (9103, "x<P" * 99), (9104, "P>" * 77), (9105, "a" * 100_000), (9106, "é" * 70_000)]
    return [(k, t, "en", "s", len(t), "k", "w", 7, "s", 3, "c", 1) for k, t in rows]


def test_middle_equals_plain_version(spark):
    rows = given() + odd() + marked()
    made = middle.fill_in_middle(frame(spark, rows)).collect()
    assert len(made) == len(rows)
    want = []
    for r in rows:
        n, form, p, m, output = plain_middle(r[0], r[1])
        of = [hashlib.sha256(x.encode()).hexdigest() for x in (output, r[1] or "")]
        want.append((r[0], r[1], n, form, p, m, *of, output))
    names = ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output"]
    assert by_row(made, *names) == sorted(want, key=lambda t: [(v is None, v) for v in t])
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert all(r["key"] == "k" and r["shared"] == "s" for r in made)


def test_middle_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert middle.fill_in_middle(docs).count() == 0
    clashing = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id INT, text STRING, form STRING, n INT")
    assert middle.fill_in_middle(clashing, with_text=False).columns == ["doc_id", "text", *middle.ADDED]


@settings(max_examples=60, deadline=None)
@cases(st.text("<PSM>a ", max_size=40), st.integers(0, 40), st.integers(0, 40), st.sampled_from(["psm", "spm"]), st.integers(1, 9))
def test_parser_restores_however_the_output_is_cut(text, x, y, form, step):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted((min(x, len(text)), min(y, len(text))))
    p, m, s = text[:a], text[a:b], text[b:]
    output = (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}").encode()
    parser, parts = middle.Parser(form), [b"", b"", b""]
    for i in range(0, len(output), step):
        for part, data in parser.feed(output[i : i + step]):
            parts[part] += data
    for part, data in parser.feed(b"", last=True):
        parts[part] += data
    assert b"".join(parts) == text.encode()


def plain_print(text):
    words = [w.lower() for w in split(text)]
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints):
    """Least index in the component of each fingerprint, by comparing all."""
    own = list(range(len(prints)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            a, b = sorted((find(i), find(j)))
            own[b] = a
    return [find(i) for i in range(len(prints))]


def test_simhash_equals_plain_version(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    near = []
    for i in range(80):
        own = list(words)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(400)] = f"n{rng.randrange(10**6)}"
        near.append((5000 + i, " ".join(own), "en", "s", 1, "k", "w", 7, "s", 3, "c", 1))
    rows = given() + odd() + near
    found = simhash.simhash_components(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    prints = [plain_print(r[1]) for r in rows]
    groups = collections.defaultdict(list)
    roots = least_reachable(prints)
    for r, root in zip(rows, roots):
        groups[root].append(r[0])
    least = {root: min((i for i in ids if i is not None), default=None) for root, ids in groups.items()}
    want = [(r[0], f"{p:016x}", least[root]) for r, p, root in zip(rows, prints, roots)]
    got = by_row(found, "doc_id", "fingerprint", "component_id")
    assert got == sorted(want, key=lambda t: [(v is None, v) for v in t])
    assert len({p for p in prints[-80:]}) > 20 and len({c for _, _, c in want[-80:]}) < 40
    assert simhash.simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0


def crowd(count, bits, seed=2):
    rng = random.Random(seed)
    centre, found = rng.getrandbits(64), set()
    while len(found) < count:
        x = centre
        for _ in range(rng.randrange(bits)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    return sorted(found)


def test_probing_and_tallying_agree_with_all_pairs():
    rng = random.Random(3)
    base = rng.getrandbits(64) & ~0xFF0000FF
    some = sorted({base | rng.getrandbits(8) | rng.getrandbits(8) << 24 for _ in range(120)})
    prints = np.array(some, np.uint64)
    want = least_reachable(some)
    assert simhash.tallied(prints).tolist() == want
    assert simhash.probed(prints).tolist() == want


def test_links_of_a_crowd_lose_nothing(spark):
    """A crowd of fingerprints around one is split by two more bytes and keeps its components."""
    some = crowd(1500, 7) + crowd(200, 5, seed=9)
    signed = [p - 2**64 if p >= 2**63 else p for p in some]
    frame_ = spark.createDataFrame([(p,) for p in signed], "_print BIGINT")
    links = {(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.linked_prints(frame_).collect()}
    place = {p: i for i, p in enumerate(some)}
    own = list(range(len(some)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for a, b in links:
        x, y = sorted((find(place[a]), find(place[b])))
        own[y] = x
    assert [find(i) for i in range(len(some))] == least_reachable(some)
    assert len(links) < 40 * len(some)


def plain_phrases(rows, least=10, covered=50, top=2000):
    counts, sizes = collections.defaultdict(collections.Counter), collections.Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            sizes[lang] += len(words)
            for k in (1, 2, 3):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        kept = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            if len(phrase) == 2 and any(
                len(q) == 3 and phrase in (q[:2], q[1:]) and 100 * b >= covered * a for q, b in f.items() if b >= least
            ):
                continue
            cuts = [(10**6 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return out


NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrases_equal_plain_version(spark):
    rows = given(120) + odd() + [(r[0], r[1], None, *r[3:]) for r in given(40)]
    found = phrases.collocations(frame(spark, rows))
    assert found.columns == NAMES
    want = plain_phrases(rows)
    assert by_row(found.collect(), *NAMES) == sorted(want)
    assert len(want) > 100 and {w[0] for w in want} >= {"en", "und"}


def test_phrases_without_text(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = [r for r in odd() if not (r[1] or "").strip()]
    assert phrases.collocations(frame(spark, blank)).count() == 0


def test_top_is_kept_per_language(spark):
    rows = given(120)
    found = phrases.collocations(frame(spark, rows), top=3).collect()
    assert by_row(found, *NAMES) == sorted(plain_phrases(rows, top=3))


@settings(max_examples=40, deadline=None)
@cases(st.integers(2, 31), st.integers(0, 31), st.data())
def test_packing_can_be_undone(width, bits, data):
    packing = phrases.Packing(width, bits)
    triples = data.draw(st.lists(st.tuples(*[st.integers(0, 2**width - 1)] * 3), min_size=1, max_size=30))
    columns = [np.array(c, np.int64) for c in zip(*triples)]
    quotients, remainders = packing.split(*columns)
    assert quotients.min() >= 0 and quotients.max() < 2**31
    assert len(set(zip(quotients.tolist(), remainders.tolist()))) == len(set(triples))
    for q, r, triple in zip(quotients.tolist(), remainders, triples):
        assert tuple(int(x[0]) for x in packing.join(q, np.array([r], np.uint64))) == triple


def test_filters_merge_and_travel():
    rng = np.random.default_rng(1)
    seen = rng.integers(0, 2**63, 400, dtype=np.uint64)
    parts = [np.unique(rng.choice(seen, 3000), return_counts=True) for _ in range(3)]
    back = [phrases.loaded(phrases.stored(*p)) for p in parts]
    keys, counts = phrases.merged(*(np.concatenate(c) for c in zip(*back)))
    want = collections.Counter()
    for k, c in parts:
        want.update(dict(zip(k.tolist(), c.tolist())))
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(want)
    assert (np.diff(keys) > 0).all()
