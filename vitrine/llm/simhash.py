"""SimHash near-dedup over an inverted index of positional bytes.

Two 64-bit fingerprints that differ in at most two bits share at least six of their eight
positional bytes, so four of the first six. A posting of the index holds the fingerprints
that share a choice of four of those; within it the shared bytes of each pair are tallied
over all eight positions, pairs with six or more are kept, and their bits are compared.
Postings of four bytes, not of one: a posting of one byte has 1/256 of all fingerprints and
pairs that grow with their square. A posting that near copies crowd is split by two
more shared bytes, so what is left differs within 16 bits and is searched in linear time.
"""

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from .common import packed, stage
from .components import connected_components

BITS, BYTES = 2, 8
LEAST_SHARED = BYTES - BITS
#: Positions whose four-byte choices make postings: a pair shares at least four of these.
INDEXED, POSTED = 6, 4
#: Members up to which the pairs of a posting are tallied; beyond, it is split.
TALLIED = 128
#: Shingles whose bits are counted at once.
COUNTED = 2**15
_UPPER = bytes(range(65, 91))
_TO_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())


def fingerprint(data, n=3):
    """SimHash of the ``n``-word shingles of UTF-8 bytes, A-Z lower-cased, as an integer."""
    from xxhash import xxh64_intdigest

    words = data.translate(_TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(n, len(words))
    firsts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    lasts = ends[k - 1 :].tolist()
    total = np.zeros(64, np.int64)
    for at in range(0, len(firsts), COUNTED):
        some = zip(firsts[at : at + COUNTED], lasts[at : at + COUNTED])
        hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in some], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    ones = 2 * total > len(firsts)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def _with_fingerprints(rows, n):
    """The rows with the text replaced by its fingerprint as a signed 64-bit integer."""
    schema = rows.drop("_text").schema.add("_print", "long")

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("_text").cast(pa.binary())
            prints = np.array([fingerprint(t.as_py() or b"", n) for t in texts], np.uint64)
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(c for _, c in rest), pa.array(prints.view(np.int64))], names=[*(c for c, _ in rest), "_print"]
            )

    return rows.mapInArrow(sign, schema)


def _mask(positions):
    """The bytes at the given positions as a signed 64-bit mask."""
    value = sum(0xFF << 8 * p for p in positions)
    return value - 2**64 if value >= 2**63 else value


def _posting(prints, masks):
    return prints.select("_print", F.explode(masks).alias("_mask")).withColumn(
        "_bytes", F.expr("_print & _mask")
    )


def labels(near):
    """Least index in the component of each index, of a symmetric matrix of links."""
    near = near | np.eye(len(near), dtype=bool)
    own = np.arange(len(near))
    while True:
        least = np.where(near, own[None, :], len(near)).min(axis=1)
        least = least[least]
        if (least == own).all():
            return own
        own = least


def tallied(prints):
    """The same for fingerprints: pairs that share enough positional bytes are verified."""
    differ = prints[:, None] ^ prints[None, :]
    shared = (differ.view(np.uint8).reshape(*differ.shape, BYTES) == 0).sum(axis=2)
    near = shared >= LEAST_SHARED
    near &= np.bitwise_count(differ) <= BITS
    return labels(near)


def probed(prints):
    """The same for many distinct fingerprints that share six positional bytes.

    They differ within 16 bits, so each one's neighbours are looked up in a table of those.
    """
    differ = np.bitwise_or.reduce(prints ^ prints[0])
    free = [p for p in range(BYTES) if int(differ) >> 8 * p & 0xFF]
    value = np.zeros(len(prints), np.int64)
    for i, p in enumerate(free):
        value |= (prints >> np.uint64(8 * p) & np.uint64(0xFF)).astype(np.int64) << 8 * i
    place = np.full(2 ** (8 * len(free)), -1, np.int64)
    place[value] = np.arange(len(prints))
    steps = [1 << i for i in range(8 * len(free))]
    steps += [a | b for a, b in combinations(steps, 2)]
    own = np.arange(len(prints))
    while True:
        least = own.copy()
        for step in steps:
            at = place[value ^ step]
            np.minimum(least, np.where(at >= 0, own[at], len(prints)), out=least)
        least = least[least]
        if (least == own).all():
            return own
        own = least


def _runs(batches):
    """Members of each posting, from batches sorted by posting."""
    held, last = [], None
    for batch in batches:
        masks, parts, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        edges = np.flatnonzero((np.diff(masks) != 0) | (np.diff(parts) != 0)) + 1
        for a, b in zip([0, *edges], [*edges, len(prints)]):
            if a == b:
                continue
            if held and last != (masks[a], parts[a]):
                yield np.concatenate(held)
                held = []
            last = (masks[a], parts[a])
            held.append(prints[a:b])
    if held:
        yield np.concatenate(held)


def _links(postings):
    """(a, b) pairs that span the components of each posting."""

    def link(batches):
        import pyarrow as pa

        a, b, size = [], [], 0

        def send():
            columns = [pa.array(np.concatenate(c).view(np.int64)) for c in (a, b)]
            return pa.RecordBatch.from_arrays(columns, names=["a", "b"])

        for members in _runs(batches):
            prints = np.unique(members).view(np.uint64)
            own = tallied(prints) if len(prints) <= TALLIED else probed(prints)
            moved = np.flatnonzero(own != np.arange(len(prints)))
            if len(moved):
                a.append(prints[own[moved]])
                b.append(prints[moved])
                size += len(moved)
            if size > 2**18:
                yield send()
                a, b, size = [], [], 0
        if size:
            yield send()

    return postings.mapInArrow(link, "a BIGINT, b BIGINT")


def linked_prints(prints):
    """Pairs of fingerprints that span all components of links of at most BITS bits.

    Takes a frame of distinct ``_print``. Members of a posting are counted before any are
    gathered: at most TALLIED meet in one, and at most 2^16 in a split one, whatever the input.
    """
    chosen = list(combinations(range(INDEXED), POSTED))
    posted = _posting(prints, F.array(*(F.lit(_mask(c)) for c in chosen)))
    by = ["_mask", "_bytes"]
    counts = posted.groupBy(*by).agg(F.count("*").alias("_members")).where("_members > 1")
    shared = posted.join(stage(counts, "postings"), by)
    small = shared.where(F.col("_members") <= TALLIED)
    # the six ways to share two more bytes
    wider = [
        F.array(*(F.lit(_mask(c + more)) for more in combinations(sorted({*range(BYTES)} - {*c}), 2)))
        for c in chosen
    ]
    wider = F.create_map(*(x for c, w in zip(chosen, wider) for x in (F.lit(_mask(c)), w)))
    crowded = shared.where(F.col("_members") > TALLIED).select("_print", wider[F.col("_mask")].alias("_masks"))
    split = _posting(crowded, F.col("_masks"))
    columns = [*by, "_print"]
    both = small.select(*columns).union(split.select(*columns))
    return _links(both.repartition(*by).sortWithinPartitions(*by))


ADDED = ["fingerprint", "component_id"]


def simhash_components(docs, key="doc_id", text="text", shingle=3, carry=None):
    """The documents with ``fingerprint`` (16 hex digits) and ``component_id``.

    A bit of the fingerprint is set if it is set in over half the XXH64 values (seed 42) of
    the text's shingles, repeats included; a text of fewer words is one shingle, and one
    without words, as a null one, has fingerprint zero, which links like any other.
    Fingerprints link at BITS or fewer differing bits; component_id is the least key that
    can be reached, null keys being the greatest.

    Equal fingerprints are one node. Repeated rows get equal results, an empty table an
    empty frame; input columns with the names of added ones are replaced. ``carry`` names
    the input columns to keep (all).
    """
    kept = [c for c in carry or docs.columns if c not in ADDED]
    rows = docs.select(packed(docs, kept), F.col(key).alias("_key"), F.col(text).alias("_text"))
    signed = stage(_with_fingerprints(rows, shingle), "prints")
    nodes = stage(signed.groupBy("_print").agg(F.min("_key").alias("_least")), "nodes")
    roots = connected_components(stage(linked_prints(nodes.select("_print")), "links"))
    roots = roots.withColumnRenamed("node", "_print")
    rooted = nodes.join(roots, "_print", "left").withColumn("root", F.coalesce("root", "_print"))
    least = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    found = stage(rooted.join(least, "root").select("_print", "component_id"), "found")
    digits = F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint")
    return signed.join(found, "_print").select("_row.*", digits, "component_id")
