"""Fuzzy line dedup: MinHash of character shingles, exact Jaccard, distributed union-find.

A line's shingles are its windows of ten characters, lower-cased and with single spaces.
Every line is signed on all of them. Band keys bring lines together; there each is compared
with one line per round, drawn anew, and only with lines that it doesn't hang together with
yet. Of the pairs left between components the likeliest of each two components is compared
first, then the rest of those still apart. Before any text is read, a pair must agree in
enough of the min-hashes of a longer signature that lines sharing a band get, and in size.
Signatures and comparisons of texts are numpy inside tasks; Spark deals out the lines, bands
and pairs.
"""

from functools import reduce
from math import comb

import numpy as np
from pyspark.sql import functions as F

from ..session import delete_folder, run_dir
from .common import packed, stage, text_key
from .components import connected_components
from .hashing import BASE, INVERSE, grouped, mix, powers

SHINGLE = 10
THRESHOLD = 0.8
#: 13 bands of 4: at the threshold a pair shares a band with a probability of 0.9989.
HASHES = 52
ROWS = 4
#: Min-hashes, independent of those of the bands, by which a pair is judged before its texts
#: are read, and the probability that this loses a pair at the threshold.
SKETCH = 126
MISS = 1e-6
#: A min-hash of a sketch is a byte; seven to a value leave the sum of two bytes room.
PACK = 7
SEVENS = 0x007F7F7F7F7F7F7F
TOPS = 0x0080808080808080
ROUNDS = 2
#: Rounds go on while one finds more links than this share of the lines in bands.
MORE_ROUNDS = 0.001
#: Ids of candidate lines are broadcast up to so many; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Bytes that one character takes while its line is hashed.
CHAR_BYTES = 8


def plain_line(line):
    """Lower-cased, trimmed, each run of ASCII white space one space."""
    # most lines have single spaces only and need no replacing
    spaced = F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")
    return F.trim(F.lower(F.when(line.rlike(r"[\x09-\x0D]|  "), spaced).otherwise(line)))


def occurrences(docs, key="doc_id", text="text"):
    """(doc_id, text_key, pos, line) of every line with a word, positions from 0."""
    lines = F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "raw")
    rows = docs.select(F.col(key).alias("doc_id"), text_key(F.col(text)).alias("text_key"), lines)
    rows = rows.where(F.col("raw").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select("doc_id", "text_key", "pos", plain_line(F.col("raw")).alias("line"))


def line_id(line):
    """64-bit hash that stands for all equal lines."""
    return F.xxhash64(line)


def window_hashes(lines, shingle=SHINGLE):
    """(hashes, starts): a hash for each window of every line, those of a line together, and
    where those of each line start. A line shorter than a window is one."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    n = len(codes)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * powers(BASE, n), out=sums[1:])
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    ends = np.cumsum(sizes)
    counts = np.maximum(sizes - shingle + 1, 1)
    starts = np.cumsum(counts) - counts
    first = np.arange(counts.sum()) + np.repeat(ends - sizes - starts, counts)
    last = first + np.repeat(np.minimum(sizes, shingle), counts)
    return mix((sums[last] - sums[first]) * powers(INVERSE, n + 1)[first]), starts


def min_hashes(found, starts, hashes, before=0):
    """``hashes`` minima of each line, by the multipliers behind the first ``before``."""
    found = (found >> np.uint64(32)).astype(np.uint32)
    numbers = np.arange(before + 1, before + hashes + 1, dtype=np.uint64)
    multipliers = (mix(numbers * BASE) | np.uint64(1)).astype(np.uint32)
    mins = np.empty((len(starts), hashes), np.uint64)
    for i, m in enumerate(multipliers):
        mins[:, i] = np.minimum.reduceat(found * m, starts)
    return mins


def signed_bands(lines, shingle=SHINGLE, hashes=HASHES, rows=ROWS):
    """A key for each ``rows`` min-hashes of all windows, one row of keys per line."""
    mins = min_hashes(*window_hashes(lines, shingle), hashes)
    mins = mins.reshape(len(lines), hashes // rows, rows)
    keys = np.broadcast_to(np.arange(hashes // rows, dtype=np.uint64), mins.shape[:2]).copy()
    for r in range(rows):
        keys = mix(keys * BASE + mins[:, :, r])
    return keys.view(np.int64)


def _decoded(column):
    return [x.decode("utf-8", "replace") for x in column.to_pylist()]


def signed_occurrences(seen, shingle=SHINGLE, hashes=HASHES, rows=ROWS):
    """(doc_id, text_key, pos, id, line, bands) of every occurrence; ``line`` is null and
    ``bands``, the band keys of the line, is empty where the same batch has them already."""

    def sign(batches):
        import pyarrow as pa

        for batch in batches:
            ids = batch.column("id").to_numpy()
            firsts = np.sort(np.unique(ids, return_index=True)[1])
            texts = _decoded(batch.column("line").take(pa.array(firsts)))
            groups = grouped(texts, lambda x: CHAR_BYTES * len(x))
            keys = [signed_bands(g, shingle, hashes, rows).ravel() for g in groups]
            new = np.zeros(len(ids), bool)
            new[firsts] = True
            ends = np.concatenate([[0], np.cumsum(new * (hashes // rows))]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*keys, ids[:0]])))
            line = batch.column("line").take(pa.array(np.arange(len(ids)), mask=~new))
            places = [batch.column(c) for c in ("doc_id", "text_key", "pos", "id")]
            yield pa.RecordBatch.from_arrays([*places, line, bands], names=names)

    each = seen.where("line IS NOT NULL").select(
        "doc_id", "text_key", "pos", line_id(F.col("line")).alias("id"), F.col("line").cast("binary").alias("line")
    )
    # both added columns may lack a value
    added = [F.lit(None).cast(kind).alias(c) for c, kind in (("line", "binary"), ("bands", "array<bigint>"))]
    schema = each.drop("line").select("*", *added).schema
    names = schema.names
    return each.mapInArrow(sign, schema)


def distinct_windows(lines, shingle=SHINGLE):
    """(sets, ends): the sorted distinct window hashes of each line, those of a line together,
    and where those of each line end."""
    found, starts = window_hashes(lines, shingle)
    bits = np.uint64(max(1, (len(lines) - 1).bit_length()))
    owner = np.repeat(np.arange(len(lines), dtype=np.uint64), np.diff(starts, append=len(found)))
    # the number of the line stands before the hash
    keys = np.sort(owner << np.uint64(64) - bits | found >> bits)
    keys = keys[np.diff(keys, prepend=~keys[:1]) != 0]
    sizes = np.bincount((keys >> np.uint64(64) - bits).astype(np.int64), minlength=len(lines))
    return keys << bits, np.cumsum(sizes)


def sketched(lines, shingle=SHINGLE, hashes=SKETCH, before=HASHES):
    """(windows, sketch): how many distinct windows each line has, and a byte of each of
    ``hashes`` min-hashes, PACK to a value."""
    found, starts = window_hashes(lines, shingle)
    mins = mix(min_hashes(found, starts, hashes, before)).astype(np.uint8)
    rows = np.zeros((len(lines), hashes // PACK, 8), np.uint8)
    rows[:, :, :PACK] = mins.reshape(len(lines), hashes // PACK, PACK)
    windows = np.diff(distinct_windows(lines, shingle)[1], prepend=0)
    return windows, rows.view("<i8")[:, :, 0]


def line_sketches(texts, shingle=SHINGLE, hashes=SKETCH, before=HASHES):
    """(id, sketch): a struct of the line's distinct windows ``n`` and its sketch s0, s1, ..."""
    names = ["n", *[f"s{i}" for i in range(hashes // PACK)]]

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(batch.column("id").to_pylist(), _decoded(batch.column("line"))))
            for group in grouped(rows, lambda x: CHAR_BYTES * len(x[1])):
                windows, values = sketched([x for _, x in group], shingle, hashes, before)
                columns = [pa.array(np.ascontiguousarray(c)) for c in (windows, *values.T)]
                ids = pa.array([i for i, _ in group], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", *names])

    rows = texts.select("id", F.col("line").cast("binary").alias("line"))
    rows = rows.mapInArrow(sketch, ", ".join(f"{c} BIGINT" for c in ["id", *names]))
    return rows.select("id", F.struct(*names).alias("sketch"))


def least_agreement(threshold, hashes=SKETCH, miss=MISS):
    """The most min-hashes that may be asked for, so that a pair at the threshold has fewer
    in common with a probability of at most ``miss``."""
    below = 0.0
    for k in range(hashes + 1):
        below += comb(hashes, k) * threshold**k * (1 - threshold) ** (hashes - k)
        if below > miss:
            return k
    return hashes


def agreement(left, right, hashes=SKETCH):
    """How many min-hashes two sketches have in common, as a column expression."""
    differ = []
    for i in range(hashes // PACK):
        x = F.col(f"{left}.s{i}").bitwiseXOR(F.col(f"{right}.s{i}"))
        # the top bit of a byte tells whether it differs
        apart = (x.bitwiseAND(F.lit(SEVENS)) + F.lit(SEVENS)).bitwiseOR(x).bitwiseAND(F.lit(TOPS))
        differ.append(F.bit_count(apart))
    return F.lit(hashes) - reduce(lambda a, b: a + b, differ)


def _may_be_alike(left, right, threshold):
    """Whether the sizes allow the threshold and the sketches agree often enough."""
    x, y = F.col(f"{left}.n"), F.col(f"{right}.n")
    sizes = F.least(x, y) >= F.lit(threshold) * F.greatest(x, y) - F.lit(1e-9)
    return sizes & (agreement(left, right) >= least_agreement(threshold))


def alike(left, right, threshold=THRESHOLD, shingle=SHINGLE):
    """Whether the lines of each pair have at least the threshold's Jaccard similarity."""
    # a line of many pairs is cut into windows once
    place = {x: i for i, x in enumerate(dict.fromkeys([*left, *right]))}
    sets, ends = distinct_windows(list(place), shingle)
    starts = np.concatenate([[0], ends[:-1]])
    bits = np.uint64(max(1, (len(left) - 1).bit_length()))
    pair = np.arange(len(left), dtype=np.uint64)

    def keys(lines):
        at = np.fromiter((place[x] for x in lines), np.int64, len(lines))
        sizes = ends[at] - starts[at]
        before = np.cumsum(sizes) - sizes
        taken = np.arange(sizes.sum()) + np.repeat(starts[at] - before, sizes)
        return np.repeat(pair << np.uint64(64) - bits, sizes) | sets[taken] >> bits, sizes

    (x, n), (y, m) = keys(left), keys(right)
    every = np.sort(np.concatenate([x, y]))
    both = every[1:][every[1:] == every[:-1]] >> np.uint64(64) - bits
    shared = np.bincount(both.astype(np.int64), minlength=len(left))
    return shared >= threshold * (n + m - shared) - 1e-9


def _verified(pairs, lines, threshold, shingle):
    """The pairs (a, b) whose lines have at least the threshold's Jaccard similarity."""

    def verify(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(_decoded(batch.column("left")), _decoded(batch.column("right"))))
            groups = grouped(rows, lambda x: CHAR_BYTES * (len(x[0]) + len(x[1])))
            found = [alike([x for x, _ in g], [y for _, y in g], threshold, shingle) for g in groups]
            if found:
                near = batch.select(["a", "b"]).filter(pa.array(np.concatenate(found)))
                if near.num_rows:
                    yield near

    of = lambda node, line: lines.select(
        F.col("id").alias(node), F.col("line").cast("binary").alias(line)
    )
    both = pairs.select("a", "b").join(of("a", "left"), "a").join(of("b", "right"), "b")
    return both.select("a", "b", "left", "right").mapInArrow(verify, "a BIGINT, b BIGINT")


def _near(pairs, sketches, threshold):
    """The pairs (a, b) whose sizes and sketches let them reach the threshold."""
    of = lambda node, name: sketches.select(F.col("id").alias(node), F.col("sketch").alias(name))
    both = pairs.join(of("a", "_x"), "a").join(of("b", "_y"), "b")
    return both.where(_may_be_alike("_x", "_y", threshold)).select("a", "b")


def _rooted(rows, known):
    """The rows with the component that their ``id`` is in so far."""
    if known is None:
        return rows.withColumn("root", F.col("id"))
    roots = known.select(F.col("a").alias("id"), F.col("b").alias("_root"))
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("_root", "id")).drop("_root")


def _stars(edges):
    """(a, b): every linked line with the least one of its component, itself with itself."""
    return stage(connected_components(edges).select(F.col("node").alias("a"), F.col("root").alias("b")), "line-components")


def _of_mixed(members, sketches):
    """The members of bands with lines of several components, with their sketches and
    all such bands of their line."""
    mixed = members.groupBy("band").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    mixed = mixed.where("least <> most").select("band")
    some = stage(members.join(mixed, "band", "left_semi"), "line-mixed")
    own = some.groupBy("id").agg(F.collect_list("band").alias("bands")).join(sketches, "id")
    return stage(some.join(own, "id"), "line-mixed")


def _across(members, threshold=None):
    """The pairs (a, b) of lines of a band that lie in different components.

    The components of a band are paired first, so that lines of one component never are, and
    the lines of the smaller one are looked up first. With a threshold only pairs stay whose
    sketches let them reach it, each in the least band that its lines share, with their
    components ``low`` and ``high`` and the number of min-hashes in common, ``agree``.
    """
    roots = stage(members.groupBy("band", "root").agg(F.count("*").alias("n")), "line-roots")
    of = lambda root: roots.select("band", F.col("root").alias(root), F.col("n").alias(f"_{root}"))
    both = of("few").join(of("many"), "band").where(F.struct("_few", "few") < F.struct("_many", "many"))
    both = both.select("band", "few", "many")
    held = [c for c in members.columns if c in ("sketch", "bands")]
    of = lambda root, node: members.select(
        "band", F.col("root").alias(root), F.col("id").alias(node), *[F.col(c).alias(f"_{node}_{c}") for c in held]
    )
    pairs = both.join(of("few", "x"), ["band", "few"]).join(of("many", "y"), ["band", "many"])
    names = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    if threshold is None:
        return pairs.select(*names).distinct()
    shared = F.array_min(F.array_intersect("_x_bands", "_y_bands"))
    pairs = pairs.where(_may_be_alike("_x_sketch", "_y_sketch", threshold) & (shared == F.col("band")))
    ends = [F.least("few", "many").alias("low"), F.greatest("few", "many").alias("high")]
    return pairs.select(*names, *ends, agreement("_x_sketch", "_y_sketch").alias("agree"))


def _links_across(members, known, texts, threshold, shingle):
    """The links found so far and those between their components, as far as they join any."""
    pairs = stage(_across(members, threshold), "line-across")
    likeliest = F.max_by(F.struct("a", "b"), F.struct("agree", "a", "b"))
    first = pairs.groupBy("low", "high").agg(likeliest.alias("p")).select("p.*").distinct()
    known = _stars(known.union(stage(_verified(first, texts, threshold, shingle), "line-found")))
    of = lambda name: known.select(F.col("a").alias(name), F.col("b").alias(f"_{name}"))
    # what two components hang on is the same for all pairs between them
    apart = pairs.join(of("low"), "low", "left").join(of("high"), "high", "left")
    apart = apart.where(F.coalesce("_low", "low") != F.coalesce("_high", "high"))
    rest = apart.select("a", "b").join(first, ["a", "b"], "left_anti")
    return known.union(_verified(rest, texts, threshold, shingle))


def fuzzy_classes(seen, threshold=THRESHOLD, shingle=SHINGLE, hashes=HASHES, rows=ROWS,
                  rounds=ROUNDS):
    """(classes, places): (node, root) of the distinct lines that hang together with another,
    and (doc_id, text_key, pos, id) of every occurrence.

    ``seen`` are ``occurrences``; ``root`` is the least id of a component.
    """
    spark = seen.sparkSession
    path = run_dir(spark, "line-bands")
    signed = signed_occurrences(seen, shingle, hashes, rows)
    signed.write.option("compression", "zstd").parquet(path)
    signed = spark.read.schema(signed.schema).parquet(path)
    # dealt out by band once, for the counts and for what is looked up in them
    keyed = signed.select("id", F.explode("bands").alias("band")).repartition("band")
    shared = keyed.groupBy("band").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    shared = shared.where("least <> most").select("band")
    bucketed = stage(keyed.join(shared.hint("shuffle_hash"), "band").distinct(), "line-buckets")
    wanted = stage(bucketed.select("id").distinct(), "line-ids")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = signed.where("line IS NOT NULL").select("id", "line").join(wanted, "id", "left_semi")
    # equal lines are one
    texts = stage(texts.groupBy("id").agg(F.first("line").alias("line")), "line-texts")
    places = stage(signed.drop("line", "bands"), "line-occurrences")
    # all that is still read of the largest table is written
    delete_folder(spark, path)
    sketches = stage(line_sketches(texts, shingle, SKETCH, hashes), "line-sketches")
    known, turn, more = None, 0, True
    members = _rooted(bucketed, None)
    while more:
        drawn = F.min(F.struct(F.xxhash64("band", "id", F.lit(turn)).alias("h"), "id", "root"))
        heads = members.groupBy("band").agg(drawn.alias("head"))
        pairs = members.join(heads, "band").where("root <> head.root")
        pairs = pairs.select(F.least("id", "head.id").alias("a"), F.greatest("id", "head.id").alias("b"))
        near = _near(pairs.distinct(), sketches, threshold)
        found = stage(_verified(near, texts, threshold, shingle), "line-found")
        # what is known already goes on as stars, which take few rounds to join
        known = _stars(found if known is None else known.union(found))
        members = stage(_rooted(bucketed, known), "line-members")
        turn += 1
        more = turn < rounds or found.count() > MORE_ROUNDS * bucketed.count()
    links = _links_across(_of_mixed(members, sketches), known, texts, threshold, shingle)
    return connected_components(stage(links, "line-links")), places


def removed_lines(docs, key="doc_id", text="text", **options):
    """(doc_id, text_key, removed): positions (from 0) of the lines that go, where any do.

    Of each class of like lines the first occurrence, by id and then position, stays.
    """
    seen = occurrences(docs, key, text)
    classes, places = fuzzy_classes(seen, **options)
    places = places.join(classes.withColumnRenamed("node", "id"), "id", "left")
    places = stage(
        places.select("doc_id", "text_key", "pos", F.coalesce("root", "id").alias("root")), "line-places"
    )
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "pos")
    firsts = places.groupBy("root").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    firsts = firsts.where("n > 1").select("root", "first")
    later = places.join(firsts, "root")
    is_first = (
        F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
        & (F.col("text_key") == F.col("first.text_key"))
        & (F.col("pos") == F.col("first.pos"))
    )
    gone = later.where(~is_first).groupBy("doc_id", "text_key")
    return gone.agg(F.sort_array(F.collect_set("pos")).alias("removed"))


def dedup_lines(docs, key="doc_id", text="text", carry=None, **options):
    """The documents with ``n_lines``, ``n_removed``, ``removed`` and ``kept_text``.

    Lines without a word are no lines: they are not counted and always stay. ``removed``
    lists positions from 0 among all lines of the text. Null and empty texts have no lines;
    a null id stands behind all others; rows alike in id and text are one document and get
    equal results; an empty table gives an empty frame. Input columns with the names of added
    ones are replaced. ``carry`` names the input columns to keep (all).
    """
    added = ["n_lines", "n_removed", "removed", "kept_text"]
    kept = [c for c in carry or docs.columns if c not in added]
    gone = removed_lines(docs, key, text, **options)
    lines = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    some = F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("bigint")
    base = docs.select(
        packed(docs, kept), F.col(key).alias("_key"), text_key(F.col(text)).alias("_text_key"),
        F.col(text).alias("_text"), some.alias("n_lines"),
    )
    found = base["_key"].eqNullSafe(gone["doc_id"]) & (base["_text_key"] == gone["text_key"])
    none = F.expr("cast(array() as array<int>)")
    rows = base.join(gone, found, "left").select(
        "_row", "_text", "n_lines", F.coalesce("removed", none).alias("removed")
    )
    left = F.expr("filter(split(_text, '\\n', -1), (x, i) -> NOT array_contains(removed, i))")
    return rows.withColumns(
        {
            "n_removed": F.size("removed").cast("bigint"),
            "kept_text": F.when(F.size("removed") == 0, F.col("_text")).otherwise(F.array_join(left, "\n")),
        }
    ).select("_row.*", *added)
