"""N-gram Jaccard join: candidates from a MinHash LSH forest, verified exactly.

Each tree of the forest labels a set with a string of min-hashes. Texts are neighbours in a
tree while their labels share a prefix; the matched prefix is shortened from the full
label until the expected recall at the threshold, over all trees, reaches the target.
Sets below one prefix form a subtree and are compared there by their whole signatures, in
blocks, so that no subtree is one task and no list of pairs is written. What remains are
groups of like texts, in which every pair is verified on the shingles themselves.
"""

import numpy as np
from pyspark.sql import functions as F

from .common import packed, same, stage, text_key
from .components import connected_components
from .hashing import grouped, mix, shingle_sets

SHINGLE = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 8
RECALL = 0.99
#: Standard errors of the signature's estimate by which a pair may lie below the threshold.
SLACK = 4.0
SUBTREE_BLOCK = 1024
VERIFY_BLOCK = 256
COLUMNS = 16384


def prefix_length(threshold, trees, depth, recall):
    """The longest prefix whose expected recall at the threshold reaches the target."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError(f"{trees} trees cannot reach a recall of {recall}")


def seeds(trees, depth):
    """Odd multipliers, one for each place of each label."""
    count = np.arange(1, trees * depth + 1, dtype=np.uint64)
    return mix(count * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(sets, multipliers):
    """Min-hashes of non-empty sets, one row per set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), len(multipliers)), np.uint64)
    for k, m in enumerate(multipliers):
        out[:, k] = np.minimum.reduceat(flat * m, starts)
    return mix(out)


def _sketches(rows, trees, depth, prefix, shingle):
    """(doc_id, text_key, n_shingles, set_a, set_b, prefixes, bytes) of every row with words."""
    import pyarrow as pa

    kinds = [("doc_id", rows.schema["doc_id"].dataType.simpleString()), ("text_key", "bigint")]
    schema = ", ".join(f"{c} {t}" for c, t in kinds)
    schema += ", n_shingles BIGINT, set_a BIGINT, set_b BIGINT, prefixes ARRAY<BIGINT>, bytes BINARY"

    def sketch(batches):
        multipliers = seeds(trees, depth)
        for batch in batches:
            texts = [(i, t.encode()) for i, t in enumerate(batch.column("text").to_pylist()) if t]
            for group in grouped(texts, lambda x: len(x[1])):
                sets = shingle_sets([t for _, t in group], shingle)
                kept = [(i, s) for (i, _), s in zip(group, sets) if len(s)]
                if not kept:
                    continue
                sets = [s for _, s in kept]
                marks = signatures(sets, multipliers)
                labels = marks.reshape(len(sets), trees, depth)[:, :, :prefix]
                keys = np.broadcast_to(np.arange(trees, dtype=np.uint64), (len(sets), trees)).copy()
                for d in range(prefix):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + labels[:, :, d])
                picked = pa.array([i for i, _ in kept])
                bounds = pa.array(np.arange(0, keys.size + 1, trees, dtype=np.int32))
                low = np.array([np.bitwise_xor.reduce(mix(s)) for s in sets]).view(np.int64)
                high = np.array([np.add.reduce(mix(s ^ np.uint64(1))) for s in sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(picked), batch.column("text_key").take(picked),
                        pa.array([len(s) for s in sets], pa.int64()), pa.array(low), pa.array(high),
                        pa.ListArray.from_arrays(bounds, pa.array(keys.view(np.int64).ravel())),
                        pa.array([r.tobytes() for r in marks.astype(np.uint8)], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "set_a", "set_b", "prefixes", "bytes"],
                )

    return rows.mapInArrow(sketch, schema)


def _runs(batches, keys):
    """The rows of each run of equal keys as one table, from batches sorted by the keys."""
    import pyarrow as pa

    held, label = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = tuple(c[a] for c in columns)
            if held and own != label:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            label = own
    if held:
        yield pa.Table.from_batches(held)


def _dealt(members, key, block):
    """Members of groups with ``size`` known, once for each pair of blocks they belong to.

    Groups of up to ``block`` are one pair (0, 0); larger ones are cut into blocks by a
    hash of the node, and every two blocks meet in one task.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int")
    rows = members.withColumn("_blocks", blocks).withColumn("side", own)
    rows = rows.withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    rows = rows.withColumns({"i": F.least("side", "_other"), "j": F.greatest("side", "_other")})
    return rows.drop("_blocks", "_other", "size").repartition(key, "i", "j").sortWithinPartitions(
        key, "i", "j"
    )


def _roots(linked):
    """For each row of a symmetric boolean matrix the first row of its component."""
    n = len(linked)
    labels = np.arange(n)
    near = linked | np.eye(n, dtype=bool)
    while True:
        least = np.where(near, labels[None, :], n).min(axis=1)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def _alike_in_subtrees(rows, cut):
    """(a, b): members of a subtree whose signatures agree in a share of ``cut``, chained."""

    def compare(batches):
        import pyarrow as pa

        left, right = [], []
        for table in _runs(batches, ["prefix", "i", "j"]):
            nodes = table.column("node").to_numpy()
            if len(nodes) < 2:
                continue
            marks = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
            marks = marks.reshape(len(nodes), -1)
            linked = np.zeros((len(nodes), len(nodes)), bool)
            for r in range(len(nodes)):
                linked[r] = (marks == marks[r]).mean(axis=1) >= cut
            roots = _roots(linked)
            moved = roots != np.arange(len(nodes))
            left.append(nodes[moved])
            right.append(nodes[roots[moved]])
            if len(left) >= 2000:
                yield pa.RecordBatch.from_arrays([np.concatenate(left), np.concatenate(right)], names=["a", "b"])
                left, right = [], []
        if left:
            yield pa.RecordBatch.from_arrays([np.concatenate(left), np.concatenate(right)], names=["a", "b"])

    return rows.mapInArrow(compare, "a BIGINT, b BIGINT")


def _overlaps(sets):
    """Sizes of the intersections of every two sets, by products of incidence matrices."""
    sizes = np.array([len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[place] > 1
    rank = np.cumsum(counts > 1) - 1
    place, owner = rank[place[shared]], owner[shared]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    width = max(1, min(COLUMNS, 2**22 // len(sets)))
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [at, at + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], place[a:b] - at] = 1
        both += part @ part.T
    return both, sizes


def _verified(rows, threshold, shingle):
    """(a, b, links): members of a group with links, where they hang together, and how many
    links they have within the pair of blocks."""

    def verify(batches):
        import pyarrow as pa

        for table in _runs(batches, ["root", "i", "j"]):
            nodes = table.column("node").to_numpy()
            if len(nodes) < 2:
                continue
            texts = [t.encode() for t in table.column("text").to_pylist()]
            sets = [s for group in grouped(texts, len) for s in shingle_sets(group, shingle)]
            both, sizes = _overlaps(sets)
            linked = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            np.fill_diagonal(linked, False)
            if table.column("i")[0] != table.column("j")[0]:
                side = table.column("side").to_numpy()
                linked &= side[:, None] != side[None, :]
            links = linked.sum(axis=1)
            some = links > 0
            if some.any():
                yield pa.RecordBatch.from_arrays(
                    [nodes[some], nodes[_roots(linked)[some]], links[some].astype(np.int64)],
                    names=["a", "b", "links"],
                )

    return rows.mapInArrow(verify, "a BIGINT, b BIGINT, links BIGINT")


def ngram_classes(docs, key="doc_id", text="text", threshold=THRESHOLD, shingle=SHINGLE,
                  trees=TREES, depth=DEPTH, recall=RECALL):
    """(doc_id, text_key, class_id, class_key, n_copies, n_links) of every row.

    Two rows are linked if the Jaccard similarity of their sets of ``shingle``-word
    shingles is at least ``threshold``; classes are what links connect. ``class_id`` is the
    least id in the class, ``class_key`` the text hash of the row that has it, ``n_links`` the number of other shingle sets that a row's set is
    linked to, ``n_copies`` that of other rows with the same set.

    A text without words (null or empty too) is a class of its own with its own id. Null
    ids are kept; they stand behind all others, and a class of null ids has a null class
    id. Repeated rows are copies. An empty table gives an empty frame.
    """
    prefix = prefix_length(threshold, trees, depth, recall)
    rows = docs.select(
        F.col(key).alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")
    )
    sketched = stage(_sketches(rows, trees, depth, prefix, shingle), "sketches")
    by_set = ["set_a", "set_b"]
    least = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    owners = sketched.groupBy(*by_set).agg(F.min(least).alias("first"), F.count("*").alias("count"))
    owners = owners.select(
        *by_set, F.col("first.doc_id").alias("doc_id"), F.col("first.text_key").alias("text_key"), "count"
    )
    # From here on one node stands for all rows with the same shingles.
    owners = stage(owners.withColumn("node", F.monotonically_increasing_id()), "sets")
    marks = sketched.select("doc_id", "text_key", *by_set, "prefixes", "bytes")
    owned = owners.alias("o").join(
        marks.alias("m"), same(owners, marks, ["doc_id", "text_key", *by_set])
    )
    # rows alike in id and text have equal marks
    owned = owned.select("o.node", "m.prefixes", "m.bytes").dropDuplicates(["node"])
    owned = stage(owned, "marks")
    below = owned.select("node", F.explode("prefixes").alias("prefix"))
    shared = below.groupBy("prefix").agg(F.count("*").alias("size")).where("size > 1")
    members = below.join(shared, "prefix")
    members = members.join(owned.select("node", "bytes"), "node")
    # 1/256 of the bytes agree by chance
    error = (threshold * (1 - threshold) / (trees * depth)) ** 0.5
    cut = threshold - SLACK * error
    pairs = _alike_in_subtrees(_dealt(members, "prefix", SUBTREE_BLOCK), cut)
    groups = stage(connected_components(pairs), "groups")
    sizes = groups.groupBy("root").agg(F.count("*").alias("size"))
    wanted = groups.join(sizes, "root").join(owners.select("node", "doc_id", "text_key"), "node")
    texts = rows.alias("t").join(
        wanted.alias("w"), same(rows, wanted, ["doc_id", "text_key"])
    )
    # equal ids and texts again: one copy is enough
    texts = texts.select("w.root", "w.size", "w.node", "t.text").dropDuplicates(["node"])
    links = stage(_verified(_dealt(texts, "root", VERIFY_BLOCK), threshold, shingle), "links")
    classes = connected_components(links)
    counts = links.groupBy("a").agg(F.sum("links").alias("n_links"))
    tagged = owners.join(classes, "node", "left").join(
        counts.withColumnRenamed("a", "node"), "node", "left"
    )
    tagged = stage(
        tagged.select(
            *by_set, "doc_id", "text_key", F.coalesce("root", "node").alias("root"),
            (F.col("count") - 1).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        ), "classes",
    )
    firsts = tagged.groupBy("root").agg(F.min(least).alias("first")).select(
        "root", F.col("first.doc_id").alias("class_id"), F.col("first.text_key").alias("class_key")
    )
    tagged = tagged.join(firsts, "root").select(
        *by_set, "class_id", "class_key", "n_copies", "n_links"
    )
    known = sketched.select("doc_id", "text_key", *by_set).join(tagged, by_set)
    known = known.select("doc_id", "text_key", "class_id", "class_key", "n_copies", "n_links")
    no_words = rows.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    none = F.lit(0).cast("bigint")
    alone = no_words.select(
        "doc_id", "text_key", F.col("doc_id").alias("class_id"),
        F.col("text_key").alias("class_key"), none.alias("n_copies"), none.alias("n_links"),
    )
    return known.unionByName(alone)


def keep_one(docs, key="doc_id", text="text", **options):
    """The documents without near copies: of each class the row with the least id stays.

    Rows without words are no copies of each other, but of rows alike in id and text one
    stays. All columns are kept; the classes meet the texts by id and text hash.
    """
    classes = ngram_classes(docs, key, text, **options)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    keep = classes.where(first).select("doc_id", "text_key").distinct()
    tagged = docs.select(
        packed(docs, docs.columns), F.col(key).alias("_key"), text_key(F.col(text)).alias("_text_key")
    )
    matches = tagged["_key"].eqNullSafe(keep["doc_id"]) & (tagged["_text_key"] == keep["text_key"])
    kept = tagged.join(keep, matches, "left_semi")
    return kept.dropDuplicates(["_key", "_text_key"]).select("_row.*")
