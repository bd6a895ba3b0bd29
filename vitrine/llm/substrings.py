"""Substring dedup: repeated windows of words, found by partitioning into super-k-mers.

The minimiser of a window is its word with the least rank, longer words first and then by
hash. Consecutive windows with the same minimiser share a stretch of text, which travels
as one packed string to the bucket of the minimiser's hash. All occurrences of a window
meet there, and sorting tells its first document exactly, by the words themselves.
"""

import hashlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from .common import packed, stage, text_key
from .hashing import gram_hashes, grouped, mix, word_hashes

WINDOW = 13
#: Bytes of packed strings that a task holds before it sends them to their buckets.
HELD_BYTES = 24 * 2**20
#: Buckets per shuffle partition.
BUCKETS = 4
#: Places of packed strings that are compared with their windows at once.
PLACES = 2**15
LONGEST = 31
ID_MAX = np.iinfo(np.int64).max


def ranks(hashes, lengths):
    """Rank of each word as a minimiser: long words are rare, so they make small groups."""
    short = np.uint64(LONGEST) - np.minimum(lengths, LONGEST).astype(np.uint64)
    return (short << np.uint64(58)) | (mix(hashes) >> np.uint64(6))


def stretches(order, text, window):
    """(first word, windows, minimiser's rank) of each run of windows that share one.

    ``order`` has the words' ranks and ``text`` the texts they are in; windows lie within one
    text. Ties go to the leftmost word.
    """
    if len(order) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    view = np.lib.stride_tricks.sliding_window_view(order, window)
    place = view.argmin(axis=1) + np.arange(len(view))
    inside = text[: len(view)] == text[window - 1 :]
    change = np.ones(len(view), bool)
    change[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (text[1 : len(view)] != text[: len(view) - 1])
    first = np.flatnonzero(change)
    count = np.diff(np.append(first, len(view)))
    kept = inside[first]
    return first[kept], count[kept], order[place[first[kept]]]


class Outbox:
    """Packed strings of a task by bucket, sent as compressed blobs when enough are held.

    Equal strings of one task travel once, with the places they were seen at.
    """

    def __init__(self, buckets):
        self.buckets, self.size, self.held = buckets, 0, {}

    def add(self, rank, packed, doc, key, start):
        places = self.held.get((rank, packed))
        if places is None:
            self.held[rank, packed] = [(doc, key, start)]
            self.size += len(packed) + 200
        else:
            places.append((doc, key, start))
            self.size += 60

    def flush(self):
        """(bucket, blob) of everything held."""
        by_bucket = {}
        for (rank, packed), places in self.held.items():
            bucket = (rank & 0x3FFFFFFFFFFFFFF) % self.buckets
            by_bucket.setdefault(bucket, []).append((rank, packed, places))
        self.size, self.held = 0, {}
        writer = zstandard.ZstdCompressor(level=3)
        for bucket, rows in by_bucket.items():
            # in the order of their places, since neighbours compress well
            counts = np.array([len(r[2]) for r in rows], np.int32)
            places = np.array([p for r in rows for p in r[2]], np.int64).reshape(-1, 3)
            strings = b"\n".join(r[1] for r in rows)
            head = np.array([len(rows), len(places), len(strings)], np.int64)
            parts = [
                head, np.array([r[0] for r in rows], np.uint64), counts,
                places[:, 0].copy(), places[:, 1].copy(), places[:, 2].astype(np.int32),
            ]
            blob = b"".join(p.tobytes() for p in parts) + strings
            yield int(bucket), writer.compress(blob)


def opened(blob):
    """(ranks, strings, counts, docs, keys, starts) of a blob."""
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, m, _ = np.frombuffer(data, np.int64, 3)
    at, out = 24, []
    for kind, count in ((np.uint64, n), (np.int32, n), (np.int64, m), (np.int64, m), (np.int32, m)):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return out[0], data[at:].split(b"\n"), *out[1:]


def _packed(docs, buckets, window):
    """(bucket, blob) rows of all super-k-mers."""

    def pack(batches):
        import pyarrow as pa

        def send(rows):
            rows = list(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                names=["bucket", "blob"],
            )

        outbox = Outbox(buckets)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(ID_MAX).to_pylist()
            keys = batch.column("text_key").to_pylist()
            texts = [(i, t.encode()) for i, t in enumerate(batch.column("text").to_pylist()) if t]
            for group in grouped(texts, lambda x: len(x[1])):
                data = [t for _, t in group]
                hashes, text, first, end = word_hashes(data)
                order = ranks(hashes, end - first)
                begin, count, rank = stretches(order, text, window)
                of_text = np.searchsorted(text, np.arange(len(data)))
                joined = b" ".join([w for t in data for w in t.split()])
                edge = np.concatenate([[0], np.cumsum(end - first + 1)])
                owner = text[begin]
                rows = zip(
                    edge[begin].tolist(), (edge[begin + count + window - 1] - 1).tolist(), rank.tolist(),
                    owner.tolist(), (begin - of_text[owner]).tolist(),
                )
                for b, e, r, o, start in rows:
                    at = group[o][0]
                    outbox.add(r, joined[b:e], ids[at], keys[at], start)
                if outbox.size >= HELD_BYTES:
                    yield send(outbox.flush())
        if outbox.held:
            yield send(outbox.flush())

    return docs.mapInArrow(pack, "bucket INT, blob BINARY")


def windows_of(strings, window):
    """(string index, first byte, end byte, hash) of every window in distinct packed strings.

    Windows of one string follow each other; bytes count in the strings joined by line feeds.
    Some strings are hashed at a time, which takes some fifty bytes for each of theirs.
    """
    parts, before, byte = [], 0, 0
    for group in grouped(strings, len):
        hashes, text, first, end = word_hashes(group)
        at = np.flatnonzero(text[: len(text) - window + 1] == text[window - 1 :])
        parts.append((
            text[at] + before, first[at] + byte, end[at + window - 1] + byte, gram_hashes(hashes, window)[at],
        ))
        before, byte = before + len(group), byte + sum(map(len, group)) + len(group)
    return tuple(np.concatenate(c) for c in zip(*parts))


def least_documents(strings, low, window):
    """(string index, least document) of each window, given the least document of each string.

    Hashes bring equal windows together, and their bytes decide: should two differ, all
    windows are told apart by their bytes alone.
    """
    text, first, end, hashes = windows_of(strings, window)
    if not len(text):
        return text, low[:0]
    order = np.argsort(hashes, kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.diff(hashes[order]) != 0
    group = np.cumsum(new) - 1
    least = np.empty(len(order), np.int64)
    least[order] = np.minimum.reduceat(low[text[order]], np.flatnonzero(new))[group]
    more = np.flatnonzero(~new)
    one, other = order[more], order[np.flatnonzero(new)[group[more]]]
    whole = b"\n".join(strings)
    spans = zip(first[one].tolist(), end[one].tolist(), first[other].tolist(), end[other].tolist())
    if any(whole[a:b] != whole[c:d] for a, b, c, d in spans):
        known, own = {}, [whole[a:b] for a, b in zip(first.tolist(), end.tolist())]
        for w, x in zip(own, low[text].tolist()):
            known[w] = min(known.get(w, x), x)
        least = np.array([known[w] for w in own], np.int64)
    return text, least


def repeated(strings, counts, docs, keys, starts, window):
    """(docs, keys, starts) of each window in the given super-k-mers whose words also start
    in a document with a smaller id.

    ``counts`` has the places of each string, the others have them one after the other.
    Strings that several blobs hold are opened once, with all their places.
    """
    number = {}
    own = np.repeat(np.array([number.setdefault(s, len(number)) for s in strings], np.int64), counts)
    distinct = list(number)
    low = np.full(len(distinct), ID_MAX)
    np.minimum.at(low, own, docs)
    text, least = least_documents(distinct, low, window)
    begin = np.searchsorted(text, np.arange(len(distinct)))
    size = np.searchsorted(text, np.arange(len(distinct)), side="right") - begin
    out = []
    for a in range(0, len(own), PLACES):
        some = own[a : a + PLACES]
        place = np.repeat(np.arange(a, a + len(some)), size[some])
        offset = np.arange(len(place)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        hit = docs[place] > least[begin[own[place]] + offset]
        place, offset = place[hit], offset[hit]
        out.append((docs[place], keys[place], starts[place] + offset))
    return tuple(np.concatenate(c) for c in zip(*out))


def _hits(blobs, window):
    """(doc_id, text_key, starts) of repeated windows; one bucket at a time is in memory."""

    def flush(held):
        import pyarrow as pa

        parts = [opened(b) for b in held]
        rank = np.concatenate([p[0] for p in parts])
        strings = [s for p in parts for s in p[1]]
        counts = np.concatenate([p[2] for p in parts])
        docs, keys, starts = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        order = np.argsort(rank, kind="stable")
        edges = np.flatnonzero(np.diff(rank[order], prepend=rank[order[:1]] + np.uint64(1)))
        # only groups that more than one document is in can hold a repeat
        low = np.minimum.reduceat(np.minimum.reduceat(docs, bounds[:-1])[order], edges)
        high = np.maximum.reduceat(np.maximum.reduceat(docs, bounds[:-1])[order], edges)
        several = np.flatnonzero(np.repeat(low != high, np.diff(np.append(edges, len(order)))))
        if not len(several):
            return None
        rows = order[several]
        size = counts[rows]
        place = np.repeat(bounds[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        docs, keys, starts = repeated([strings[r] for r in rows], size, docs[place], keys[place], starts[place], window)
        if not len(docs):
            return None
        order = np.lexsort((keys, docs))
        docs, keys, starts = docs[order], keys[order], starts[order]
        new = np.ones(len(docs), bool)
        new[1:] = (np.diff(docs) != 0) | (np.diff(keys) != 0)
        first = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(first, len(docs)), pa.int32()), pa.array(starts, pa.int32())
        )
        return pa.RecordBatch.from_arrays(
            [pa.array(docs[first], pa.int64()), pa.array(keys[first], pa.int64()), lists],
            names=["doc_id", "text_key", "starts"],
        )

    def search(batches):
        held, bucket = [], None
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                if held and b != bucket:
                    out = flush(held)
                    held = []
                    if out is not None:
                        yield out
                bucket = b
                held.append(blob.as_py())
        if held:
            out = flush(held)
            if out is not None:
                yield out

    return blobs.mapInArrow(search, "doc_id BIGINT, text_key BIGINT, starts ARRAY<INT>")


def _kept(rows, window, with_text):
    """Fields of the documents once the words of the given windows are gone."""
    import pyarrow as pa

    def cut(batches):
        for batch in batches:
            n, removed, digest, kept = [], [], [], []
            for text, starts in zip(batch.column("_text"), batch.column("_starts")):
                words = (text.as_py() or "").encode().split()
                starts = starts.as_py()
                if starts:
                    gone = np.zeros(len(words) + 1, np.int32)
                    for s in {x for part in starts for x in part}:
                        gone[s] += 1
                        gone[s + window] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    left = [w for w, g in zip(words, gone) if not g]
                else:
                    left = words
                joined = b" ".join(left)
                n.append(len(words))
                removed.append(len(words) - len(left))
                digest.append(hashlib.sha256(joined).hexdigest())
                kept.append(joined.decode() if with_text else None)
            place = {"_text", "_starts"}
            columns = [c for name, c in zip(batch.schema.names, batch.columns) if name not in place]
            columns += [pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                columns.append(pa.array(kept, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = rows.drop("_text", "_starts").schema
    schema = schema.add("n_words", "long").add("n_removed", "long").add("kept_sha256", "string")
    if with_text:
        schema = schema.add("kept_text", "string")
    names = schema.names
    return rows.mapInArrow(cut, schema)


def remove_repeats(docs, key="doc_id", text="text", window=WINDOW, buckets=None, with_text=True,
                   carry=None):
    """The documents with ``n_words``, ``n_removed``, ``kept_sha256`` and ``kept_text``.

    A word goes if a window of ``window`` words that covers it also starts in a document
    with a smaller id; windows are judged on the input. Words lie between ASCII white space
    and are compared unchanged. The kept words are joined by one space.

    Ids are integers. A null id counts as the largest, rows with equal ids as one document
    (none of them is the smaller). Null and empty texts, and such of fewer words than a
    window, lose nothing. Repeated rows get equal results, an empty table an empty frame;
    input columns with the names of added ones are replaced. ``carry`` names the input
    columns to keep (all). ``buckets`` should grow with the input: one bucket's super-k-mers
    are held in memory; it is BUCKETS for each shuffle partition unless given.
    """
    spark = docs.sparkSession
    added = ["n_words", "n_removed", "kept_sha256", "kept_text"]
    kept = [c for c in carry or docs.columns if c not in added]
    if buckets is None:
        buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(
        F.col(key).cast("bigint").alias("doc_id"), text_key(F.col(text)).alias("text_key"),
        F.col(text).alias("text"),
    )
    blobs = _packed(rows, buckets, window).repartition("bucket").sortWithinPartitions("bucket")
    hits = stage(_hits(blobs, window), "repeats")
    hits = hits.groupBy("doc_id", "text_key").agg(F.collect_list("starts").alias("_starts"))
    base = docs.select(
        packed(docs, kept), F.coalesce(F.col(key).cast("bigint"), F.lit(int(ID_MAX))).alias("_key"),
        text_key(F.col(text)).alias("_text_key"), F.col(text).alias("_text"),
    )
    found = (base["_key"] == hits["doc_id"]) & (base["_text_key"] == hits["text_key"])
    joined = base.join(hits, found, "left").select("_row", "_text", "_starts")
    cut = _kept(joined, window, with_text)
    return cut.select("_row.*", *cut.columns[1:])
