"""Fill-in-middle transformation: outputs put together by a secondary sort of text pieces.

Each text is cut into pieces of a bounded number of units. A piece is keyed by its document
and by its position in the output, so one hash shuffle with a sort inside each partition
(``repartitionAndSortWithinPartitions`` in DataFrame form, which sorts and spills in the
JVM) lets the output stream by in order into an incremental digest. The stream is taken
apart at its marks again, sorted by position in the text inside the same partition, and
streamed into the digest of the restored text. No output is ever held whole unless asked for.
"""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from .common import packed, stage, text_key

MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"plain": (), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
#: Places of the parts in the text.
PARTS = {"prefix": 0, "middle": 1, "suffix": 2}
#: Units and bytes of a piece at most.
PIECE_UNITS = 2048
PIECE_BYTES = 2**15
#: Bytes of rows that a task gathers before it hands them on.
BATCH_BYTES = 2**22
#: Recent rows of a task whose repeats are not sent again.
RECENT = 2**16
SHIFT = 32

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def draws(key, seed):
    """Four 32-bit draws of a document: the first hex digits of the SHA-256 of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def units(data):
    """(first byte of every unit, first byte of every code point) of UTF-8 bytes.

    A unit is a run of ASCII letters or one other code point.
    """
    row = np.frombuffer(data, np.uint8)
    letter = _LETTER[row]
    lead = (row & 0xC0) != 0x80
    start = lead.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(start), np.flatnonzero(lead)


def plan(data, key, seed, rewritten, spm):
    """(units, form, prefix's and middle's code points, {part: (first, last byte, cuts)})."""
    starts, leads = units(data)
    n = len(starts)
    h1, h2, h3, h4 = draws(key, seed)
    edges = np.append(starts, len(data))
    whole = {"text": (0, len(data), edges[::PIECE_UNITS])}
    if not data or h3 % 100 >= rewritten or any(mark in data for mark in MARKS.values()):
        return n, "plain", None, None, whole
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    parts = {
        name: (int(edges[x]), int(edges[y]), edges[x:y:PIECE_UNITS])
        for name, x, y in (("prefix", 0, a), ("middle", a, b), ("suffix", b, n))
    }
    prefix, middle = (int(v) for v in np.searchsorted(leads, (edges[a], edges[b])))
    return n, "spm" if h4 % 100 < spm else "psm", prefix, middle - prefix, parts


def pieces(data, first, last, cuts):
    """The bytes from first to last, cut at the given places and to PIECE_BYTES."""
    bounds = [first, *(int(c) for c in cuts if first < c < last), last]
    for a, b in zip(bounds[:-1], bounds[1:]):
        for at in range(a, b, PIECE_BYTES):
            yield data[at : min(at + PIECE_BYTES, b)]


def output_pieces(data, form, parts):
    """(position, bytes) of an output; the mark of a part leads its first piece."""
    for rank, name in enumerate(ORDERS[form] or ("text",)):
        mark, seq = MARKS.get(name, b""), 0
        for piece in pieces(data, *parts[name]):
            yield rank << SHIFT | seq, mark + piece
            mark, seq = b"", seq + 1
        if not seq:
            yield rank << SHIFT, mark


class Parser:
    """Takes an output apart as it streams by, from its bytes and form alone."""

    def __init__(self, form):
        self.ahead = [(MARKS[name], PARTS[name]) for name in ORDERS[form]]
        self.part, self.tail = 0, b""

    def feed(self, data, last=False):
        """(part's place in the text, bytes) of what can be told so far."""
        data = self.tail + data
        self.tail = b""
        while self.ahead:
            at = data.find(self.ahead[0][0])
            if at < 0:
                break
            if at:
                yield self.part, data[:at]
            data = data[at + 3 :]
            self.part = self.ahead.pop(0)[1]
        if self.ahead and not last:  # a mark may begin in the last two bytes
            cut = max(len(data) - 2, 0)
            data, self.tail = data[:cut], data[cut:]
        if data:
            yield self.part, data


def _batches(rows, schema, size):
    """Arrow batches of about BATCH_BYTES."""
    import pyarrow as pa

    held, total = [], 0
    for row in rows:
        held.append(row)
        total += 64 + size(row)
        if total >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _groups(batches):
    """(first row, iterator of rows) of each run of rows with the same id and text key."""
    import itertools

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for _, group in itertools.groupby(rows(), lambda r: r[:2]):
        first = next(group)
        yield first, itertools.chain([first], group)


HEAD = "_n BIGINT, _form STRING, _prefix BIGINT, _middle BIGINT"


def _cut(rows, seed, rewritten, spm):
    def cut(batches):
        import pyarrow as pa

        seen = {}

        def out():
            for batch in batches:
                ids, keys = batch.column("_id").to_pylist(), batch.column("_text_key").to_pylist()
                for id_, key, data in zip(ids, keys, batch.column("_text").cast(pa.binary())):
                    if (id_, key) in seen:
                        continue
                    seen[id_, key] = None
                    if len(seen) > RECENT:
                        del seen[next(iter(seen))]
                    data = data.as_py() or b""
                    n, form, prefix, middle, parts = plan(data, id_ or "", seed, rewritten, spm)
                    for at, piece in output_pieces(data, form, parts):
                        head = (None, None, None, None) if at else (n, form, prefix, middle)
                        yield (id_, key, at, piece, *head)

        schema = pa.schema([
            ("_id", pa.string()), ("_text_key", pa.int64()), ("_at", pa.int64()), ("_piece", pa.binary()),
            ("_n", pa.int64()), ("_form", pa.string()), ("_prefix", pa.int64()), ("_middle", pa.int64()),
        ])
        yield from _batches(out(), schema, lambda r: len(r[3]))

    return rows.mapInArrow(cut, f"_id STRING, _text_key BIGINT, _at BIGINT, _piece BINARY, {HEAD}")


def _assemble(sorted_pieces, with_text):
    """The output of each document as digest (and text), and its bytes by place in the text."""

    def assemble(batches):
        import pyarrow as pa

        def out():
            for (id_, key, _, _, n, form, prefix, middle), group in _groups(batches):
                digest, parser, seq, last, text = hashlib.sha256(), Parser(form), 0, None, []
                for row in group:
                    if row[2] == last:  # a repeated row
                        continue
                    last = row[2]
                    digest.update(row[3])
                    if with_text:
                        text.append(row[3])
                    for part, data in parser.feed(row[3]):
                        yield id_, key, part << SHIFT | seq, data, None, None, None, None, None, None
                        seq += 1
                for part, data in parser.feed(b"", last=True):
                    yield id_, key, part << SHIFT | seq, data, None, None, None, None, None, None
                whole = b"".join(text).decode() if with_text else None
                yield id_, key, -1, b"", n, form, prefix, middle, digest.hexdigest(), whole

        schema = pa.schema([
            ("_id", pa.string()), ("_text_key", pa.int64()), ("_at", pa.int64()), ("_piece", pa.binary()),
            ("_n", pa.int64()), ("_form", pa.string()), ("_prefix", pa.int64()), ("_middle", pa.int64()),
            ("_digest", pa.string()), ("_output", pa.string()),
        ])
        yield from _batches(out(), schema, lambda r: len(r[3]) + len(r[9] or ""))

    return sorted_pieces.mapInArrow(
        assemble,
        f"_id STRING, _text_key BIGINT, _at BIGINT, _piece BINARY, {HEAD}, _digest STRING, _output STRING",
    )


ADDED = ["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def _restore(sorted_parts):
    def restore(batches):
        import pyarrow as pa

        def out():
            for (id_, key, _, _, n, form, prefix, middle, digest, text), group in _groups(batches):
                restored = hashlib.sha256()
                for row in group:
                    restored.update(row[3])
                yield id_, key, n, form, prefix, middle, digest, restored.hexdigest(), text

        schema = pa.schema([
            ("_id", pa.string()), ("_text_key", pa.int64()), ("n", pa.int64()), ("form", pa.string()),
            ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output_sha256", pa.string()),
            ("restored_sha256", pa.string()), ("output", pa.string()),
        ])
        yield from _batches(out(), schema, lambda r: len(r[8] or ""))

    return sorted_parts.mapInArrow(
        restore,
        "_id STRING, _text_key BIGINT, n BIGINT, form STRING, prefix_chars BIGINT, middle_chars BIGINT, "
        "output_sha256 STRING, restored_sha256 STRING, output STRING",
    )


def fill_in_middle(docs, key="doc_id", text="text", seed=1, rewritten=90, spm=20, with_text=True,
                   carry=None):
    """The documents with ``n``, ``form``, ``prefix_chars``, ``middle_chars``, the digests
    ``output_sha256`` and ``restored_sha256``, and ``output``.

    A text of n units (a run of ASCII letters, or one other code point) is cut after two
    unit counts drawn from its key. Of the texts, ``rewritten`` per cent take the form psm
    (``<P>``prefix``<S>``suffix``<M>``middle), ``spm`` per cent of those the form spm
    (``<S>``suffix``<P>``prefix``<M>``middle); the rest, empty texts and such that hold a
    mark stay plain. ``restored_sha256`` is of the text rebuilt from output and form.

    A null text is an empty one; a null key draws as an empty string does. Rows with equal
    key and text get equal results and are cut once in a task, rows with equal keys and other
    texts are told apart by a 64-bit hash. A very long text travels in pieces of at most
    PIECE_BYTES. An empty table gives an empty frame; input columns with the names of
    added ones are replaced. ``carry`` names the input columns to keep (all). Only
    ``with_text`` gathers an output, of one document at a time.
    """
    added = [*ADDED, *(["output"] if with_text else [])]
    kept = [c for c in carry or docs.columns if c not in added]
    id_, key_ = F.col(key).cast("string").alias("_id"), text_key(F.col(text)).alias("_text_key")
    cut = _cut(docs.select(id_, key_, F.col(text).alias("_text")), seed, rewritten, spm)
    by = ["_id", "_text_key"]
    # the sort for restoration needs no shuffle: each document is in one partition already
    assembled = _assemble(cut.repartition(*by).sortWithinPartitions(*by, "_at"), with_text)
    made = stage(_restore(assembled.sortWithinPartitions(*by, "_at")), "middle")
    rows = docs.select(packed(docs, kept), id_, key_)
    found = rows["_id"].eqNullSafe(made["_id"]) & (rows["_text_key"] == made["_text_key"])
    return rows.join(made, found).select("_row.*", *added)
