"""WARC archives of Zstandard frames: a dictionary in front, then one frame per record.

An archive is a value of the ``content`` column, as Spark's ``binaryFile`` reader gives it
too, so archives lie in any store that Spark reaches and need no local files.
"""

import base64
import hashlib
import struct

import zstandard
from pyspark import TaskContext
from pyspark.sql import functions as F

from .common import stage

SKIPPABLE = 0x184D2A5D  # fixed value: the skippable frame that holds the dictionary
FRAME = b"\x28\xb5\x2f\xfd"  # fixed value: first bytes of a Zstandard frame
DICTIONARY = b"\x37\xa4\x30\xec"  # fixed value: first bytes of a dictionary
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

ARCHIVE_BYTES = 8 * 2**20
DICTIONARY_BYTES = 16 * 2**10
SAMPLES = 200
LEVEL = 3
FIRST_PIECE = 2**12
MAX_RECORD = 2**31 - 1

ARCHIVES = "archive STRING, content BINARY"
RECORDS = """archive STRING, position INT, record_id STRING, record_type STRING, url STRING,
    refers_to STRING, payload_digest STRING, payload_bytes BIGINT, payload BINARY"""


def base32_sha1(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def text_id(page_id):
    return "null" if page_id is None else str(page_id)


def clean(value):
    """A header value on one line; its own line breaks become spaces."""
    return " ".join((value or "").splitlines())


def record(page_id, url, payload, refers_to=None, revisit=False):
    """The bytes of one record. A revisit keeps the length and digest of the payload only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
    block %= len(payload)
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{text_id(page_id)}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean(url)),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", f"<urn:page:{text_id(refers_to)}>"),
        ]
    else:
        block += payload
    headers += [
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def pack(records, dictionary_bytes=DICTIONARY_BYTES, level=LEVEL):
    """One archive of the given records; few or tiny records go without a dictionary."""
    dictionary = None
    step = max(1, len(records) // SAMPLES)
    try:
        dictionary = zstandard.train_dictionary(dictionary_bytes, records[::step])
    except zstandard.ZstdError:
        pass  # too little to learn from
    writer = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    parts = []
    if dictionary is not None:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        parts = [struct.pack("<II", SKIPPABLE, len(packed)), packed]
    return b"".join(parts + [writer.compress(r) for r in records])


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def leading_dictionary(content):
    """(dictionary or None, where the records start)."""
    if len(content) < 8 or struct.unpack_from("<I", content)[0] != SKIPPABLE:
        return None, 0
    size = struct.unpack_from("<I", content, 4)[0]
    packed = content[8 : 8 + size]
    if len(packed) != size:
        raise ArchiveError("the dictionary frame is cut off")
    if packed[:4] == FRAME:
        packed = zstandard.ZstdDecompressor().decompressobj().decompress(packed)
    if packed[:4] != DICTIONARY:
        raise ArchiveError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(packed), 8 + size


def frames(content):
    """The decoded frames of an archive in order; later skippable frames are passed over.

    A frame is fed in pieces that double, so what is read beyond its end is no longer than
    itself or the first piece, and an archive takes time in proportion to its length.
    """
    dictionary, at = leading_dictionary(content)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(content)
    while at < len(content):
        if len(content) - at >= 8 and struct.unpack_from("<I", content, at)[0] >> 4 == 0x184D2A5:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        decoder = reader.decompressobj()
        parts, end, piece = [], at, FIRST_PIECE
        try:
            while not decoder.eof and end < len(content):
                parts.append(decoder.decompress(view[end : end + piece]))
                end, piece = min(end + piece, len(content)), 2 * piece
        except zstandard.ZstdError as error:
            raise ArchiveError(f"frame at byte {at}: {error}") from error
        if not decoder.eof:
            raise ArchiveError(f"the frame at byte {at} is cut off")
        at = end - len(decoder.unused_data)
        yield b"".join(parts)


def split_headers(data, first):
    """(headers by lower-case name, what follows the empty line)."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(first):
        raise ArchiveError(f"no {first.decode()} header block")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"bad header line {line[:80]!r}")
        headers[name.strip().lower().decode()] = value.strip().decode()
    return headers, rest


def bare(value):
    """A record id without its angle brackets and scheme."""
    return value.strip("<>").rpartition(":")[2] if value else None


def parse(data):
    """Fields of the one record that a frame must hold; checks lengths and digests."""
    headers, rest = split_headers(data, VERSION)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"a record has no {name}")
    length = headers["content-length"]
    if not length.isdigit() or int(length) > MAX_RECORD:
        raise ArchiveError(f"bad content length {length[:20]}")
    if len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ArchiveError("a frame doesn't end with its record")
    kind = headers["warc-type"]
    http, payload = split_headers(rest[:-4], b"HTTP/")
    size = http.get("content-length", "")
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if not size.isdigit():
        raise ArchiveError("a record has no payload length")
    if kind == "response":
        if int(size) != len(payload) or digest != base32_sha1(payload):
            raise ArchiveError(f"the payload of {headers['warc-record-id']} is not as declared")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise ArchiveError("a revisit holds a payload or refers to nothing")
        payload = None
    else:
        raise ArchiveError(f"unknown record type {kind[:40]}")
    return (
        bare(headers["warc-record-id"]), kind, headers.get("warc-target-uri"),
        bare(headers.get("warc-refers-to")), digest, int(size), payload,
    )


def with_revisits(pages, least_bytes=0):
    """Rows (id, url, payload) with ``digest`` (hex), ``first_id`` (whose response holds the payload) and ``revisit``.

    Of equal payloads of at least ``least_bytes`` that with the largest id is stored. A null
    id counts as the smallest; pages that tie on the largest id are all stored. Digests are
    counted before the join, and only repeated ones are joined, so a hot payload is one row.
    """
    tagged = pages.withColumn("digest", F.sha1("payload"))
    large = F.octet_length("payload") >= least_bytes
    stored = tagged.where(large).groupBy("digest").agg(
        F.max("id").alias("first_id"), F.count("*").alias("count")
    )
    stored = stored.where("count > 1").select("digest", "first_id")
    joined = tagged.join(stored, "digest", "left")
    other = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.withColumn("revisit", other)


def write_archives(pages, key="page_id", url="url", payload="html", least_bytes=0,
                   archive_bytes=ARCHIVE_BYTES):
    """The pages as rows (archive, content), each a WARC of about ``archive_bytes`` before
    compression. A null payload is an empty one, a null url an empty one."""
    plain = pages.select(
        F.col(key).alias("id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"),
    )
    rows = with_revisits(plain, least_bytes)
    longest = archive_bytes

    def write(batches):
        part, held, size, n = TaskContext.get().partitionId(), [], 0, 0
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("id", "url", "payload", "first_id", "revisit")]
            for page_id, address, data, first, revisit in zip(*names):
                held.append(record(page_id, address, data, first, revisit))
                size += len(held[-1])
                if size >= longest:
                    yield archive(part, n, held)
                    held, size, n = [], 0, n + 1
        if held:
            yield archive(part, n, held)

    def archive(part, n, held):
        import pyarrow as pa

        row = {"archive": [f"pages-{part:06d}-{n:05d}.warc.zst"], "content": [pack(held)]}
        return pa.RecordBatch.from_pydict(row, schema=pa.schema([("archive", pa.string()), ("content", pa.binary())]))

    return rows.mapInArrow(write, ARCHIVES)


def read_archives(archives, with_payload=True):
    """Records of archives given as (archive or path, content), one frame each.

    Headers, lengths and digests are checked; the first fault ends the job with an
    ``ArchiveError``. Without ``with_payload`` the payloads are checked and left out.
    """
    name = "archive" if "archive" in archives.columns else "path"
    rows = archives.select(F.col(name).alias("archive"), "content")

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([
            ("archive", pa.string()), ("position", pa.int32()), ("record_id", pa.string()),
            ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()),
            ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
        ])
        for batch in batches:
            for label, content in zip(batch.column(0), batch.column(1)):
                out, size, label = [], 0, label.as_py()
                for position, data in enumerate(frames(content.as_py())):
                    fields = parse(data)
                    kept = fields if with_payload else (*fields[:-1], None)
                    out.append((label, position, *kept))
                    size += len(data) if with_payload else 100
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)

    return rows.mapInArrow(read, RECORDS)


def round_trip(pages, **options):
    """Write the pages as archives into the shared folder and read the records back."""
    return read_archives(stage(write_archives(pages, **options), "warc"), with_payload=False)
