"""Rows that every operator must take: given documents and odd ones, with clashing columns."""

import random
import re

import duckdb

SMALL = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, "
    "key STRING, words STRING, size INT, shared STRING, node INT, common STRING, spans INT"
)
EXTRA = ("k", "w", 7, "s", 3, "c", 1)
SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def given(limit=60):
    rows = duckdb.sql(
        f"SELECT doc_id, text, lang, source, n_chars FROM '{SMALL}/documents.parquet' ORDER BY 1 LIMIT {limit}"
    ).fetchall()
    return [(*r, *EXTRA) for r in rows]


def odd():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    long_text = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    base = " ".join(f"common{i}" for i in range(60))
    near = base.replace("common30", "changed")
    rows = [
        (9001, None, "en", "src0"),
        (9002, "", "en", None),
        (9003, " \t\n ", None, "src1"),
        (9004, long_text, "xx", "src2"),
        (9005, base, "en", "src0"),
        (9006, base, "en", "src0"),
        (9007, near, "en", "src3"),
        (9008, base + "\n" + base, None, None),
        (9009, "Ünïcode ЖЖ 漢字 😀 " * 12, "de", "src0"),
        (9010, "a", "en", "src0"),
        (9010, "a", "en", "src0"),
        (9011, base, "en", "src0"),
        (9011, near, "en", "src0"),
        (None, base, "en", "src0"),
        (None, near + " more", "en", "src0"),
        (None, None, None, None),
    ]
    return [(*r, None if r[1] is None else len(r[1]), *EXTRA) for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def split(text):
    return [w for w in SPACE.split((text or "").encode()) if w]


def by_row(rows, *names):
    """Rows as sorted tuples of the named fields, nulls last."""
    found = [tuple(r[n] for n in names) for r in rows]
    return sorted(found, key=lambda t: [(v is None, v) for v in t])
