"""The pipeline against a plain version of its stages, and its entry."""

import collections
import hashlib

import __spark_entry__ as entry
import corpus_pipeline
from vitrine.llm import classifier

from .cases import SMALL, frame, odd, split
from .test_copies import plain_classes
from .test_filters import plain_decontamination
from .test_records import plain_targets, points


def plain_mix(rows):
    """How often each row is read: by the order of the shuffled sources and their targets."""
    sizes, streams, times = collections.Counter(), collections.defaultdict(list), {}
    for r in rows:
        sizes[r.source] += len(split(r.text))
        streams[r.source].append(r)
    targets = plain_targets(sizes)
    for source, own in streams.items():
        own.sort(key=lambda r: hashlib.md5(f"0|{r.doc_id}".encode()).hexdigest())
        quota, at = int(targets[source] + 0.5), 0
        for r in own:
            n = len(split(r.text))
            taken = sum(
                max(0, min(quota, start + n) - start) for start in (at, sizes[source] + at)
            )
            times[r.doc_id] = int(taken / n + 0.5) if n else 0
            at += n
    return times


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    network = classifier.fit_quality(docs, labels)
    scored = classifier.score_quality(docs, network).collect()
    rows = [r for r in scored if r.score >= 0.3]
    firsts = {c["doc_id"]: c["class_id"] for c in plain_classes([(r.doc_id, r.text) for r in rows])}
    rows = [r for r in rows if firsts[r.doc_id] == r.doc_id]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [r for r in rows if not plain_decontamination(r.text, items)[3]]
    want = collections.Counter()
    for doc, n in plain_mix(rows).items():
        scores = points(doc, corpus_pipeline.SHARDS)
        if n:
            want[doc, scores.index(min(scores))] = n
    found = corpus_pipeline.run(spark, SMALL).collect()
    assert 0 < len(rows) < len(scored)
    assert collections.Counter((r.doc_id, r.shard) for r in found) == want
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_stages_take_odd_rows_and_none(spark):
    for rows in (odd(), []):
        docs = frame(spark, rows).drop("words", "key")
        columns = docs.columns
        for name, function in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stage(function(spark, docs, SMALL), f"test-{name}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert docs.columns == columns
        if not rows:
            assert docs.count() == 0


def test_mixing_keeps_columns_of_any_name(spark):
    """Input columns named like those the mix works on come out as they went in."""
    rows = [(i, "w " * (10 + i), f"s{i % 2}", -i, "x", 5) for i in range(40)]
    docs = spark.createDataFrame(
        rows, "doc_id BIGINT, text STRING, source STRING, size BIGINT, _times STRING, start INT"
    )
    found = corpus_pipeline.mixing_stage(spark, docs, SMALL)
    assert found.columns == docs.columns
    found = found.collect()
    assert found and {tuple(r) for r in found} <= set(rows)


def test_entry_has_every_operator():
    names = entry.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)
