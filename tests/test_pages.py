"""The paged stream source over landed files: nothing lost, nothing twice."""

import json
from functools import partial

import pytest

from vitrine.sources.pages import PageStream, scan_products_stream

SCHEMA = "id BIGINT, update_at STRING, name STRING"


class LandedPages:
    """Rows of JSON files in a folder, by (update_at, id)."""

    def __init__(self, folder):
        rows = [json.loads(line) for f in sorted(folder.glob("*.json")) for line in f.read_text().splitlines()]
        self.rows = sorted(((r["update_at"], r["id"]), (r["id"], r["update_at"], r["name"])) for r in rows)

    def _between(self, after, until):
        return [r for r in self.rows if (after is None or r[0] > after) and r[0] <= until]

    def latest(self):
        return self.rows[-1][0] if self.rows else None

    def cuts(self, after, until, rows):
        return [m for m, _ in self._between(after, until)[rows - 1 :: rows]][:-1] if rows else []

    def page(self, after, until, limit):
        return self._between(after, until)[:limit]


def land(folder, name, ids, time):
    folder.mkdir(exist_ok=True)
    rows = [{"id": i, "update_at": f"2024-01-01 00:00:{time(i):02}", "name": f"n{i}"} for i in ids]
    (folder / f"{name}.json").write_text("\n".join(map(json.dumps, rows)))


def test_ranges_cover_everything_once(tmp_path):
    land(tmp_path, "a", range(50), lambda i: i // 10)  # ten rows share a time
    stream = PageStream(partial(LandedPages, tmp_path), rows_per_task=7, page_rows=3)
    start, end = stream.initialOffset(), stream.latestOffset()
    parts = stream.partitions(start, end)
    assert len(parts) == 7
    rows = [list(stream.read(p)) for p in parts]
    assert max(map(len, rows)) <= 14
    assert sorted(r[0] for part in rows for r in part) == list(range(50))
    assert stream.partitions(end, end) == []
    middle = {"time": "2024-01-01 00:00:02", "id": 24}
    rest = [r[0] for p in stream.partitions(middle, end) for r in stream.read(p)]
    assert sorted(rest) == list(range(25, 50))


def test_no_rows(tmp_path):
    stream = PageStream(partial(LandedPages, tmp_path), 7, 3)
    assert stream.latestOffset() == stream.initialOffset()
    assert stream.partitions(stream.initialOffset(), stream.latestOffset()) == []


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    source, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()
    factory = partial(LandedPages, source)

    def run(fails=False):
        def store(batch, batch_id):
            if fails:
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

        stream = scan_products_stream(spark, factory, SCHEMA, rows_per_task=10, page_rows=4)
        query = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    land(source, "1", range(30), lambda i: i // 6)
    assert run() == list(range(30))
    land(source, "2", range(30, 55), lambda i: i // 6)  # some at a time that was read before
    with pytest.raises(Exception, match="lost"):
        run(fails=True)
    land(source, "3", range(55, 60), lambda i: 30)
    assert run()[:55] == list(range(55))  # the lost batch comes again
    for _ in range(2):  # the next run goes on behind it
        assert run() == list(range(60))
