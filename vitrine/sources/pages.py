"""Rows of a service or table read as a stream, in pages by (time, id).

The source holds no connection and knows no protocol: a *page reader*, made in each task by
the given factory, answers three questions about rows ordered by (time, id), a mark being such
a pair:

``latest()``
    the greatest mark there is, or None;
``cuts(after, until, rows)``
    marks that cut the rows behind ``after`` up to ``until`` into runs of about ``rows``;
``page(after, until, limit)``
    the first ``limit`` rows of that range in order, each with its mark: (mark, row).
"""

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Rows that one task reads, about, and rows of a page.
ROWS_PER_TASK = 100_000
PAGE_ROWS = 1000
START = (None, None)


class Range(InputPartition):
    """Rows behind one mark up to and with another."""

    def __init__(self, after, until):
        self.after, self.until = after, until


def _offset(mark):
    return {"time": mark[0], "id": mark[1]}


def _mark(offset):
    return None if offset["time"] is None else (offset["time"], offset["id"])


class PageStream(DataSourceStreamReader):
    def __init__(self, factory, rows_per_task, page_rows):
        self.factory, self.rows_per_task, self.page_rows = factory, rows_per_task, page_rows

    def initialOffset(self):
        return _offset(START)

    def latestOffset(self):
        latest = self.factory().latest()
        return _offset(START if latest is None else latest)

    def partitions(self, start, end):
        """Ranges between cuts: each task pages through its own, none through all."""
        after, until = _mark(start), _mark(end)
        if until is None or until == after:
            return []
        inner = [tuple(c) for c in self.factory().cuts(after, until, self.rows_per_task)]
        bounds = [after, *inner, until]
        return [Range(a, b) for a, b in zip(bounds, bounds[1:]) if a != b]

    def read(self, partition):
        reader, after = self.factory(), partition.after
        while True:
            page = reader.page(after, partition.until, self.page_rows)
            for mark, row in page:
                yield tuple(row)
                after = tuple(mark)
            if len(page) < self.page_rows:
                return

    def commit(self, end):
        pass


def page_source(name, factory, schema, rows_per_task=ROWS_PER_TASK, page_rows=PAGE_ROWS):
    """A data source for ``spark.dataSource.register``, then ``readStream.format(name)``.

    Offsets are marks, so a query that is restarted from its checkpoint goes on behind the last
    committed one; a batch that is repeated reads the same range. Rows must not be added
    at or below a mark that ``latest`` has named: a reader over a table with late commits names
    marks older than its longest transaction. A null time or id has no place in the order
    and must be given one by the reader. ``factory`` is called without arguments.
    """

    class PageSource(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def streamReader(self, schema):
            return PageStream(factory, rows_per_task, page_rows)

    return PageSource


def scan_products_stream(spark, factory, schema, name="product_pages", **sizes):
    """The products of a page reader as a stream."""
    spark.dataSource.register(page_source(name, factory, schema, **sizes))
    return spark.readStream.format(name).load()
