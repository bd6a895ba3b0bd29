"""Commerce-content analytics as Spark jobs.

``functions``  Column expressions (text, urls, scoring, payloads, captions)
``operators``  DataFrame -> DataFrame steps (filters, joins, aggregates, upserts)
``sources``    readers and writers
``plans``      end-to-end jobs put together from the operators
``streaming``  Structured Streaming jobs
``dims``       small fixed dimension tables
"""
