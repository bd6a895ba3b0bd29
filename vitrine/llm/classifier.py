"""Quality classifier: a convolutional network over the bytes of whole texts, in numpy.

Filters of six bytes slide over overlapping chunks that together cover the text. Each chunk
keeps its largest responses, a small layer combines them, and the mean and maximum over the
chunks give one probability.
"""

import numpy as np
from pyspark.sql import functions as F

WIDTH = 6
FILTERS = 16
HIDDEN = 12
CHUNK = 256
STRIDE = 192

#: Bounds of the sample that the network is fitted on: rows, and chunks of each row.
TRAIN_ROWS = 3000
TRAIN_CHUNKS = 10
EPOCHS = 12
STEPS = 400  # at least so many, however few the rows
BATCH = 64
RATE = 0.01
DECAY = 1e-4
BLOCK_BYTES = 2**19


def chunk_starts(length):
    """First positions of the chunks of a text; the last one ends with the text."""
    last = max(0, length - CHUNK)
    starts = list(range(0, last, STRIDE))
    return [*starts, last]


def padded(data):
    """The bytes with zeros behind, so that every chunk and filter has its full width."""
    return data + bytes(max(CHUNK - len(data), 0) + WIDTH - 1)


def sample_chunks(data, most=TRAIN_CHUNKS):
    """At most ``most`` chunks, spread evenly over the whole text, as one byte string."""
    starts = chunk_starts(len(data))
    if len(starts) > most:
        starts = [starts[i] for i in np.linspace(0, len(starts) - 1, most).astype(int)]
    whole = padded(data)
    return b"".join(whole[s : s + CHUNK + WIDTH - 1] for s in starts)


class Network:
    """Weights, forward and backward pass."""

    def __init__(self, seed=0, prior=0.5):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.layer = rng.normal(0, FILTERS**-0.5, (FILTERS, HIDDEN)).astype(np.float32)
        self.bias = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, HIDDEN**-0.5, 2 * HIDDEN).astype(np.float32)
        self.level = np.full(1, np.log(prior / (1 - prior)), np.float32)

    def weights(self):
        return [self.filters, self.offset, self.layer, self.bias, self.out, self.level]

    def head(self, pooled, owner, count):
        """Probabilities of ``count`` texts from their chunks' responses; owners ascend."""
        hidden = np.maximum(pooled @ self.layer + self.bias, 0)
        starts = np.searchsorted(owner, np.arange(count))
        sizes = np.bincount(owner, minlength=count)[:, None]
        mean = np.add.reduceat(hidden, starts, axis=0) / sizes
        most = np.maximum.reduceat(hidden, starts, axis=0)
        joined = np.concatenate([mean, most], axis=1)
        logit = np.clip(joined @ self.out + self.level, -30, 30)
        return 1 / (1 + np.exp(-logit)), (hidden, starts, sizes, most, joined)

    def gradients(self, chunks, owner, labels):
        """Gradients of the mean log loss over chunks (rows of bytes) of labelled texts."""
        count = len(labels)
        response = np.zeros((len(chunks), CHUNK, FILTERS), np.float32)
        for k in range(WIDTH):
            response += self.filters[k][chunks[:, k : k + CHUNK]]
        best = response.argmax(axis=1)
        raw = np.take_along_axis(response, best[:, None], axis=1)[:, 0] + self.offset
        pooled = np.maximum(raw, 0)
        score, (hidden, starts, sizes, most, joined) = self.head(pooled, owner, count)
        d_logit = ((score - labels) / count).astype(np.float32)
        d_out, d_level = joined.T @ d_logit, d_logit.sum(keepdims=True)
        d_joined = d_logit[:, None] * self.out
        d_hidden = (d_joined[:, :HIDDEN] / sizes)[owner].astype(np.float32)
        top = hidden == most[owner]
        d_hidden += np.where(top, d_joined[:, HIDDEN:][owner], 0) / np.maximum(
            np.add.reduceat(top.astype(np.float32), starts, axis=0)[owner], 1
        )
        d_hidden *= hidden > 0
        d_pooled = (d_hidden @ self.layer.T) * (raw > 0)
        d_filters = np.zeros_like(self.filters)
        row, column = np.arange(len(chunks))[:, None], np.arange(FILTERS)[None, :]
        for k in range(WIDTH):
            np.add.at(d_filters[k], (chunks[row, best + k], column), d_pooled)
        return [d_filters, d_pooled.sum(axis=0), pooled.T @ d_hidden, d_hidden.sum(axis=0), d_out, d_level]

    def fit(self, texts, labels, epochs=EPOCHS, seed=0):
        """Adam over texts given as ``sample_chunks`` gives them."""
        rng, step = np.random.default_rng(seed), 0
        size = CHUNK + WIDTH - 1
        rows = [np.frombuffer(t, np.uint8).reshape(-1, size) for t in texts]
        labels = np.asarray(labels, np.float32)
        first = [np.zeros_like(w) for w in self.weights()]
        second = [np.zeros_like(w) for w in self.weights()]
        epochs = max(epochs, -(-STEPS * BATCH // len(rows)))
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                picked = order[at : at + BATCH]
                chunks = np.concatenate([rows[i] for i in picked])
                owner = np.repeat(np.arange(len(picked)), [len(rows[i]) for i in picked])
                step += 1
                grads = self.gradients(chunks, owner, labels[picked])
                for w, g, a, b in zip(self.weights(), grads, first, second):
                    g = g + DECAY * w
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self

    def tables(self):
        """Responses to byte pairs: three lookups a position instead of six."""
        f = self.filters
        return [
            (f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS)
            for k in range(0, WIDTH, 2)
        ]

    def pooled(self, data, tables):
        """The largest responses of every chunk of a whole text, read in blocks."""
        starts = np.array(chunk_starts(len(data)))
        codes = np.frombuffer(padded(data), np.uint8).astype(np.uint16)
        pairs = (codes[:-1] << np.uint16(8)) | codes[1:]
        out = np.empty((len(starts), FILTERS), np.float32)
        step = max(1, BLOCK_BYTES // STRIDE)
        for at in range(0, len(starts), step):
            own = starts[at : at + step]
            low, high = own[0], own[-1] + CHUNK
            response = tables[0][pairs[low:high]]
            response += tables[1][pairs[low + 2 : high + 2]]
            response += tables[2][pairs[low + 4 : high + 4]]
            bounds = np.empty(2 * len(own), np.int64)
            bounds[0::2], bounds[1::2] = own - low, own - low + CHUNK
            if bounds[-1] == len(response):
                bounds = bounds[:-1]
            out[at : at + step] = np.maximum.reduceat(response, bounds, axis=0)[0::2]
        return np.maximum(out + self.offset, 0)


def held_out(column, folds=5):
    """Whether the key's CRC-32, taken of its text, falls into the fold that is not learned."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == 0


def training_sample(docs, labels, key="doc_id", text="text", label="quality", folds=5,
                    rows=TRAIN_ROWS):
    """At most ``rows`` labelled rows outside the held-out fold as (chunks, label) on the driver.

    Rows are taken in the order of a hash of the key; a key labelled twice counts by its
    least label. The sample of keys is bounded, so it is broadcast to the documents.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key), folds))
    known = known.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    picked = known.orderBy(F.xxhash64("_key"), "_key").limit(rows)
    joined = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(
        F.broadcast(picked), "_key"
    )

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [sample_chunks((t or "").encode()) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").cast(pa.string()), pa.array(texts, pa.binary()), batch.column("_label").cast(pa.int32())],
                names=["key", "chunks", "label"],
            )

    found = joined.mapInArrow(cut, "key STRING, chunks BINARY, label INT")
    found = sorted((r["key"], bytes(r["chunks"]), r["label"]) for r in found.limit(rows).collect())
    return [r[1] for r in found], [r[2] for r in found]


def fit_quality(docs, labels, key="doc_id", text="text", label="quality", folds=5,
                rows=TRAIN_ROWS, epochs=EPOCHS, seed=0):
    """A network fitted on the training sample; without both labels in it, it says how often
    label 1 occurs (a half if nothing is labelled)."""
    texts, marks = training_sample(docs, labels, key, text, label, folds, rows)
    share = sum(marks) / len(marks) if marks else 0.5
    network = Network(seed, min(max(share, 0.01), 0.99))
    if 0 < share < 1 and marks:
        return network.fit(texts, marks, epochs, seed)
    network.out[:] = 0
    return network


def score_quality(docs, network, text="text", score="score"):
    """The documents with ``score``, the probability of label 1 for the whole text.

    A null text counts as an empty one, which has a score as well. All columns are kept;
    one named like the score is replaced. Rows are scored each for itself.
    """
    kept = [c for c in docs.columns if c != score]
    rows = docs.select(*kept, F.col(text).cast("string").alias("_scored_text"))
    schema = rows.drop("_scored_text").withColumn(score, F.lit(0.0)).schema

    def run(batches):
        import pyarrow as pa

        tables = network.tables()
        for batch in batches:
            place = batch.schema.get_field_index("_scored_text")
            pooled = [network.pooled((t.as_py() or "").encode(), tables) for t in batch.column(place)]
            if pooled:
                owner = np.repeat(np.arange(len(pooled)), [len(p) for p in pooled])
                scores = network.head(np.concatenate(pooled), owner, len(pooled))[0]
            else:
                scores = np.zeros(0)
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(scores, pa.float64())], names=[*kept, score]
            )

    return rows.mapInArrow(run, schema)
