"""Phrase collocation mining with counting quotient filters.

Words of a chunk of texts get numbers of the chunk first, and the numbers of the corpus by a
join of the chunk's distinct words with the counted vocabulary, so no token is shuffled by
its word. Pairs and triples of word numbers are packed, permuted by an invertible mixing,
and split into a quotient, which names the filter, and the full remainder: nothing is lost, so
the counters are exact and the words come back out. A task keeps each filter as sorted
remainders with counters; filters of the same quotient are merged by their order.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import stage
from .hashing import mix

BREAKS = b".,;:!?\n\v\f\r"
NO_LANGUAGE = "und"
#: Bytes of one language that a task gathers into a chunk; a longer text makes one alone.
CHUNK_BYTES = 2**23
#: Entries that a task counts before it hands its filters on.
HELD = 2**21
#: Entries that one quotient gets on average, at most.
PER_QUOTIENT = 2**20
#: Parts of the vocabulary that are numbered side by side.
NUMBERED = 256
_STOP = b"\xff"  # in no UTF-8 text
_UPPER = bytes(range(65, 91))
_TABLE = bytes.maketrans(_UPPER + BREAKS + b"\t", _UPPER.lower() + _STOP * len(BREAKS) + b" ")


class Numbers(dict):
    """Consecutive numbers, from 0, for what is asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def numbered_tokens(texts):
    """(distinct words, counts, word numbers by token) of UTF-8 texts; 0 is a break."""
    numbers = Numbers({_STOP: 0})
    data = (b" " + _STOP + b" ").join(t.translate(_TABLE) for t in texts)
    tokens = data.replace(_STOP, b" " + _STOP + b" ").split()
    found = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
    counts = np.bincount(found, minlength=len(numbers))
    return list(numbers)[1:], counts[1:], found


CHUNKS = "chunk BIGINT, lang STRING, n BIGINT, words ARRAY<STRING>, counts ARRAY<BIGINT>, tokens BINARY"


def _chunks(docs):
    """Rows of CHUNKS: the texts of a language in a task, as numbers of the chunk's words."""

    def cut(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        held, made = {}, 0

        def send(lang):
            nonlocal made
            words, counts, tokens = numbered_tokens(held.pop(lang)[0])
            number = TaskContext.get().partitionId() << 32 | made
            made += 1
            blob = zstandard.compress(tokens.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number]), pa.array([lang]), pa.array([int(counts.sum())]),
                    pa.array([[w.decode() for w in words]], pa.list_(pa.string())),
                    pa.array([counts], pa.list_(pa.int64())), pa.array([blob], pa.binary()),
                ],
                names=["chunk", "lang", "n", "words", "counts", "tokens"],
            )

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                own = held.setdefault(lang, [[], 0])
                own[0].append(text.as_py())
                own[1] += len(own[0][-1])
                if own[1] >= CHUNK_BYTES:
                    yield send(lang)
        for lang in list(held):
            yield send(lang)

    return docs.mapInArrow(cut, CHUNKS)


def vocabulary(chunks, least):
    """(id, lang, word, f) of the words that occur ``least`` times; ids from 1, near dense."""
    pairs = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
    pairs = pairs.select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    counted = pairs.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    counted = counted.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(NUMBERED)))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))
    return counted.withColumn("id", (rank.cast("bigint") - 1) * NUMBERED + F.col("part") + 1).drop("part")


class Packing:
    """Three numbers of ``width`` bits as a quotient of ``bits`` bits and the remainder.

    The packed number is permuted by a Feistel network over its two halves, which can be
    undone; the quotient is the top of the result and the remainder all the rest.
    """

    ROUNDS = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))

    def __init__(self, width, bits):
        self.width = max(width, 2)
        self.low = 3 * self.width // 2
        self.high = 3 * self.width - self.low
        self.bits = min(max(bits, 3 * self.width - 64, 0), self.high)
        if self.width > 31:
            raise ValueError("more than 2^31 frequent words")

    def _mixed(self, x, key, bits):
        return mix(x + key) >> np.uint64(64 - bits)

    def split(self, one, two, three):
        """(quotients, remainders) of packed triples; a pair has 0 for its third number."""
        w, low = np.uint64(self.width), np.uint64(self.low)
        rest = (two.astype(np.uint64) << w) | three.astype(np.uint64)
        a = (one.astype(np.uint64) << np.uint64(2 * self.width - self.low)) | (rest >> low)
        b = rest & np.uint64(2**self.low - 1)
        for i, key in enumerate(self.ROUNDS):
            if i % 2:
                a = a ^ self._mixed(b, key, self.high)
            else:
                b = b ^ self._mixed(a, key, self.low)
        kept = self.high - self.bits
        quotient = (a >> np.uint64(kept)).astype(np.int64)
        return quotient, ((a & np.uint64(2**kept - 1)) << low) | b

    def join(self, quotient, remainders):
        """The triples that ``split`` packed."""
        low, kept = np.uint64(self.low), self.high - self.bits
        b = remainders & np.uint64(2**self.low - 1)
        a = (remainders >> low) | (np.uint64(quotient) << np.uint64(kept))
        for i, key in reversed(list(enumerate(self.ROUNDS))):
            if i % 2:
                a = a ^ self._mixed(b, key, self.high)
            else:
                b = b ^ self._mixed(a, key, self.low)
        shift, ones = np.uint64(2 * self.width - self.low), np.uint64(2**self.width - 1)
        rest = ((a & np.uint64(2 ** int(shift) - 1)) << low) | b
        return tuple(x.astype(np.int64) for x in (a >> shift, rest >> np.uint64(self.width), rest & ones))


def merged(remainders, counts):
    """One sorted filter from several, laid end to end."""
    order = np.argsort(remainders, kind="stable")
    remainders, counts = remainders[order], counts[order]
    first = np.flatnonzero(np.diff(remainders, prepend=remainders[:1] + np.uint64(1)))
    return remainders[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def stored(remainders, counts):
    """A filter as bytes: steps between remainders by byte plane, and counters above one."""
    import zstandard

    steps = np.diff(remainders, prepend=np.uint64(0))
    many = np.flatnonzero(counts > 1)
    head = np.array([len(steps), len(many)], "<i8").tobytes()
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()
    places = many.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return zstandard.compress(head + planes + places + counts[many].astype("<i8").tobytes(), 1)


def loaded(data):
    """(remainders, counts) of a stored filter."""
    import zstandard

    data = np.frombuffer(zstandard.decompress(data), np.uint8)
    n, m = (int(x) for x in data[:16].view("<i8"))
    steps = np.ascontiguousarray(data[16 : 16 + 8 * n].reshape(8, n).T).view("<u8").ravel()
    places = np.ascontiguousarray(data[16 + 8 * n : 16 + 8 * n + 4 * m].reshape(4, m).T).view("<i4").ravel()
    counts = np.ones(n, np.int64)
    counts[places] = np.frombuffer(data[16 + 8 * n + 4 * m :].tobytes(), "<i8")
    return np.cumsum(steps, dtype=np.uint64), counts


def _filters(chunks, packing):
    """(quotient, filter) rows of the pairs and triples in the chunks of a task."""

    def count(batches):
        import pyarrow as pa
        import zstandard

        held, size = [], 0

        def send():
            quotients, remainders, counts = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(quotients, kind="stable")
            quotients, remainders, counts = quotients[order], remainders[order], counts[order]
            first = np.flatnonzero(np.diff(quotients, prepend=-1))
            ends = [*first[1:], len(quotients)]
            blobs = [stored(*merged(remainders[a:b], counts[a:b])) for a, b in zip(first, ends)]
            return pa.RecordBatch.from_arrays(
                [pa.array(quotients[first].astype(np.int32)), pa.array(blobs, pa.binary())], names=["quotient", "filter"]
            )

        for batch in batches:
            for n, blob, pairs in zip(batch.column("n_words"), batch.column("tokens"), batch.column("ids")):
                planes = np.frombuffer(zstandard.decompress(blob.as_py()), np.uint8)
                tokens = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.int32).ravel()
                number = np.zeros(n.as_py() + 1, np.int64)
                pairs = pairs.values
                number[pairs.field("at").to_numpy() + 1] = pairs.field("id").to_numpy()
                ids = number[tokens]
                two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                three = two[:-1][np.diff(two) == 1]
                none = np.zeros(len(two), np.int64)
                for grams in ((ids[two], ids[two + 1], none), (ids[three], ids[three + 1], ids[three + 2])):
                    quotients, remainders = packing.split(*grams)
                    order = np.lexsort((remainders, quotients))
                    quotients, remainders = quotients[order], remainders[order]
                    new = np.ones(len(order), bool)
                    new[1:] = (np.diff(quotients) != 0) | (np.diff(remainders) != 0)
                    first = np.flatnonzero(new)
                    if len(first):
                        held.append((quotients[first], remainders[first], np.diff(np.append(first, len(order)))))
                        size += len(first)
                if size >= HELD:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return chunks.mapInArrow(count, "quotient INT, filter BINARY")


def _frequent(filters, packing, least):
    """(i1, i2, i3, f) of what occurs ``least`` times in the merged filters; i3 is 0 in pairs."""

    def merge(batches):
        import pyarrow as pa

        held, last = [], None

        def send():
            remainders, counts = merged(*(np.concatenate(c) for c in zip(*map(loaded, held))))
            many = counts >= least
            ids = packing.join(last, remainders[many])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*ids, counts[many])], names=["i1", "i2", "i3", "f"])

        for batch in batches:
            for quotient, blob in zip(batch.column("quotient").to_pylist(), batch.column("filter")):
                if held and quotient != last:
                    yield send()
                    held = []
                last = quotient
                held.append(blob.as_py())
        if held:
            yield send()

    return filters.mapInArrow(merge, "i1 BIGINT, i2 BIGINT, i3 BIGINT, f BIGINT")


def frequent_phrases(docs, text="text", lang="lang", least=10):
    """(words, grams, sizes): frequent words (id, lang, word, f), frequent pairs and triples
    (i1, i2, i3, f), and the words of each language (lang, n). All counts are exact.
    """
    spark = docs.sparkSession
    chunks = stage(
        _chunks(docs.select(
            F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )), "chunks",
    )
    sizes = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    words = stage(vocabulary(chunks, least), "vocabulary")
    highest = words.agg(F.max("id")).first()[0] or 0
    total = chunks.agg(F.sum("n")).first()[0] or 0
    packing = Packing(int(highest).bit_length(), int(2 * total // PER_QUOTIENT).bit_length() + 4)
    seen = chunks.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    ids = seen.join(words.select("lang", "word", "id"), ["lang", "word"])
    ids = ids.groupBy("chunk").agg(F.collect_list(F.struct("at", "id")).alias("ids"))
    tokens = chunks.select("chunk", F.size("words").alias("n_words"), "tokens")
    filters = _filters(tokens.join(ids, "chunk").select("n_words", "tokens", "ids"), packing)
    filters = filters.repartition("quotient").sortWithinPartitions("quotient")
    grams = stage(_frequent(filters, packing, least), "grams")
    return words, grams, sizes


SCORE = (
    "(CAST(a AS DECIMAL(38, 0)) * CAST(a AS DECIMAL(38, 0)) * CAST(1000000 AS DECIMAL(38, 0)))"
    " DIV (CAST({l} AS DECIMAL(38, 0)) * CAST({r} AS DECIMAL(38, 0)))"
)


def collocations(docs, text="text", lang="lang", least=10, covered=50, top=2000):
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Phrases have two or three words, lie within a piece of a text between the characters
    ``.,;:!?`` and line ends, and occur ``a`` >= ``least`` times. Each cut into a first and a last part, which
    occur l and r times, scores floor(10^6 a^2 / (l r)), and the lowest score counts, the first
    of equal ones. A phrase goes if a triple that holds it has at least ``covered`` per cent of
    its occurrences. n counts the words of the language. Order: score, a, phrase in bytes.

    A null language is ``und``, a null text empty; empty texts and languages without a phrase give no row, an empty table
    none. Repeated rows count as often as they occur. Other columns are not read. Products
    are decimals of 38 digits, enough for counts up to 10^16.
    """
    words, grams, sizes = frequent_phrases(docs, text, lang, least)

    def word(i):
        return words.select(
            F.col("id").alias(f"i{i}"), F.col("word").alias(f"w{i}"), F.col("f").alias(f"f{i}"),
            *([F.col("lang")] if i == 1 else []),
        )

    pairs = grams.where("i3 = 0").select("i1", "i2", F.col("f").alias("a"))
    triples = grams.where("i3 > 0").withColumnRenamed("f", "a")
    cover = triples.select("i1", "i2", "a").union(triples.select(F.col("i2"), F.col("i3"), "a"))
    cover = cover.groupBy("i1", "i2").agg(F.max("a").alias("longer"))
    two = pairs.join(cover, ["i1", "i2"], "left").where(f"longer IS NULL OR 100 * longer < {int(covered)} * a")
    two = two.join(word(1), "i1").join(word(2), "i2").select(
        "lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"),
        F.expr(SCORE.format(l="f1", r="f2")).alias("score"),
    )
    three = (
        triples.join(pairs.select("i1", "i2", F.col("a").alias("f12")), ["i1", "i2"])
        .join(pairs.select(F.col("i1").alias("i2"), F.col("i2").alias("i3"), F.col("a").alias("f23")), ["i2", "i3"])
        .join(word(1), "i1").join(word(2), "i2").join(word(3), "i3")
        .withColumn("s1", F.expr(SCORE.format(l="f1", r="f23")))
        .withColumn("s2", F.expr(SCORE.format(l="f12", r="f3")))
    )
    first = F.col("s1") <= F.col("s2")
    three = three.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
        F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"),
        F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"),
        F.least("s1", "s2").alias("score"),
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.union(three).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
