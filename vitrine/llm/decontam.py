"""Benchmark decontamination as a prefix-filtered set join with exact verification.

An item is cut into windows of 13 consecutive words (a shorter item is one window), a
window into overlapping shingles of three words. A window that a document contains in full
shares every shingle with it, so its prefix of rarest shingles, by their counts in the
documents, needs one element only. Documents are joined on that one; the shingle's place
gives the place of the window, which must lie within the text, and there the words are
compared one by one.
"""

from pyspark.sql import functions as F

from .common import lower_ascii, packed, same, stage, text_key

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
SHINGLE = 3


def plain_words(text):
    """Runs of ASCII letters and digits and of all code points above 127; only A-Z are
    lower-cased. A null text has none."""
    return F.array_remove(F.split(lower_ascii(text), SEPARATORS, -1), "")


def _shingles(array, size):
    """Structs (hash, pos) of all shingles of ``size`` words, positions from 1."""
    return (
        f"if(size({array}) < {size}, cast(array() as array<struct<hash:bigint,pos:int>>), "
        f"transform(sequence(1, size({array}) - {size - 1}), i -> named_struct('hash', "
        f"xxhash64(slice({array}, i, {size}), {size}), 'pos', i)))"
    )


def item_windows(benchmark, item="item_id", text="text", window=WINDOW):
    """(item_id, words) of every window; an item without words has none."""
    rows = benchmark.select(F.col(item).alias("item_id"), plain_words(F.col(text)).alias("_words"))
    rows = rows.where(F.size("_words") > 0)
    starts = f"sequence(1, greatest(size(_words) - {window - 1}, 1))"
    return rows.select(
        "item_id", F.explode(F.expr(f"transform({starts}, i -> slice(_words, i, {window}))")).alias("words")
    )


def contaminated_windows(docs, windows, doc="doc_id", text="text", shingle=SHINGLE):
    """(key, text_key, n_words, starts, found): per document the places of item windows.

    ``windows`` has distinct (words, window_id). ``found`` lists structs (start, window_id)
    of verified occurrences, positions from 1, in documents that have any; the others are
    left out.
    """
    windows = windows.withColumn("size", F.least(F.size("words"), F.lit(shingle)))
    # the few shingle sizes that occur: ``shingle``, and less only for very short items
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())
    parts = F.expr(
        "explode(transform(sequence(1, size(words) - size + 1), i -> named_struct('hash', "
        "xxhash64(slice(words, i, size), size), 'pos', i)))"
    )
    of_windows = windows.select("window_id", "size", parts.alias("s")).select(
        "window_id", F.col("s.hash").alias("hash"), (F.col("s.pos") - 1).alias("offset")
    )
    of_windows = stage(of_windows, "window-shingles")
    keyed = docs.select(
        F.col(doc).alias("key"), text_key(F.col(text)).alias("text_key"),
        plain_words(F.col(text)).alias("words"),
    )
    every = F.concat(*[F.expr(_shingles("words", n)) for n in sizes]) if sizes else F.expr(_shingles("words", shingle))
    of_docs = keyed.select("key", "text_key", F.explode(every).alias("s"))
    of_docs = of_docs.select("key", "text_key", F.col("s.hash").alias("hash"), F.col("s.pos").alias("pos"))
    # Only shingles of items go on; Spark broadcasts their hashes while they are few.
    hits = stage(
        of_docs.join(of_windows.select("hash").distinct(), "hash", "left_semi"), "shingle-hits"
    )
    counts = hits.groupBy("hash").count()
    ranked = of_windows.join(counts, "hash", "left")
    rarity = F.struct(F.coalesce("count", F.lit(0)).alias("count"), "hash", "offset")
    prefix = ranked.groupBy("window_id").agg(F.min(rarity).alias("p"))
    prefix = prefix.where("p.count > 0").select(
        "window_id", F.col("p.hash").alias("hash"), F.col("p.offset").alias("offset")
    )
    placed = hits.join(prefix, "hash").withColumn("start", F.col("pos") - F.col("offset"))
    placed = placed.where("start >= 1").join(windows.select("window_id", F.col("words").alias("wanted")), "window_id")
    per_doc = placed.groupBy("key", "text_key").agg(
        F.collect_set(F.struct("start", "window_id", "wanted")).alias("places")
    )
    # The text travels, not its words: an array of strings takes several times the room.
    texts = docs.select(
        F.col(doc).alias("key"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")
    )
    joined = texts.join(per_doc, same(texts, per_doc, ["key", "text_key"])).select(
        texts["key"], texts["text_key"], "places", plain_words(F.col("text")).alias("words")
    )
    fits = "p.start + size(p.wanted) - 1 <= size(words) AND slice(words, p.start, size(p.wanted)) = p.wanted"
    found = F.expr(
        f"transform(filter(places, p -> {fits}), "
        "p -> named_struct('start', p.start, 'window_id', p.window_id, 'size', size(p.wanted)))"
    )
    joined = joined.select("key", "text_key", found.alias("found")).where(F.size("found") > 0)
    return joined.dropDuplicates(["key", "text_key"])


def decontaminate(docs, benchmark, doc="doc_id", text="text", item="item_id",
                  item_text="text", window=WINDOW, shingle=SHINGLE, carry=None):
    """Every document with the words and items by which it overlaps the benchmark.

    Adds to the documents' columns: ``n_words``; ``n_hit``, words inside any occurrence of
    an item window; ``items``, the sorted ids (as strings) of items with a window in the
    text; ``n_items``; ``spans``, the covered stretches as structs (start, end), words from
    1; and ``contaminated``: any hit, and at least 5% of the words hit.

    A null text has no words and is clean; null ids are kept and matched null-safely; rows
    alike in id and text get equal results; items without words match nothing; with an
    empty benchmark nothing is hit. Columns of those names in the input are replaced; ``carry``
    names the input columns to keep (all).
    """
    added = ["n_words", "n_hit", "n_items", "items", "spans", "contaminated"]
    kept = [c for c in carry or docs.columns if c not in added]
    parts = stage(item_windows(benchmark, item, item_text, window), "item-windows")
    name = F.sha2(F.concat_ws(" ", "words"), 256)
    parts = parts.select("item_id", "words", name.alias("window_id"))
    windows = stage(parts.select("words", "window_id").distinct(), "windows")
    found = stage(contaminated_windows(docs, windows, doc, text, shingle), "found-windows")
    # Starts in order: a stretch ends where the next occurrence begins behind it.
    merged = F.expr(
        "aggregate(sort_array(transform(found, f -> named_struct('start', f.start, 'end', "
        "f.start + f.size - 1))), cast(array() as array<struct<start:int,end:int>>), (a, x) -> "
        "if(size(a) > 0 AND element_at(a, -1).end + 1 >= x.start, "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, "
        "'end', greatest(element_at(a, -1).end, x.end)))), concat(a, array(x))))"
    )
    spans = found.select("key", "text_key", merged.alias("spans"))
    pairs = found.select("key", "text_key", F.explode("found.window_id").alias("window_id")).distinct()
    items = pairs.join(parts.select("window_id", "item_id").distinct(), "window_id")
    items = items.groupBy("key", "text_key").agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items")
    )
    hit = spans.alias("s").join(items.alias("i"), same(spans, items, ["key", "text_key"])).select(
        "s.*", "i.items"
    )
    base = docs.select(
        packed(docs, kept), F.col(doc).alias("_key"), text_key(F.col(text)).alias("_text_key"),
        F.size(plain_words(F.col(text))).cast("bigint").alias("n_words"),
    )
    matches = base["_key"].eqNullSafe(hit["key"]) & (base["_text_key"] == hit["text_key"])
    rows = base.join(hit, matches, "left")
    n_hit = F.expr("coalesce(aggregate(spans, 0L, (a, x) -> a + x.end - x.start + 1), 0L)")
    rows = rows.withColumns(
        {
            "n_hit": n_hit,
            "items": F.coalesce("items", F.expr("cast(array() as array<string>)")),
        }
    )
    rows = rows.withColumn("n_items", F.size("items").cast("bigint"))
    rows = rows.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
    return rows.select("_row.*", *added)
