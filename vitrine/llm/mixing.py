"""Mixing sources to target weights along a low-discrepancy schedule."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import same, stage, words

GRID_BITS = 31
GOLDEN = 1327217885  # the golden ratio's fraction times 2^31, made odd
CELL_BITS = 21
CHUNK_BITS = 16
ORDER_DIGITS = 3
BLOCK_WORDS = 256
SPARE = 4


def with_sizes(docs, key="doc_id", source="source", text="text"):
    """(doc_id, source, size) of every row; a null text has no words."""
    return docs.select(
        F.col(key).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(words(F.col(text))).cast("bigint").alias("size"),
    )


def source_targets(sized, weights=(5, 2, 1), share=1.5, most=2):
    """(source, source_size, weight, target): words to take from each source.

    Sources by code point, null last, take ``weights`` in turn and split ``share`` times
    all words. A target stops at ``most`` times its source; the excess is split again by
    weight until nothing is above: target = least(most * size, weight * level), where
    the level is the largest that any split along the order of size / weight gives.
    The table has a row per source, so one task can order it.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))).cast("int")
    table = F.array(*[F.lit(float(w)) for w in weights])
    sources = sizes.select("source", "source_size", F.get(table, turn).alias("weight"))
    ratio = F.col("source_size") / F.col("weight")
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - most * F.coalesce(
        F.sum("source_size").over(before), F.lit(0)
    )
    sources = sources.withColumn("_level", left / F.sum("weight").over(after))
    sources = sources.withColumn("_level", F.max("_level").over(everything))
    target = F.least(
        most * F.col("source_size").cast("double"), F.col("weight") * F.col("_level")
    )
    return sources.select("source", "source_size", "weight", target.alias("target"))


def spans(sized, seed=0):
    """Rows with ``start``, the words of the same source before them in a shuffled order.

    The order is that of an MD5 of seed and id. Its first digits cut a source into
    ranges that are summed on their own and shifted by the sums of those before.
    """
    name = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = sized.withColumn("_order", F.md5(name))
    rows = rows.withColumn("_range", F.substring("_order", 1, ORDER_DIGITS))
    sums = rows.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    ranges = Window.partitionBy("source").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = sums.select(
        "source", "_range", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_shift")
    )
    inside = (
        Window.partitionBy("source", "_range")
        .orderBy("_order", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = rows.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.alias("r").join(
        starts.alias("s"),
        F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._range") == F.col("s._range")),
    )
    return joined.select(
        "r.doc_id", "r.source", "r.size", (F.col("r._before") + F.col("s._shift")).alias("start")
    )


def _drawn(spark, needs, spare):
    """(slot, source, chunk): which source each slot falls to.

    Slot i lies at the golden-ratio point ``i * GOLDEN mod 2^31``; points are mapped through
    the cumulative ``need + spare`` of the sources, which is also the number of slots. Points
    and intervals meet on coarse cells.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    width = F.col("need") + F.lit(spare)
    count = needs.agg(F.sum(width)).first()[0] or 0
    grid, cell = 2**GRID_BITS, 2**CELL_BITS
    high = F.sum(width).over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    edges = needs.select("source", (high.cast("double") / max(count, 1) * grid).cast("bigint").alias("high"))
    edges = edges.withColumn("low", F.lag("high", 1, 0).over(by_name))
    last = F.lead("high").over(by_name).isNull()
    edges = edges.withColumn("high", F.when(last, F.lit(grid)).otherwise(F.col("high")))
    edges = edges.where("low < high").withColumn(
        "cell", F.explode(F.expr(f"sequence(low div {cell}, (high - 1) div {cell})"))
    )
    slots = spark.range(count).withColumnRenamed("id", "slot")
    at = (F.col("slot") % grid * GOLDEN) % grid
    slots = slots.withColumn("at", at).withColumn("cell", F.expr(f"at div {cell}"))
    drawn = slots.join(edges, "cell").where("low <= at AND at < high")
    return drawn.select("slot", "source", F.shiftright("slot", CHUNK_BITS).alias("chunk"))


def schedule(spark, targets, block_words=BLOCK_WORDS, spare=SPARE):
    """(slot, source, rank): which source fills each slot, and its how-manieth block that is.

    A source needs as many blocks as its target fills. It is given ``spare`` more slots, as
    points may miss its share of the slots by a few; ``spare`` doubles until every source
    has its need. A source whose target is met skips its further slots, so the schedule
    alone decides what is read, and every stretch of it is near the mix. Slots are ranked in
    chunks that are shifted by the counts of the chunks before: no task sees a whole source.
    """
    need = F.ceil(F.round("target") / block_words).cast("bigint").alias("need")
    needs = stage(targets.select("source", need).where("need > 0").coalesce(1), "mix-needs")
    while True:
        drawn = _drawn(spark, needs, spare)
        counts = stage(drawn.groupBy("chunk", "source").count(), "mix-counts")
        filled = counts.groupBy("source").agg(F.sum("count").alias("_slots"))
        enough = needs["source"].eqNullSafe(filled["source"]) & (F.col("_slots") >= F.col("need"))
        if needs.join(filled, enough, "left_anti").isEmpty():
            break
        spare *= 2
    chunks = Window.partitionBy("source").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = counts.select(
        "chunk", "source", F.coalesce(F.sum("count").over(chunks), F.lit(0)).alias("_shift")
    )
    starts = starts.alias("s").join(needs.alias("n"), F.col("s.source").eqNullSafe(F.col("n.source")))
    starts = starts.select("s.*", "n.need")
    inside = Window.partitionBy("chunk", "source").orderBy("slot")
    ranked = drawn.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.alias("r").join(
        starts.alias("s"),
        F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.chunk") == F.col("s.chunk")),
    )
    return joined.select(
        "r.slot", "r.source", (F.col("r._rank") + F.col("s._shift")).alias("rank"), "s.need"
    ).where("rank < need").drop("need")


def mix_sources(docs, weights=(5, 2, 1), share=1.5, most=2, block_words=BLOCK_WORDS, seed=0,
                key="doc_id", source="source", text="text"):
    """Pieces of documents in the order in which the mix reads them.

    Returns (placed, targets, pieces). ``placed`` has (doc_id, source, size, start) of every
    row and ``targets`` a row per source. ``pieces`` has (slot, doc_id, source, size, start,
    rank, first, words): ``words`` words of the document from its word ``first`` on are read
    in ``slot``. The documents of a source, shuffled, form a stream that starts again at its
    end; block ``rank`` of ``block_words`` words fills the rank-th slot that the schedule
    gives to the source, and what no slot asks for is not read. The last block is cut at the
    source's target, rounded to words.

    Rows without words or with null texts give no pieces; null sources form a source; rows
    with equal ids count as rows of their own; empty tables give empty frames.
    """
    spark = docs.sparkSession
    sized = stage(with_sizes(docs, key, source, text), "mix-sizes")
    targets = stage(source_targets(sized, weights, share, most).coalesce(1), "mix-targets")
    placed = stage(spans(sized, seed), "mix-spans")
    tagged = placed.alias("d").join(
        targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))
    )
    rounds = F.explode(F.sequence(F.lit(0), F.lit(int(-(-most // 1)) - 1)))
    tagged = tagged.select(
        "d.*", "t.source_size", F.round("t.target").cast("bigint").alias("quota")
    ).withColumn("round", rounds)
    low = F.col("round") * F.col("source_size") + F.col("start")
    tagged = tagged.withColumn("low", low).withColumn(
        "high", F.least(F.col("low") + F.col("size"), F.col("quota"))
    )
    ranks = F.expr(f"sequence(low div {block_words}, (high - 1) div {block_words})")
    cut = tagged.where("low < high").withColumn("rank", F.explode(ranks))
    begin = F.greatest("low", F.col("rank") * block_words)
    end = F.least("high", (F.col("rank") + 1) * block_words)
    cut = cut.select(
        "doc_id", "source", "size", "start", "rank",
        (begin - F.col("low")).alias("first"), (end - begin).alias("words"),
    )
    slots = schedule(spark, targets, block_words)
    pieces = cut.alias("c").join(
        slots.alias("s"),
        F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.rank") == F.col("s.rank")),
    )
    return placed, targets, pieces.select("s.slot", "c.*")


def words_taken(placed, targets, pieces):
    """Every row with its source's size and target, and the words that the mix takes.

    The place in its source's stream tells rows apart that are alike otherwise.
    """
    place = ["doc_id", "source", "size", "start"]
    sums = pieces.groupBy(*place).agg(F.sum("words").alias("taken"))
    left = placed.alias("d").join(
        targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))
    )
    left = left.select("d.*", "t.source_size", "t.target")
    joined = left.join(sums, same(left, sums, place), "left")
    names = ["doc_id", "source", "size", "source_size", "target"]
    return joined.select(*[left[n] for n in names], F.coalesce(sums["taken"], F.lit(0)).alias("taken"))
