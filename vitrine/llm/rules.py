"""Quality rules: repetition, symbols and divergence from the histograms of a language."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import packed, stage, words

SYMBOLS = "#*$%&|<>"
STOPS = r"[.,;:!?'\"()\-]+"
CLASSES = ["lower", "upper", "digit", "stop", "symbol", "other"]
WINDOW = 8
COMMON_WORDS = 64

#: Jensen-Shannon distances above which a text is unlike its language.
MOST_CHAR_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.41
#: Short texts lie further off by chance, and so do texts of a language that few words are
#: known of: from ``n`` words against ``m`` the limit for words is at least
#: sqrt(SHORT_BASE^2 + SHORT_SPREAD / n + SHORT_SPREAD / m), which is above MOST_WORD_DISTANCE
#: below 77 words; that for characters is sqrt(MOST_CHAR_DISTANCE^2 + SHORT_SPREAD / m).
SHORT_BASE = 0.30
SHORT_SPREAD = 6.0
#: Texts with less than this are not compared.
LEAST_CHARS = 200
LEAST_WORDS = 20


def _term(p, q):
    """Twice what one bucket adds to the Jensen-Shannon divergence in bits, as SQL."""
    part = "if({0} > 0, {0} * log2(2 * {0} / ({0} + {1})), 0D)"
    return f"({part.format(p, q)} + {part.format(q, p)})"


def measures(docs, text="text"):
    """Adds ``_words`` and the counts of one text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and
    ``_classes``, code points in words by character class. Words are compared exactly but
    for the 64-bit hash of a window, which only meets the windows of its own text.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns(
        {
            "_words": words(F.col(text)),
            "_lines": F.filter(F.split(value, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    rows = rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    rows = rows.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "_joined": F.array_join("_words", ""),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "_windows": F.expr(
                f"if(size(_hashes) < {WINDOW}, cast(array() as array<bigint>), transform("
                f"sequence(1, size(_hashes) - {WINDOW - 1}), "
                f"i -> xxhash64(slice(_hashes, i, {WINDOW}))))"
            ),
        }
    ).drop("_lines", "_hashes")
    # Each pass takes one class of characters out, so the later ones see little.
    left, sizes = F.col("_joined"), []
    rows = rows.withColumn("_left", left)
    for pattern in (r"\p{Ll}+", r"\p{Lu}+", r"\p{Nd}+", STOPS, r"[#*$%&|<>]+"):
        rows = rows.withColumn("_rest", F.regexp_replace("_left", pattern, ""))
        name = f"_c{len(sizes)}"
        rows = rows.withColumn(name, F.char_length("_left") - F.char_length("_rest"))
        rows = rows.drop("_left").withColumnRenamed("_rest", "_left")
        sizes.append(F.col(name).cast("bigint"))
    rows = rows.withColumns(
        {
            "word_chars": F.char_length("_joined").cast("bigint"),
            "n_symbols": sizes[4],
            "_classes": F.array(*sizes, F.char_length("_left").cast("bigint")),
            "_sorted": F.expr(
                "if(size(array_distinct(_windows)) = size(_windows), NULL, "
                "sort_array(transform(_windows, (h, i) -> struct(h, i))))"
            ),
        }
    )
    twice = (
        "transform(filter(_sorted, (x, i) -> "
        "(i > 0 AND _sorted[i - 1].h = x.h) OR (i + 1 < size(_sorted) AND _sorted[i + 1].h = x.h)), "
        "x -> x.i)"
    )
    covered = (
        f"aggregate(sort_array({twice}), named_struct('last', -{WINDOW}, 'n', 0L), "
        f"(a, x) -> named_struct('last', x, 'n', a.n + least({WINDOW}, x - a.last)), a -> a.n)"
    )
    rows = rows.withColumn("n_repeat_words", F.expr(f"if(_sorted IS NULL, 0L, {covered})"))
    return rows.drop("_joined", "_left", "_windows", "_sorted", *[f"_c{i}" for i in range(5)])


def word_references(docs, text="text", lang="lang", common=COMMON_WORDS):
    """A row per language with the shares of its most frequent words over all documents.

    (_lang, ref_words, common, shares, common_share, longest): ``common`` by falling count,
    ties by the word, ``shares`` of all words, ``longest`` the bytes of the longest one.
    """
    each = docs.select(F.col(lang).alias("_lang"), F.explode(words(F.col(text))).alias("word"))
    counts = stage(each.groupBy("_lang", "word").count(), "word-counts")
    totals = counts.groupBy("_lang").agg(F.sum("count").alias("ref_words"))
    by_count = Window.partitionBy("_lang").orderBy(F.desc("count"), "word")
    top = counts.withColumn("_rank", F.row_number().over(by_count)).where(
        F.col("_rank") <= common
    )
    # at most ``common`` words a language are gathered
    top = top.groupBy("_lang").agg(
        F.sort_array(F.collect_list(F.struct("_rank", "word", "count"))).alias("_top")
    )
    joined = totals.alias("l").join(top.alias("r"), F.col("l._lang").eqNullSafe(F.col("r._lang")))
    return joined.select(
        "l._lang", "ref_words", F.col("_top.word").alias("common"),
        F.expr("transform(_top, x -> x.count / ref_words)").alias("shares"),
        F.expr("aggregate(_top, 0D, (a, x) -> a + x.count / ref_words)").alias("common_share"),
        F.expr("array_max(transform(_top, x -> octet_length(x.word)))").alias("longest"),
    )


def class_references(measured):
    """A row per language: (_lang, class_shares) over the words of all documents."""
    sums = [F.sum(F.get("_classes", F.lit(i))) for i in range(len(CLASSES))]
    every = F.nullif(F.sum("word_chars"), F.lit(0))
    shares = [F.coalesce(x / every, F.lit(0.0)) for x in sums]
    return measured.groupBy("_lang").agg(F.array(*shares).alias("class_shares"))


def word_distance(measured):
    """Adds ``word_distance``, 0 (alike) to 1, to rows with their language's common words:
    the square root of the divergence in bits, the other words being one bucket."""
    # Equal positions lie together once sorted; a run is closed when the next one starts.
    run = _term("(a.run / n_words)", "shares[a.word - 1]")
    closed = f"a.jsd + if(a.word = 0, 0D, {run})"
    seen = "a.seen + if(a.word = 0, 0D, shares[a.word - 1])"
    merge = (
        "(a, x) -> if(a.word = x, "
        "named_struct('word', a.word, 'run', a.run + 1L, 'jsd', a.jsd, 'seen', a.seen), "
        f"named_struct('word', x, 'run', 1L, 'jsd', {closed}, 'seen', {seen}))"
    )
    other = _term("((n_words - size(_common)) / n_words)", "(1D - common_share)")
    apart = (
        "aggregate(_common, named_struct('word', 0, 'run', 0L, 'jsd', 0D, 'seen', 0D), "
        f"{merge}, a -> {closed} + common_share - ({seen})) + {other}"
    )
    # A word longer than every common one need not be looked up.
    position = "if(octet_length(w) > longest, 0, cast(array_position(common, w) as int))"
    rows = measured.withColumn(
        "_common", F.expr(f"sort_array(filter(transform(_words, w -> {position}), x -> x > 0))")
    )
    distance = f"if(n_words = 0 OR ref_words IS NULL, 0D, sqrt(greatest(({apart}) / 2, 0D)))"
    return rows.withColumn("word_distance", F.expr(distance)).drop("_common")


def char_distance(measured):
    """Adds ``char_distance``, the same over the character classes."""
    chars = "+".join(
        _term(f"(_classes[{i}] / word_chars)", f"class_shares[{i}]") for i in range(len(CLASSES))
    )
    distance = f"if(word_chars = 0, 0D, sqrt(greatest(({chars}) / 2, 0D)))"
    return measured.withColumn("char_distance", F.expr(distance))


def quality_rules(docs, text="text", lang="lang", most_char=MOST_CHAR_DISTANCE,
                  most_word=MOST_WORD_DISTANCE, least_chars=LEAST_CHARS,
                  least_words=LEAST_WORDS, common=COMMON_WORDS, carry=None):
    """The documents with their counts, distances, ``base_failed`` and ``kept``.

    Base: fewer than 20 words, or more than 30% of the words in 8-word windows that the
    text holds twice or more. Others are compared with their language, whose histograms
    come from all documents: characters from ``least_chars`` code points on, words from
    ``least_words`` words on, by a limit that rises smoothly from ``most_word`` as texts get
    short. Both limits rise smoothly as the words of the whole language get few; no language
    is left out.

    A null text is an empty one and fails the base; a null language is a language of its
    own; rows with equal ids are judged each for itself; an empty table stays empty. Input
    columns with the names of added ones are replaced. ``carry`` names the input columns
    to keep (all): without the text, the measured rows that are written are small.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "char_distance", "word_distance", "base_failed", "kept"]
    kept = [c for c in carry or docs.columns if c not in added]
    of_words = stage(word_references(docs, text, lang, common).coalesce(1), "word-references")
    rows = docs.select(
        packed(docs, kept), F.col(lang).alias("_lang"), F.col(text).alias("_text")
    )
    measured = measures(rows, "_text")
    measured = measured.alias("m").join(
        of_words.alias("w"), F.col("m._lang").eqNullSafe(F.col("w._lang")), "left"
    )
    measured = measured.select("m.*", *[f"w.{c}" for c in of_words.columns[1:]])
    measured = word_distance(measured).select(
        "_row", "_lang", "_classes", "ref_words", *added[:5], "word_distance"
    )
    measured = stage(measured, "measures")
    of_classes = class_references(measured)
    rows = measured.alias("m").join(
        of_classes.alias("c"), F.col("m._lang").eqNullSafe(F.col("c._lang"))
    )
    rows = char_distance(rows.select("m.*", "c.class_shares"))
    base = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    of = lambda n: F.lit(SHORT_SPREAD) / F.greatest(F.coalesce(n, F.lit(0)), F.lit(1))
    own, known = of(F.col("n_words")), of(F.col("ref_words"))
    word_limit = F.greatest(F.lit(float(most_word)), F.sqrt(F.lit(SHORT_BASE**2) + own + known))
    char_limit = F.sqrt(F.lit(float(most_char) ** 2) + known)
    unlike = ((F.col("word_chars") >= least_chars) & (F.col("char_distance") > char_limit)) | (
        (F.col("n_words") >= least_words) & (F.col("word_distance") > word_limit)
    )
    rows = rows.withColumn("base_failed", base).withColumn("kept", ~base & ~unlike)
    return rows.select("_row.*", *added)
