"""Language-model scoring by the likelihood of a text over all its subword segmentations.

A token is a path through the lattice of vocabulary pieces that spell it; its probability is
the sum over all paths, by a forward recursion in log space. Piece weights start from the
scores that the vocabulary file has and take up the counts of the pieces' best paths over
the distinct words of the training documents. A token of the training documents has one more path, the arc of the
whole token, weighed by its count; all such arcs together weigh as much as tokens that
occurred more than once do (Good and Turing's estimate).
"""

import math

from pyspark.sql import functions as F

from .common import lower_ascii, same, stage, text_key, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"
#: Words of at least 1/FREQUENT of all tokens are looked up in the tasks; there are no more
#: than FREQUENT of them, of at most LONGEST_FREQUENT bytes. Others are joined.
FREQUENT = 2**19
LONGEST_FREQUENT = 32
#: Counts that the file's scores are worth when the corpus counts are added to them.
PRIOR_COUNT = 10_000.0
ROWS = 20_000


def vocabulary_pieces(path=VOCABULARY):
    """Piece -> log probability by the scores of a SentencePiece file, read on the driver.

    The scores of a merge vocabulary are negative ranks; a rank weighs 1 / (rank + 2), as
    frequencies fall with the rank. Scores between -64 and 0 in all pieces are log
    probabilities and taken as they are. Byte pieces stand for characters without a piece.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_unknown(i)) and SPACE_MARK not in piece[1:]:
            scores[piece] = model.get_score(i)
    plain = {p: s for p, s in scores.items() if s > -1e8}
    if plain and min(plain.values()) > -64 and max(plain.values()) <= 0 and min(plain.values()) < 0:
        weights = {p: math.exp(s) for p, s in plain.items()}
    else:
        weights = {p: 1 / (2 - s) for p, s in plain.items() if s <= 0}
    total = sum(weights.values())
    return {p: math.log(w / total) for p, w in weights.items()}


class Lattice:
    """Segmentations of tokens into weighted pieces."""

    def __init__(self, pieces):
        self.pieces = pieces
        self.longest = max((len(p) for p in pieces), default=1)
        least = min(pieces.values(), default=0.0)
        self.bytes = [pieces.get(f"<0x{b:02X}>", least) for b in range(256)]

    def spelled(self, char):
        """Log probability of a character written in byte pieces."""
        return sum(self.bytes[b] for b in char.encode("utf-8", "surrogatepass"))

    def log_probability(self, word):
        """Log of the summed probability of all segmentations of one word."""
        text = SPACE_MARK + word
        pieces, longest = self.pieces, self.longest
        forward = [0.0]
        for end in range(1, len(text) + 1):
            paths = []
            for start in range(max(0, end - longest), end):
                weight = pieces.get(text[start:end])
                if weight is not None:
                    paths.append(forward[start] + weight)
            if text[end - 1] not in pieces:
                paths.append(forward[end - 1] + self.spelled(text[end - 1]))
            if len(paths) == 1:
                forward.append(paths[0])
            else:
                most = max(paths)
                forward.append(most + math.log(sum([math.exp(p - most) for p in paths])))
        return forward[-1]

    def best(self, word):
        """The pieces of the likeliest segmentation."""
        text = SPACE_MARK + word
        pieces, longest = self.pieces, self.longest
        score, back = [0.0], [0]
        for end in range(1, len(text) + 1):
            top, at = -math.inf, end - 1
            for start in range(max(0, end - longest), end):
                weight = pieces.get(text[start:end])
                if weight is not None and score[start] + weight > top:
                    top, at = score[start] + weight, start
            if text[end - 1] not in pieces:
                weight = score[end - 1] + self.spelled(text[end - 1])
                if weight > top:
                    top, at = weight, end - 1
            score.append(top)
            back.append(at)
        out, end = [], len(text)
        while end:
            piece = text[back[end] : end]
            if piece in pieces:
                out.append(piece)
            else:
                out += [f"<0x{b:02X}>" for b in piece.encode("utf-8", "surrogatepass")]
            end = back[end]
        return out


def held_out(column, folds=7, fold=2):
    """Whether the key's CRC-32, taken of its text, falls into the fold that is not learned."""
    text = F.coalesce(column.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold


def token_counts(docs, text="text", trained="trained"):
    """(word, count, seen): how often each word occurs in training rows, and in all rows."""
    each = docs.select(trained, F.explode(words(lower_ascii(F.col(text)))).alias("word"))
    one = F.col(trained).cast("bigint")
    return each.groupBy("word").agg(F.sum(one).alias("count"), F.count("*").alias("seen"))


def learned_pieces(counts, prior):
    """Piece -> log probability: the prior's pieces after one pass over the training words.

    Each distinct word counts once, since the pieces have to spell the words that have no
    or hardly any count of their own. A row per piece is collected: the vocabulary bounds it.
    """
    lattice = Lattice(prior)

    def count(batches):
        import pyarrow as pa

        sums = {}
        for batch in batches:
            for word in batch.column("word").to_pylist():
                for piece in lattice.best(word):
                    sums[piece] = sums.get(piece, 0) + 1
        if sums:
            yield pa.RecordBatch.from_pydict(
                {"piece": pa.array(list(sums), pa.string()), "n": pa.array(list(sums.values()), pa.int64())}
            )

    trained = counts.where("count > 0").select("word")
    parts = trained.mapInArrow(count, "piece STRING, n BIGINT")
    sums = {r["piece"]: r["n"] for r in parts.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    total = sum(sums.get(p, 0) for p in prior) + PRIOR_COUNT
    return {
        p: math.log((sums.get(p, 0) + PRIOR_COUNT * math.exp(w)) / total) for p, w in prior.items()
    }


def with_log_probability(counts, pieces, words_seen, whole, end):
    """The words with ``log10``, the log10 probability over all their paths.

    ``whole`` is the weight of the whole-token arcs, which share it by ``count`` out of
    ``words_seen``; ``end`` the probability that a token is the end instead.
    """
    lattice = Lattice(pieces)
    log_parts, log_word = math.log(1 - whole), math.log(1 - end)

    def probability(word, count):
        log = log_parts + lattice.log_probability(word)
        if count and whole:
            arc = math.log(whole * count / words_seen)
            log = max(log, arc) + math.log1p(math.exp(-abs(log - arc)))
        return (log_word + log) / math.log(10)

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            pairs = zip(batch.column("word").to_pylist(), batch.column("count").to_pylist())
            logs = [probability(w, n) for w, n in pairs]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(logs, pa.float64())], names=[*batch.schema.names, "log10"]
            )

    return counts.mapInArrow(score, counts.withColumn("log10", F.lit(0.0)).schema)


def _lookups(rows, table):
    """Per row one partial sum over its frequent words (word null), and its other words."""

    def look(batches):
        import pyarrow as pa

        known = table.value
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("text_key")
            place, word, count, seen, base, score = [], [], [], [], [], []

            def send():
                at = pa.array(place, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [
                        ids.take(at), keys.take(at), pa.array(word, pa.string()),
                        pa.array(count, pa.int64()), pa.array(seen, pa.int64()),
                        pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                    ],
                    names=["doc_id", "text_key", "word", "n", "n_known", "base", "score"],
                )

            for i, text in enumerate(batch.column("text")):
                tokens = {}
                for t in (text.as_py() or "").encode().lower().split():
                    tokens[t] = tokens.get(t, 0) + 1
                n, n_known, base_sum, score_sum = 0, 0, 0.0, 0.0
                for t, k in tokens.items():
                    found = known.get(t)
                    if found is None:
                        place.append(i)
                        word.append(t.decode())
                        count.append(k)
                        seen.append(None)
                        base.append(None)
                        score.append(None)
                    else:
                        n += k
                        n_known += k * found[0]
                        base_sum += k * found[1]
                        score_sum += k * found[2]
                place.append(i)
                word.append(None)
                count.append(n)
                seen.append(n_known)
                base.append(base_sum)
                score.append(score_sum)
                if len(place) >= ROWS:
                    yield send()
                    place, word, count, seen, base, score = [], [], [], [], [], []
            if place:
                yield send()

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_key BIGINT, word STRING, "
    return rows.mapInArrow(look, schema + "n BIGINT, n_known BIGINT, base DOUBLE, score DOUBLE")


def score_documents(docs, key="doc_id", text="text", vocabulary=VOCABULARY, folds=7, fold=2,
                    frequent=FREQUENT):
    """(doc_id, text_key, held_out, n_tokens, n_known, train_tokens, base_score, score).

    Tokens are the words, A-Z lower-cased, and one end per text; a null text has the end
    only. Rows whose key's CRC-32 modulo ``folds`` is ``fold`` are scored but not learned.
    ``score`` is the log10 probability of the text over all segmentations of its words into
    vocabulary pieces, ``base_score`` that of an add-one model of whole tokens.

    Null keys count as empty text and are kept; rows alike in key and text get a row each;
    without training rows the vocabulary's own scores and a count of 0 hold; an empty table
    gives an empty frame.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("doc_id"), text_key(F.col(text)).alias("text_key"),
        F.col(text).alias("text"), held_out(F.col(key), folds, fold).alias("held_out"),
    )
    counts = token_counts(rows.withColumn("trained", ~F.col("held_out")))
    counts = stage(counts, "token-counts")
    ends = rows.where(~F.col("held_out")).count()
    sums = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n"),
        F.coalesce(F.sum("seen"), F.lit(0)).alias("seen"),
        F.count(F.when(F.col("count") > 0, 1)).alias("v"),
        F.count(F.when(F.col("count") == 1, 1)).alias("once"),
    ).first()
    n, v = sums["n"] + ends, sums["v"] + (ends > 0)
    pieces = learned_pieces(counts, vocabulary_pieces(vocabulary))
    whole = min(0.999, 1 - sums["once"] / sums["n"]) if sums["n"] else 0.0
    end = (ends + 1) / (n + 2)
    scored = with_log_probability(counts, pieces, sums["n"], whole, end).withColumns(
        {
            "known": (F.col("count") > 0).cast("bigint"),
            "base": F.log10((F.col("count") + 1) / F.lit(float(n + v + 1))),
        }
    )
    scored = stage(scored.select("word", "seen", "known", "base", "log10"), "token-scores")
    short = F.octet_length("word") <= LONGEST_FREQUENT
    top = scored.where(short & (F.col("seen") * frequent >= sums["seen"]))
    table = {r[0].encode(): tuple(r[1:]) for r in top.select("word", "known", "base", "log10").collect()}
    found = stage(_lookups(rows, spark.sparkContext.broadcast(table)), "token-lookups")
    rare = found.where("word IS NOT NULL").select("doc_id", "text_key", "word", "n")
    rare = rare.join(scored.select("word", "known", "base", "log10"), "word").select(
        "doc_id", "text_key", "n", (F.col("n") * F.col("known")).alias("n_known"),
        (F.col("n") * F.col("base")).alias("base"), (F.col("n") * F.col("log10")).alias("score"),
    )
    parts = found.where("word IS NULL").drop("word").withColumn("copies", F.lit(1))
    parts = parts.unionByName(rare.withColumn("copies", F.lit(0)))
    # rows alike in key and text add up alike: each gets its share
    sums_of = parts.groupBy("doc_id", "text_key").agg(
        F.sum("copies").alias("copies"),
        *[F.sum(c).alias(c) for c in ("n", "n_known", "base", "score")],
    )
    keyed = rows.select("doc_id", "text_key", "held_out")
    joined = keyed.join(sums_of, same(keyed, sums_of, ["doc_id", "text_key"]))
    end_base = math.log10((ends + 1) / (n + v + 1))
    share = lambda c: F.col(c) / F.col("copies")
    return joined.select(
        keyed["doc_id"], keyed["text_key"], "held_out",
        (share("n").cast("bigint") + 1).alias("n_tokens"),
        (share("n_known").cast("bigint") + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (share("base") + end_base).alias("base_score"),
        (share("score") + math.log10(end)).alias("score"),
    )
