"""The registered queries of this package, with their SQL where there is one."""

from pyspark.sql import functions as F

from . import (
    classifier, decontam, forest, lattice, lines, middle, mixing, phrases, rules, shards, simhash,
    substrings, warc,
)

SHARDS = 24


def read(spark, folder, table):
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_ngram_jaccard_join(spark, folder):
    classes = forest.ngram_classes(read(spark, folder, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", "n_links", "n_copies")


def op2_prefix_decontamination(spark, folder):
    docs, benchmark = read(spark, folder, "documents"), read(spark, folder, "benchmark")
    found = decontam.decontaminate(docs, benchmark, carry=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op3_byte_network(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    network = classifier.fit_quality(docs, read(spark, folder, "labels"))
    scored = classifier.score_quality(docs, network)
    return scored.select(
        "doc_id", classifier.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op4_quality_rules(spark, folder):
    judged = rules.quality_rules(read(spark, folder, "documents"), carry=["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


def op5_rendezvous_sharding(spark, folder):
    docs = read(spark, folder, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shards.assign_shards(sized, [1.0] * SHARDS, grown=[1.0] * (SHARDS + 1))
    numbered = shards.number_slots(placed, ["doc_id", "text_crc32", "size"])
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


def op6_subword_lattice(spark, folder):
    scored = lattice.score_documents(read(spark, folder, "documents").select("doc_id", "text"))
    return scored.drop("text_key")


def op7_super_kmer_dedup(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, with_text=False, carry=["doc_id"])


def op8_warc_round_trip(spark, folder):
    records = warc.round_trip(read(spark, folder, "pages"))
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)")
    return records.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"),
    )


def op9_fuzzy_line_dedup(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs, carry=["doc_id"]).drop("kept_text")


def op10_source_mix(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text", "source")
    taken = mixing.words_taken(*mixing.mix_sources(docs))
    return taken.select("doc_id", "size", "source_size", "target", "taken", "source")


def op11_secondary_sort_middle(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return middle.fill_in_middle(docs, with_text=False)[["doc_id", *middle.ADDED]]


def op12_byte_index_simhash(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "text")
    return simhash.simhash_components(docs)[["doc_id", "fingerprint", "component_id"]]


def op13_quotient_filter_phrases(spark, folder):
    return phrases.collocations(read(spark, folder, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_prefix_decontamination": op2_prefix_decontamination,
    "op3_byte_network": op3_byte_network,
    "op4_quality_rules": op4_quality_rules,
    "op5_rendezvous_sharding": op5_rendezvous_sharding,
    "op6_subword_lattice": op6_subword_lattice,
    "op7_super_kmer_dedup": op7_super_kmer_dedup,
    "op8_warc_round_trip": op8_warc_round_trip,
    "op9_fuzzy_line_dedup": op9_fuzzy_line_dedup,
    "op10_source_mix": op10_source_mix,
    "op11_secondary_sort_middle": op11_secondary_sort_middle,
    "op12_byte_index_simhash": op12_byte_index_simhash,
    "op13_quotient_filter_phrases": op13_quotient_filter_phrases,
}

ORACLES = {
    "op5_rendezvous_sharding": """
        WITH tbl AS (
          SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
          FROM range(256) r(i)),
        d AS (
          SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
            xor(list_reduce(list_prepend(4294967295, list_transform(
              regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
              lambda p: CAST(concat('0x', p) AS BIGINT))),
              lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc,
            list_transform(range(25), lambda i: CAST(concat('0x', substr(md5(
              concat_ws('|', '0', i, doc_id)), 1, 15)) AS BIGINT)) AS h
          FROM documents, tbl),
        p AS (
          SELECT *, list_position(h[1:24], list_max(h[1:24])) - 1 AS shard,
            list_position(h, list_max(h)) - 1 AS grown_shard,
            CAST(concat('0x', substr(md5(concat_ws('|', doc_id, crc, size)), 1, 15)) AS BIGINT)
              % 1024 AS cut
          FROM d)
        SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard,
          row_number() OVER (PARTITION BY shard ORDER BY cut, doc_id, crc, size) - 1 AS slot,
          grown_shard
        FROM p""",
    "op8_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS h,
                max(page_id) OVER (PARTITION BY html) AS last FROM p)
        SELECT page_id, n AS payload_bytes,
          array_to_string(list_transform(range(32), lambda i: substr(
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            ((CAST(concat('0x', substr(h, 5 * (i // 4) + 1, 5)) AS BIGINT)
              >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
          CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN last <> page_id THEN last END AS refers_to
        FROM d""",
    "op10_source_mix": r"""
        WITH d AS (
          SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''),
            '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
          FROM documents),
        s AS (SELECT source, sum(size) AS source_size,
                CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                  WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
              FROM d GROUP BY source),
        l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
                - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s),
        t AS (SELECT source, source_size,
                least(2.0::DOUBLE * source_size, weight * max(level) OVER ()) AS target FROM l),
        p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source
                ORDER BY md5(concat_ws('|', '0', CAST(doc_id AS VARCHAR))), doc_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
        q AS (SELECT doc_id, source, size, start, source_size, target, round(target) AS quota
              FROM p JOIN t USING (source))
        SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, source,
          CAST(greatest(least(start + size, quota) - start, 0)
             + greatest(least(source_size + start + size, quota) - source_size - start, 0)
            AS BIGINT) AS taken
        FROM q""",
    "op7_super_kmer_dedup": r"""
        WITH w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        win AS (
          SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i
                FROM w WHERE len(ws) >= 13)),
        firsts AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win),
        gone AS (
          SELECT doc_id, list_distinct(list(p)) AS ps
          FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p
                FROM win JOIN firsts USING (win) WHERE first < doc_id)
          GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
          sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE
            list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)""",
    "op2_prefix_decontamination": r"""
        WITH w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
          FROM documents),
        b AS (
          SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
          FROM benchmark),
        iw AS (
          SELECT DISTINCT item_id, least(len(ws), 13) AS k,
            array_to_string(ws[i:i + 12], ' ') AS win
          FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i
                FROM b WHERE len(ws) > 0)),
        sizes AS (SELECT DISTINCT k FROM iw),
        dw AS (
          SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win
          FROM (SELECT doc_id, k, ws, unnest(range(1, len(ws) - k + 2)) AS i
                FROM w, sizes WHERE len(ws) >= k)),
        hits AS (SELECT doc_id, dw.k, i, item_id FROM dw JOIN iw USING (win) WHERE dw.k = iw.k),
        n AS (SELECT doc_id, count(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items,
                 string_agg(item, ',' ORDER BY item) AS items
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits)
               GROUP BY doc_id)
        SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit,
          coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
          coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op11_secondary_sort_middle": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h,
            regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
          FROM documents),
        g AS (
          SELECT *, len(u) AS n, list_transform(range(4), lambda i:
            CAST(concat('0x', substr(h, 8 * i + 1, 8)) AS BIGINT)) AS k FROM d),
        c AS (
          SELECT *, least(k[1] % (n + 1), k[2] % (n + 1)) AS x, greatest(k[1] % (n + 1), k[2] % (n + 1)) AS y,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
              OR k[3] % 100 >= 90 THEN 'plain' WHEN k[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
          FROM g),
        p AS (
          SELECT *, array_to_string(u[1:x], '') AS prefix, array_to_string(u[x + 1:y], '') AS middle,
            array_to_string(u[y + 1:], '') AS suffix FROM c)
        SELECT doc_id, n, form,
          CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
          CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
          sha256(CASE form WHEN 'plain' THEN t
            WHEN 'psm' THEN concat('<P>', prefix, '<S>', suffix, '<M>', middle)
            ELSE concat('<S>', suffix, '<P>', prefix, '<M>', middle) END) AS output_sha256,
          sha256(t) AS restored_sha256
        FROM p""",
    "op13_quotient_filter_phrases": r"""
        WITH p AS (
          SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws
          FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents)),
        g AS (
          SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3
          FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p)),
        f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
        f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
        longer AS (
          SELECT lang, x, y, max(f) AS f
          FROM (SELECT lang, w1 AS x, w2 AS y, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        cut AS (
          SELECT c.lang, concat_ws(' ', c.w1, c.w2) AS phrase, c.f AS a, 1 AS j, x.f AS l, y.f AS r
          FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
          LEFT JOIN longer o ON o.lang = c.lang AND o.x = c.w1 AND o.y = c.w2
          WHERE o.f IS NULL OR 100 * o.f < 50 * c.f
          UNION ALL
          SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), c.f, 1, x.f, y.f
          FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1
          JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
          UNION ALL
          SELECT c.lang, concat_ws(' ', c.w1, c.w2, c.w3), c.f, 2, x.f, y.f
          FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2
          JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
        scored AS (SELECT *, (CAST(a AS HUGEINT) * a * 1000000) // (CAST(l AS HUGEINT) * r) AS score FROM cut),
        kept AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
        SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        JOIN n USING (lang) WHERE rank <= 2000""",
}
