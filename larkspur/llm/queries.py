"""The ten operators as queries over the driver's tables, and SQL for those SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import exact_dedup, jaccard_join, packing, pii, quality_classifier, quality_rules, sentencepiece_codec, substring_dedup, suffix_dedup, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    of = lambda kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    return found.select(
        "doc_id",
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS],
        F.sha2(pii.joined(of(pii.BASE_KINDS)), 256).alias("base_sha256"),
        pii.joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in pii.EXTRA_KINDS],
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    added = packing.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=50, digest=True)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=400, digest=True)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_warc,
        op3_jaccard_join,
        op4_pii,
        op5_sentencepiece,
        op6_exact_dedup,
        op7_packing,
        op8_substring_dedup,
        op9_quality_rules,
        op10_suffix_dedup,
    )
}

WORDS_SQL = r"SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents"

ORACLE_SQL = {
    "op3_jaccard_join": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x20\x09-\x0D]+') AS w FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
          FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        pairs AS (
          SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
          GROUP BY ALL),
        links AS (
          SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)),
        ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM reach JOIN ends ON b = x),
        low AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id
        FROM documents d JOIN low ON a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
    """,
    "op8_substring_dedup": f"""
        WITH words AS ({WORDS_SQL}),
        windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
                    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
        marked AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS m FROM windows),
        each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM words),
        gone AS (SELECT e.doc_id, e.i, word,
                   coalesce(bool_or(m) OVER (PARTITION BY e.doc_id ORDER BY e.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS g
                 FROM each e LEFT JOIN marked k ON e.doc_id = k.doc_id AND e.i = k.i),
        kept AS (SELECT doc_id, count(*) FILTER (g) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT g), '') AS t
                 FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM words LEFT JOIN kept USING (doc_id)
    """,
    "op2_warc": """
        SELECT page_id, n AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> max(page_id) OVER g THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> max(page_id) OVER g THEN max(page_id) OVER g END AS refers_to
        FROM (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d
              FROM pages)
        WINDOW g AS (PARTITION BY h)
    """,
    "op10_suffix_dedup": """
        WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        strings AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 800)) AS h
                    FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 399)) AS i FROM bytes WHERE length(x) >= 800)),
        starts AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS k FROM strings) WHERE k > 1),
        runs AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (
                   SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM starts)),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM runs GROUP BY doc_id, r),
        gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS f, a AS t FROM spans
                 UNION ALL SELECT doc_id, max(b), 1000000000 FROM spans GROUP BY doc_id),
        kept AS (SELECT g.doc_id, string_agg(substr(x, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k FROM gaps g JOIN bytes USING (doc_id) GROUP BY 1),
        sums AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
        SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(k, x))) AS kept_sha256
        FROM bytes LEFT JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
    """,
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        WINDOW g AS (PARTITION BY t)
    """,
}
