"""Queries: text features and loose values."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.exprs import loose_number, slug, suffix_number, without_prefix
from larkspur.operators import texts as ops
from larkspur.plans.registry import query
from larkspur.sources.views import TEXTS_SQL, table, texts


def _hits(name: str) -> str:
    return f"regexp_matches(coalesce(description, ''), '(?i){ops.PATTERNS[name].replace(chr(39), chr(39) * 2)}')::INTEGER"


@query("lexical_flags", f"WITH {TEXTS_SQL} SELECT doc_id, {', '.join(f'{_hits(n)} AS {n}' for n in ops.PATTERNS)} FROM texts")
def lexical_flags(spark, sf_dir):
    return ops.lexical_flags(texts(spark, sf_dir), "description").select("doc_id", *ops.PATTERNS)


@query(
    "cue_score",
    f"WITH {TEXTS_SQL}, f AS (SELECT doc_id, {' + '.join(map(_hits, ops.CHEAP))} AS cheap_cues, {' + '.join(map(_hits, ops.PREMIUM))} AS premium_cues FROM texts) SELECT *, premium_cues - cheap_cues AS band_score FROM f",
)
def cue_score(spark, sf_dir):
    return ops.cue_scores(ops.lexical_flags(texts(spark, sf_dir), "description")).select("doc_id", "cheap_cues", "premium_cues", "band_score")


@query("text_length_truncate", f"WITH {TEXTS_SQL} SELECT doc_id, length(coalesce(description, '')) AS n, substr(coalesce(description, ''), 1, 40) AS head FROM texts")
def text_length_truncate(spark, sf_dir):
    t = F.coalesce("description", F.lit(""))
    return texts(spark, sf_dir).select("doc_id", F.length(t).cast("bigint").alias("n"), F.substring(t, 1, 40).alias("head"))


@query(
    "suffix_parse",
    """WITH f AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'photo_' || p_partkey || '.jpg' WHEN 1 THEN 'a_b_' || p_size || '.x.png' WHEN 2 THEN 'none.jpg' ELSE p_name END AS filename FROM part)
       SELECT p_partkey, coalesce(try_cast(string_split(regexp_replace(filename, '\\.[^.]*$', ''), '_')[-1] AS INTEGER), -1) AS suffix FROM f""",
)
def suffix_parse(spark, sf_dir):
    k = F.col("p_partkey")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("photo_"), k.cast("string"), F.lit(".jpg")))
        .when(k % 4 == 1, F.concat(F.lit("a_b_"), F.col("p_size").cast("string"), F.lit(".x.png")))
        .when(k % 4 == 2, F.lit("none.jpg"))
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", suffix_number(name).alias("suffix"))


@query(
    "slugify",
    "SELECT p_partkey, lower(regexp_replace(regexp_replace(p_type || ' / ' || p_brand || '!', '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug, regexp_replace('frac_' || p_brand, '^frac_', '') AS bare FROM part",
)
def slugify(spark, sf_dir):
    text = F.concat(F.col("p_type"), F.lit(" / "), F.col("p_brand"), F.lit("!"))
    return table(spark, sf_dir, "part").select("p_partkey", slug(text).alias("slug"), without_prefix(F.concat(F.lit("frac_"), "p_brand"), "frac_").alias("bare"))


VALUES = ["1.5", " Yes ", "no", "", "true", "n", "Y", "-2e3", "abc", "12 "]


@query(
    "coerce_number",
    f"""WITH v AS (SELECT event_id, CASE WHEN event_id % 11 < 10 THEN [{", ".join(f"'{v}'" for v in VALUES)}][event_id % 11 + 1] END AS raw FROM events)
        SELECT event_id, coalesce(try_cast(trim(raw) AS DOUBLE), CASE WHEN lower(trim(raw)) IN ('true', 'yes', 'y') THEN 1.0 ELSE 0.0 END) AS number FROM v""",
)
def coerce_number(spark, sf_dir):
    raw = F.when(F.col("event_id") % 11 < 10, F.element_at(F.array(*map(F.lit, VALUES)), (F.col("event_id") % 11 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", loose_number(raw).alias("number"))


@query(
    "json_rows",
    """WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '{"rows":[[' || c_custkey || ',"yes",' || c_nationkey || '],[' || (c_custkey + 1) || ',null,true]]}'
           ELSE '{"items":[{"zpid":' || c_custkey || ',"llm_a":"0.5","b":' || c_nationkey || '}]}' END AS reply FROM customer),
         r AS (SELECT c_custkey, c_custkey AS zpid, CASE WHEN c_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a, c_nationkey::DOUBLE AS b FROM c JOIN customer USING (c_custkey)
           UNION ALL SELECT c_custkey, c_custkey + 1, 0.0::DOUBLE, 1.0::DOUBLE FROM c WHERE c_custkey % 2 = 0)
       SELECT * FROM r""",
)
def json_rows(spark, sf_dir):
    """Replies of two shapes, made and decoded: {"rows": [[id, a, b]]} and {"items": [{id, llm_a, b}]}."""
    from larkspur.operators.incremental import decode_flags

    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    rows = F.concat(F.lit('{"rows":[['), k, F.lit(',"yes",'), n, F.lit("],["), (F.col("c_custkey") + 1).cast("string"), F.lit(",null,true]]}"))
    items = F.to_json(F.struct(F.array(F.struct(F.col("c_custkey").alias("zpid"), F.lit("0.5").alias("llm_a"), F.col("c_nationkey").alias("b"))).alias("items")))
    replies = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, rows).otherwise(items).alias("reply"))
    return decode_flags(replies, "reply", ["llm_a", "llm_b"]).select("c_custkey", "zpid", F.col("llm_a").alias("a"), F.col("llm_b").alias("b"))


TERMS_SQL = f"""w AS (SELECT doc_id, regexp_extract_all(translate(lower(coalesce(text, '')), '{ops.ACCENTED}', '{ops.PLAIN}'), '{ops.WORD}') AS t FROM documents),
          u AS (SELECT doc_id, unnest(range(1, len(t) + 1)) AS i, unnest(t) AS a FROM w),
          b AS (SELECT doc_id, a || ' ' || lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS term FROM u),
          c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, a AS term FROM u UNION ALL SELECT * FROM b WHERE term IS NOT NULL) GROUP BY 1, 2)"""


@query(
    "tfidf_top_terms",
    f"""WITH {TERMS_SQL},
          n AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1),
          v AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM f, n WHERE df >= 3 AND df <= 0.98 * n ORDER BY total DESC, term LIMIT 5000),
          x AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term)), y AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x),
          z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 9) DESC, term) AS place FROM y)
        SELECT doc_id, term, place, round(w, 6) AS weight FROM z WHERE place <= 3""",
)
def tfidf_top_terms(spark, sf_dir):
    from pyspark.sql import Window

    weights = ops.tfidf(table(spark, sf_dir, "documents"), "doc_id", "text")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("weight", 9)), "term"))
    top = weights.withColumn("place", place).where("place <= 3")
    return top.select("doc_id", "term", F.col("place").cast("bigint").alias("place"), F.round("weight", 6).alias("weight"))


@query(
    "tfidf_applied",
    f"""WITH {TERMS_SQL}, s AS (SELECT doc_id FROM documents WHERE lang = 'en'), n AS (SELECT count(*) AS n FROM s),
          f AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c WHERE doc_id IN (SELECT doc_id FROM s) GROUP BY 1),
          v AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM f, n WHERE df >= 3 AND df <= 0.98 * n ORDER BY total DESC, term LIMIT 5000),
          x AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM c JOIN v USING (term)), y AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x)
        SELECT doc_id, count(*) AS n_terms, round(sum(w), 6) AS total, round(max(w), 6) AS largest FROM y GROUP BY 1""",
)
def tfidf_applied(spark, sf_dir):
    """A vocabulary fitted on the English documents, applied to all."""
    x = table(spark, sf_dir, "documents")
    weights = ops.weigh(x, "doc_id", "text", ops.vocabulary(x.where("lang = 'en'"), "text"))
    return weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("largest"))
