"""Queries: resumable enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import incremental
from larkspur.plans.registry import query
from larkspur.sources.views import CHUNKS_SQL, chunks, table


@query("keep_last_dedup", f"WITH {CHUNKS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY zpid ORDER BY chunk DESC, pos DESC) AS k FROM chunks) SELECT zpid, chunk, flag FROM r WHERE k = 1")
def keep_last_dedup(spark, sf_dir):
    return incremental.keep_last(chunks(spark, sf_dir), "zpid", ["chunk", "pos"]).select("zpid", "chunk", "flag")


@query(
    "resumable_batches",
    f"""WITH {CHUNKS_SQL}, p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events WHERE event_id NOT IN (SELECT zpid FROM chunks WHERE chunk % 3 = 0))
        SELECT event_id AS zpid, pos // 16 AS batch, min(event_id) OVER (PARTITION BY pos // 16) AS first_zpid FROM p""",
)
def resumable_batches(spark, sf_dir):
    work = table(spark, sf_dir, "events").select(F.col("event_id").alias("zpid"))
    left = incremental.pending(work, chunks(spark, sf_dir).where("chunk % 3 = 0"), "zpid")
    numbered = incremental.batches(left, "zpid", 16)
    first = numbered.groupBy("batch").agg(F.min("zpid").alias("first_zpid"))
    return numbered.join(first, "batch").select("zpid", "batch", "first_zpid")


@query(
    "prompt_json",
    """SELECT doc_id // 16 AS batch, md5('{"items":' || to_json(list({'zpid': doc_id, 'description': substr(coalesce(text, ''), 1, 1400)} ORDER BY doc_id)) || '}') AS prompt
       FROM documents GROUP BY 1""",
)
def prompt_json(spark, sf_dir):
    """Prompts of the texts as they are, up to the reference's 1400 characters; digests stand for them."""
    return prompts(spark, sf_dir).select("batch", F.md5("prompt").alias("prompt"))


def prompts(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select(F.expr("doc_id div 16").alias("batch"), "doc_id", "text")
    return incremental.encode_prompt(x, "batch", "doc_id", "text")
