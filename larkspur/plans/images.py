"""Queries: photos and their vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.exprs import dot, l2_normalise, softmax
from larkspur.operators import images
from larkspur.plans.registry import query
from larkspur.sources.views import PHOTOS_SQL, photos

OK_SQL = PHOTOS_SQL + ", good AS (SELECT * FROM photos WHERE ok = 1)"
SHARES = ", ".join(f"avg((type = '{k}')::INTEGER) AS frac_{k}" for k in images.TYPES)
ENTROPY = " + ".join(f"CASE WHEN frac_{k} > 0 THEN -frac_{k} * ln(frac_{k} + 1e-9) ELSE 0 END" for k in images.TYPES)


def good(spark, sf_dir):
    return photos(spark, sf_dir).where("ok = 1")


def unfold(out, column: str):
    """A row per key and place, rounded, so that vectors compare."""
    long = out.select("listing_id", F.posexplode(column).alias("i", "x"))
    return long.select("listing_id", F.col("i").cast("bigint").alias("i"), F.round("x", 5).alias("x"))


UNNESTED = "u AS (SELECT listing_id, type, image_index, unnest(range(64)) AS i, unnest(vector) AS x FROM good)"


@query("group_head_n", f"WITH {PHOTOS_SQL}, r AS (SELECT listing_id, image_index, row_number() OVER (PARTITION BY listing_id ORDER BY image_index) AS place FROM photos) SELECT * FROM r WHERE place <= 3")
def group_head_n(spark, sf_dir):
    return images.head(photos(spark, sf_dir), 3).select("listing_id", "image_index", F.col("place").cast("bigint").alias("place"))


@query("main_photo", f"WITH {OK_SQL} SELECT listing_id, min(image_index) AS image_index, min_by(type, image_index) AS type FROM good GROUP BY 1")
def main_photo(spark, sf_dir):
    return images.main_photo(good(spark, sf_dir)).select("listing_id", "image_index", "type")


@query(
    "photo_scalars",
    f"""WITH {OK_SQL}, s AS (SELECT listing_id, count(*) AS n_images, {SHARES}, max((type = 'satellite')::INTEGER) AS has_satellite, avg(suffix) AS suffix_mean, min(suffix) AS suffix_min,
          max(suffix) AS suffix_max, coalesce(stddev_samp(suffix), 0) AS suffix_std, min_by(suffix, image_index) AS suffix_main FROM good GROUP BY 1)
        SELECT listing_id, n_images, has_satellite, {", ".join(f"round(frac_{k}, 6) AS frac_{k}" for k in images.TYPES)}, round(suffix_mean, 6) AS suffix_mean, suffix_min, suffix_max,
          round(suffix_std, 6) AS suffix_std, suffix_main, round({ENTROPY}, 6) + 0 AS type_entropy, round(1 - frac_satellite - frac_floorplan, 6) AS frac_inside_out FROM s""",
)
def photo_scalars(spark, sf_dir):
    out = images.scalars(good(spark, sf_dir))
    rounded = [f"frac_{k}" for k in images.TYPES] + ["suffix_mean", "suffix_std", "frac_inside_out"]
    plain = ["listing_id", "n_images", "has_satellite", "suffix_min", "suffix_max", "suffix_main"]
    return out.select(*plain, *[F.round(c, 6).alias(c) for c in rounded], (F.round("type_entropy", 6) + 0).alias("type_entropy"))


@query(
    "listing_flags",
    f"""WITH {OK_SQL}, s AS (SELECT listing_id, count(*) AS n, bool_and(type = 'satellite') AS sat, bool_and(type = 'floorplan') AS fp, min_by(type, image_index) AS main FROM good GROUP BY 1),
          f AS (SELECT listing_id, (n = 1)::INTEGER AS single_photo, (n <= 3)::INTEGER AS sparse_listing, (n <= 5)::INTEGER AS few_photos, round(ln(1 + n), 6) AS log_n_images,
            sat::INTEGER AS satellite_only, fp::INTEGER AS floorplan_only, (n = 1 AND main = 'exterior')::INTEGER AS single_exterior, (n = 1 AND main = 'satellite')::INTEGER AS single_satellite FROM s)
        SELECT *, (sparse_listing = 0 AND single_photo = 0 AND satellite_only = 0)::INTEGER AS gate, (single_photo = 1 OR single_satellite = 1 OR satellite_only = 1) AS at_risk FROM f""",
)
def listing_flags(spark, sf_dir):
    out = images.listing_flags(good(spark, sf_dir))
    return out.withColumns({"log_n_images": F.round("log_n_images", 6), "gate": images.gate(), "at_risk": images.at_risk()})


@query("vector_mean_pool", f"WITH {OK_SQL}, {UNNESTED} SELECT listing_id, i, round(avg(x), 5) AS x FROM u GROUP BY 1, 2")
def vector_mean_pool(spark, sf_dir):
    return unfold(images.mean_pool(good(spark, sf_dir)), "pooled")


@query(
    "masked_pool",
    f"WITH {OK_SQL}, {UNNESTED} SELECT listing_id, i, round(coalesce(avg(x) FILTER (type IN ('interior', 'exterior')), avg(x)), 5) AS x FROM u GROUP BY 1, 2",
)
def masked_pool(spark, sf_dir):
    return unfold(images.masked_pool(good(spark, sf_dir), ["interior", "exterior"]), "pooled")


@query("vector_diversity", f"WITH {OK_SQL}, {UNNESTED}, s AS (SELECT listing_id, i, stddev_samp(x) AS s FROM u GROUP BY 1, 2) SELECT listing_id, round(coalesce(avg(s), 0), 6) AS diversity FROM s GROUP BY 1")
def vector_diversity(spark, sf_dir):
    return images.diversity(good(spark, sf_dir)).select("listing_id", F.round("diversity", 6).alias("diversity"))


@query(
    "cosine_softmax",
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT vec_id AS prompt, v AS w FROM e WHERE vec_id < 4),
         c AS (SELECT vec_id, prompt, list_cosine_similarity(v, w) AS s FROM e, p), m AS (SELECT *, exp((s - max(s) OVER k) * 10) AS x FROM c WINDOW k AS (PARTITION BY vec_id))
       SELECT vec_id, prompt, round(x / sum(x) OVER (PARTITION BY vec_id), 5) AS p FROM m""",
)
def cosine_softmax(spark, sf_dir):
    from larkspur.sources.views import table

    e = table(spark, sf_dir, "embeddings").select("vec_id", l2_normalise(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))
    prompts = e.where("vec_id < 4").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("ps"))  # four fixed prompts
    sims = e.crossJoin(F.broadcast(prompts)).withColumn("sims", F.transform("ps", lambda p: dot(F.col("v"), p["v"])))
    out = sims.select("vec_id", F.posexplode(softmax("sims", 10.0)).alias("prompt", "p"))
    return out.select("vec_id", F.col("prompt").cast("bigint").alias("prompt"), F.round("p", 5).alias("p"))
