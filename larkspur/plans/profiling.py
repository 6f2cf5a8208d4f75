"""Queries: data profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.exprs import argmax_name
from larkspur.operators import profile
from larkspur.plans.registry import query
from larkspur.sources.views import LISTINGS_SQL, PHOTOS_SQL, listings, photos, table

MEASURES = ["price", "area", "bedrooms", "bathrooms", "tax", "listing_price", "lot_area", "photos", "latitude"]
FLAGS = ["no_tax", "no_listing", "many_rooms"]


def _union(one, names) -> str:
    return " UNION ALL ".join(one(c) for c in names)


def flagged(spark, sf_dir):
    return listings(spark, sf_dir).withColumns(
        {
            "no_tax": F.col("tax").isNull().cast("int"),
            "no_listing": F.col("listing_price").isNull().cast("int"),
            "many_rooms": (F.col("bedrooms") > 4).cast("int"),
        }
    )


FLAGGED_SQL = LISTINGS_SQL + ", flagged AS (SELECT *, (tax IS NULL)::INTEGER AS no_tax, (listing_price IS NULL)::INTEGER AS no_listing, (bedrooms > 4)::INTEGER AS many_rooms FROM listings)"


@query("missing_profile", f"WITH {LISTINGS_SQL} SELECT * FROM ({_union(lambda c: f'''SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing, round(100.0 * (count(*) - count({c})) / count(*), 6) AS pct FROM listings''', MEASURES)}) WHERE n_missing > 0")
def missing_profile(spark, sf_dir):
    out = profile.missing_profile(listings(spark, sf_dir), MEASURES)
    return out.select(F.col("column").alias("column_name"), "n_missing", F.round("pct", 6).alias("pct"))


@query(
    "describe_exact",
    f"WITH {LISTINGS_SQL} "
    + _union(
        lambda c: f"SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS least, round(quantile_cont({c}, 0.25), 6) AS p25, "
        f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS largest FROM listings",
        MEASURES,
    ),
)
def describe_exact(spark, sf_dir):
    out = profile.describe(listings(spark, sf_dir), MEASURES)
    return out.select(F.col("column").alias("column_name"), "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "p25", "p50", "p75", "largest")])


@query("value_counts_topn", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def value_counts_topn(spark, sf_dir):
    return profile.value_counts(table(spark, sf_dir, "orders"), "o_custkey", 15).withColumnRenamed("count", "n")


@query(
    "corr_with_target",
    f"WITH {LISTINGS_SQL}, r AS ({_union(lambda c: f'''SELECT '{c}' AS column_name, corr({c}, log_price) AS r FROM listings''', MEASURES)}) SELECT column_name, round(r, 6) AS r FROM r ORDER BY abs(r) DESC, column_name LIMIT 8",
)
def corr_with_target(spark, sf_dir):
    out = profile.correlations(listings(spark, sf_dir), MEASURES, "log_price")
    return out.orderBy(F.desc(F.abs("r")), "column").limit(8).select(F.col("column").alias("column_name"), F.round("r", 6).alias("r"))


PAIRED = ["price", "area", "tax", "listing_price"]


@query("corr_matrix", f"WITH {LISTINGS_SQL} " + _union(lambda ab: f"SELECT '{ab[0]}' AS a, '{ab[1]}' AS b, round(corr({ab[0]}, {ab[1]}), 6) AS r FROM listings", [(a, b) for a in PAIRED for b in PAIRED]))
def corr_matrix(spark, sf_dir):
    return profile.correlation_matrix(listings(spark, sf_dir), PAIRED).select("a", "b", F.round("r", 6).alias("r"))


@query(
    "binary_effects",
    f"WITH {FLAGGED_SQL}, e AS ("
    + _union(
        lambda c: f"SELECT '{c}' AS feature, count(*) FILTER ({c} = 1) AS n, 100.0 * count(*) FILTER ({c} = 1) / count(*) AS pct, avg(price) FILTER ({c} = 1) AS mean_on, avg(price) FILTER ({c} = 0) AS mean_off FROM flagged",
        FLAGS,
    )
    + ") SELECT feature, n, round(pct, 4) AS pct, round(mean_on, 4) AS mean_on, round(mean_off, 4) AS mean_off, round(mean_on - mean_off, 4) AS diff FROM e",
)
def binary_effects(spark, sf_dir):
    out = profile.binary_effects(flagged(spark, sf_dir), FLAGS, "price")
    return out.select("feature", "n", *[F.round(c, 4).alias(c) for c in ("pct", "mean_on", "mean_off", "diff")]).orderBy(F.desc("diff"))


@query(
    "iqr_outliers",
    f"WITH {LISTINGS_SQL}, q AS (SELECT quantile_cont(tax, 0.25) AS a, quantile_cont(tax, 0.75) AS b FROM listings) SELECT listing_id, tax FROM listings, q WHERE tax < a - 1.5 * (b - a) OR tax > b + 1.5 * (b - a)",
)
def iqr_outliers(spark, sf_dir):
    return profile.iqr_outliers(listings(spark, sf_dir), "tax").select("listing_id", "tax")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


@query(
    "crosstab_pct",
    "SELECT o_orderpriority, " + ", ".join(f"round(100.0 * count(*) FILTER (o_orderstatus = '{s}') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')), 0), 6) AS pct_{s.lower()}" for s in STATUSES) + " FROM orders GROUP BY 1",
)
def crosstab_pct(spark, sf_dir):
    out = profile.crosstab_pct(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", STATUSES)
    return out.select("o_orderpriority", *[F.round(s, 6).alias(f"pct_{s.lower()}") for s in STATUSES])


@query("group_mean_median_count", f"WITH {LISTINGS_SQL} SELECT kind, count(area) AS n, round(avg(area), 6) AS mean, round(median(area), 6) AS middle, count(DISTINCT zone) AS zones FROM listings GROUP BY kind")
def group_mean_median_count(spark, sf_dir):
    return listings(spark, sf_dir).groupBy("kind").agg(
        F.count("area").alias("n"), F.round(F.avg("area"), 6).alias("mean"), F.round(F.median("area"), 6).alias("middle"), F.count_distinct("zone").alias("zones")
    )


@query(
    "dominant_type",
    f"""WITH {PHOTOS_SQL}, s AS (SELECT listing_id, avg((type = 'interior')::INTEGER) AS i, avg((type = 'exterior')::INTEGER) AS e, avg((type = 'satellite')::INTEGER) AS s,
          avg((type = 'floorplan')::INTEGER) AS f FROM photos GROUP BY 1)
        SELECT listing_id, CASE greatest(i, e, s, f) WHEN i THEN 'interior' WHEN e THEN 'exterior' WHEN s THEN 'satellite' ELSE 'floorplan' END AS dominant FROM s""",
)
def dominant_type(spark, sf_dir):
    from larkspur.operators.images import TYPES, share

    shares = photos(spark, sf_dir).groupBy("listing_id").agg(*[share(k).alias(k) for k in TYPES])
    return shares.select("listing_id", argmax_name(list(TYPES)).alias("dominant"))
