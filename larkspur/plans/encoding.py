"""Queries: zone encodings and listing features."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import encode, features
from larkspur.plans.registry import query
from larkspur.sources.views import LISTINGS_SQL, PREDICTIONS_SQL, listings, predictions, table

ZONES_SQL = """
  z AS (SELECT zone, count(y) AS n, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM y GROUP BY zone),
  g AS (SELECT quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM y),
  e AS (SELECT zone, n, (n * z.q[1] + 20 * g.q[1]) / (n + 20) AS q10, (n * z.q[2] + 20 * g.q[2]) / (n + 20) AS q50,
          (n * z.q[3] + 20 * g.q[3]) / (n + 20) AS q90 FROM z, g)"""


@query(
    "zone_quantile_encoding",
    f"""WITH y AS (SELECT o_orderkey, c_nationkey AS zone, ln(1 + o_totalprice) AS y, o_totalprice AS p
                   FROM orders JOIN customer ON o_custkey = c_custkey), {ZONES_SQL}
        SELECT o_orderkey, zone, n AS zone_rows, round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90,
          round(q90 - q10, 6) AS log_spread, round(p / greatest(exp(q50) - 1, 1), 6) AS price_to_q50
        FROM y JOIN e USING (zone)""",
)
def zone_quantile_encoding(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("c_nationkey").alias("zone"), F.log1p("o_totalprice").alias("y"), F.col("o_totalprice").alias("p")
    )
    fitted, overall = encode.zone_quantiles(rows, "zone", "y")
    out = encode.look_up(rows, fitted, overall, ["zone"])
    out = encode.zone_ratios(out, "p", "p")
    rounded = [F.round(c, 6).alias(c) for c in ("q10", "q50", "q90", "log_spread")]
    return out.select("o_orderkey", "zone", "zone_rows", *rounded, F.round("tax_to_q50", 6).alias("price_to_q50"))


@query(
    "zone_lookup_with_default",
    f"""WITH y AS (SELECT c_nationkey AS zone, c_acctbal AS y FROM customer WHERE c_nationkey < 20), {ZONES_SQL}
        SELECT s_suppkey, round(coalesce(e.q10, g.q[1]), 6) AS q10, round(coalesce(e.q50, g.q[2]), 6) AS q50, round(coalesce(e.q90, g.q[3]), 6) AS q90
        FROM supplier LEFT JOIN e ON zone = s_nationkey CROSS JOIN g""",
)
def zone_lookup_with_default(spark, sf_dir):
    train = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("zone"), "c_acctbal")
    fitted, overall = encode.zone_quantiles(train, "zone", "c_acctbal")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("zone"))
    out = encode.look_up(rows, fitted, overall, ["zone"])
    return out.select("s_suppkey", *[F.round(c, 6).alias(c) for c in ("q10", "q50", "q90")])


@query(
    "zone_photo_median",
    f"""WITH {LISTINGS_SQL}, p AS (SELECT listing_id, zone, greatest(coalesce(photos, 0), 0) AS v FROM listings),
          g AS (SELECT median(v) AS g FROM p), m AS (SELECT zone, (count(v) * median(v) + 20 * any_value(g)) / (count(v) + 20) AS m FROM p, g GROUP BY zone)
        SELECT listing_id, round(m, 6) AS zone_median, round(v / greatest(coalesce(m, g), 1), 6) AS photo_ratio
        FROM p LEFT JOIN m USING (zone) CROSS JOIN g""",
)
def zone_photo_median(spark, sf_dir):
    rows = listings(spark, sf_dir)
    fitted = encode.zone_median(rows, "zone", "photos")
    out = rows.join(fitted, "zone", "left")
    photos = F.greatest(F.coalesce("photos", F.lit(0.0)), F.lit(0.0))
    ratio = photos / F.greatest(F.coalesce("zone_median", "overall"), F.lit(1.0))
    return out.select("listing_id", F.round("zone_median", 6).alias("zone_median"), F.round(F.coalesce(ratio, F.lit(1.0)), 6).alias("photo_ratio"))


FEATURES = "log_area log_lot age log_listing log_tax log_photos few_photos_large_home coast_km coastal_area".split()
QUOTIENTS = "bath_to_bed area_per_bedroom tax_per_area listing_to_tax photos_per_100".split()  # the same in any engine
COAST_SQL = "2 * 6371.0 * asin(sqrt(least(power(sin((radians(latitude) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(latitude)) * power(sin((radians(-80.08) - radians(longitude)) / 2), 2), 1.0)))"
LOG0 = "ln(1 + greatest(coalesce({0}, 0.0), 0.0))"


@query(
    "listing_features",
    f"""WITH {LISTINGS_SQL}, x AS (SELECT *, greatest(coalesce(photos, 0.0), 0.0) AS ph, {COAST_SQL} AS km FROM listings), m AS (SELECT median(age) AS ma FROM listings)
        SELECT listing_id, o_custkey // 100 AS zone_prefix, (coalesce(listing_price > 0, false))::INTEGER AS has_listing,
          round({LOG0.format('area')}, 6) AS log_area, round({LOG0.format('lot_area')}, 6) AS log_lot, round(coalesce(age, ma), 6) AS age,
          coalesce(bathrooms / nullif(bedrooms, 0), 1.0) AS bath_to_bed, coalesce(area / nullif(bedrooms, 0), area) AS area_per_bedroom,
          tax / nullif(area, 0) AS tax_per_area, round({LOG0.format('listing_price')}, 6) AS log_listing, round({LOG0.format('tax')}, 6) AS log_tax,
          listing_price / nullif(tax, 0) AS listing_to_tax, round(ln(1 + ph), 6) AS log_photos, ph / nullif(area / 100.0, 0) AS photos_per_100,
          round((ph <= 5)::INTEGER * {LOG0.format('area')}, 6) AS few_photos_large_home, round(km, 6) AS coast_km,
          round(CASE WHEN coalesce(km <= 3, false) THEN coalesce(area, 0.0) ELSE 0.0 END, 6) AS coastal_area
        FROM x CROSS JOIN m""",
)
def listing_features(spark, sf_dir):
    out = features.listing_features(listings(spark, sf_dir), "o_custkey")
    return out.select("listing_id", "zone_prefix", "has_listing", *QUOTIENTS, *[F.round(c, 6).alias(c) for c in FEATURES])


@query(
    "fold_safe_encoding",
    f"""WITH {PREDICTIONS_SQL}, r AS (SELECT listing_id, zone, fold, log_price AS y FROM predictions), f AS (SELECT unnest(range(5))::INTEGER AS fo),
          t AS (SELECT fo, zone, y FROM r, f WHERE fold <> fo), g AS (SELECT fo, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM t GROUP BY fo),
          z AS (SELECT fo, zone, count(y) AS n, quantile_cont(y, [0.1, 0.5, 0.9]) AS q FROM t GROUP BY ALL),
          e AS (SELECT fo, zone, (n * z.q[1] + 20 * g.q[1]) / (n + 20) AS q10, (n * z.q[2] + 20 * g.q[2]) / (n + 20) AS q50, (n * z.q[3] + 20 * g.q[3]) / (n + 20) AS q90 FROM z JOIN g USING (fo))
        SELECT listing_id, fold, round(coalesce(q10, q[1]), 6) AS q10, round(coalesce(q50, q[2]), 6) AS q50, round(coalesce(q90, q[3]), 6) AS q90
        FROM r LEFT JOIN e ON fold = e.fo AND r.zone = e.zone LEFT JOIN g ON fold = g.fo""",
)
def fold_safe_encoding(spark, sf_dir):
    out = encode.fold_safe(predictions(spark, sf_dir), "fold", 5, "zone", "log_price")
    return out.select("listing_id", "fold", *[F.round(c, 6).alias(c) for c in ("q10", "q50", "q90")])
