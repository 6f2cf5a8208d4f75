"""Listing features: one projection, null-safe throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.exprs import clip, haversine_km, log1p0, safe_div

COAST_LONGITUDE = -80.08
COAST_KM = 3.0
REFERENCE_YEAR = 2024


def listing_features(x: DataFrame, zone_code: str = "zip") -> DataFrame:
    """The engineered columns of a listing table (see the names below).

    ``age`` is filled with the table's median; if the table has no such column it is made from
    ``year_built``.  Photos below 0 or missing count as 0.
    """
    if "age" not in x.columns:
        x = x.withColumn("age", F.lit(REFERENCE_YEAR) - F.col("year_built"))
    middle = F.broadcast(x.agg(F.median("age").alias("__age")))
    photos = clip(F.coalesce(F.col("photos"), F.lit(0.0)), low=0.0)
    coast = haversine_km("latitude", "longitude", F.col("latitude"), F.lit(COAST_LONGITUDE))
    area = F.col("area")
    return x.crossJoin(middle).withColumns(
        {
            "log_area": log1p0("area"),
            "log_lot": log1p0("lot_area"),
            "age": F.coalesce("age", "__age"),
            "bath_to_bed": F.coalesce(safe_div("bathrooms", "bedrooms"), F.lit(1.0)),
            "area_per_bedroom": F.coalesce(safe_div("area", "bedrooms"), area),
            "tax_per_area": safe_div("tax", "area"),
            "log_listing": log1p0("listing_price"),
            "log_tax": log1p0("tax"),
            "has_listing": F.coalesce(F.col("listing_price") > 0, F.lit(False)).cast("int"),
            "listing_to_tax": safe_div("listing_price", "tax"),
            "log_photos": F.log1p(photos),
            "photos_per_100": safe_div(photos, area / 100.0),
            "few_photos_large_home": F.when(photos <= 5, 1.0).otherwise(0.0) * log1p0("area"),
            "coast_km": coast,
            "coastal_area": F.when(F.coalesce(coast <= COAST_KM, F.lit(False)), F.coalesce(area, F.lit(0.0))).otherwise(0.0),
            "zone_prefix": F.expr(f"{zone_code} div 100"),
        }
    ).drop("__age")
