"""Queries: nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import knn
from larkspur.plans.registry import query
from larkspur.sources.views import table

PLACES_SQL = """places AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 31 <> 0 THEN 25.0::DOUBLE + (c_custkey * 7919 % 5000)::DOUBLE / 1000.0 END AS lat,
  CASE WHEN c_custkey % 31 <> 0 THEN -80.0::DOUBLE - (c_custkey * 104729 % 3000)::DOUBLE / 1000.0 END AS lon, c_acctbal AS y FROM customer)"""
FILLED_SQL = "m AS (SELECT median(lat) AS mlat, median(lon) AS mlon FROM r), rf AS (SELECT id, coalesce(lat, mlat) AS lat, coalesce(lon, mlon) AS lon, y FROM r, m), qf AS (SELECT id, coalesce(lat, mlat) AS lat, coalesce(lon, mlon) AS lon FROM q, m)"
KM_SQL = "round(2 * 6371.0 * asin(sqrt(least(power(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin((radians(b.lon) - radians(a.lon)) / 2), 2), 1.0))), 9)"


SHOPS_SQL = """shops AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 13 <> 0 THEN 25.0::DOUBLE + (s_suppkey * 6151 % 5000)::DOUBLE / 1000.0 END AS lat,
  CASE WHEN s_suppkey % 13 <> 0 THEN -80.0::DOUBLE - (s_suppkey * 92821 % 3000)::DOUBLE / 1000.0 END AS lon FROM supplier)"""


def _sql(asked: str, on: str) -> str:
    return f"""WITH {PLACES_SQL}, {SHOPS_SQL}, q AS (SELECT * FROM {asked}), r AS (SELECT * FROM places), {FILLED_SQL},
      d AS (SELECT a.id, b.y, row_number() OVER (PARTITION BY a.id ORDER BY {KM_SQL}, b.id) AS place FROM qf a JOIN rf b ON {on})
      SELECT id, round(avg(y), 6) AS knn FROM d WHERE place <= 20 GROUP BY id"""


def places(spark, sf_dir):
    k = F.col("c_custkey")
    gap = lambda x: F.when(k % 31 != 0, x)
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), gap(25.0 + (k * 7919 % 5000) / 1000.0).alias("lat"), gap(-80.0 - (k * 104729 % 3000) / 1000.0).alias("lon"), F.col("c_acctbal").alias("y")
    )


def shops(spark, sf_dir):
    k = F.col("s_suppkey")
    gap = lambda x: F.when(k % 13 != 0, x)
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), gap(25.0 + (k * 6151 % 5000) / 1000.0).alias("lat"), gap(-80.0 - (k * 92821 % 3000) / 1000.0).alias("lon")
    )


@query("knn_mean_target_loo", _sql("places", "a.id <> b.id"))
def knn_mean_target_loo(spark, sf_dir):
    x = places(spark, sf_dir)
    return knn.mean_target(x, x, 20, exclude_self=True).select("id", F.round("knn", 6).alias("knn"))


@query("knn_mean_target", _sql("shops", "true"))
def knn_mean_target(spark, sf_dir):
    """Every supplier against every customer."""
    return knn.mean_target(shops(spark, sf_dir), places(spark, sf_dir), 20).select("id", F.round("knn", 6).alias("knn"))
