"""Valuation-shaped views of the driver's tables, as DataFrames and as SQL.

Prices, areas and coordinates are stand-ins; missing and zero values are put in by id so that
every null path is met.  Each ``*_SQL`` is one named query for a WITH clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.exprs import fold_of

TYPES = ("interior", "exterior", "satellite", "floorplan")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "lineitem"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")  # whole numbers add up alike in any order
    sums = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum("l_quantity"), 2).alias("q"),
        F.count(F.lit(1)).cast("double").alias("k"),
        (F.sum(cents) / 100.0).alias("e"),
        (F.sum(cents * (100 - F.round(F.col("l_discount") * 100).cast("bigint"))) / 10000.0).alias("d"),
    )
    where = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("zone"), F.col("n_regionkey").alias("zone3")
    )
    k = F.col("o_orderkey")
    gap = lambda m, x: F.when(k % m != 0, x)
    x = o.join(where, "o_custkey", "left").join(sums, "o_orderkey", "left")
    return x.select(
        k.alias("listing_id"),
        "o_custkey",
        "zone",
        "zone3",
        F.col("o_orderpriority").alias("kind"),
        F.col("o_totalprice").alias("price"),
        F.log1p("o_totalprice").alias("log_price"),
        gap(11, F.when(k % 13 == 0, 0.0).otherwise(F.col("q"))).alias("area"),
        F.when(k % 17 == 0, 0.0).otherwise(F.col("k")).alias("bedrooms"),
        gap(19, (1 + k % 4).cast("double")).alias("bathrooms"),
        gap(7, F.when(k % 29 == 0, 0.0).otherwise(F.col("e"))).alias("tax"),
        gap(3, F.col("d")).alias("listing_price"),
        gap(2, F.col("q") * 10).alias("lot_area"),
        gap(23, (k % 9).cast("double")).alias("photos"),
        gap(37, (2024 - 1950 - k % 70).cast("double")).alias("age"),
        gap(31, 25.0 + (F.col("o_custkey") * 7919 % 5000) / 1000.0).alias("latitude"),
        gap(31, -80.0 - (F.col("o_custkey") * 104729 % 3000) / 1000.0).alias("longitude"),
    )


LISTINGS_SQL = """listings AS (
  SELECT o_orderkey AS listing_id, o_custkey, c_nationkey AS zone, n_regionkey AS zone3, o_orderpriority AS kind,
    o_totalprice AS price, ln(1 + o_totalprice) AS log_price,
    CASE WHEN o_orderkey % 11 <> 0 THEN CASE WHEN o_orderkey % 13 = 0 THEN 0.0::DOUBLE ELSE q END END AS area,
    CASE WHEN o_orderkey % 17 = 0 THEN 0.0::DOUBLE ELSE k END AS bedrooms,
    CASE WHEN o_orderkey % 19 <> 0 THEN (1 + o_orderkey % 4)::DOUBLE END AS bathrooms,
    CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_orderkey % 29 = 0 THEN 0.0::DOUBLE ELSE e END END AS tax,
    CASE WHEN o_orderkey % 3 <> 0 THEN d END AS listing_price,
    CASE WHEN o_orderkey % 2 <> 0 THEN q * 10 END AS lot_area,
    CASE WHEN o_orderkey % 23 <> 0 THEN (o_orderkey % 9)::DOUBLE END AS photos,
    CASE WHEN o_orderkey % 37 <> 0 THEN (2024 - 1950 - o_orderkey % 70)::DOUBLE END AS age,
    CASE WHEN o_orderkey % 31 <> 0 THEN 25.0::DOUBLE + (o_custkey * 7919 % 5000)::DOUBLE / 1000.0 END AS latitude,
    CASE WHEN o_orderkey % 31 <> 0 THEN -80.0::DOUBLE - (o_custkey * 104729 % 3000)::DOUBLE / 1000.0 END AS longitude
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT l_orderkey, round(sum(l_quantity), 2) AS q, count(*)::DOUBLE AS k, sum(round(l_extendedprice * 100)::BIGINT)::DOUBLE / 100.0 AS e,
               sum(round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT))::DOUBLE / 10000.0 AS d FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with vectors: parent listing_id, image_index, type, ok flag."""
    e, v = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("label") % 4 + 1).cast("int"))
    return e.select(
        (v % 120).alias("listing_id"),
        F.expr("vec_id div 120").alias("image_index"),
        kind.alias("type"),
        (v % 17 != 0).cast("int").alias("ok"),
        F.col("label").cast("double").alias("suffix"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )


PHOTOS_SQL = """photos AS (
  SELECT vec_id % 120 AS listing_id, vec_id // 120 AS image_index,
    ['interior', 'exterior', 'satellite', 'floorplan'][label % 4 + 1] AS type,
    (vec_id % 17 <> 0)::INTEGER AS ok, label::DOUBLE AS suffix, embedding::DOUBLE[] AS vector FROM embeddings)"""

PHRASES = (
    "Starter home, priced below market!",
    "Luxurious waterfront estate with private dock",
    "Fixer-upper, as is, bring your tools",
    "Move-in ready and priced to sell; won't last",
    "Bank-owned foreclosure, investor special",
    "Manufactured home on leased land",
    "Price reduced - great deal, motivated seller",
    "Gourmet kitchen, ocean view, high end finishes",
    "Affordable entry level with rental income",
    "A quiet place",
)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions: a phrase by id and the whole text of a document; NULL where the text is."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (k % 10 + 1).cast("int"))
    return d.select("doc_id", F.concat(phrase, F.lit(" "), "text").alias("description"))


TEXTS_SQL = f"""texts AS (
  SELECT doc_id, [{', '.join("'" + p.replace("'", "''") + "'" for p in PHRASES)}][doc_id % 10 + 1] || ' ' || text AS description FROM documents)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic prediction per listing, in price and log."""
    k = F.col("listing_id")
    p = F.round(F.col("price") * 100).cast("bigint") * (150 + k * 37 % 101) / 20000.0
    out = listings(spark, sf_dir).withColumn("pred", p)
    return out.withColumns({"pred_log": F.log1p("pred"), "gate": (k % 3 != 0).cast("int"), "residual": (k * 53 % 97 - 48) / 100.0, "fold": fold_of(k, 5)})


PREDICTIONS_SQL = (
    LISTINGS_SQL
    + """, predictions AS (
  SELECT *, ln(1 + pred) AS pred_log FROM (
    SELECT *, (round(price * 100)::BIGINT * (150 + listing_id * 37 % 101))::DOUBLE / 20000.0 AS pred, (listing_id % 3 <> 0)::INTEGER AS gate,
      (listing_id * 53 % 97 - 48)::DOUBLE / 100.0 AS residual,
      (('0x' || substr(md5(listing_id::VARCHAR || '-42'), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM listings))"""
)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached flags in chunks that overlap: (chunk, pos, zpid, flag, later_flag)."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select(F.expr("event_id div 64").alias("chunk"), (k % 64).alias("pos"), k.alias("zpid"), F.round("value", 2).alias("flag"))
    again = e.where(k % 5 == 0).select(
        (F.expr("event_id div 64") + 1).alias("chunk"), (k % 64 + 64).alias("pos"), k.alias("zpid"), F.round(F.col("value") + 1, 2).alias("flag")
    )
    return rows.unionByName(again)


CHUNKS_SQL = """chunks AS (
  SELECT event_id // 64 AS chunk, event_id % 64 AS pos, event_id AS zpid, round(value, 2) AS flag FROM events
  UNION ALL SELECT event_id // 64 + 1, event_id % 64 + 64, event_id, round(value + 1, 2) FROM events WHERE event_id % 5 = 0)"""
