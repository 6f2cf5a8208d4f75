"""Queries: joins, set operations, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import exprs
from larkspur.operators import joins
from larkspur.plans.registry import query
from larkspur.sources.views import CHUNKS_SQL, LISTINGS_SQL, PREDICTIONS_SQL, chunks, listings, predictions, table


@query("template_left_join", f"WITH {PREDICTIONS_SQL} SELECT o_orderkey AS listing_id, pred FROM orders LEFT JOIN predictions ON o_orderkey = listing_id")
def template_left_join(spark, sf_dir):
    template = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id"))
    return joins.template_join(template, predictions(spark, sf_dir), "listing_id", "pred")


@query(
    "left_join_default",
    f"WITH {PREDICTIONS_SQL}, p AS (SELECT * FROM predictions WHERE listing_id % 4 <> 0), m AS (SELECT median(pred) AS m FROM p) SELECT o_orderkey AS listing_id, round(coalesce(pred, m), 6) AS pred FROM orders LEFT JOIN p ON o_orderkey = listing_id CROSS JOIN m",
)
def left_join_default(spark, sf_dir):
    known = predictions(spark, sf_dir).where("listing_id % 4 <> 0")
    template = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("listing_id")).crossJoin(F.broadcast(known.agg(F.median("pred").alias("m"))))
    return joins.template_join(template, known, "listing_id", "pred", F.col("m")).select("listing_id", F.round("pred", 6).alias("pred"))


@query("inner_join", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 200000")
def inner_join(spark, sf_dir):
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    out = o.where("o_totalprice > 200000").join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select("o_orderkey", "c_name", "n_name")


@query(
    "outer_join",
    "WITH c AS (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_nationkey < 15 GROUP BY 1), s AS (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier WHERE s_nationkey > 8 GROUP BY 1) SELECT coalesce(c.k, s.k) AS nation, customers, suppliers FROM c FULL JOIN s ON c.k = s.k",
)
def outer_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nation", "full")


@query("anti_join_pending", f"WITH {CHUNKS_SQL} SELECT event_id AS zpid FROM events WHERE event_id NOT IN (SELECT zpid FROM chunks WHERE chunk % 3 = 0)")
def anti_join_pending(spark, sf_dir):
    from larkspur.operators.incremental import pending

    work = table(spark, sf_dir, "events").select(F.col("event_id").alias("zpid"))
    return pending(work, chunks(spark, sf_dir).where("chunk % 3 = 0"), "zpid")


@query("semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_join(spark, sf_dir):
    late = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(late, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query(
    "union_schema_fill",
    f"WITH {CHUNKS_SQL} SELECT zpid, chunk, flag AS llm_a, 0.0::DOUBLE AS llm_b FROM chunks WHERE chunk % 2 = 0 UNION ALL SELECT zpid, chunk, flag, flag * 2 FROM chunks WHERE chunk % 2 = 1",
)
def union_schema_fill(spark, sf_dir):
    x = chunks(spark, sf_dir)
    old = x.where("chunk % 2 = 0").select("zpid", "chunk", F.col("flag").alias("llm_a"))
    new = x.where("chunk % 2 = 1").select("zpid", "chunk", F.col("flag").alias("llm_a"), (F.col("flag") * 2).alias("llm_b"))
    return joins.union_filled([old, new], ["llm_a", "llm_b"])


@query("union_all_distinct", f"WITH {CHUNKS_SQL} SELECT DISTINCT zpid FROM chunks")
def union_all_distinct(spark, sf_dir):
    return chunks(spark, sf_dir).select("zpid").distinct()


@query(
    "result_diff",
    f"""WITH {PREDICTIONS_SQL}, d AS (SELECT listing_id, price, pred AS new_value, pred * 0.9 AS old_value FROM predictions)
        SELECT listing_id, new_value - old_value AS diff, 100 * (new_value - old_value) / old_value AS diff_pct, (abs(new_value - price) < abs(old_value - price))::INTEGER AS better FROM d""",
)
def result_diff(spark, sf_dir):
    new = predictions(spark, sf_dir)
    old = new.select("listing_id", (F.col("pred") * 0.9).alias("pred"))
    out = joins.result_diff(new, old, "listing_id", "pred", "price")
    return out.select("listing_id", "diff", "diff_pct", "better")


@query("key_concat_columns", f"WITH {LISTINGS_SQL} SELECT a.listing_id, a.price, b.area FROM listings a JOIN listings b USING (listing_id) WHERE b.area IS NOT NULL")
def key_concat_columns(spark, sf_dir):
    x = listings(spark, sf_dir)
    return x.select("listing_id", "price").join(x.select("listing_id", "area").where("area is not null"), "listing_id")


@query("scalar_rules", f"""WITH {LISTINGS_SQL} SELECT listing_id, CASE WHEN photos IS NOT NULL THEN greatest(least(photos, 6.0), 2.0) END AS clipped, CASE WHEN listing_price >= 100000 THEN listing_price END AS masked,
        (coalesce(bedrooms, 0) > 2)::INTEGER AS large, (kind IN ('1-URGENT', '2-HIGH')) AS urgent, nullif(area, 0) AS area_or_null FROM listings WHERE tax IS NOT NULL""")
def scalar_rules(spark, sf_dir):
    x = listings(spark, sf_dir).where(F.col("tax").isNotNull())
    return x.select(
        "listing_id",
        exprs.clip("photos", 2.0, 6.0).alias("clipped"),
        F.when(F.col("listing_price") >= 100_000, F.col("listing_price")).alias("masked"),
        (F.coalesce("bedrooms", F.lit(0.0)) > 2).cast("int").alias("large"),
        F.col("kind").isin("1-URGENT", "2-HIGH").alias("urgent"),
        exprs.zero_to_null("area").alias("area_or_null"),
    )


@query("top_abs", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 4500) DESC, c_custkey LIMIT 15")
def top_abs(spark, sf_dir):
    return table(spark, sf_dir, "customer").orderBy(F.desc(F.abs(F.col("c_acctbal") - 4500)), "c_custkey").limit(15).select("c_custkey", "c_acctbal")


@query("limited_scan", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def limited_scan(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(100)


@query(
    "second_largest",
    "WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC) AS r, l_extendedprice FROM lineitem) SELECT l_orderkey, l_extendedprice AS second FROM l WHERE r = 2",
)
def second_largest(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("v"))
    return x.where(F.size("v") > 1).select("l_orderkey", F.element_at("v", -2).alias("second"))
