"""Queries: error metrics, calibration and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.exprs import normal, uniform
from larkspur.operators import calibrate, metrics
from larkspur.plans.registry import query
from larkspur.sources.views import PREDICTIONS_SQL, predictions

BINS = lambda n: f"[{', '.join(str(i / n) for i in range(1, n))}]"


def _binned(n: int) -> str:
    case = " ".join(f"WHEN price <= e[{i + 1}] THEN {i}" for i in range(n - 1))
    return f"e AS (SELECT quantile_cont(price, {BINS(n)}) AS e FROM predictions), b AS (SELECT *, CASE {case} ELSE {n - 1} END AS bin FROM predictions, e)"


REPORT = """count(*) AS n, min(price) AS least, max(price) AS largest, round(100 * avg(abs(pred - price) / nullif(price, 0)), 6) AS mape,
  round(100 * avg(pred - price) / avg(price), 6) AS bias, round(100 * avg((pred > price)::INTEGER), 6) AS over_rate"""


def _report(spark, sf_dir, n):
    out = metrics.bin_report(metrics.qcut(predictions(spark, sf_dir), "price", n), "bin", "price", "pred")
    return out.select("bin", "n", "least", "largest", *[F.round(c, 6).alias(c) for c in ("mape", "bias", "over_rate")])


@query("qcut_decile_bias", f"WITH {PREDICTIONS_SQL}, {_binned(10)} SELECT bin, {REPORT} FROM b GROUP BY bin")
def qcut_decile_bias(spark, sf_dir):
    return _report(spark, sf_dir, 10)


@query("quintile_report", f"WITH {PREDICTIONS_SQL}, {_binned(5)} SELECT bin, {REPORT} FROM b GROUP BY bin")
def quintile_report(spark, sf_dir):
    return _report(spark, sf_dir, 5)


@query(
    "error_metrics",
    f"""WITH {PREDICTIONS_SQL} SELECT count(*) AS n, round(avg(abs(pred - price)), 6) AS mae, round(100 * sum(abs(pred - price)) / sum(abs(price)), 6) AS wmape,
          round(100 * median(abs(pred - price) / nullif(price, 0)), 6) AS medape, round(1 - avg((price - pred) * (price - pred)) / var_pop(price), 6) AS r2 FROM predictions""",
)
def error_metrics(spark, sf_dir):
    out = metrics.error_metrics(predictions(spark, sf_dir), "price", "pred")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "wmape", "medape", "r2")])


@query(
    "slice_metrics",
    f"""WITH {PREDICTIONS_SQL} SELECT round(100 * sum(abs(pred - price)) FILTER (gate = 1) / sum(abs(price)) FILTER (gate = 1), 6) AS gated_wmape,
          round(100 * median(abs(pred - price) / nullif(price, 0)) FILTER (price < 150000), 6) AS cheap_medape FROM predictions""",
)
def slice_metrics(spark, sf_dir):
    cheap = F.when(F.col("price") < 150000, metrics.abs_error("price", "pred") / F.nullif(F.col("price"), F.lit(0.0)))
    return predictions(spark, sf_dir).agg(
        F.round(metrics.wmape("price", "pred", F.col("gate") == 1), 6).alias("gated_wmape"), F.round(100 * F.median(cheap), 6).alias("cheap_medape")
    )


@query(
    "avg_rank_weight",
    """WITH x AS (SELECT o_orderkey, round(o_totalprice, -3) AS p FROM orders), r AS (SELECT *, (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0) / count(*) OVER () AS r FROM x),
         w AS (SELECT *, greatest(least(0.5 + 2.0 * power(1 - r, 1.5), 2.5), 0.5) AS w FROM r)
       SELECT o_orderkey, round(w / avg(w) OVER (), 6) AS weight FROM w""",
)
def avg_rank_weight(spark, sf_dir):
    from larkspur.sources.views import table

    x = table(spark, sf_dir, "orders").select("o_orderkey", F.round("o_totalprice", -3).alias("p"))
    return metrics.cheap_weight(x, "p").select("o_orderkey", F.round("weight", 6).alias("weight"))


@query(
    "impute_median",
    f"WITH {PREDICTIONS_SQL}, m AS (SELECT median(area) AS a, median(tax) AS t, median(listing_price) AS l FROM predictions) SELECT listing_id, coalesce(area, a) AS area, coalesce(tax, t) AS tax, coalesce(listing_price, l) AS listing_price FROM predictions, m",
)
def impute_median(spark, sf_dir):
    from larkspur.operators.learn import impute

    return impute(predictions(spark, sf_dir), ["area", "tax", "listing_price"]).select("listing_id", "area", "tax", "listing_price")


@query(
    "soft_clip",
    f"""WITH {PREDICTIONS_SQL}, q AS (SELECT zone, quantile_cont(log_price, 0.1) AS a, quantile_cont(log_price, 0.5) AS m, quantile_cont(log_price, 0.9) AS z FROM predictions GROUP BY zone),
          s AS (SELECT listing_id, 0.88 * pred_log + 0.12 * (0.65 * m + 0.35 * log_price) AS p, a, z FROM predictions JOIN q USING (zone)),
          t AS (SELECT listing_id, CASE WHEN p > z THEN z + 0.55 * (p - z) ELSE p END AS p, a FROM s), u AS (SELECT listing_id, CASE WHEN p < a THEN a + 0.3 * (p - a) ELSE p END AS p FROM t)
        SELECT listing_id, round(p, 6) AS clipped, round(ln(1 + 0.9 * (exp(p) - 1)), 6) AS scaled FROM u""",
)
def soft_clip(spark, sf_dir):
    x = predictions(spark, sf_dir)
    q = x.groupBy("zone").agg(F.percentile("log_price", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).alias("q"))
    q10, q50, q90 = (F.get("q", F.lit(i)) for i in range(3))
    clipped = calibrate.soft_clip(F.col("pred_log"), calibrate.anchor(q50, "log_price"), q10, q90)
    out = x.join(q, "zone").select("listing_id", clipped.alias("p"))
    return out.select("listing_id", F.round("p", 6).alias("clipped"), F.round(calibrate.scale_price("p", 0.9), 6).alias("scaled"))


@query(
    "residual_cap",
    f"""WITH {PREDICTIONS_SQL}, m AS (SELECT avg(pred_log) AS c FROM predictions) SELECT listing_id, round(pred_log + gate * greatest(least(0.6 * residual, 0.2), -0.2), 6) AS gated,
          round(pred_log + greatest(least(0.6 * residual, 0.2), -0.2), 6) AS plain, round(CASE WHEN gate = 0 THEN c + 0.75 * (pred_log - c) ELSE pred_log END, 6) AS shrunk FROM predictions, m""",
)
def residual_cap(spark, sf_dir):
    x = predictions(spark, sf_dir)
    out = x.crossJoin(F.broadcast(x.agg(F.avg("pred_log").alias("c"))))
    return out.select(
        "listing_id",
        F.round(calibrate.gated_residual("pred_log", "residual", 0.6, 0.2, "gate"), 6).alias("gated"),
        F.round(calibrate.gated_residual("pred_log", "residual", 0.6, 0.2), 6).alias("plain"),
        F.round(calibrate.sparse_shrink("pred_log", F.col("gate") == 0, 0.75, F.col("c")), 6).alias("shrunk"),
    )


@query(
    "edge_features",
    f"""WITH {PREDICTIONS_SQL}, o AS (SELECT *, ln(1 + greatest(pred, 0)) - log_price AS over FROM predictions)
        SELECT listing_id, round(ln(1 + greatest(pred, 0)), 6) AS edge_base_log, CASE WHEN tax > 0 THEN round(ln(greatest(pred, 1) / tax), 6) END AS edge_log_tax,
          CASE WHEN listing_price >= 50000 THEN round(ln(greatest(pred, 1) / listing_price), 6) END AS edge_log_listing, CASE WHEN area > 0 THEN round(ln(greatest(pred, 1) / area), 6) END AS edge_log_area,
          (over > ln(1 / (0.85 * 1.02)))::INTEGER AS trap, round(greatest(over, 0), 6) + 0 AS severity FROM o""",
)
def edge_features(spark, sf_dir):
    out = predictions(spark, sf_dir).withColumns(calibrate.edge_features("pred", "tax", "listing_price", "area"))
    out = out.withColumns(calibrate.edge_targets("pred", "log_price"))
    rounded = [F.round(c, 6).alias(c) for c in ("edge_base_log", "edge_log_tax", "edge_log_listing", "edge_log_area")]
    return out.select("listing_id", *rounded, "trap", (F.round("severity", 6) + 0).alias("severity"))


RISK_SQL = "(listing_id * 71 % 100)::DOUBLE / 100.0"


@query(
    "edge_cut",
    f"""WITH {PREDICTIONS_SQL}, o AS (SELECT *, greatest(ln(1 + greatest(pred, 0)) - log_price, 0) AS sev, {RISK_SQL} AS risk FROM predictions),
          c AS (SELECT *, CASE WHEN risk >= 0.25 THEN greatest(least(0.5 * sev, 0.35), 0) ELSE 0 END AS cut FROM o)
        SELECT listing_id, round(exp(ln(1 + greatest(pred, 0)) - cut) - 1, 6) AS price_after, round((exp(ln(1 + greatest(pred, 0)) - cut) - 1 - pred) / pred * 100, 4) + 0 AS diff_pct FROM c""",
)
def edge_cut(spark, sf_dir):
    x = predictions(spark, sf_dir).withColumns(calibrate.edge_targets("pred", "log_price"))
    risk = (F.col("listing_id") * 71 % 100) / 100.0
    after = calibrate.edge_cut("pred", risk, "severity", 0.25, 0.5)
    out = x.select("listing_id", "pred", after.alias("after"))
    return out.select("listing_id", F.round("after", 6).alias("price_after"), (F.round((F.col("after") - F.col("pred")) / F.col("pred") * 100, 4) + 0).alias("diff_pct"))


GRID = [(t, a) for t in (0.1, 0.25, 0.4, 0.6, 0.8) for a in (0.25, 0.5, 0.75, 1.0)]


@query(
    "edge_grid_best",
    f"""WITH {PREDICTIONS_SQL}, g AS (SELECT * FROM (VALUES {", ".join(f"({t}::DOUBLE, {a}::DOUBLE)" for t, a in GRID)}) v(t, a)),
          o AS (SELECT listing_id, price, pred, greatest(ln(1 + greatest(pred, 0)) - log_price, 0) AS sev, {RISK_SQL} AS risk FROM predictions),
          p AS (SELECT t, a, price, exp(ln(1 + greatest(pred, 0)) - CASE WHEN risk >= t THEN greatest(least(a * sev, 0.35), 0) ELSE 0 END) - 1 AS q FROM o, g),
          m AS (SELECT t, a, round(100 * sum(abs(q - price)) / sum(abs(price)), 6) AS wmape, round(100 * avg((q > price + 1e-6)::INTEGER), 6) AS over_rate FROM p GROUP BY 1, 2)
        SELECT t AS threshold, a AS alpha, wmape, over_rate FROM m ORDER BY over_rate, wmape, t, a LIMIT 1""",
)
def edge_grid_best(spark, sf_dir):
    from larkspur.operators.learn import grid_best

    x = predictions(spark, sf_dir).withColumns(calibrate.edge_targets("pred", "log_price")).withColumn("risk", (F.col("listing_id") * 71 % 100) / 100.0)
    out = grid_best(x, GRID, "price", "pred", "risk", "severity")
    return out.select("threshold", "alpha", "wmape", "over_rate")


@query(
    "linear_debias",
    f"WITH {PREDICTIONS_SQL}, l AS (SELECT regr_slope(log_price, pred_log) AS b, regr_intercept(log_price, pred_log) AS a FROM predictions) SELECT listing_id, round(a + b * pred_log, 6) AS debiased FROM predictions, l",
)
def linear_debias(spark, sf_dir):
    x = predictions(spark, sf_dir)
    a, b = calibrate.fit_line(x, "pred_log", "log_price")
    return calibrate.Debias("linear", a, b).apply(x, "pred_log", "d").select("listing_id", F.round("d", 6).alias("debiased"))


@query("isotonic_debias")
def isotonic_debias(spark, sf_dir):
    x = predictions(spark, sf_dir)
    return calibrate.fit_debias(x, "pred_log", "log_price", "debiased").apply(x, "pred_log", "debiased").select("listing_id", "pred_log", "debiased")


@query("hashed_draws", "SELECT o_orderkey, round((('0x' || substr(md5(o_orderkey::VARCHAR || '-1'), 1, 8))::BIGINT + 0.5) / 4294967296.0, 9) AS u, round(sqrt(-2 * ln((('0x' || substr(md5(o_orderkey::VARCHAR || '-1'), 1, 8))::BIGINT + 0.5) / 4294967296.0)) * cos(2 * pi() * (('0x' || substr(md5(o_orderkey::VARCHAR || '-2'), 1, 8))::BIGINT + 0.5) / 4294967296.0), 6) AS z FROM orders")
def hashed_draws(spark, sf_dir):
    from larkspur.sources.views import table

    u, v = uniform(F.col("o_orderkey"), 1), uniform(F.col("o_orderkey"), 2)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(u, 9).alias("u"), F.round(normal(u, v), 6).alias("z"))
