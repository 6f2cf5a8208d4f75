"""Queries: fold-safe encodings, grids of corrections and what a fitted transform gives on other rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.exprs import dot, fold_of
from larkspur.operators import calibrate, encode, images, knn, learn
from larkspur.plans.images import OK_SQL
from larkspur.plans.registry import query
from larkspur.plans.spatial import KM_SQL, PLACES_SQL, places
from larkspur.sources.scans import scratch
from larkspur.sources.views import PHOTOS_SQL, PREDICTIONS_SQL, photos, predictions

FOLDS = 5
# The grids that are tried.
ALPHAS, CAPS = [0.0, 0.25, 0.5, 0.75, 1.0], [0.03, 0.05, 0.08]
SHRINKS = [0.55, 0.65, 0.75, 0.85, 0.92, 1.0]


@query(
    "fold_safe_photo_median",
    f"""WITH {PREDICTIONS_SQL}, p AS (SELECT listing_id, zone, fold, greatest(coalesce(photos, 0), 0) AS v FROM predictions), f AS (SELECT unnest(range({FOLDS}))::INTEGER AS fo),
          t AS (SELECT fo, zone, v FROM p, f WHERE fold <> fo), g AS (SELECT fo, median(v) AS g FROM t GROUP BY fo), m AS (SELECT fo, zone, count(v) AS n, median(v) AS m FROM t GROUP BY ALL)
        SELECT listing_id, fold, round(coalesce((n * m + 20 * g) / (n + 20), g), 6) AS zone_median
        FROM p LEFT JOIN m ON fold = m.fo AND p.zone = m.zone LEFT JOIN g ON fold = g.fo""",
)
def fold_safe_photo_median(spark, sf_dir):
    out = encode.fold_safe_median(predictions(spark, sf_dir), "fold", FOLDS, "zone", "photos")
    return out.select("listing_id", "fold", F.round("zone_median", 6).alias("zone_median"))


def _nearest_sql(on: str) -> str:
    return f"""(SELECT id, avg(y) AS knn FROM (SELECT a.id, b.y, row_number() OVER (PARTITION BY a.id ORDER BY {KM_SQL}, b.id) AS place FROM filled a JOIN filled b ON a.fo = b.fo AND {on}) WHERE place <= 20 GROUP BY id)"""


@query(
    "fold_safe_knn",
    f"""WITH {PLACES_SQL}, x AS (SELECT *, ('0x' || substr(md5(id::VARCHAR || '-42'), 1, 8))::BIGINT % {FOLDS} AS fold FROM places), f AS (SELECT unnest(range({FOLDS})) AS fo UNION ALL SELECT -1),
          m AS (SELECT fo, median(lat) AS mlat, median(lon) AS mlon FROM x, f WHERE fold <> fo GROUP BY fo),
          filled AS (SELECT fo, id, fold, y, coalesce(lat, mlat) AS lat, coalesce(lon, mlon) AS lon FROM x, m)
        SELECT o.id, round(o.knn, 6) AS knn, round(t.knn, 6) AS knn_train FROM {_nearest_sql('a.fold = a.fo AND b.fold <> a.fo')} o JOIN {_nearest_sql('a.fo = -1 AND a.id <> b.id')} t USING (id)""",
)
def fold_safe_knn(spark, sf_dir):
    x = places(spark, sf_dir).withColumn("fold", fold_of("id", FOLDS))
    return knn.fold_safe(x, "fold", FOLDS).select("id", F.round("knn", 6).alias("knn"), F.round("knn_train", 6).alias("knn_train"))


@query(
    "crossfit_debias",
    f"""WITH {PREDICTIONS_SQL}, f AS (SELECT unnest(range({FOLDS}))::INTEGER AS fo), l AS (SELECT fo, regr_slope(log_price, pred_log) AS b, avg(pred_log) AS p, avg(log_price) AS r FROM predictions, f WHERE fold <> fo GROUP BY fo),
          d AS (SELECT fold, log_price, pred_log, r + coalesce(b, 1) * (pred_log - p) AS m FROM predictions JOIN l ON fold = fo)
        SELECT fold, count(*) AS n, round(avg(abs(pred_log - log_price)), 6) AS before, round(avg(abs(m - log_price)), 6) AS after FROM d GROUP BY fold""",
)
def crossfit_debias(spark, sf_dir):
    x = calibrate.crossfit_line(predictions(spark, sf_dir), "fold", FOLDS, "pred_log", "log_price", "m")
    error = lambda c: F.round(F.avg(F.abs(F.col(c) - F.col("log_price"))), 6)
    return x.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), error("pred_log").alias("before"), error("m").alias("after"))


POINTS_SQL = ", ".join(f"({a}::DOUBLE, {c}::DOUBLE)" for a in ALPHAS for c in (CAPS if a else CAPS[:1]))


@query(
    "residual_grid",
    f"""WITH {PREDICTIONS_SQL}, g AS (SELECT * FROM (VALUES {POINTS_SQL}) v(alpha, cap))
        SELECT alpha, cap, round(100 * sum(abs(exp(pred_log + greatest(least(alpha * residual, cap), -cap)) - 1 - price)) / sum(abs(price)), 6) AS wmape FROM predictions, g GROUP BY 1, 2""",
)
def residual_grid(spark, sf_dir):
    out = calibrate.residual_grid(predictions(spark, sf_dir), "price", "pred_log", "residual", ALPHAS, CAPS)
    return out.select("alpha", "cap", F.round("wmape", 6).alias("wmape"))


SHRINK_SQL = f"""{PREDICTIONS_SQL}, c AS (SELECT avg(pred_log) AS c FROM predictions), s AS (SELECT unnest({SHRINKS}::DOUBLE[]) AS alpha),
  w AS (SELECT alpha, c, 100 * sum(abs(exp(CASE WHEN gate = 0 AND alpha < 1 THEN c + alpha * (pred_log - c) ELSE pred_log END) - 1 - price)) / sum(abs(price)) AS wmape FROM predictions, c, s GROUP BY 1, 2)"""


@query("shrink_grid", f"WITH {SHRINK_SQL} SELECT alpha, round(wmape, 6) AS wmape FROM w")
def shrink_grid(spark, sf_dir):
    out = calibrate.shrink_grid(predictions(spark, sf_dir), "price", "pred_log", F.col("gate") == 0, SHRINKS)
    return out.select("alpha", F.round("wmape", 6).alias("wmape"))


@query(
    "shrink_stored",
    f"""WITH {SHRINK_SQL}, b AS (SELECT alpha, c FROM w ORDER BY round(wmape, 9), alpha LIMIT 1)
        SELECT listing_id, round(CASE WHEN gate = 0 AND alpha < 1 THEN c + alpha * (pred_log - c) ELSE pred_log END, 6) AS shrunk, pred_log AS unchanged FROM predictions, b""",
)
def shrink_stored(spark, sf_dir):
    """The best shrinking, kept as a record, read again and applied; without a record nothing changes."""
    x, risk = predictions(spark, sf_dir), F.col("gate") == 0
    best = calibrate.shrink_grid(x, "price", "pred_log", risk, SHRINKS).orderBy(F.round("wmape", 9), "alpha").first()
    path = scratch(spark, "shrink")
    nothing = calibrate.Shrink.load(spark, path)
    calibrate.Shrink(best["alpha"], best["centre"]).save(spark, path)
    fitted = calibrate.Shrink.load(spark, path)
    return x.select("listing_id", F.round(calibrate.Shrink.apply(fitted, "pred_log", risk), 6).alias("shrunk"), calibrate.Shrink.apply(nothing, "pred_log", risk).alias("unchanged"))


@query(
    "photo_totals",
    f"WITH {OK_SQL}, a AS (SELECT listing_id, count(*) AS n_images FROM good GROUP BY 1), t AS (SELECT listing_id, count(*) AS n FROM photos GROUP BY 1) SELECT listing_id, n_images, coalesce(n, n_images) AS n_photos_total FROM a LEFT JOIN t USING (listing_id)",
)
def photo_totals(spark, sf_dir):
    every = photos(spark, sf_dir)
    return images.with_totals(images.scalars(every.where("ok = 1")), every).select("listing_id", "n_images", "n_photos_total")


@query(
    "fused_medians",
    f"""WITH {PREDICTIONS_SQL}, {OK_SQL}, s AS (SELECT listing_id, count(*)::DOUBLE AS n_images, avg(suffix) AS suffix_mean FROM good GROUP BY 1),
          m AS (SELECT median(n_images) AS mn, median(suffix_mean) AS ms FROM s WHERE listing_id IN (SELECT listing_id FROM predictions WHERE fold <> 0))
        SELECT listing_id, area, round(coalesce(n_images, mn), 6) AS n_images, round(coalesce(suffix_mean, ms), 6) AS suffix_mean FROM predictions LEFT JOIN s USING (listing_id), m""",
)
def fused_medians(spark, sf_dir):
    """Tabular rows with photo columns; gaps get the medians over the training folds."""
    x = predictions(spark, sf_dir)
    part = images.scalars(photos(spark, sf_dir).where("ok = 1")).select("listing_id", F.col("n_images").cast("double").alias("n_images"), "suffix_mean")
    out = learn.fuse(x.select("listing_id", "area"), "listing_id", [part], x.where("fold <> 0"))
    return out.select("listing_id", "area", F.round("n_images", 6).alias("n_images"), F.round("suffix_mean", 6).alias("suffix_mean"))


VECTORS_SQL = f"{PHOTOS_SQL}, u AS (SELECT listing_id, image_index, unnest(vector) AS x, unnest(range(1, len(vector) + 1)) AS i FROM photos)"


def _size(scores):
    return F.round(dot(scores, scores), 5)


@query(
    "pca_lengths",
    f"WITH {VECTORS_SQL}, c AS (SELECT i, avg(x) AS m FROM u GROUP BY 1) SELECT listing_id, image_index, round(sum((x - m) * (x - m)), 5) AS length FROM u JOIN c USING (i) GROUP BY 1, 2",
)
def pca_lengths(spark, sf_dir):
    """With as many components as columns, scores are as long as the centred vectors."""
    from larkspur.plans.learning import pca_scores

    return pca_scores(spark, sf_dir).select("listing_id", "image_index", _size("scores").alias("length"))


@query("svd_lengths", f"WITH {VECTORS_SQL} SELECT listing_id, image_index, round(sum(x * x), 5) AS length FROM u GROUP BY 1, 2")
def svd_lengths(spark, sf_dir):
    """With as many components as columns, scores are as long as the vectors."""
    from larkspur.plans.learning import svd_scores

    return svd_scores(spark, sf_dir).select("listing_id", "image_index", _size("scores").alias("length"))


@query(
    "svd_applied",
    f"""WITH {VECTORS_SQL}, g AS (SELECT sum(x * x) AS total FROM u JOIN photos USING (listing_id, image_index) WHERE ok = 1)
        SELECT listing_id, image_index, round(sum(x * x), 5) AS length, round(any_value(total), 4) AS total FROM u, g GROUP BY 1, 2""",
)
def svd_applied(spark, sf_dir):
    """Axes fitted on the photos that are ok, applied to all; ``total`` is the sum of the fitted squares."""
    x = photos(spark, sf_dir).select(F.struct("listing_id", "image_index").alias("id"), "ok", "vector")
    train = x.where("ok = 1")
    axes = learn.right_axes(train, "vector", 256)
    total = learn.project(train, "id", "vector", axes).agg(F.round(F.sum(dot("scores", "scores")), 4).alias("total"))
    return learn.project(x, "id", "vector", axes).select("id.*", _size("scores").alias("length")).crossJoin(F.broadcast(total))
