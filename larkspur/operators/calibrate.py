"""Calibration of log predictions: soft clips, residuals, cuts and monotone maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.exprs import clip, col, log_ratio

# Fixed values of the game and the calibration.
SHRINK = 0.88
ANCHOR_KNN = 0.35
RATE_ABOVE, RATE_BELOW = 0.55, 0.30
BID_FRACTION, COST = 0.85, 0.02
EDGE_CAP = 0.35
LEAST_LISTING = 50_000


def anchor(q50: Column | str, knn: Column | str) -> Column:
    return (1 - ANCHOR_KNN) * col(q50) + ANCHOR_KNN * col(knn)


def soft_clip(pred: Column, centre: Column, q10: Column, q90: Column, shrink: float = SHRINK) -> Column:
    """Shrink towards ``centre``; outside [q10, q90] keep a share of the excess, above first."""
    out = shrink * pred + (1 - shrink) * centre
    out = F.when(out > q90, q90 + RATE_ABOVE * (out - q90)).otherwise(out)
    return F.when(out < q10, q10 + RATE_BELOW * (out - q10)).otherwise(out)


def scale_price(pred_log: Column | str, k: float) -> Column:
    return col(pred_log) if k == 1.0 else F.log1p(k * F.expm1(col(pred_log)))


def gated_residual(base: Column | str, residual: Column | str, alpha: float, cap: float, gate: Column | str | None = None) -> Column:
    """base + gate * (alpha * residual within +-cap)."""
    step = clip(alpha * col(residual), -cap, cap)
    return col(base) + (step if gate is None else col(gate) * step)


def sparse_shrink(pred: Column | str, risk: Column, alpha: float, centre: Column) -> Column:
    p = col(pred)
    return p if alpha >= 1 else F.when(risk, centre + alpha * (p - centre)).otherwise(p)


def finalise(x: DataFrame, pred: str, out: str, debias=None, scale: float = 1.0, clipped: Column | None = None) -> DataFrame:
    """The chain of corrections: soft clip (if given), monotone map (a fitted :class:`Debias`), scale."""
    x = x.withColumn("__in", col(pred) if clipped is None else clipped)
    if debias is None:
        return x.withColumn(out, scale_price("__in", scale)).drop("__in")
    mapped = debias.apply(x.drop(pred).withColumnRenamed("__in", pred), pred, "__mapped")
    return mapped.withColumn(out, scale_price("__mapped", scale)).drop("__mapped")


def edge_features(price: str, tax: str, listing: str, area: str) -> dict[str, Column]:
    return {
        "edge_base_log": F.log1p(F.greatest(F.col(price), F.lit(0.0))),
        "edge_log_tax": log_ratio(price, tax),
        "edge_log_listing": log_ratio(price, F.when(F.col(listing) >= LEAST_LISTING, F.col(listing))),
        "edge_log_area": log_ratio(price, area),
    }


def edge_targets(price: Column | str, real_log: Column | str) -> dict[str, Column]:
    """over: log excess of the prediction; trap: a purchase at the bid would lose; severity: excess."""
    over = F.log1p(F.greatest(col(price), F.lit(0.0))) - col(real_log)
    limit = F.lit(-1.0) * F.ln(F.lit(BID_FRACTION * (1 + COST)))
    return {"trap": (over > limit).cast("int"), "severity": F.greatest(over, F.lit(0.0))}


def edge_cut(price: Column | str, risk: Column | str, severity: Column | str, threshold, alpha) -> Column:
    """Price after a cut of alpha * severity (0 to EDGE_CAP) where risk reaches the threshold."""
    cut = F.when(col(risk) >= threshold, clip(alpha * col(severity), 0.0, EDGE_CAP)).otherwise(0.0)
    return F.expm1(F.log1p(F.greatest(col(price), F.lit(0.0))) - cut)


def interpolate(x: Column, knots: list[float], values: list[float]) -> Column:
    """Piecewise linear through sorted knots, flat outside: a bounded conditional chain."""
    if len(knots) == 1:
        return F.when(x.isNotNull(), values[0])
    out = F.lit(values[-1])
    for i in reversed(range(len(knots) - 1)):
        slope = (values[i + 1] - values[i]) / ((knots[i + 1] - knots[i]) or 1.0)
        out = F.when(x <= knots[i + 1], values[i] + slope * (x - knots[i])).otherwise(out)
    return F.when(x.isNull(), None).when(x <= knots[0], values[0]).otherwise(out)


@dataclass
class Debias:
    """Monotone map of log predictions to log values; linear for few or constant points."""

    method: str
    a: float = 0.0
    b: float = 1.0
    model: object = None

    def apply(self, x: DataFrame, pred: str, out: str) -> DataFrame:
        if self.method == "linear":
            return x.withColumn(out, self.a + self.b * F.col(pred))
        return self.model.transform(x).withColumnRenamed(self.model.getPredictionCol(), out)


def fit_line(x: DataFrame, pred: str, real: str) -> tuple[float, float]:
    row = x.agg(F.regr_slope(real, pred).alias("b"), F.avg(pred).alias("p"), F.avg(real).alias("r"), F.count(F.lit(1)).alias("n")).first()
    b = 1.0 if row["b"] is None else row["b"]
    return (0.0, 1.0) if not row["n"] else (row["r"] - b * row["p"], b)


def fit_debias(x: DataFrame, pred: str, real: str, out: str, least: int = 50) -> Debias:
    """Isotonic regression if there are ``least`` finite points that differ, else a line."""
    from larkspur.functions.exprs import finite

    x = x.where(finite(pred) & finite(real)).select(pred, real)
    row = x.agg(F.count(F.lit(1)).alias("n"), (F.max(pred) - F.min(pred)).alias("w")).first()
    if row["n"] < least or row["w"] < 1e-9:
        return Debias("linear", *fit_line(x, pred, real))
    from pyspark.ml.regression import IsotonicRegression

    model = IsotonicRegression(featuresCol=pred, labelCol=real, predictionCol=out).fit(x)
    return Debias("isotonic", model=model)


def crossfit_line(x: DataFrame, fold: str, folds: int, pred: str, real: str, out: str) -> DataFrame:
    """``pred`` mapped by the line that the other folds fit: one job for all folds."""
    others = F.explode(F.array_remove(F.array(*[F.lit(i) for i in range(folds)]), F.col(fold)))
    train = x.select(pred, real, others.alias("__fold"))
    lines = train.groupBy("__fold").agg(F.regr_slope(real, pred).alias("__b"), F.avg(pred).alias("__p"), F.avg(real).alias("__r"))
    mapped = F.col("__r") + F.coalesce("__b", F.lit(1.0)) * (F.col(pred) - F.col("__p"))
    return x.withColumn("__fold", F.col(fold)).join(F.broadcast(lines), "__fold", "left").withColumn(out, mapped).drop("__fold", "__b", "__p", "__r")


def residual_grid(x: DataFrame, actual: str, base_log: str, residual: str, alphas: list[float], caps: list[float]) -> DataFrame:
    """(alpha, cap, wmape) of each capped share of a residual, in one job; alpha 0 is tried once, as caps do not matter there."""
    from larkspur.operators.metrics import wmape

    points = [(a, c) for a in alphas for c in (caps if a else caps[:1])]
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(c)).alias("cap")) for a, c in points]))
    step = clip(F.col("g.alpha") * F.col(residual), F.col("g.cap") * -1, F.col("g.cap"))
    rows = x.select(actual, base_log, residual, grid.alias("g")).withColumn("__after", F.expm1(F.col(base_log) + step))
    return rows.groupBy(F.col("g.alpha").alias("alpha"), F.col("g.cap").alias("cap")).agg(wmape(actual, "__after").alias("wmape"))


def shrink_grid(x: DataFrame, actual: str, pred_log: str, risk: Column, alphas: list[float]) -> DataFrame:
    """(alpha, centre, wmape) of each shrinking of risky rows towards the mean, in one job."""
    from larkspur.operators.metrics import wmape

    centre = F.broadcast(x.agg(F.avg(pred_log).alias("centre")))
    rows = x.crossJoin(centre).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    shrunk = F.when(risk & (F.col("alpha") < 1), F.col("centre") + F.col("alpha") * (F.col(pred_log) - F.col("centre"))).otherwise(F.col(pred_log))
    return rows.withColumn("__after", F.expm1(shrunk)).groupBy("alpha", "centre").agg(wmape(actual, "__after").alias("wmape"))


@dataclass
class Shrink:
    """A fitted shrinking; kept as a JSON record, and the identity where none was kept."""

    alpha: float = 1.0
    centre: float = 0.0

    def save(self, spark, path: str) -> None:
        from larkspur.sources.scans import write_record

        write_record(spark, {"alpha": self.alpha, "centre": self.centre}, path)

    @staticmethod
    def load(spark, path: str) -> Shrink | None:
        from larkspur.sources.scans import exists, read_record

        return Shrink(**read_record(spark, path)) if exists(spark, path) else None

    @staticmethod
    def apply(fitted: Shrink | None, pred: Column | str, risk: Column) -> Column:
        return col(pred) if fitted is None else sparse_shrink(pred, risk, fitted.alpha, F.lit(fitted.centre))
