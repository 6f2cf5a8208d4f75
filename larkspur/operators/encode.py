"""Zone encodings: smoothed group statistics, fitted on one table and looked up by another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.exprs import clip

SMOOTHING = 20.0
PROBABILITIES = (0.1, 0.5, 0.9)


def names_of(probabilities=PROBABILITIES) -> list[str]:
    return [f"q{round(p * 100)}" for p in probabilities]


def smoothed(count: Column, own: Column, overall: Column, weight: float) -> Column:
    return F.coalesce((count * own + weight * overall) / (count + weight), overall)


def zone_quantiles(rows: DataFrame, zone: str, y: str, by: list[str] | None = None, weight: float = SMOOTHING) -> tuple[DataFrame, DataFrame]:
    """(per zone, overall) quantiles of y, shrunk towards the overall ones; ``by`` fits each group apart.

    Exact percentiles buffer a value-to-count map per group, whose size is the number of distinct
    values in it.
    """
    by, names = by or [], names_of()
    probs = F.array(*map(F.lit, PROBABILITIES))
    overall = rows.groupBy(*by).agg(F.percentile(y, probs).alias("g")).select(*by, *[F.get("g", F.lit(i)).alias(f"all_{n}") for i, n in enumerate(names)])
    zones = rows.where(F.col(zone).isNotNull()).groupBy(*by, zone).agg(F.count(y).alias("n"), F.percentile(y, probs).alias("z"))
    one = F.broadcast(overall)  # a row per group of `by`
    joined = zones.join(one, by) if by else zones.crossJoin(one)
    shrunk = [smoothed(F.col("n"), F.get("z", F.lit(i)), F.col(f"all_{n}"), weight).alias(n) for i, n in enumerate(names)]
    return joined.select(*by, zone, F.col("n").alias("zone_rows"), *shrunk), overall


def look_up(rows: DataFrame, fitted: DataFrame, overall: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Left join of the fitted values, with the overall ones where the key is unknown."""
    names = names_of()
    one = F.broadcast(overall)
    out = rows.join(fitted, (by or []) + keys, "left")
    out = out.join(one, by, "left") if by else out.crossJoin(one)
    return out.withColumns({n: F.coalesce(F.col(n), F.col(f"all_{n}")) for n in names}).drop(*[f"all_{n}" for n in names])


def zone_ratios(rows: DataFrame, tax: str, listing: str) -> DataFrame:
    """Anchors over the zone's median price, and the zone's spread in logs."""
    median = F.greatest(F.expm1("q50"), F.lit(1.0))
    return rows.withColumns({"tax_to_q50": F.col(tax) / median, "listing_to_q50": F.col(listing) / median, "log_spread": F.col("q90") - F.col("q10")})


def zone_median(rows: DataFrame, zone: str, x: str, weight: float = SMOOTHING) -> DataFrame:
    """Per zone: the median of x (null as 0, not below 0), shrunk towards the overall median."""
    v = clip(F.coalesce(F.col(x), F.lit(0.0)), low=0.0)
    rows = rows.select(zone, v.alias("v"))
    overall = F.broadcast(rows.agg(F.median("v").alias("g")))
    zones = rows.where(F.col(zone).isNotNull()).groupBy(zone).agg(F.count("v").alias("n"), F.median("v").alias("m"))
    return zones.crossJoin(overall).select(zone, smoothed(F.col("n"), F.col("m"), F.col("g"), weight).alias("zone_median"), F.col("g").alias("overall"))


def fold_safe(rows: DataFrame, fold: str, folds: int, zone: str, y: str) -> DataFrame:
    """Each row with its zone's quantiles from the other folds only: one job for all folds.

    Rows are repeated once per fold they train, so the work is (folds - 1) times the table.
    """
    others = rows.select(F.col(zone), F.col(y), F.explode(F.array_remove(F.array(*[F.lit(i) for i in range(folds)]), F.col(fold))).alias("__fold"))
    fitted, overall = zone_quantiles(others, zone, y, ["__fold"])
    return look_up(rows.withColumn("__fold", F.col(fold)), fitted, overall, [zone], ["__fold"]).drop("__fold")


def fold_safe_median(rows: DataFrame, fold: str, folds: int, zone: str, x: str, weight: float = SMOOTHING) -> DataFrame:
    """Each row with its zone's shrunk median of x over the other folds (the overall one for unknown zones)."""
    v = clip(F.coalesce(F.col(x), F.lit(0.0)), low=0.0)
    others = F.explode(F.array_remove(F.array(*[F.lit(i) for i in range(folds)]), F.col(fold)))
    train = rows.select(F.col(zone).alias("__zone"), v.alias("v"), others.alias("__fold"))
    overall = train.groupBy("__fold").agg(F.median("v").alias("__all"))
    zones = train.where("__zone is not null").groupBy("__fold", "__zone").agg(F.count("v").alias("__n"), F.median("v").alias("__m"))
    out = rows.withColumns({"__fold": F.col(fold), "__zone": F.col(zone)}).join(zones, ["__fold", "__zone"], "left").join(F.broadcast(overall), "__fold", "left")
    value = F.coalesce((F.col("__n") * F.col("__m") + weight * F.col("__all")) / (F.col("__n") + weight), F.col("__all"))
    return out.withColumn("zone_median", value).drop("__fold", "__zone", "__n", "__m", "__all")
