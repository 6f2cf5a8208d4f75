"""Data profiling: exact summaries in one pass over the table each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numeric_columns(x: DataFrame) -> list[str]:
    from pyspark.sql.types import NumericType

    return [f.name for f in x.schema.fields if isinstance(f.dataType, NumericType)]


def missing_profile(x: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, pct): columns with a missing value only."""
    counts = x.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = counts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])).alias("x"))
    return long.select("x.column", "x.n_missing", (100.0 * F.col("x.n_missing") / F.col("n")).alias("pct")).where("n_missing > 0")


def describe(x: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, least, quartiles and largest value per column, exactly."""

    def one(c: str):
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        return F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).alias("least"),
            q.alias("q"),
            F.max(c).alias("largest"),
        )

    row = x.agg(F.array(*[one(c) for c in columns]).alias("a")).select(F.explode("a").alias("s"))
    qs = [F.get("s.q", F.lit(i)).alias(f"p{25 * (i + 1)}") for i in range(3)]
    return row.select("s.column", "s.n", "s.mean", "s.std", "s.least", *qs, "s.largest")


def value_counts(x: DataFrame, column: str, top: int) -> DataFrame:
    """The ``top`` most frequent values; ties by value, missing ones dropped."""
    return x.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(top)


def correlations(x: DataFrame, columns: list[str], target: str) -> DataFrame:
    """(column, r) against the target over rows that have both."""
    row = x.agg(*[F.corr(c, target).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("r")) for c in columns])).alias("s")).select("s.*")


def correlation_matrix(x: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [(a, b) for a in columns for b in columns]
    row = x.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def binary_effects(x: DataFrame, flags: list[str], target: str) -> DataFrame:
    """Per 0/1 column: rows with 1, their share, the target's mean with and without, and the gap."""

    def one(c: str):
        on, off = F.avg(F.when(F.col(c) == 1, F.col(target))), F.avg(F.when(F.col(c) == 0, F.col(target)))
        hits = F.count_if(F.col(c) == 1)
        return F.struct(F.lit(c).alias("feature"), hits.alias("n"), (100.0 * hits / F.count(F.lit(1))).alias("pct"), on.alias("mean_on"), off.alias("mean_off"), (on - off).alias("diff"))

    return x.agg(F.array(*[one(c) for c in flags]).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def iqr_outliers(x: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Rows beyond ``reach`` interquartile ranges from the quartiles."""
    q = F.percentile(column, F.array(F.lit(0.25), F.lit(0.75)))
    fences = x.agg(q.alias("q")).select(F.get("q", F.lit(0)).alias("__a"), F.get("q", F.lit(1)).alias("__b"))
    width = reach * (F.col("__b") - F.col("__a"))
    out = x.crossJoin(F.broadcast(fences)).where((F.col(column) < F.col("__a") - width) | (F.col(column) > F.col("__b") + width))
    return out.drop("__a", "__b")


def crosstab_pct(x: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Row percentages of ``values`` of ``column``, one column each."""
    counts = x.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])
    total = F.nullif(sum((F.col(v) for v in values), F.lit(0)), F.lit(0))
    return counts.select(row, *[(100.0 * F.col(v) / total).alias(v) for v in values])
