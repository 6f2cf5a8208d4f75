"""Joins with the guards that a scoring run needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def template_join(template: DataFrame, values: DataFrame, key: str, column: str, default: Column | None = None) -> DataFrame:
    """Every row of ``template`` with its value.  Without a default a gap fails the job."""
    out = template.join(values.select(key, column), key, "left")
    fallback = F.raise_error(F.concat(F.lit(f"no {column} for {key} "), F.col(key).cast("string"))).cast(dict(values.dtypes)[column]) if default is None else default
    return out.withColumn(column, F.coalesce(F.col(column), fallback))


def result_diff(new: DataFrame, old: DataFrame, key: str, column: str, actual: str) -> DataFrame:
    """Two result tables side by side: difference, in percent, errors, and whether it got better."""
    left = new.select(key, actual, F.col(column).alias("new_value"))
    out = left.join(old.select(key, F.col(column).alias("old_value")), key, "left")
    out = out.withColumns({"diff": F.col("new_value") - F.col("old_value"), "err_old": F.abs(F.col("old_value") - F.col(actual)), "err_new": F.abs(F.col("new_value") - F.col(actual))})
    pct = 100.0 * F.col("diff") / F.nullif(F.col("old_value"), F.lit(0.0))
    return out.withColumns({"diff_pct": pct, "better": (F.col("err_new") < F.col("err_old")).cast("int")})


def union_filled(parts: list[DataFrame], columns: list[str], fill: float = 0.0) -> DataFrame:
    """Rows of tables with more or fewer columns; what a table lacks is ``fill``."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(fill)) if c in out.columns else F.lit(fill) for c in columns})
