"""Rows of a documents table as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NO_ID = (1 << 63) - 1  # stands for a null id: larger than any other


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, data): key tells rows with the same id but other texts apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("data")
    )
