"""Resumable enrichment: what is pending, in which batches, and how replies are merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.exprs import loose_number
from larkspur.operators.prefix import running_total


def pending(work: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Rows whose key no chunk holds yet."""
    return work.join(cached.select(key).distinct(), key, "left_anti")


def batches(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Number rows in the order of a unique column and cut them into consecutive batches."""
    placed = running_total(rows, order, 1, "pos")
    return placed.withColumn("batch", F.expr(f"pos div {size}"))


def keep_last(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in chunk and row order (partial aggregation, no window)."""
    others = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__v"))
    return last.select(key, "__v.*")


def decode_flags(replies: DataFrame, column: str, flags: list[str]) -> DataFrame:
    """Rows of {"rows": [[zpid, flags...]]} or {"items": [{"zpid", flag or its short name}]}.

    Rows that are too short or have no number as id are left out; values are loose numbers.
    """
    parsed = F.from_json(F.col(column), "rows array<array<string>>, items array<map<string,string>>")
    keep = [c for c in replies.columns if c != column]
    base = replies.select(*keep, parsed.alias("j"))

    def from_item(item: Column) -> Column:
        value = lambda f: F.coalesce(F.element_at(item, f), F.element_at(item, f.removeprefix("llm_")))
        return F.array(F.element_at(item, "zpid"), *[value(f) for f in flags])

    rows = F.when(F.col("j.rows").isNotNull(), F.filter("j.rows", lambda r: F.size(r) > len(flags))).otherwise(F.transform("j.items", from_item))
    out = base.select(*keep, F.explode(rows).alias("r"))
    named = [loose_number(F.get("r", F.lit(i + 1))).alias(f) for i, f in enumerate(flags)]
    return out.select(*keep, F.get("r", F.lit(0)).try_cast("bigint").alias("zpid"), *named).where("zpid is not null")


def encode_prompt(rows: DataFrame, batch: str, id_: str, text: str, most: int = 1400) -> DataFrame:
    """A JSON prompt per batch: {"items": [{id, description}]}, texts cut at ``most`` characters."""
    item = F.struct(F.col(id_).alias("zpid"), F.substring(F.coalesce(F.col(text), F.lit("")), 1, most).alias("description"))
    return rows.groupBy(batch).agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items"))).alias("prompt"))
