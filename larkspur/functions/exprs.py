"""Null-safe column expressions that every operator builds on.

A missing value is SQL NULL, never NaN.  NULL passes through arithmetic; clips keep it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_null(x: Column | str) -> Column:
    """NaN and infinities become NULL."""
    c = col(x)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return col(a) / F.nullif(col(b), F.lit(0.0))


def log1p0(x: Column | str) -> Column:
    """log1p of x; NULL and negative numbers count as 0."""
    return F.log1p(F.greatest(F.coalesce(col(x), F.lit(0.0)), F.lit(0.0)))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """x within [low, high]; NULL stays NULL."""
    c = out = col(x)
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(c.isNotNull(), out)


def finite(x: Column | str) -> Column:
    c = col(x)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance of two points in degrees."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def zero_to_null(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(0))


def log_ratio(price: Column | str, anchor: Column | str) -> Column:
    """ln(max(price, 1) / anchor); NULL for anchors that are 0, negative or missing."""
    a = col(anchor)
    return F.when(a > 0, F.ln(F.greatest(col(price), F.lit(1.0)) / a))


def bucket_of(x: Column | str, edges: list[float]) -> Column:
    """Right-closed bin of x among sorted inner edges: 0 up to the first edge."""
    c = col(x)
    out = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        out = F.when(c <= edges[i], i).otherwise(out)
    return F.when(c.isNotNull(), out)


def fold_of(id_: Column | str, folds: int, seed: int = 42) -> Column:
    """Deterministic fold of an id, the same on every engine with MD5."""
    digits = F.substring(F.md5(F.concat(col(id_).cast("string"), F.lit(f"-{seed}"))), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def uniform(*keys) -> Column:
    """A number in (0, 1) that depends on the keys alone."""
    text = F.concat_ws("-", *[k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def normal(first: Column, second: Column) -> Column:
    """A standard normal number from two uniform ones (Box and Muller)."""
    return F.sqrt(-2 * F.ln(first)) * F.cos(2 * math.pi * second)


def without_prefix(x: Column | str, prefix: str) -> Column:
    """Text without ``prefix`` at its start; other texts as they are."""
    c = col(x)
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))).otherwise(c)


def slug(x: Column | str) -> Column:
    """Lower-case letters and digits, other runs as one underscore, none at the ends."""
    return F.lower(F.regexp_replace(F.regexp_replace(col(x), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))


def suffix_number(name: Column | str) -> Column:
    """The number after the last underscore of a file name without extension, else -1."""
    stem = F.regexp_replace(col(name), r"\.[^.]*$", "")
    return F.coalesce(F.element_at(F.split(stem, "_"), -1).try_cast("int"), F.lit(-1))


def loose_number(x: Column | str) -> Column:
    """A number from free text: yes and true are 1; no, false, blank, NULL and others 0."""
    c = col(x)
    word = F.lower(F.trim(c))
    yes = F.when(word.isin("true", "yes", "y"), 1.0).otherwise(0.0)
    return F.coalesce(F.trim(c).try_cast("double"), yes)


def argmax_name(columns: list[str]) -> Column:
    """Name of the largest column of a row; the first of equal ones."""
    best = F.greatest(*[F.coalesce(F.col(c), F.lit(float("-inf"))) for c in columns])
    out = None
    for c in columns:
        out = F.when(F.col(c) == best, c) if out is None else out.when(F.col(c) == best, c)
    return out


# Vectors are array<double>.
def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column | str) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(col(v), lambda x: x / F.nullif(norm, F.lit(0.0)))


def softmax(v: Column | str, scale: float = 1.0) -> Column:
    top = F.array_max(col(v))
    exps = F.transform(col(v), lambda x: F.exp((x - top) * scale))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda s, y: s + y))
