"""Nearest neighbours on the globe by growing rings of grid cells.

Rows at one place have the same distances, so places meet places: a place of the query meets the places of the reference in
its own cell, then in the cells around it, by an equi-join, and a place of the reference shows the least ids that can be among
k (ties are broken by the reference id).  The k nearest are final when the k-th is nearer than anything outside the cells can
be; other places try a larger ring, and those that the largest does not settle meet all reference places.  Means are made once
a place; a row only looks up its place.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.exprs import EARTH_KM, haversine_km
from larkspur.sources.scans import stored

KM_PER_DEGREE = math.pi * EARTH_KM / 180
SLACK_KM = 1e-8  # distances are rounded to nine places; one beyond the edge must not round to a tie
NEAR = "array<struct<km: double, rid: bigint, y: double>>"


def _cells(x: DataFrame, size: float) -> DataFrame:
    return x.withColumns({"cx": F.floor(F.col("lat") / size).cast("long"), "cy": F.floor(F.col("lon") / size).cast("long")})


def _dealt(x: DataFrame, label: str) -> DataFrame:
    """``x`` stored in as many parts as a shuffle has: a small file would be one task in all that reads it."""
    return stored(x.repartition(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id"), label)


class _Search:
    """The nearest reference rows of places, in several groups at once.

    ``reference`` has own, id, lat, lon, y; group g has the rows of any other ``own`` as reference, and group ALL all rows.
    Missing coordinates are filled with the medians of the group's reference rows; groups without any are left out.
    """

    ALL = -1

    def __init__(self, reference: DataFrame, groups: list[int], most: int):
        self.spark, self.most = reference.sparkSession, most
        every = F.filter(F.array(*map(F.lit, groups)), lambda g: (g == self.ALL) | (g != F.col("own")))
        place = ["own", "lat", "lon"]
        self.tally = stored(reference.groupBy(place).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("total"), F.count("y").alias("known")), "knn-tally")
        median = lambda c: F.percentile(c, F.lit(0.5), F.col("n")).alias(f"m{c}")
        found = self.tally.withColumn("g", F.explode(every)).groupBy("g").agg(
            median("lat"), median("lon"), F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d"),
            (F.sum("total") / F.nullif(F.sum("known"), F.lit(0))).alias("overall"), F.sum(F.least("n", F.lit(most))).alias("n"), F.approx_count_distinct(F.struct("lat", "lon")).alias("places"),
        ).collect()  # a row for each group
        self.overall = {r["g"]: r["overall"] for r in found}
        self.known = {r["g"]: r for r in found if r["mlat"] is not None and r["mlon"] is not None}
        if self.known:
            first = F.row_number().over(Window.partitionBy(place).orderBy("id"))
            least = reference.withColumn("place", first).where(F.col("place") <= most).groupBy(place).agg(F.collect_list(F.struct(F.col("id").alias("rid"), "y")).alias("rows"))
            each = self.filled(least.withColumn("g", F.explode(every)), F.col("g")).where("lat is not null").groupBy("g", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
            self.spots = stored(each.agg(F.slice(F.sort_array(F.flatten(F.collect_list("rows"))), 1, most).alias("rows")), "knn-spots")

    def of(self, g: Column, values: dict) -> Column:
        """The value of the group ``g``, or NULL."""
        return F.coalesce(*[F.when(g == k, F.lit(v)) for k, v in values.items()], F.lit(None).cast("double"))

    def filled(self, x: DataFrame, g: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """``x`` with its place as the group ``g`` sees it in the columns ``lat`` and ``lon``; NULL in groups that are left out."""
        middle = {c: self.of(g, {k: r[f"m{c}"] for k, r in self.known.items()}) for c in ("lat", "lon")}
        return x.withColumns({to: F.when(middle[c].isNotNull(), F.coalesce(F.col(c), middle[c])) for to, c in ((lat, "lat"), (lon, "lon"))})

    def near(self, asked: DataFrame, cell_degrees: float | None = None) -> DataFrame:
        """(g, lat, lon, near): the nearest rows (km, rid, y) of each place asked for (g, lat, lon, filled), nearest first."""
        if not self.known:
            return self.spark.createDataFrame([], f"g int, lat double, lon double, near {NEAR}")
        known = self.known.values()
        high, wide = max(max(r["b"] - r["a"] for r in known), 1e-6), max(max(r["d"] - r["c"] for r in known), 1e-6)
        size = cell_degrees or max(1e-4, math.sqrt(high * wide * self.most / max(r["n"] for r in known)))
        ref = _cells(self.spots.withColumns({"lat": F.col("rlat"), "lon": F.col("rlon")}), size).drop("lat", "lon")
        left = stored(_cells(asked.where("lat is not null").select("g", "lat", "lon").distinct(), size).withColumn("p", F.monotonically_increasing_id()), "knn-left")
        done, ring = [], 0 if any(2 * r["n"] >= self.most * r["places"] for r in known) else 1  # its own cell seldom settles a place of few rows
        while True:
            if ring * size > 2 * max(high, wide) + size * 2:
                done.append(stored(_by_parts(left, self.spots, self.most), "knn-near"))
                break
            step = F.explode(F.sequence(F.lit(-ring), F.lit(ring)))
            around = left.withColumn("dx", step).withColumn("dy", step).withColumns({"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")})
            final = (F.size("near") == self.most) & (F.element_at("near", -1)["km"] + SLACK_KM < _reach(size, ring))
            # Spark's size of ``around`` leaves out the explode: it would be sent whole to the tasks of ``ref``, often one.
            settled = stored(_best(around.join(ref.hint("merge"), ["g", "cx", "cy"]), self.most).where(final), "knn-near")
            done.append(settled)
            left = stored(left.join(settled.select("p"), "p", "left_anti"), "knn-left")
            if left.isEmpty():
                break
            ring = ring * 4 or 1
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out.drop("p")


def _reach(size: float, ring: int) -> Column:
    """Kilometres from (lat, lon) to the nearest edge of the cells up to ``ring`` around its own: nothing outside them is nearer."""
    edge = lambda c: F.least(F.col(c) - (F.floor(F.col(c) / size) - ring) * size, (F.floor(F.col(c) / size) + ring + 1) * size - F.col(c))
    # A degree of longitude is shortest at the edge that is farthest from the equator.
    parallel = F.cos(F.radians(F.least(F.abs(F.col("lat")) + (ring + 1) * size, F.lit(89.9))))
    return F.least(edge("lat"), edge("lon") * parallel) * KM_PER_DEGREE


def _best(pairs: DataFrame, most: int) -> DataFrame:
    """(p, g, lat, lon, near): the nearest rows of the joined places; Spark keeps ``most`` per place and task before the shuffle."""
    km = F.round(haversine_km("lat", "lon", "rlat", "rlon"), 9)
    each = pairs.withColumn("km", km).select("p", "g", "lat", "lon", "km", F.explode("rows").alias("r")).select("p", "g", "lat", "lon", "km", "r.rid", "r.y")
    each = each.withColumn("place", F.row_number().over(Window.partitionBy("p").orderBy("km", "rid"))).where(F.col("place") <= most)
    near = F.sort_array(F.collect_list(F.struct("km", "rid", "y"))).cast(NEAR).alias("near")
    return each.groupBy("p").agg(F.first("g").alias("g"), F.first("lat").alias("lat"), F.first("lon").alias("lon"), near)


def _by_parts(left: DataFrame, spots: DataFrame, most: int) -> DataFrame:
    """Places that no ring settled (fewer rows than wanted in reach) against all reference places, dealt into parts."""
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    dealt = spots.withColumn("part", F.pmod(F.xxhash64("rlat", "rlon"), F.lit(parts)).cast("int"))
    return _best(each.join(dealt.hint("merge"), ["g", "part"]), most)


def _one(x: DataFrame) -> DataFrame:
    """Rows as a reference of one group."""
    return x.select(F.lit(0).alias("own"), "id", "lat", "lon", "y")


def nearest(query: DataFrame, reference: DataFrame, k: int, exclude_self: bool, cell_degrees: float | None = None) -> DataFrame:
    """(id, rid, y, km): up to k nearest reference rows of each query row.

    ``query`` has id, lat, lon; ``reference`` id, lat, lon, y.  Missing coordinates are filled with
    the reference's medians.  ``exclude_self`` leaves out the reference row with the query's id.
    Cells hold about k rows if the reference is spread evenly; the size follows from its extent.
    """
    search = _Search(_one(reference), [_Search.ALL], k + int(exclude_self))  # of the nearest, one can be the row itself
    asked = search.filled(query.select(F.lit(_Search.ALL).alias("g"), "id", "lat", "lon"), F.col("g"))
    near = asked.join(search.near(asked, cell_degrees), ["g", "lat", "lon"])
    found = F.slice(F.filter("near", lambda r: r["rid"] != F.col("id")), 1, k) if exclude_self else F.col("near")
    return near.select("id", F.explode(found).alias("r")).select("id", "r.rid", "r.y", "r.km")


def _mean(near: Column) -> Column:
    """The mean of the known y of a list, or NULL."""
    y = F.filter(F.transform(near, lambda r: r["y"]), lambda v: v.isNotNull())
    return F.aggregate(y, F.lit(0.0), lambda s, v: s + v) / F.nullif(F.size(y), F.lit(0))


def _by_place(near: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(g, plat, plon, m): the mean of the first k of each place; with ``exclude_self`` also rids and others, the mean without each row of the list."""
    out = {"m": _mean(F.slice("near", 1, k))}
    if exclude_self:
        out |= {"rids": F.col("near.rid"), "others": F.transform("near", lambda o: _mean(F.slice(F.filter("near", lambda r: r["rid"] != o["rid"]), 1, k)))}
    return near.select("g", F.col("lat").alias("plat"), F.col("lon").alias("plon"), *[v.alias(c) for c, v in out.items()])


def _looked_up(x: DataFrame, search: _Search, g: Column, means: DataFrame, name: str, exclude_self: bool) -> DataFrame:
    """``x`` with the mean of its place in the group ``g``; the mean of all where a row has no neighbour, 0 without reference."""
    at = search.filled(x.withColumn("g", g), F.col("g"), "plat", "plon").join(means, ["g", "plat", "plon"], "left")
    m = F.col("m")
    if exclude_self:
        place = F.array_position("rids", F.col("id")).cast("int")
        m = F.when(place > 0, F.get("others", place - 1)).otherwise(m)
    return at.select(*x.columns, F.coalesce(m, search.of(F.col("g"), search.overall), F.lit(0.0)).alias(name))


def mean_target(query: DataFrame, reference: DataFrame, k: int = 20, exclude_self: bool = False, **options) -> DataFrame:
    """(id, knn): mean y of the k nearest; the mean of all where a row has no neighbour, 0 without reference."""
    every = F.lit(_Search.ALL)
    search = _Search(_dealt(_one(reference), "knn-rows"), [_Search.ALL], k + int(exclude_self))  # of the nearest, one can be the row itself
    asked = search.filled(query.select(every.alias("g"), "lat", "lon"), every)
    means = _by_place(search.near(asked, **options), k, exclude_self)
    return _looked_up(query.select("id", "lat", "lon"), search, every, means, "knn", exclude_self).select("id", "knn")


def fold_safe(x: DataFrame, fold: str, folds: int, k: int = 20) -> DataFrame:
    """(id, knn, knn_train): mean target of the k nearest rows of the other folds, and, for the row as a training
    row of its own fold's encoder, of the k nearest others of all folds (itself left out).

    Both are found in the same jobs: group i has the rows outside fold i as reference, group ALL all rows.
    """
    every, own, inside = F.lit(_Search.ALL), F.col("own"), F.col("own").between(0, folds - 1)
    rows = _dealt(x.select(F.col(fold).cast("int").alias("own"), "id", "lat", "lon", "y"), "knn-rows")
    search = _Search(rows, [_Search.ALL, *range(folds)], k + 1)
    asked = search.tally.where(inside).select(F.explode(F.array(own, every)).alias("g"), "lat", "lon")
    near = search.near(search.filled(asked, F.col("g")))
    out = _looked_up(rows.where(inside).select("own", "id", "lat", "lon"), search, own, _by_place(near.where(F.col("g") != every), k, False), "knn", False)
    out = _looked_up(out, search, every, _by_place(near.where(F.col("g") == every), k, True), "knn_train", True)
    return out.select("id", "knn", "knn_train")
