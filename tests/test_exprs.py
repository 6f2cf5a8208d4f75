"""Null, tie and edge semantics of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from larkspur.functions import exprs as E
from larkspur.operators import calibrate, metrics, prefix


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column.alias("v")).collect()]


def test_division_and_logs(spark):
    rows = [(1.0, 2.0), (1.0, 0.0), (None, 2.0), (1.0, None)]
    assert values(spark, rows, "a double, b double", E.safe_div("a", "b")) == [0.5, None, None, None]
    assert values(spark, [(None,), (-3.0,), (0.0,)], "a double", E.log1p0("a")) == [0.0, 0.0, 0.0]
    got = values(spark, [(10.0, 5.0), (0.0, 5.0), (10.0, 0.0), (10.0, None)], "a double, b double", E.log_ratio("a", "b"))
    assert got[0] == pytest.approx(math.log(2)) and got[1] == pytest.approx(-math.log(5)) and got[2:] == [None, None]


def test_clip_keeps_null_and_nan_becomes_null(spark):
    assert values(spark, [(None,), (-1.0,), (9.0,)], "a double", E.clip("a", 0.0, 5.0)) == [None, 0.0, 5.0]
    assert values(spark, [(float("nan"),), (float("inf"),), (1.0,)], "a double", E.nan_to_null("a")) == [None, None, 1.0]
    assert values(spark, [(float("nan"),), (None,), (1.0,)], "a double", E.finite("a")) == [False, False, True]


def test_bins_are_closed_on_the_right(spark):
    assert values(spark, [(1.0,), (2.0,), (2.1,), (None,)], "a double", E.bucket_of("a", [1.0, 2.0])) == [0, 1, 2, None]
    x = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (2.0,)], "a double")
    with pytest.raises(ValueError):
        metrics.qcut(x, "a", 4)


def test_distance(spark):
    got = values(spark, [(0.0, 0.0, 0.0, 180.0), (10.0, 20.0, 10.0, 20.0)], "a double, b double, c double, d double", E.haversine_km("a", "b", "c", "d"))
    assert got == pytest.approx([math.pi * 6371, 0.0])


def test_strings(spark):
    assert values(spark, [("GPT 4.1-nano!",), ("__a",)], "a string", E.slug("a")) == ["gpt_4_1_nano", "a"]
    assert values(spark, [("x_12.jpg",), ("12.jpg",), ("x_.jpg",), (None,)], "a string", E.suffix_number("a")) == [12, 12, -1, -1]
    words = [("1e3",), (" YES ",), ("no",), ("",), (None,), ("maybe",)]
    assert values(spark, words, "a string", E.loose_number("a")) == [1000.0, 1.0, 0.0, 0.0, 0.0, 0.0]


def test_vectors(spark):
    rows = [([3.0, 4.0],), ([0.0, 0.0],)]
    assert values(spark, rows, "v array<double>", E.l2_normalise("v")) == [[0.6, 0.8], [None, None]]
    got = values(spark, [([1.0, 1.0],)], "v array<double>", E.softmax("v"))
    assert got[0] == pytest.approx([0.5, 0.5])


def test_argmax_takes_the_first(spark):
    rows = [(1.0, 1.0), (0.0, 2.0), (None, 1.0)]
    assert values(spark, rows, "a double, b double", E.argmax_name(["a", "b"])) == ["a", "b", "b"]


def test_average_rank_and_weight(spark):
    x = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, 9.0), (5, None)], "id long, a double")
    got = {r["id"]: r["rank"] for r in metrics.average_rank(x, "a").collect()}
    assert got == {1: 0.625, 2: 0.625, 3: 0.25, 4: 1.0, 5: None}
    w = [r["weight"] for r in metrics.cheap_weight(x.where("a is not null"), "a").collect()]
    assert sum(w) / 4 == pytest.approx(1.0)


def test_running_total(spark):
    x = spark.range(100).select((F.col("id") * 7 % 100).alias("k"))
    got = {r["k"]: r["before"] for r in prefix.running_total(x, "k", F.col("k"), "before").collect()}
    assert got == {k: k * (k - 1) // 2 for k in range(100)}


def test_soft_clip_and_cut(spark):
    x = spark.createDataFrame([(12.0,), (8.0,), (10.0,)], "p double")
    out = [r[0] for r in x.select(calibrate.soft_clip(F.col("p"), F.lit(10.0), F.lit(9.0), F.lit(11.0), 1.0)).collect()]
    assert out == pytest.approx([11.55, 8.7, 10.0])
    y = spark.createDataFrame([(100.0, 0.9, 9.0), (100.0, 0.1, 9.0), (100.0, 0.9, -1.0)], "p double, r double, s double")
    cut = [r[0] for r in y.select(calibrate.edge_cut("p", "r", "s", 0.5, 1.0)).collect()]
    assert cut == pytest.approx([101 * math.exp(-0.35) - 1, 100, 100])


def test_interpolation_is_flat_outside(spark):
    x = spark.createDataFrame([(-1.0,), (0.5,), (9.0,), (None,)], "p double")
    assert [r[0] for r in x.select(calibrate.interpolate(F.col("p"), [0.0, 1.0], [2.0, 4.0])).collect()] == [2.0, 3.0, 4.0, None]


def test_debias(spark):
    few = spark.createDataFrame([(float(i), 2.0 * i + 1) for i in range(5)], "p double, r double")
    d = calibrate.fit_debias(few, "p", "r", "o")
    assert d.method == "linear" and [r["o"] for r in d.apply(few, "p", "o").collect()] == pytest.approx([1, 3, 5, 7, 9])
    many = spark.createDataFrame([(float(i), float(i + (5 if i % 2 else -5))) for i in range(80)], "p double, r double")
    d = calibrate.fit_debias(many, "p", "r", "o")
    out = [r["o"] for r in d.apply(many, "p", "o").orderBy("p").collect()]
    assert d.method == "isotonic" and out == sorted(out)


def test_folds_match_everywhere(spark):
    import duckdb

    got = [r[0] for r in spark.range(300).select(E.fold_of("id", 5)).collect()]
    want = [r[0] for r in duckdb.sql("SELECT ('0x' || substr(md5(i::VARCHAR || '-42'), 1, 8))::BIGINT % 5 FROM range(300) t(i) ORDER BY i").fetchall()]
    assert got == want
