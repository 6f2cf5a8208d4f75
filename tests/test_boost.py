"""Boosted trees against plain sums, and the invariants of out-of-fold scores and fitted bundles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import boost, bundle, learn


def table(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(0, 10, n), rng.normal(size=n)
    y = np.where(a > 4, 3.0, 0.0) + 0.3 * rng.normal(size=n)
    rows = [(i, None if i % 9 == 0 else float(a[i]), float(b[i]), float(y[i]), i % 4) for i in range(n)]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, fold int"), rows


def scores(df):
    return {r.id: r.p for r in df.collect()}


def test_best_split_equals_all_splits():
    rng = np.random.default_rng(0)
    bins, g = rng.integers(0, boost.BINS, (3, 500)), rng.normal(size=500)
    g += np.where(bins[1] > 40, 1.0, 0.0)
    sums = np.array([[np.column_stack([np.bincount(f, w, boost.BINS) for w in (g, np.ones(500), None)])] for f in bins])
    (feature, cut, gl, hl, gr, hr) = boost.best_splits(sums, 20)[0]
    best = max(
        ((g[f <= c].sum() ** 2 / ((f <= c).sum() + 1) + g[f > c].sum() ** 2 / ((f > c).sum() + 1), k, c) for k, f in enumerate(bins) for c in range(boost.BINS) if 20 <= (f <= c).sum() <= 480)
    )
    assert (feature, cut) == best[1:] and feature == 1
    left = bins[feature] <= cut
    assert np.allclose([gl, hl, gr, hr], [g[left].sum(), left.sum(), g[~left].sum(), (~left).sum()])
    assert boost.best_splits(np.zeros((2, 1, boost.BINS, 3)), 1)[0][0] == -1


@pytest.mark.parametrize("loss", ["mean", "huber", "quantile", "logistic"])
def test_slopes_are_derivatives(loss):
    run, y = boost.Run(loss, tau=0.3), np.array([0.0, 1.0, 1.0, 0.0])
    f = np.array([0.5, -0.7, 2.0, -1.0])

    def value(x):
        r = y - x
        if loss == "mean":
            return r**2 / 2
        if loss == "huber":
            return np.where(abs(r) <= run.delta, r**2 / 2, run.delta * (abs(r) - run.delta / 2))
        if loss == "quantile":
            return np.where(r >= 0, run.tau * r, (run.tau - 1) * r)
        return np.log1p(np.exp(x)) - y * x

    g, h = boost.slopes(run, y, f)
    assert np.allclose(g, (value(f + 1e-6) - value(f - 1e-6)) / 2e-6, atol=1e-4) and (h > 0).all()


def test_scores_follow_the_step(spark):
    x, rows = table(spark)
    got = scores(learn.out_of_fold(x, "fold", 4, ["a", "b"], "y", "p"))
    known = [r for r in rows if r[1] is not None]
    assert len(got) == 600 and np.mean([abs(got[r[0]] - (3.0 if r[1] > 4 else 0.0)) for r in known]) < 0.25
    wide = boost.boosted(x, "id", "y", ["a", "b"], [boost.Run("huber", delta=2.0)], ["fold"], 4, "p")
    huber = {r.id: r.p[0] for r in wide.collect()}
    assert np.mean([abs(huber[r[0]] - (3.0 if r[1] > 4 else 0.0)) for r in known]) < 0.3


def test_a_row_does_not_train_its_own_score(spark):
    x, _ = table(spark)
    other = x.withColumn("y", F.when(F.col("fold") == 2, F.col("y") * -50 + 7).otherwise(F.col("y")))
    one, two = (scores(learn.out_of_fold(t, "fold", 4, ["a", "b"], "y", "p", rounds=4).where("fold = 2")) for t in (x, other))
    assert one == two and len(one) == 150
    rest = [scores(learn.out_of_fold(t, "fold", 4, ["a", "b"], "y", "p", rounds=4).where("fold = 1")) for t in (x, other)]
    assert rest[0] != rest[1]


def test_quantiles_leave_their_share_below(spark):
    x, rows = table(spark, 2000)
    got = scores(learn.out_of_fold(x, "fold", 4, ["a", "b"], "y", "p", quantile=0.35))
    assert abs(np.mean([r[3] < got[r[0]] for r in rows]) - 0.35) < 0.05


def test_seeds_are_averaged_and_new_rows_use_all_models(spark):
    x, _ = table(spark)
    x = x.withColumn("other", ((F.col("id") * 7) % 4).cast("int"))
    new = x.withColumn("fold", F.when(F.col("id") >= 20, F.col("fold"))).withColumn("y", F.when(F.col("id") >= 20, F.col("y")))
    got = scores(learn.out_of_fold(new, "fold", 4, ["a"], "y", "p", rounds=3))
    assert len(got) == 600 and all(np.isfinite(v) for v in got.values())
    each = [scores(learn.out_of_fold(x, c, 4, ["a"], "y", "p", rounds=3)) for c in ("fold", "other")]
    both = scores(learn.out_of_fold(x, ["fold", "other"], 4, ["a"], "y", "p", rounds=3))
    assert np.allclose([both[i] for i in range(600)], [(each[0][i] + each[1][i]) / 2 for i in range(600)], atol=1e-5)


def test_search_equals_single_fits(spark):
    x, _ = table(spark)
    configs = {"a": learn.Run(features=("a",)), "b": learn.Run("huber", features=("b",)), "q": learn.Run("quantile", 0.4)}
    found = dict(learn.search(x, "fold", 4, "y", configs, ["a", "b"], rounds=3))
    alone = dict(learn.search(x, "fold", 4, "y", {"b": configs["b"]}, ["a", "b"], rounds=3))
    assert list(found)[0] == "a" and abs(found["b"] - alone["b"]) < 1e-6


def test_odd_tables(spark):
    none = spark.createDataFrame([], "id long, a double, y double, fold int")
    assert learn.out_of_fold(none, "fold", 2, ["a"], "y", "p", rounds=2).count() == 0
    same = spark.createDataFrame([(i, None, None if i == 3 else 2.0, i % 2) for i in range(30)], "id long, a double, y double, fold int")
    assert set(scores(learn.out_of_fold(same, "fold", 2, ["a"], "y", "p", rounds=2)).values()) == {2.0}


def test_tuning_may_leave_the_base(spark):
    rows = [(float(np.expm1(1.0 + i / 10)), 1.0 + i / 10, 5.0) for i in range(10)]
    x = spark.createDataFrame(rows, "price double, base double, r double")
    got = learn.tune_residual(x, "price", "base", "r", [0.0, 0.5], [0.05, 0.1], "o").collect()
    assert [r.o for r in got] == [r.base for r in got]
    helped = x.withColumn("base", F.col("base") - 0.05)
    got = learn.tune_residual(helped, "price", "base", "r", [0.0, 0.5], [0.05, 0.1], "o").collect()
    assert np.allclose([r.o for r in got], [r.base + 0.05 for r in got])


def test_term_axes_equal_a_dense_svd(spark):
    rng = np.random.default_rng(1)
    dense = (rng.random((60, 40)) < 0.2) * rng.random((60, 40))
    dense[:, :3] += 1.0
    rows = [(i, f"t{j:02d}", float(dense[i, j])) for i in range(60) for j in range(40) if dense[i, j]]
    weights = spark.createDataFrame(rows, "id long, term string, weight double")
    got = {r.id: r.scores for r in learn.term_scores(weights, "id", learn.term_axes(weights, "id", 3, passes=40)).collect()}
    g = np.array([got[i] for i in range(60)])
    u, s, _ = np.linalg.svd(dense)
    want = u[:, :3] * s[:3]
    assert np.allclose(np.abs(g), np.abs(want), atol=1e-3)


def test_bundle_is_stored_and_checked(spark, tmp_path):
    x = spark.createDataFrame([(i, f"{'luxury' if i % 4 else 'plain'} home number {i % 3} with a view {'and pool' * (i % 2)}") for i in range(12)], "id long, t string")
    vectors = spark.createDataFrame([(i, [float(i), 1.0, float(i % 2)]) for i in range(12)], "id long, vector array<double>")
    fitted = bundle.TextBundle.fit(x, "id", "t", k=2, vectors=vectors, record={"tag": "one"})
    path = f"file://{tmp_path}/bundle"
    fitted.save(spark, path)
    new = spark.createDataFrame([(1, "a luxury view"), (2, None), (3, "zzz")], "id long, t string")
    one, two = ({r.id: r for r in b.apply(new, "id", "t", vectors).collect()} for b in (fitted, bundle.TextBundle.load(spark, path, tag="one")))
    assert set(one) == {1, 2, 3} and one[1].premium_cues == 1 and one[2].scores is None and len(one[1].vector_scores) == 2
    assert np.allclose(one[1].scores, two[1].scores)
    with pytest.raises(ValueError, match="made with"):
        bundle.TextBundle.load(spark, path, tag="two")
    with pytest.raises(FileNotFoundError):
        bundle.TextBundle.load(spark, f"{path}-none")


def test_walk_equals_a_plain_descent():
    import numpy as np

    from larkspur.operators import boost

    rng = np.random.default_rng(3)
    for _ in range(20):
        bins, feature, cut = rng.integers(0, 64, (5, 300)).astype(np.uint8), rng.integers(-1, 5, 16), rng.integers(0, 64, 16)
        for levels in range(5):
            want = []
            for row in bins.T:
                node = 1
                for _ in range(levels):
                    node = 2 * node + int(feature[node] >= 0 and row[feature[node]] > cut[node])
                want.append(node)
            assert boost.walk(bins, feature, cut, levels).tolist() == want


def test_few_rounds_store_no_scores(spark):
    """The scores of many models over few rounds (feature_search) are not stored row by row; errors are those of the scores."""
    from pyspark.sql import functions as F

    from larkspur.operators import boost

    x = spark.range(400).select("id", (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 20 * 0.1).alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    runs = [boost.Run("quantile", 0.4), boost.Run("huber"), boost.Run("mean")]
    booster = boost.grown(x, "id", "y", ["a"], runs, ["fold"], 2, 2, 2)
    assert booster.blocks.agg(F.max(F.length("score"))).first()[0] == 0
    off = [F.avg(F.abs(F.col("y") - F.get("p", F.lit(i)))) for i in range(3)]
    want = x.join(booster.scores("id", "p"), "id").agg(*off).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(booster.errors(), want))


def test_search_takes_all_rounds_and_seeds(spark, monkeypatch):
    """feature_search fits its 44 configurations as the other queries fit theirs; its error is the mean over seeds."""
    from larkspur.plans import learning

    seen, x = [], table(spark)[0]
    monkeypatch.setattr(learn, "grown", lambda x, id_, label, features, runs, seeds, folds, rounds, depth: seen.append((len(runs), seeds, folds, rounds)) or boost.Booster.__new__(boost.Booster))
    monkeypatch.setattr(boost.Booster, "errors", lambda self: [0.5] * 44)
    assert learning.feature_search(spark, "/root/testdata/sf0.001").count() == 44
    assert seen == [(44, learning.FOLD_COLUMNS, learning.FOLDS, learn.ROUNDS)] and len(learning.FOLD_COLUMNS) == 3
    monkeypatch.undo()
    x = x.withColumn("other", ((F.col("id") * 7) % 4).cast("int"))
    config = {"q": learn.Run("quantile", 0.4)}
    each = [learn.search(x, c, 4, "y", config, ["a", "b"], rounds=2)[0][1] for c in ("fold", "other")]
    assert abs(learn.search(x, ["fold", "other"], 4, "y", config, ["a", "b"], rounds=2)[0][1] - sum(each) / 2) < 1e-9
