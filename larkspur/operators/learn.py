"""Out-of-fold learning: folds, imputation, boosted trees, cross-fits and grids.

Trees are those of :mod:`larkspur.operators.boost`: quantile, mean, Huber and logistic loss, all models of a
call in the same jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.boost import Run, boosted, grown
from larkspur.operators.quantiles import exact_quantiles
from larkspur.sources.scans import stored

ROUNDS = 30
DEPTH = 4


def medians(x: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact median of each column."""
    found = exact_quantiles(x, {c: [0.5] for c in columns})
    schema = ", ".join(f"`__{c}` double" for c in columns)
    return x.sparkSession.createDataFrame([tuple(None if found[c] is None else found[c][0] for c in columns)], schema)


def impute(x: DataFrame, columns: list[str], fitted: DataFrame | None = None) -> DataFrame:
    """NULLs of ``columns`` become the medians of ``fitted`` (a row of :func:`medians`) or of x."""
    one = F.broadcast(medians(x, columns) if fitted is None else fitted)
    return x.crossJoin(one).withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in columns}).drop(*[f"__{c}" for c in columns])


def run_of(kind: str = "mean", quantile: float | None = None, **options) -> Run:
    """The objective: a quantile if one is given, else ``kind``: mean, huber or risk (probability of 1)."""
    if quantile is not None:
        return Run("quantile", quantile, **options)
    return Run("logistic" if kind == "risk" else kind, **options)


def fit_predict(
    train: DataFrame, test: DataFrame, features: list[str], label: str, out: str, kind: str = "mean", quantile: float | None = None, id_: str = "id", rounds: int = ROUNDS
) -> DataFrame:
    """Fit on ``train``, add ``out`` to ``test``; ids are unique longs."""
    columns = [id_, label, *features]
    known = train.select(*columns, F.lit(1).alias("__fold"))
    new = test.select(id_, F.lit(None).cast("double").alias(label), *features, F.lit(None).cast("int").alias("__fold"))
    scores = boosted(known.unionByName(new), id_, label, features, [run_of(kind, quantile)], ["__fold"], 1, "__p", rounds, DEPTH)
    return test.join(scores.select(id_, F.get("__p", F.lit(0)).alias(out)), id_)


def out_of_fold(
    x: DataFrame,
    fold: str | list[str],
    folds: int,
    features: list[str],
    label: str,
    out: str,
    kind: str = "mean",
    quantile: float | None = None,
    id_: str = "id",
    rounds: int = ROUNDS,
) -> DataFrame:
    """Each row scored by models of the other folds: the mean over seeds, where ``fold`` names a column for each.

    Ids are unique longs.  Rows without a fold train nothing and are scored by all models.
    """
    seeds = [fold] if isinstance(fold, str) else fold
    scores = boosted(x, id_, label, features, [run_of(kind, quantile)], seeds, folds, "__p", rounds, DEPTH)
    return x.join(scores.select(id_, F.get("__p", F.lit(0)).alias(out)), id_)


def ensemble_mean(runs: list[DataFrame], id_: str, column: str) -> DataFrame:
    """Mean prediction over runs (seeds)."""
    long = runs[0].select(id_, column)
    for r in runs[1:]:
        long = long.unionByName(r.select(id_, column))
    return long.groupBy(id_).agg(F.avg(column).alias(column))


def grid_best(x: DataFrame, grid: list[tuple[float, float]], price: str, pred: str, risk: str, severity: str) -> DataFrame:
    """All (threshold, alpha) of the grid in one job; the best by over_rate, wmape, then the pair."""
    from larkspur.operators.calibrate import edge_cut
    from larkspur.operators.metrics import wmape

    points = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(a)).alias("alpha")) for t, a in grid]))
    rows = x.select(price, pred, risk, severity, points.alias("g"))
    after = edge_cut(pred, risk, severity, F.col("g.threshold"), F.col("g.alpha"))
    scored = rows.withColumn("__after", after).groupBy(F.col("g.threshold").alias("threshold"), F.col("g.alpha").alias("alpha"))
    over = 100.0 * F.avg((F.col("__after") > F.col(price) + 1e-6).cast("double"))  # more than rounding
    out = scored.agg(F.round(wmape(price, "__after"), 6).alias("wmape"), F.round(over, 6).alias("over_rate"))
    return out.orderBy("over_rate", "wmape", "threshold", "alpha").limit(1)


def choice_errors(x: DataFrame, actual: str, choices: dict) -> DataFrame:
    """(choice, wmape, q1_mape) of several predictions of one table, in one pass; q1 is the cheapest fifth by ``actual``."""
    from larkspur.operators.metrics import quantile_edges, wmape

    edge = (quantile_edges(x, actual, 5) or [None])[0]
    names = list(enumerate(choices.values()))
    share = lambda c: F.abs(c - F.col(actual)) / F.nullif(F.col(actual), F.lit(0.0))
    cheap = lambda i: F.when(F.col(actual) <= edge, share(F.col(f"__c{i}")))
    sums = [f for i, _ in names for f in (wmape(actual, f"__c{i}").alias(f"w{i}"), (100.0 * F.avg(cheap(i))).alias(f"q{i}"))]
    row = x.withColumns({f"__c{i}": c for i, c in names}).agg(*sums)
    cells = [F.struct(F.lit(float(k)).alias("choice"), F.col(f"w{i}").alias("wmape"), F.col(f"q{i}").alias("q1_mape")) for i, k in enumerate(choices)]
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.*")


def eligible_within(scored: DataFrame, base: float, budget: float) -> DataFrame:
    """The choices whose wMAPE is at most ``budget`` over the base's."""
    limit = scored.where(F.col("choice") == base).select((F.col("wmape") + budget).alias("__limit"))
    return scored.crossJoin(F.broadcast(limit)).where(F.col("wmape") <= F.col("__limit")).drop("__limit")


def best_within(scored: DataFrame, base: float, budget: float) -> DataFrame:
    """The eligible choice with the highest roi_mean (to 4 places), then the lowest wMAPE, q1_mape and choice."""
    return eligible_within(scored, base, budget).orderBy(F.desc(F.bround("roi_mean", 4)), *[c for c in ("wmape", "q1_mape", "choice") if c in scored.columns]).limit(1)


def top_within(scored: DataFrame, base: float, budget: float, most: int = 8) -> DataFrame:
    """The ``most`` eligible choices with the highest roi_mean."""
    return eligible_within(scored, base, budget).orderBy(F.desc("roi_mean"), "choice").limit(most)


def pick_strategy(roi: dict[str, float], base: str, residual: str, fusion: str) -> str:
    """Fusion only if it beats the base and is no worse than the residual; the residual if it beats the base."""
    if roi[fusion] > roi[base] and roi[fusion] >= roi[residual]:
        return fusion
    return residual if roi[residual] > roi[base] else base


def search(x: DataFrame, fold: str | list[str], folds: int, label: str, configs: dict[str, Run], features: list[str], id_: str = "id", rounds: int = ROUNDS) -> list[tuple[str, float]]:
    """(name, mean absolute out-of-fold error, averaged over seeds) of each configuration, best first; all are fitted in the same jobs."""
    seeds = [fold] if isinstance(fold, str) else fold
    errors = grown(x, id_, label, features, list(configs.values()), seeds, folds, rounds, DEPTH).errors()
    return sorted(zip(configs, errors), key=lambda r: (r[1], r[0]))


def tune_residual(x: DataFrame, actual: str, base_log: str, residual: str, alphas: list[float], caps: list[float], out: str) -> DataFrame:
    """base_log plus the capped share of ``residual`` with the lowest wMAPE; share 0 leaves the base as it is."""
    from larkspur.operators.calibrate import gated_residual, residual_grid

    best = residual_grid(x, actual, base_log, residual, alphas, caps).orderBy("wmape", "alpha", "cap").first()
    if best is None or best["alpha"] == 0.0:
        return x.withColumn(out, F.col(base_log))
    return x.withColumn(out, gated_residual(base_log, residual, best["alpha"], best["cap"]))


def fuse(base: DataFrame, key: str, parts: list[DataFrame], train: DataFrame) -> DataFrame:
    """Base rows with the columns of other tables by key; gaps get the medians over ``train`` keys."""
    out = base
    for part in parts:
        columns = [c for c in part.columns if c != key]
        fitted = medians(part.join(train.select(key), key, "left_semi"), columns)
        out = impute(out.join(part, key, "left"), columns, fitted)
    return out


def standardised_pca(x: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """(id, scores): centred principal component scores; the sign of a component is arbitrary."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = x.select(id_, array_to_vector(vector).alias("__v"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="__c", outputCol="__s").fit(centred)
    return model.transform(centred).select(id_, vector_to_array("__s").alias("scores"))


def gram(x: DataFrame, vector: str, size: int):
    """Sum of the outer products of ``size``-dimensional vectors (a size x size matrix), added up by task first."""
    import numpy as np

    def part(batches):
        import pandas as pd

        total = np.zeros((size, size))
        for pdf in batches:
            rows = np.array(pdf[vector].tolist(), float).reshape(-1, size)
            total += rows.T @ rows
        yield pd.DataFrame({"i": np.arange(size), "row": list(total)})

    sums = x.where(F.col(vector).isNotNull()).select(vector).mapInPandas(part, "i int, row array<double>")
    added = sums.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()  # size * size cells
    out = np.zeros((size, size))
    for r in added:
        out[r["i"], r["j"]] = r["v"]
    return out


def right_axes(x: DataFrame, vector: str, k: int) -> list[list[float]]:
    """The k leading right singular vectors of the rows of ``vector``, uncentred."""
    import numpy as np

    size = x.agg(F.max(F.size(vector))).first()[0] or 0
    values, axes = np.linalg.eigh(gram(x, vector, size)) if size else (np.zeros(0), np.zeros((0, 0)))
    return axes[:, np.argsort(-values)[: min(k, size)]].T.tolist()


def project(x: DataFrame, id_: str, vector: str, axes: list[list[float]]) -> DataFrame:
    """(id, scores): rows, of the fitted table or another, along fitted axes."""
    from larkspur.functions.exprs import dot

    return x.select(id_, F.array(*[dot(vector, F.array(*map(F.lit, a))) for a in axes]).alias("scores"))


def truncated_svd(x: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """(id, scores): projections on the k leading right singular vectors, uncentred."""
    return project(x, id_, vector, right_axes(x, vector, k))


def _blocks_of(weights: DataFrame, id_: str) -> tuple[list[str], DataFrame]:
    """The terms in order (a bounded vocabulary) and per id its (place, weight) pairs, stored."""
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").collect()]
    places = weights.sparkSession.createDataFrame(list(enumerate(terms)), "i int, term string")
    rows = weights.join(F.broadcast(places), "term").groupBy(id_).agg(F.collect_list("i").alias("i"), F.collect_list("weight").alias("w"))
    return terms, stored(rows, "term-rows")


def term_axes(weights: DataFrame, id_: str, k: int, passes: int = 5, seed: int = 7) -> DataFrame:
    """(term, axis): the k leading right singular vectors of a sparse (id, term, weight) table, uncentred.

    Randomised subspace iteration: each pass multiplies the rows' squares with a thin matrix, added up by task; the
    driver holds that matrix (terms x (k + 10)), whatever the number of rows.
    """
    import numpy as np
    import pandas as pd

    spark = weights.sparkSession
    weights = stored(weights, "term-weights")  # texts are split once for the terms and the rows
    if weights.isEmpty():
        return spark.createDataFrame([], "term string, axis array<double>")
    terms, rows = _blocks_of(weights, id_)
    size = len(terms)
    width, part = min(size, k + 10), 512

    def times(q):
        shared = spark.sparkContext.broadcast(q)

        def add(batches):
            q, total = shared.value, np.zeros((size, width))
            for pdf in batches:
                for at in range(0, len(pdf), part):
                    dense = np.zeros((min(part, len(pdf) - at), size))
                    for n, (i, w) in enumerate(zip(pdf["i"].iloc[at : at + part], pdf["w"].iloc[at : at + part])):
                        dense[n, i] = w
                    total += dense.T @ (dense @ q)
            yield pd.DataFrame({"b": np.arange(0, size, part) // part, "v": [total[a : a + part].tobytes() for a in range(0, size, part)]})

        def together(pdf):
            return pd.DataFrame({"b": [pdf["b"].iloc[0]], "v": [np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0).tobytes()]})

        parts = rows.select("i", "w").mapInPandas(add, "b int, v binary").groupBy("b").applyInPandas(together, "b int, v binary").orderBy("b").collect()
        shared.destroy()
        return np.concatenate([np.frombuffer(r["v"]).reshape(-1, width) for r in parts])

    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, width)))[0]
    for _ in range(passes if width < size else 1):
        q = np.linalg.qr(times(q))[0]
    small = q.T @ times(q)
    values, inner = np.linalg.eigh((small + small.T) / 2)
    axes = q @ inner[:, np.argsort(-values)[: min(k, size)]]
    return spark.createDataFrame([(t, a) for t, a in zip(terms, axes.tolist())], "term string, axis array<double>")


def term_scores(weights: DataFrame, id_: str, axes: DataFrame) -> DataFrame:
    """(id, scores): rows of this or another table along the axes of :func:`term_axes`."""
    import numpy as np
    import pandas as pd

    fitted = axes.orderBy("term").collect()  # a bounded vocabulary
    if not fitted:
        return weights.select(id_, F.array().cast("array<double>").alias("scores")).limit(0)
    spark = weights.sparkSession
    places = spark.createDataFrame([(i, r["term"]) for i, r in enumerate(fitted)], "i int, term string")
    rows = weights.join(F.broadcast(places), "term").groupBy(id_).agg(F.collect_list("i").alias("i"), F.collect_list("weight").alias("w"))
    shared = spark.sparkContext.broadcast(np.array([r["axis"] for r in fitted]))

    def score(batches):
        for pdf in batches:
            yield pd.DataFrame({id_: pdf[id_], "scores": [np.asarray(w) @ shared.value[i] for i, w in zip(pdf["i"], pdf["w"])]})

    return rows.mapInPandas(score, f"`{id_}` {dict(weights.dtypes)[id_]}, scores array<double>")


def term_svd(weights: DataFrame, id_: str, k: int) -> DataFrame:
    """(id, scores): uncentred SVD scores of a sparse (id, term, weight) table; its vocabulary is bounded."""
    return term_scores(weights, id_, term_axes(weights, id_, k))
