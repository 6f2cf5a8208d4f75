"""Quality classifier: random Fourier features, ridge by normal equations, isotonic scores.

Statistics of the whole text are computed natively for every document.  The standardised
statistics and ``FEATURES`` random Fourier features (a Gaussian kernel, fixed seed) form a row z
of about 180 numbers; every partition sums z z' and z y, the sums are added in two steps, and the
driver solves one small system.  Calibration pools adjacent violators over a histogram of the
raw scores of all training rows.  All training rows count; nothing is sampled.

Defined results: null or empty texts are scored like any text without words; without training
rows of both classes every score is the share of ones (0.5 without any row); labels other than
0 and 1 and labels without a document are ignored, a repeated label counts as often as it
occurs; repeated documents are scored one by one; an empty table gives an empty result.  Only
id, text and the label column are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.storage import materialize
from larkspur.llm.textstats import with_text_stats

FEATURES = 160
RIDGE = 1e-3
SEED = 20240607
CELLS = 2000  # cells of the calibration histogram
LOW, HIGH = -0.5, 1.5  # raw scores are clipped to this range
STATS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_chars_all n_upper n_digits n_marks n_distinct_words".split()
)


def inputs(pdf: pd.DataFrame) -> np.ndarray:
    """Scale-free inputs of the model from the statistics."""
    s = {k: pdf[k].to_numpy(float) for k in STATS}
    words, chars, lines = np.maximum(s["n_words"], 1), np.maximum(s["n_chars_all"], 1), np.maximum(s["n_lines"], 1)
    return np.column_stack(
        [
            np.log1p(s["n_words"]),
            np.log1p(s["n_words"] / lines),
            np.minimum(s["word_chars"] / words, 40),
            np.minimum(s["n_symbols"] / words, 6),
            np.minimum(s["n_marks"] / words, 6),
            s["n_dup_lines"] / lines,
            s["n_repeat_words"] / words,
            s["n_distinct_words"] / words,
            np.log1p(s["n_distinct_words"]) / np.log1p(words),
            s["n_upper"] / chars,
            s["n_digits"] / chars,
            np.minimum(chars / (s["word_chars"] + 1), 10),
        ]
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def rows(self, pdf: pd.DataFrame) -> np.ndarray:
        x = np.clip((inputs(pdf) - self.mean) / self.scale, -6, 6)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([np.ones(len(x)), x, waves])

    def raw(self, pdf: pd.DataFrame) -> np.ndarray:
        return np.clip(self.rows(pdf) @ self.weights, LOW, HIGH)

    def score(self, pdf: pd.DataFrame) -> np.ndarray:
        return np.clip(np.interp(self.raw(pdf), self.knots, self.values), 0.0, 1.0)


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on increasing x: the pools' mean x and value."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        pools.append([a * c, b * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _added(parts: DataFrame, keys: list[str]) -> DataFrame:
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1][["i", "slot"]].copy()
        first["v"] = [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]
        return first

    return parts.groupBy(*keys).applyInPandas(add, "i int, slot int, v array<double>")


def _sums(rows: DataFrame, of_batch, size: int) -> np.ndarray:
    """Sum ``of_batch(pdf)`` (a matrix of ``size`` rows) over all batches of all partitions."""

    def partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            one = of_batch(pdf)
            total = one if total is None else total + one
        if total is not None:
            from pyspark import TaskContext

            slot = TaskContext.get().partitionId() % 64
            yield pd.DataFrame({"i": np.arange(size, dtype=np.int32), "slot": np.int32(slot), "v": list(total)})

    parts = rows.mapInPandas(partition, "i int, slot int, v array<double>")
    got = _added(_added(parts, ["i", "slot"]), ["i"]).collect()  # `size` rows at any input size
    return np.array([r["v"] for r in sorted(got, key=lambda r: r["i"])])


def fit(train: DataFrame, label: str = "y", calibrate: DataFrame | None = None) -> Model:
    """``train``: the columns of STATS and a 0/1 label.

    Scores are calibrated on ``calibrate`` (rows of the same columns), or on ``train`` where these rows
    do not have both labels; where ``train`` lacks one, both tables are one.
    """
    d = inputs(pd.DataFrame({k: [0.0] for k in STATS})).shape[1]
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(d, FEATURES)) / np.sqrt(d) * 1.5
    model = Model(np.zeros(d), np.ones(d), directions, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), np.zeros(1), np.full(1, 0.5))

    def moments(pdf: pd.DataFrame) -> np.ndarray:
        x, y = inputs(pdf), pdf[label].to_numpy(float)
        return np.vstack([np.full(d, len(x)), np.full(d, y.sum()), x.sum(0), (x * x).sum(0)])

    sums = _sums(train, moments, 4)
    p = 1 + d + FEATURES
    model.weights = np.zeros(p)
    if calibrate is not None and (not len(sums) or sums[1, 0] in (0, sums[0, 0])):
        return fit(train.unionByName(calibrate), label)
    if not len(sums):
        return model
    n, ones = sums[0, 0], sums[1, 0]
    model.values = np.full(1, ones / n)
    if ones in (0, n):
        return model
    model.mean = sums[2] / n
    model.scale = np.sqrt(np.maximum(sums[3] / n - model.mean**2, 1e-9))

    def equations(pdf: pd.DataFrame) -> np.ndarray:
        z, y = model.rows(pdf), pdf[label].to_numpy(float)
        return np.column_stack([z.T @ z, z.T @ y])

    sums = _sums(train, equations, p)
    ridge = RIDGE * n * np.eye(p)
    ridge[0, 0] = 0
    model.weights = np.linalg.solve(sums[:, :p] + ridge, sums[:, p])

    def cells(pdf: pd.DataFrame) -> np.ndarray:
        raw, y = model.raw(pdf), pdf[label].to_numpy(float)
        at = np.minimum(((raw - LOW) / (HIGH - LOW) * CELLS).astype(int), CELLS - 1)
        return np.vstack([np.bincount(at, v, CELLS) for v in (np.ones(len(y)), raw, y)])

    sums = np.zeros((0, CELLS)) if calibrate is None else _sums(calibrate, cells, 3)
    count, raw, y = sums if len(sums) and 0 < sums[2].sum() < sums[0].sum() else _sums(train, cells, 3)
    used = count > 0
    model.knots, model.values = pool_adjacent(raw[used] / count[used], y[used] / count[used], count[used])
    return model


def score(stats: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` (columns of ``stats``) and the score of every row."""
    kinds = {f.name: f.dataType.simpleString() for f in stats.schema}

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[keep].assign(score=model.score(pdf))

    return stats.select(*keep, *STATS).mapInPandas(of, ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", score double")


def held_out(id_col: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def calibrates(id_col: Column) -> Column:
    """Labelled documents that calibrate the score: a quarter of those learned from, none of which fits the ridge."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 1


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    cut: float = 0.3,
    keep: list[str] | None = None,
) -> DataFrame:
    """Per document: id, the columns of ``keep``, held_out, score and predicted (1 if score >= cut).

    A null id counts as not held out, and no label belongs to it.
    """
    carried = {f"__keep_{i}": c for i, c in enumerate(keep or [])}
    slim = docs.select(F.col(id_col).alias("__id"), F.col(text_col), *[F.col(c).alias(k) for k, c in carried.items()])
    stats = materialize(with_text_stats(slim, text_col, ["__id", *carried]), "text-stats")
    marks = labels.select(F.col(id_col).alias("__of"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0))
    train = stats.where(~held_out(F.col("__id"))).join(marks, F.col("__id") == F.col("__of"))
    train = materialize(train.select(*STATS, "y", calibrates(F.col("__id")).alias("__c")), "quality-train")
    model = fit(train.where("not __c"), calibrate=train.where("__c"))
    scored = score(stats, model, ["__id", *carried])
    return scored.select(
        F.col("__id").alias(id_col),
        *[F.col(k).alias(c) for k, c in carried.items()],
        F.coalesce(held_out(F.col("__id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )
