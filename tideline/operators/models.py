"""Distributed fits: standardised ridge by moments, boosted trees a series or over all, and the tuning protocol."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage
from . import boosting
from .folds import assign_folds
from .joins import interval_join

ALPHAS = (0.1, 1.0, 10.0, 100.0)
SHIFT_ROWS = 1000
GBM_GRID = tuple((rate, rounds) for rate in (0.05, 0.1) for rounds in (300, 600))


def scaler(fit_rows: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """keys with mean_<c> and scale_<c>: population deviation, 1 for a constant column."""
    sd = {c: F.stddev_pop(c) for c in columns}
    return fit_rows.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.when(s > 0, s).otherwise(1.0).alias(f"scale_{c}") for c, s in sd.items()])


def standardise(df: DataFrame, fitted: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    rows = df.join(fitted, keys)
    return rows.withColumns({c: (F.col(c) - F.col(f"mean_{c}")) / F.col(f"scale_{c}") for c in columns}).select(*df.columns)


def unstandardise(df: DataFrame, fitted: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    rows = df.join(fitted, keys)
    return rows.withColumns({c: F.col(c) * F.col(f"scale_{c}") + F.col(f"mean_{c}") for c in columns}).select(*df.columns)


def block_moments(df: DataFrame, columns: list[str], target: str, keys: list[str]) -> DataFrame:
    """keys, n, shift (one rough mean a column) and the packed sums of products of (1, columns, target).

    Each Arrow batch becomes one row a key before the shuffle. Columns are shifted by a rough mean,
    that of some rows, so that sums of squares don't cancel; which rows doesn't matter.
    """
    names = [*columns, target]
    p = len(names) + 1
    means = df.select(*names).limit(SHIFT_ROWS).agg(*[F.avg(c).alias(c) for c in names]).first()
    shift = np.array([float(means[c] or 0.0) for c in names])
    schema = ", ".join([f"`{k}` {dict(df.dtypes)[k]}" for k in keys] + ["packed binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            rows = []
            for key, part in pdf.groupby(keys, dropna=False, sort=False):
                x = np.column_stack([np.ones(len(part)), part[names].to_numpy(dtype=float) - shift])
                rows.append([*(key if isinstance(key, tuple) else (key,)), (x.T @ x).tobytes()])
            if rows:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[*keys, "packed"]), preserve_index=False)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        gram = sum(np.frombuffer(b).reshape(p, p) for b in pdf["packed"])
        return pd.DataFrame([[*pdf[keys].iloc[0], gram.tobytes()]], columns=[*keys, "packed"])

    partial = df.select(*keys, *names).dropna().mapInArrow(run, schema)
    out = partial.groupBy(*keys).applyInPandas(total, schema)
    return out.withColumn("shift", F.array(*[F.lit(float(v)) for v in shift]))


def solve_ridge(gram: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and coefficients (of unscaled, shifted columns) of ridge on standardised columns."""
    n = gram[0, 0]
    mean = gram[0, 1:] / n
    cov = gram[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1] / n, 0))
    scale = np.where(scale > 1e-12 * np.maximum(1.0, np.abs(mean[:-1])), scale, 1.0)
    z, b = cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale
    w = np.linalg.solve(z + alpha * np.eye(len(z)), b) / scale
    return np.concatenate(([mean[-1] - w @ mean[:-1]], w))


def fit_ridge(assigned: DataFrame, columns: list[str], target: str, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """series_id, fold, alpha, intercept, coef: alpha by validation MAE, then refit on train and validation.

    assigned: rows with series_id, fold and role. Moments serve all alphas; validation errors of all
    alphas come from one pass. Ties go to the first alpha.
    """
    keys = ["series_id", "fold"]
    moments = block_moments(assigned.filter(F.col("role").isin("train", "validation")), columns, target, [*keys, "role"])
    coef_schema = "series_id string, fold int, alpha double, intercept double, coef array<double>"

    def solve(pdf: pd.DataFrame, roles: tuple[str, ...]) -> pd.DataFrame:
        part = pdf[pdf["role"].isin(roles)]
        rows = []
        if len(part):
            p = len(columns) + 2
            shift = np.asarray(part["shift"].iloc[0], dtype=float)
            gram = sum(np.frombuffer(b).reshape(p, p) for b in part["packed"])
            for alpha in alphas:
                w = solve_ridge(gram, alpha)
                rows.append([part["series_id"].iloc[0], int(part["fold"].iloc[0]), alpha, w[0] + shift[-1] - w[1:] @ shift[:-1], w[1:].tolist()])
        return pd.DataFrame(rows, columns=["series_id", "fold", "alpha", "intercept", "coef"])

    tuned = moments.groupBy(*keys).applyInPandas(lambda pdf: solve(pdf, ("train",)), coef_schema)
    refit = moments.groupBy(*keys).applyInPandas(lambda pdf: solve(pdf, ("train", "validation")), coef_schema)
    validation = predict_linear(assigned.filter("role = 'validation'"), tuned, columns, keys)
    errors = validation.groupBy(*keys, "alpha").agg(F.avg(F.abs(F.col("pred") - F.col(target))).alias("mae"))
    best = errors.groupBy(*keys).agg(F.min_by("alpha", F.struct("mae", "alpha")).alias("alpha"))
    return refit.join(best, [*keys, "alpha"])


def boundaries(folds: DataFrame) -> list:
    """The times at which some fold's training or validation ends, in order: few, as folds are."""
    return sorted({t for r in folds.select("val_start", "test_start").collect() for t in r})


def time_block(bounds: list):
    """How many of the boundaries a row's ts has passed."""
    return F.size(F.filter(F.array(*[F.lit(t) for t in bounds]), lambda t: t <= F.col("ts")))


def ridge_moments(rows: DataFrame, bounds: list, columns: list[str], target: str) -> DataFrame:
    """series_id, block and the packed moments of each block of time between boundaries: a pass over rows, whatever the folds."""
    return block_moments(rows.withColumn("block", time_block(bounds)), columns, target, ["series_id", "block"])


def fit_ridge_folds(rows: DataFrame, folds: DataFrame, columns: list[str], target: str, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """As fit_ridge on assigned folds, but no row is copied for each fold it trains.

    Expanding folds share their rows: a fold's moments are the sum of those of the blocks before its
    boundary. Only validation rows, which few folds share, meet the folds.
    """
    keys = ["series_id", "fold"]
    bounds = boundaries(folds)
    spans = [(int(r["fold"]), bounds.index(r["val_start"]), bounds.index(r["test_start"])) for r in folds.select("fold", "val_start", "test_start").orderBy("fold").collect()]
    p = len(columns) + 2

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        shift = np.asarray(pdf["shift"].iloc[0], dtype=float)
        grams = {int(b): np.frombuffer(raw).reshape(p, p) for b, raw in zip(pdf["block"], pdf["packed"], strict=True)}
        out = []
        for fold, val, test in spans:
            for name, end in (("train", val), ("refit", test)):
                mine = [g for b, g in grams.items() if b <= end]
                if mine:
                    gram = sum(mine)
                    for alpha in alphas:
                        w = solve_ridge(gram, alpha)
                        out.append([pdf["series_id"].iloc[0], fold, name, alpha, w[0] + shift[-1] - w[1:] @ shift[:-1], w[1:].tolist()])
        return pd.DataFrame(out, columns=["series_id", "fold", "fit", "alpha", "intercept", "coef"])

    fitted = ridge_moments(rows, bounds, columns, target).groupBy("series_id").applyInPandas(solve, "series_id string, fold int, fit string, alpha double, intercept double, coef array<double>")
    held = interval_join(rows, folds.select("fold", "val_start", "test_start"), "ts", "val_start", "test_start")
    tried = predict_linear(held, fitted.filter("fit = 'train'").drop("fit"), columns, keys)
    errors = tried.groupBy(*keys, "alpha").agg(F.avg(F.abs(F.col("pred") - F.col(target))).alias("mae"))
    best = errors.groupBy(*keys).agg(F.min_by("alpha", F.struct("mae", "alpha")).alias("alpha"))
    return fitted.filter("fit = 'refit'").drop("fit").join(best, [*keys, "alpha"])


def predict_linear(rows: DataFrame, coefficients: DataFrame, columns: list[str], keys: list[str], least: float | None = None) -> DataFrame:
    """rows with alpha and pred; a dot product in column expressions. least clips from below."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    joined = rows.join(coefficients, keys)
    pred = F.col("intercept") + F.aggregate(F.zip_with(x, F.col("coef"), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    pred = F.greatest(pred, F.lit(least)) if least is not None else pred
    return joined.withColumn("pred", pred).drop("intercept", "coef")


def fit_gbm(assigned: DataFrame, columns: list[str], target: str, fold: int, grid: tuple[tuple[float, int], ...] = GBM_GRID, max_depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """(series_id and its trees, series_id and the chosen rate and rounds) for one fold: a model a series.

    (rate, rounds) has the lowest validation MAE, the first of equals; then trees are refitted on train
    and validation. Rows with a null are left out of the fit. A series without rows in both roles has none.
    """
    rows = assigned.filter((F.col("fold") == fold) & F.col("role").isin("train", "validation")).select("series_id", *[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias("_y"), (F.col("role") == "validation").alias("_held")).dropna()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        held = pdf["_held"].to_numpy()
        out = []
        if held.any() and not held.all():
            (rate, rounds), trees = boosting.tune_and_fit(pdf[columns].to_numpy(), pdf["_y"].to_numpy(), held, grid, max_depth)
            out.append([pdf["series_id"].iloc[0], rate, rounds, pickle.dumps(trees)])
        return pd.DataFrame(out, columns=["series_id", "rate", "rounds", "trees"])

    model = rows.groupBy("series_id").applyInPandas(fit, "series_id string, rate double, rounds int, trees binary")
    return model, model.select("series_id", "rate", "rounds")


def predict_trees(rows: DataFrame, model: DataFrame, columns: list[str], least: float | None = None) -> DataFrame:
    """rows with pred: null where a column is, or where the series has no model. least clips from below."""

    def predict(pdf: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        x = pdf[columns].to_numpy(dtype=float)
        pred = np.full(len(pdf), np.nan)
        known = ~np.isnan(x).any(axis=1)
        if len(fitted) and known.any():
            pred[known] = pickle.loads(fitted["trees"].iloc[0]).predict(x[known])
        return pdf.assign(pred=pred if least is None else np.maximum(pred, least))

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + ", pred double"
    out = rows.groupBy("series_id").cogroup(model.groupBy("series_id")).applyInPandas(predict, schema)
    return out.withColumn("pred", F.when(~F.isnan("pred"), F.col("pred")))


def fit_gbm_pooled(assigned: DataFrame, columns: list[str], target: str, fold: int, grid: tuple[tuple[float, int], ...] = GBM_GRID, max_depth: int = 5):
    """(model, (rate, rounds)) of one Spark ML model for a fold over all series; refit on train and validation. A null in a column is an error."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(assigned.filter(F.col("fold") == fold)).select("features", F.col(target).alias("label"), "role").persist()

    def fit(part: DataFrame, config: tuple[float, int]):
        return GBTRegressor(stepSize=config[0], maxIter=config[1], maxDepth=max_depth, seed=0, checkpointInterval=10).fit(part)

    def loss(model) -> float:
        return model.transform(rows.filter("role = 'validation'")).agg(F.avg(F.abs(F.col("prediction") - F.col("label")))).first()[0]

    best = tune(grid, lambda c: fit(rows.filter("role = 'train'"), c), loss)
    model = fit(rows.filter(F.col("role").isin("train", "validation")), best)
    rows.unpersist()
    return model, best


def tune(configs: tuple, fit: Callable, loss: Callable):
    """The config whose fit has the lowest validation loss; the first of equals."""
    losses = [(loss(fit(c)), i) for i, c in enumerate(configs)]
    return configs[min(losses)[1]]


def predict_pooled(rows: DataFrame, model, columns: list[str], least: float | None = None) -> DataFrame:
    """rows with pred by a pooled model."""
    from pyspark.ml.feature import VectorAssembler

    out = model.transform(VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="error").transform(rows))
    pred = F.greatest("prediction", F.lit(least)) if least is not None else F.col("prediction")
    return out.withColumn("pred", pred).drop("features", "prediction")


Fitter = Callable[[DataFrame, DataFrame, list[str], str], DataFrame]


def ridge_forecast(rows: DataFrame, folds: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Test rows of all folds with pred by ridge."""
    test = assign_folds(rows, folds).filter("role = 'test'")
    return predict_linear(test, fit_ridge_folds(rows, folds, columns, target), columns, ["series_id", "fold"]).drop("alpha")


def gbm_forecast(rows: DataFrame, folds: DataFrame, columns: list[str], target: str, grid: tuple[tuple[float, int], ...] = GBM_GRID, max_depth: int = 5) -> DataFrame:
    """Test rows of all folds with pred by boosted trees, a model a series and fold, all in one job.

    A task gets the rows of one series and fold, tunes, refits and predicts the fold's test rows, so rows
    are dealt once and no model is stored. pred is null where a column is, and where a series lacks rows in
    either role. A series and fold is bounded by its span of time; for rows beyond one task see pooled_forecast.
    """
    assigned = assign_folds(rows, folds)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, role = pdf[columns].to_numpy(dtype=float), pdf[target].to_numpy(dtype=float), pdf["role"].to_numpy()
        known = ~np.isnan(x).any(axis=1)
        fit, test = known & ~np.isnan(y) & (role != "test"), role == "test"
        held = role[fit] == "validation"
        pred = np.full(len(pdf), np.nan)
        if held.any() and not held.all() and (test & known).any():
            _, trees = boosting.tune_and_fit(x[fit], y[fit], held, grid, max_depth)
            pred[test & known] = trees.predict(x[test & known])
        return pdf.assign(pred=pred)[test]

    schema = ", ".join(f"`{n}` {t}" for n, t in assigned.dtypes) + ", pred double"
    # Rows are few for the time that a fit takes: a count of partitions keeps Spark from joining small ones into one task.
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * folds.count())
    out = assigned.repartition(parts, "series_id", "fold").groupBy("series_id", "fold").applyInPandas(run, schema)
    return out.withColumn("pred", F.when(~F.isnan("pred"), F.col("pred")))


def pooled_forecast(rows: DataFrame, folds: DataFrame, columns: list[str], target: str, grid: tuple[tuple[float, int], ...] = GBM_GRID, max_depth: int = 5, tolerance: float = 0.01, at_once: int = 4) -> DataFrame:
    """Test rows of all folds with pred by boosted trees of Spark ML, one model a fold over all series: rows no task can hold.

    For each rate of the grid trees are added, up to its most rounds, until the squared error on validation
    rows, which Spark tracks beside the fit, no longer falls by the tolerance; the rate with the lowest
    validation MAE, the first of equals, is refitted on train and validation with as many rounds. Splits come
    from histograms that tasks sum. Folds are fitted at_once side by side; rows with a null among the columns
    or target are left out of fits and predicted as null. The rows of all folds are staged once.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assigned = stage(assign_folds(rows, folds), "assigned")
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    vectors = VectorAssembler(inputCols=columns, outputCol="_features").transform(assigned.filter(known)).withColumn("_label", F.col(target).cast("double"))
    most = {rate: max(n for r, n in grid if r == rate) for rate, _ in grid}

    def fit(fold: int):
        mine = vectors.filter((F.col("fold") == fold) & (F.col("role") != "test") & F.col("_label").isNotNull()).select("_features", "_label", (F.col("role") == "validation").alias("_held")).persist()
        held = {r["_held"]: r["count"] for r in mine.groupBy("_held").count().collect()}
        model = None
        if len(held) == 2:
            common = {"featuresCol": "_features", "labelCol": "_label", "predictionCol": "pred", "maxDepth": max_depth, "seed": 0, "maxBins": boosting.BINS, "minInstancesPerNode": boosting.LEAST_ROWS}
            tried = []
            for i, (rate, rounds) in enumerate(most.items()):
                one = GBTRegressor(stepSize=rate, maxIter=rounds, validationIndicatorCol="_held", validationTol=tolerance, **common).fit(mine)
                loss = one.transform(mine.filter("_held")).agg(F.avg(F.abs(F.col("pred") - F.col("_label")))).first()[0]
                tried.append((loss, i, rate, one.getNumTrees))
            _, _, rate, rounds = min(tried)
            model = GBTRegressor(stepSize=rate, maxIter=rounds, **common).fit(mine)
        mine.unpersist()
        return fold, model

    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())
    with ThreadPoolExecutor(at_once) as pool:
        fitted = list(pool.map(fit, numbers))
    # One pass over the staged test rows a fold; the fold's rows are few of all.
    out = assigned.filter((F.col("role") == "test") & ~known).withColumn("pred", F.lit(None).cast("double"))
    for fold, model in fitted:
        test = vectors.filter((F.col("fold") == fold) & (F.col("role") == "test"))
        pred = model.transform(test) if model is not None else test.withColumn("pred", F.lit(None).cast("double"))
        out = out.unionByName(pred.drop("_features", "_label"))
    return out


def forecasts(rows: DataFrame, folds: DataFrame, columns: list[str], target: str, fitters: dict[str, Fitter], least: float | None = None) -> DataFrame:
    """Long predictions (series_id, ts, fold, test_start, y, model, pred) of each fitter on every fold's test rows."""
    out = None
    for name, fitter in fitters.items():
        pred = F.col("pred") if least is None else F.greatest("pred", F.lit(least))
        got = fitter(rows, folds, columns, target).select("series_id", "ts", "fold", "test_start", F.col(target).alias("y"), F.lit(name).alias("model"), F.when(F.col("pred").isNotNull(), pred).alias("pred"))
        out = got if out is None else out.unionByName(got)
    return out
