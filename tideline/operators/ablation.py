"""What a piece of information is worth to a fitted model: the same fit under several modes, on the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring
from .models import Fitter


def mode_forecasts(modes: Iterable[str], build: Callable[[str], tuple[DataFrame, list[str]]], folds: DataFrame, target: str, fitter: Fitter, least: float | None = None) -> DataFrame:
    """Long predictions with mode: build(mode) gives the rows and feature names that fitter fits on every fold.

    Modes are few and each has columns of its own, so each is a fit by itself.
    """
    out = None
    for mode in modes:
        rows, columns = build(mode)
        pred = F.col("pred") if least is None else F.when(F.col("pred").isNotNull(), F.greatest("pred", F.lit(least)))
        got = fitter(rows, folds, columns, target).select("series_id", "ts", "fold", "test_start", F.col(target).alias("y"), F.lit(mode).alias("mode"), pred.alias("pred"))
        out = got if out is None else out.unionByName(got)
    if out is None:
        raise ValueError("no modes")
    return out


def tidy_modes(pred: DataFrame, model: str = "ridge") -> DataFrame:
    """fold, test_start, model, mode, mae; the job fails where a fold's modes aren't scored on the same rows."""
    t = pred.groupBy("fold", "test_start", "mode").agg(*scoring.row_digest(pred), F.count(scoring.error()).alias("n"), scoring.mae().alias("mae"))
    return scoring.on_same_rows(t, ("fold", "test_start")).drop("n").withColumn("model", F.lit(model))


def mode_table(pred: DataFrame, base: str) -> DataFrame:
    """mode, n, scores over all folds, and the difference of MAE to the base mode; the modes must share their rows."""
    t = scoring.on_same_rows(scoring.scores(pred, "mode", n_rows=True))
    return scoring.against(t, "mode", base)
