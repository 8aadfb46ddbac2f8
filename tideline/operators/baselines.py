"""Forecasts that need no fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import lag, mean_of_lags
from .series import fill_gaps

NAIVE, YESTERDAY, FOUR_WEEKS = "seasonal_naive", "yesterday", "mean_last_4_weeks"


def demand_baselines(df: DataFrame, target: str = "x", day: int = 24) -> DataFrame:
    """df with the value a week ago, a day ago, and the mean of the last four weeks' same step."""
    week = 7 * day
    return df.withColumns({NAIVE: lag(target, week), YESTERDAY: lag(target, day), FOUR_WEEKS: mean_of_lags(target, (week, 2 * week, 3 * week, 4 * week))})


def clear_sky_persistence(cf: str, poa: str, day: int = 24) -> Column:
    """Yesterday's ratio to the clear sky times today's clear sky, at least 0; else yesterday's value."""
    ratio = F.when(F.col(poa) > 1.0, F.least(F.col(cf) / F.col(poa), F.lit(2.0)))
    ratio = F.when(F.col(cf).isNotNull(), ratio)
    smart = lag(ratio, day) * F.col(poa)
    return F.coalesce(F.when(smart.isNotNull(), F.greatest(smart, F.lit(0.0))), lag(cf, day))


def solar_baselines(df: DataFrame, cf: str = "cf", poa: str = "cs_poa", day: int = 24) -> DataFrame:
    return df.withColumns({YESTERDAY: lag(cf, day), "last_week": lag(cf, 7 * day), "clearsky_persistence": clear_sky_persistence(cf, poa, day)})


def to_long(df: DataFrame, models: list[str], target: str) -> DataFrame:
    """series_id, ts, y, model, pred."""
    return df.select("series_id", "ts", F.col(target).alias("y"), *models).unpivot(["series_id", "ts", "y"], models, "model", "pred")


def on_scored_rows(pred: DataFrame, scored: DataFrame, strict: tuple[str, ...] = ()) -> DataFrame:
    """Long predictions at the scored (series_id, ts); a strict model with a hole there is left out.

    A published forecast is never filled, so a series in which it has a hole loses it altogether.
    """
    cut = pred.join(scored.select("series_id", "ts"), ["series_id", "ts"], "left_semi")
    holes = cut.filter(F.col("model").isin(*strict) & F.col("pred").isNull()).select("series_id", "model").distinct()
    missing = scored.select("series_id").distinct().withColumn("model", F.explode(F.array(*[F.lit(m) for m in strict]).cast("array<string>")))
    counts = cut.filter(F.col("model").isin(*strict)).groupBy("series_id", "model").agg(F.count("ts").alias("n"))
    wanted = scored.groupBy("series_id").agg(F.count("ts").alias("want"))
    short = missing.join(wanted, "series_id").join(counts, ["series_id", "model"], "left").filter(F.coalesce("n", F.lit(0)) < F.col("want")).select("series_id", "model")
    return cut.join(holes.unionByName(short).distinct(), ["series_id", "model"], "left_anti")


def without_holes(pred: DataFrame, strict: tuple[str, ...]) -> DataFrame:
    """Long predictions on their scored rows, without the series of a strict model in which it has a hole."""
    holes = pred.filter(F.col("model").isin(*strict) & F.col("pred").isNull()).select("series_id", "model").distinct()
    return pred.join(holes, ["series_id", "model"], "left_anti")


def filled_on_scored_rows(df: DataFrame, scored: DataFrame, models: list[str]) -> DataFrame:
    """Wide baselines at the scored rows, holes filled forward then backward within them."""
    return fill_gaps(df.join(scored.select("series_id", "ts"), ["series_id", "ts"], "left_semi"), *models)
