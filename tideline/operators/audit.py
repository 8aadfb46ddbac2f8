"""Looking for look-ahead: change one input row and see which feature rows and columns react."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage


def poke(df: DataFrame, value: str, ts: str, amount: float) -> DataFrame:
    """df with amount added to value at one time (in every series)."""
    return df.withColumn(value, F.when(F.col("ts") == F.lit(ts).cast("timestamp"), F.col(value) + amount).otherwise(F.col(value)))


def _both(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    a = before.select("series_id", "ts", *[F.col(c).alias(f"a_{c}") for c in columns])
    return a.join(after.select("series_id", "ts", *[F.col(c).alias(f"b_{c}") for c in columns]), ["series_id", "ts"])


def changed_rows(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Common keys at which any column differs."""
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return _both(before, after, columns).filter(differs).select("series_id", "ts")


def leakage_report(before: DataFrame, after: DataFrame, columns: list[str], ts: str, horizon_hours: int = 24) -> DataFrame:
    """By series: rows changed before ts, within the horizon after it, and from the horizon on.

    A build without look-ahead has changes only in the last.
    """
    at = F.lit(ts).cast("timestamp")
    safe = at + F.expr(f"interval {horizon_hours} hours")
    t = F.col("ts")

    def n(c):
        return F.coalesce(F.sum(c.cast("long")), F.lit(0))

    return changed_rows(before, after, columns).groupBy("series_id").agg(n(t < at).alias("before"), n((t >= at) & (t < safe)).alias("too_soon"), n(t >= safe).alias("allowed"))


def reacting_columns(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """column and how many rows of it changed, for each column; one pass for all."""
    counts = _both(before, after, columns).agg(*[F.coalesce(F.sum((~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).cast("long")), F.lit(0)).alias(c) for c in columns])
    return counts.unpivot([], columns, "column", "n_changed")


def dependency_check(reacting: DataFrame, declared: list[str]) -> DataFrame:
    """column and verdict: missed (reacts, not declared), spurious (declared, doesn't react),
    absent (declared, no such column) or ok."""
    listed = reacting.sparkSession.createDataFrame([(c,) for c in declared], "column string").withColumn("_d", F.lit(True))
    both = reacting.join(listed, "column", "full")
    moved, known = F.coalesce(F.col("n_changed") > 0, F.lit(False)), F.coalesce("_d", F.lit(False))
    verdict = F.when(F.col("n_changed").isNull(), "absent").when(moved & ~known, "missed").when(~moved & known, "spurious").otherwise("ok")
    return both.select("column", verdict.alias("verdict"))


def poke_every(df: DataFrame, value: str, spacing: int, amount: float, step_seconds: int = 3600) -> DataFrame:
    """df with amount added to value at every spacing-th step of time."""
    nth = F.floor(F.unix_timestamp("ts") / step_seconds)
    return df.withColumn(value, F.when(F.pmod(nth, F.lit(spacing)) == 0, F.col(value) + amount).otherwise(F.col(value)))


def lookback_profile(df: DataFrame, build: Callable[[DataFrame], DataFrame], value: str, columns: list[str], spacing: int, amount: float, step_seconds: int = 3600) -> DataFrame:
    """column, first, last and n_steps: at how many steps after an input row each column reads it, from two builds for all columns.

    Every spacing-th input row is changed; a changed row belongs to the nearest of these, at most half the
    spacing away. So spacing must be over twice the longest look-back. A column that reads steps 24 to 47 has
    first 24, last 47 and n_steps 24, one of a lag of 24 has n_steps 1; one with first below the day
    reads too soon, below 0 it looks ahead; one that reads nothing has nulls and 0. df must be dense.
    """
    before, after = (stage(build(t), "built") for t in (df, poke_every(df, value, spacing, amount, step_seconds)))
    away = F.pmod(F.floor(F.unix_timestamp("ts") / step_seconds), F.lit(spacing))
    away = F.when(away > spacing // 2, away - spacing).otherwise(away).cast("long")
    differs = [F.struct(F.lit(c).alias("column"), (~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias("moved")) for c in columns]
    moved = _both(before, after, columns).select(away.alias("away"), F.explode(F.array(*differs)).alias("d")).select("away", "d.*")
    steps = F.when(F.col("moved"), F.col("away"))
    return moved.groupBy("column").agg(F.min(steps).alias("first"), F.max(steps).alias("last"), F.countDistinct(steps).alias("n_steps"))


def audit(df: DataFrame, build: Callable[[DataFrame], DataFrame], value: str, ts: str, amount: float, columns: list[str]) -> DataFrame:
    """leakage_report of a feature build for a poke of its input."""
    return leakage_report(build(df), build(poke(df, value, ts, amount)), columns, ts)
