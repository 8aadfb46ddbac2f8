"""Splits in time and rolling-origin folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage
from .joins import interval_join


def chronological_split(df: DataFrame, val_start: str, test_start: str) -> DataFrame:
    """df with split: train before val_start, validation before test_start, then test (UTC)."""
    ts = F.col("ts")
    return df.withColumn("split", F.when(ts < F.lit(val_start).cast("timestamp"), "train").when(ts < F.lit(test_start).cast("timestamp"), "validation").otherwise("test"))


def check_split(df: DataFrame) -> None:
    """Raise if a part of the split is empty. One small aggregate."""
    missing = {"train", "validation", "test"} - {r["split"] for r in df.select("split").distinct().collect()}
    if missing:
        raise ValueError(f"a split came out empty: {', '.join(sorted(missing))}")


def backtest_folds(df: DataFrame, first_test_start: str, block_months: int = 6, val_months: int = 12, least_rows: int = 720) -> DataFrame:
    """fold, val_start, test_start, test_end, a row for each block of months from first_test_start.

    The last block ends an hour after the last ts; blocks stop where fewer than least_rows
    different times remain. The number of folds follows the time span, not the table. Times are counted
    by block, then summed from the last block back.
    """
    start = F.lit(first_test_start).cast("timestamp")
    times = df.select("ts").distinct()
    last = times.agg(F.max("ts").alias("last"))
    blocks = F.floor(F.months_between(F.col("last"), start) / block_months).cast("int") + 1
    grid = last.filter(F.col("last") >= start).select("last", F.explode(F.sequence(F.lit(0), blocks)).alias("k"))
    begin, end = start + F.make_ym_interval(F.lit(0), F.col("k") * block_months), start + F.make_ym_interval(F.lit(0), (F.col("k") + 1) * block_months)
    folds = stage(grid.select((F.col("k") + 1).cast("int").alias("fold"), (begin - F.make_ym_interval(F.lit(0), F.lit(val_months))).alias("val_start"), begin.alias("test_start"), end.alias("_block_end"), F.least(end, F.col("last") + F.expr("interval 1 hour")).alias("test_end"), "last"), "folds")
    counted = interval_join(times, folds.select("fold", "test_start", "_block_end"), "ts", "test_start", "_block_end").groupBy("fold").agg(F.count(F.lit(1)).alias("_n"))
    later = Window.partitionBy().orderBy(F.desc("fold")).rowsBetween(Window.unboundedPreceding, 0)  # a row a fold
    left = folds.join(counted, "fold", "left").withColumn("_left", F.sum(F.coalesce("_n", F.lit(0))).over(later))
    return left.filter(F.col("_left") >= least_rows).filter("test_start < last").select("fold", "val_start", "test_start", "test_end")


def assign_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Each row once for each fold it has a role in: train, validation or test.

    Expanding folds share nearly all rows, so every row meets the list of folds, which are few; its columns are folds' own.
    """
    rows = folds.orderBy("fold").collect()
    if not rows:
        return df.join(folds.limit(0), F.lit(False)).withColumn("role", F.lit(""))
    each = F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in folds.schema]) for r in rows])
    ts = F.col("ts")
    role = F.when(ts < F.col("val_start"), "train").when(ts < F.col("test_start"), "validation").otherwise("test")
    return df.withColumn("_f", F.explode(F.filter(each, lambda f: ts < f["test_end"]))).select(*df.columns, "_f.*").withColumn("role", role)


def refit_rows(assigned: DataFrame) -> DataFrame:
    return assigned.filter(F.col("role").isin("train", "validation"))


def daylight_rows(df: DataFrame, clear_sky: DataFrame) -> DataFrame:
    """df at the times when the sky has daylight; a time without a flag is night."""
    return df.join(clear_sky.filter("daylight").select("ts").distinct(), "ts", "left_semi")
