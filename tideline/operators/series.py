"""Series preparation: trim, densify, fill, align, and the ratios built on filled series.

Tables are keyed by series_id and ts; the value column is a parameter. Missing values are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..staging import stage
from .joins import asof_join


def by_series() -> WindowSpec:
    """Rows of a series in order of time. (Windows can only be made once there is a session.)"""
    return Window.partitionBy("series_id").orderBy("ts")


def _past() -> WindowSpec:
    return by_series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _future() -> WindowSpec:
    return by_series().rowsBetween(Window.currentRow, Window.unboundedFollowing)


def hourly_totals(events: DataFrame, value: str = "x") -> DataFrame:
    """The sum of value by event type and hour, from a table of single events."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return events.groupBy(F.col("event_type").alias("series_id"), hour.alias("ts")).agg(F.sum("value").alias(value))


def trim_to_valid(df: DataFrame, value: str = "x") -> DataFrame:
    """Each series from its first to its last non-null value; a series without any goes."""
    ends = df.groupBy("series_id").agg(F.min(F.when(F.col(value).isNotNull(), F.col("ts"))).alias("_lo"), F.max(F.when(F.col(value).isNotNull(), F.col("ts"))).alias("_hi"))
    return df.join(ends, "series_id").filter(F.col("ts").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def densify(df: DataFrame, step: str = "1 hour") -> DataFrame:
    """Every step between each series' first and last ts, with nulls where there was no row.

    Steps are laid out a year at a time, so no row holds the times of a whole long series.
    """
    ends = df.groupBy("series_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    every = F.expr(f"interval {step}")
    years = ends.select("series_id", "lo", "hi", F.explode(F.sequence(F.year("lo"), F.year("hi"))).alias("y"))
    begin, end = F.make_timestamp(F.col("y"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp(F.col("y") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    # A year's steps start at the first multiple of the step at or after its beginning, counted from lo.
    seconds = F.expr(f"unix_timestamp(timestamp'1970-01-01 00:00:00' + interval {step}) - unix_timestamp(timestamp'1970-01-01 00:00:00')")
    skipped = F.greatest(F.lit(0), F.ceil((F.unix_timestamp(begin) - F.unix_timestamp("lo")) / seconds))
    first = F.timestamp_seconds(F.unix_timestamp("lo") + skipped * seconds)
    last = F.least(F.col("hi"), end - F.expr("interval 1 second"))
    grid = years.select("series_id", F.explode(F.when(first <= last, F.sequence(first, last, every))).alias("ts"))
    return grid.join(df, ["series_id", "ts"], "left")


def filled(value: Column) -> Column:
    """value, else the last one before it, else (in a leading gap only) the first one after it."""
    return F.coalesce(F.last(value, ignorenulls=True).over(_past()), F.first(value, ignorenulls=True).over(_future()))


def fill_gaps(df: DataFrame, *values: str) -> DataFrame:
    return df.withColumns({v: filled(F.col(v)) for v in values or ("x",)})


def clean_series(df: DataFrame, value: str = "x", step: str = "1 hour") -> DataFrame:
    """Trim, densify and fill: the form that lags and rolling columns need.

    Rows without a value are as good as absent, so what is left spans the trimmed series: its ends
    are found once.
    """
    return fill_gaps(densify(df.filter(F.col(value).isNotNull()), step), value)


def interpolate_gaps(df: DataFrame, value: str = "x", limit: int = 6, step_seconds: int = 3600) -> DataFrame:
    """The straight line across a gap for up to `limit` steps; later steps of the gap take the last of these.

    A leading gap takes the first value. Reads both sides of a gap, so it looks ahead. A trailing gap
    keeps the last value.
    """
    known = F.when(F.col(value).isNotNull(), F.unix_timestamp("ts"))
    x0, t0 = F.last(value, ignorenulls=True).over(_past()), F.last(known, ignorenulls=True).over(_past())
    x1, t1 = F.first(value, ignorenulls=True).over(_future()), F.first(known, ignorenulls=True).over(_future())
    df = df.withColumns({"_x0": x0, "_t0": t0, "_x1": x1, "_t1": t1})
    place = F.least((F.unix_timestamp("ts") - F.col("_t0")) / step_seconds, F.lit(float(limit)))
    line = F.col("_x0") + (F.col("_x1") - F.col("_x0")) * place / ((F.col("_t1") - F.col("_t0")) / step_seconds)
    filled_ = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_x0").isNull(), F.col("_x1")).when(F.col("_x1").isNull(), F.col("_x0")).otherwise(line)
    return df.withColumn(value, filled_).drop("_x0", "_t0", "_x1", "_t1")


def gap_report(df: DataFrame, *values: str) -> DataFrame:
    """By series: n_rows, missing_<v> and share_<v> for each value, and rows that miss any."""
    missing = {v: F.col(v).isNull() for v in values}
    any_of = None
    for m in missing.values():
        any_of = m if any_of is None else any_of | m
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for v, m in missing.items():
        aggs += [F.sum(m.cast("long")).alias(f"missing_{v}"), F.avg(m.cast("double")).alias(f"share_{v}")]
    return df.groupBy("series_id").agg(*aggs, F.sum(any_of.cast("long")).alias("missing_any"))


def spread_daily(dense: DataFrame, daily: DataFrame, value: str) -> DataFrame:
    """A figure given once a day, at any time of it, on every row of the dense table: the latest known at or before ts, before that the first one."""
    known = daily.filter(F.col(value).isNotNull()).select("series_id", "ts", F.col(value).alias("_before"), F.col(value).alias("_after"))
    both = asof_join(asof_join(dense, known, "_before"), known, "_after", direction="forward")
    return both.withColumn(value, F.coalesce("_before", "_after")).drop("_before", "_after")


def capacity_factor(generation: Column, capacity: Column) -> Column:
    return F.try_divide(generation, capacity)


def reconcile(df: DataFrame, ours: str, theirs: str, tolerance: float = 0.01) -> DataFrame:
    """By series: rows compared, the largest difference and how many exceed the tolerance."""
    d = F.abs(F.col(ours) - F.col(theirs))
    return df.groupBy("series_id").agg(F.count(d).alias("n_compared"), F.max(d).alias("max_diff"), F.coalesce(F.sum((d > tolerance).cast("long")), F.lit(0)).alias("n_over"))


def zone_capacity_factor(dense: DataFrame, generation: str = "x", window: int = 24 * 365, least: int = 24 * 30) -> DataFrame:
    """cf: generation over its own maximum of the last `window` rows, within 0 and 1.

    The maximum needs `least` rows with a value; before that, the first one known is used.
    """
    from .scale import fill_back, trailing_max

    # Both read their input several times: it is written once.
    peaked = fill_back(stage(trailing_max(stage(dense, "dense"), generation, window, least, "_peak"), "peaks"), "_peak")
    ratio = F.try_divide(F.col(generation), F.col("_peak"))
    return peaked.withColumn("cf", F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))).drop("_peak")


def reconcile_irregular(a: DataFrame, b: DataFrame, ours: str, theirs: str, tolerance: float = 0.01, within_seconds: float = 3600.0) -> DataFrame:
    """As reconcile for tables whose stamps differ: each row of a (series_id, ts, ours) against b's latest value within that time before it."""
    return reconcile(asof_join(a.select("series_id", "ts", ours), b, theirs, tolerance_seconds=within_seconds), ours, theirs, tolerance)


def align_irregular(keys: DataFrame, df: DataFrame, *values: str, within_seconds: float | None = None) -> DataFrame:
    """df's latest values at or before each key (series_id, ts), whatever df's stamps are; each column's latest known one."""
    out = keys.select("series_id", "ts")
    for v in values:
        out = asof_join(out, df.filter(F.col(v).isNotNull()), v, tolerance_seconds=within_seconds)
    return out


def align(keys: DataFrame, df: DataFrame, *values: str) -> DataFrame:
    """df's values at the keys (series_id, ts), filled where df has none."""
    return fill_gaps(keys.select("series_id", "ts").join(df.select("series_id", "ts", *values), ["series_id", "ts"], "left"), *values)


def shares(df: DataFrame, value: str = "x") -> DataFrame:
    """Each series' mean over the sum of all series' means. One row a series: the window is small."""
    means = df.groupBy("series_id").agg(F.avg(value).alias("mean"))
    return means.withColumn("share", F.try_divide(F.col("mean"), F.sum("mean").over(Window.partitionBy())))


def growth(df: DataFrame, value: str = "x") -> DataFrame:
    """First and last value by ts, and their ratio."""
    known = df.filter(F.col(value).isNotNull())
    ends = known.groupBy("series_id").agg(F.min_by(value, "ts").alias("first"), F.max_by(value, "ts").alias("last"))
    return ends.withColumn("ratio", F.try_divide("last", "first"))


def pick_series(df: DataFrame, *names: str) -> DataFrame:
    return df.filter(F.col("series_id").isin(*names))
