"""One query for each group of operators. Those with SQL in oracle.py compare cell by cell."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar_cols as cal
from ..functions import solar
from ..operators import ablation, audit, baselines, features, folds, geo, joins, models, scale, scoring, series
from ..sources import tables
from ..staging import stage
from . import base

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
MODELS = ["seasonal_naive", "yesterday"]
SCORED_FROM = "2024-01-10"
DAY_LAGS = (1, 2, 3, 7, 14)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = lambda spark, sf_dir: base.presented(f(spark, sf_dir))
    return f


# ---- preparation ---------------------------------------------------------------------------


@query
def series_trim(spark, d):
    return series.trim_to_valid(base.gappy(spark, d))


@query
def series_densify(spark, d):
    return series.densify(base.hourly(spark, d))


@query
def series_fill(spark, d):
    return series.fill_gaps(series.densify(base.gappy(spark, d)), "x")


@query
def series_carry_in_fill(spark, d):
    return scale.carry_in_fill(series.densify(base.gappy(spark, d)), "x", chunk_rows=100)


@query
def series_interpolate(spark, d):
    return series.interpolate_gaps(series.densify(series.trim_to_valid(base.gappy(spark, d))), "x", limit=2)


@query
def series_gap_report(spark, d):
    g = base.gappy(spark, d).withColumn("y", F.when(F.hour("ts") != 5, F.col("x")))
    return series.gap_report(series.densify(g), "x", "y")


@query
def series_spread_daily(spark, d):
    clean = base.clean(spark, d)
    capacity = clean.filter(F.hour("ts") == 12).select("series_id", "ts", (F.col("x") * 2 + 100).alias("capacity_mw"))
    return series.spread_daily(clean, capacity, "capacity_mw").withColumn("cf", series.capacity_factor(F.col("x"), F.col("capacity_mw")))


@query
def series_reconcile(spark, d):
    clean = base.clean(spark, d).withColumn("cf", F.try_divide(F.col("x"), F.lit(5000.0)))
    return series.reconcile(clean.withColumn("profile", F.round("cf", 2)), "cf", "profile", 0.004)


@query
def series_zone_capacity_factor(spark, d):
    return series.zone_capacity_factor(series.densify(base.gappy(spark, d)), "x", 168, 48)


@query
def series_align(spark, d):
    """All series at the hours in which the first of them has events."""
    hours = base.hourly(spark, d)
    first = hours.agg(F.min("series_id").alias("series_id"))
    keys = base.clean(spark, d).join(hours.join(first, "series_id").select("ts"), "ts", "left_semi")
    return series.align(keys, base.gappy(spark, d), "x")


def _single_events(spark, d):
    """Events by type at their own stamps, which lie anywhere."""
    return base.table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


@query
def series_asof(spark, d):
    """The last event before each hour and the first after it, if within twenty minutes."""
    hours, events = base.clean(spark, d).select("series_id", "ts"), _single_events(spark, d)
    before = joins.asof_join(hours, events.withColumnRenamed("value", "before"), "before", tolerance_seconds=1200, at="before_ts", chunk_seconds=86400)
    return joins.asof_join(before, events.withColumnRenamed("value", "after"), "after", direction="forward", tolerance_seconds=1200, at="after_ts", chunk_seconds=86400)


@query
def series_spread_off_grid(spark, d):
    """A figure stamped 17 minutes past noon, every third day."""
    clean = base.clean(spark, d)
    capacity = clean.filter((F.hour("ts") == 12) & (F.dayofmonth("ts") % 3 == 0)).select("series_id", (F.col("ts") + F.expr("interval 17 minutes")).alias("ts"), (F.col("x") * 2 + 100).alias("capacity_mw"))
    return series.spread_daily(clean, capacity, "capacity_mw").select("series_id", "ts", "capacity_mw")


@query
def series_reconcile_irregular(spark, d):
    """Single events against the hour's total at or before them."""
    return series.reconcile_irregular(_single_events(spark, d), base.hourly(spark, d), "value", "x", 50.0)


@query
def series_align_irregular(spark, d):
    """Each day's figure of the orders as the last event of each type left it."""
    keys = base.clean(spark, d).filter(F.hour("ts") % 6 == 5).select("series_id", (F.col("ts") + F.expr("interval 1234 seconds")).alias("ts"))
    return series.align_irregular(keys, _single_events(spark, d), "value")


@query
def series_pick(spark, d):
    return series.pick_series(base.clean(spark, d), "click", "view").groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"))


@query
def interval_totals(spark, d):
    """Days of orders within a period for each part, of 1 to 90 days, which overlap."""
    k = F.col("p_partkey")
    begin = F.lit("1995-01-01").cast("timestamp") + F.make_dt_interval((k * 37 % 2400).cast("int"))
    periods = base.table(spark, d, "part").select(k.alias("period"), begin.alias("lo"), (begin + F.make_dt_interval((k % 90 + 1).cast("int"))).alias("hi"))
    return joins.interval_join(base.daily_orders(spark, d), periods).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("x")).alias("x"))


@query
def series_shares(spark, d):
    return series.shares(base.clean(spark, d))


@query
def series_growth(spark, d):
    return series.growth(base.gappy(spark, d))


@query
def source_seams(spark, d):
    h = base.hourly(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp")
    first = h.filter(F.col("ts") <= cut + F.expr("interval 36 hours")).withColumn("source_file", F.lit("a"))
    second = h.filter(F.col("ts") >= cut).withColumn("source_file", F.lit("b")).withColumn("x", F.col("x") + 1)
    both = first.unionByName(second)
    kept = tables.drop_seam_duplicates(both, ["series_id", "ts"])
    return kept.groupBy("series_id").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n")).crossJoin(tables.seam_duplicates(both, ["series_id", "ts"]))


@query
def source_seams_planned(spark, d):
    """The same files, of which only the hours that both cover are shuffled."""
    h = base.hourly(spark, d)
    cut = F.lit("2024-01-15").cast("timestamp")
    first = h.filter(F.col("ts") <= cut + F.expr("interval 36 hours")).withColumn("source_file", F.lit("a"))
    second = h.filter(F.col("ts") >= cut).withColumn("source_file", F.lit("b")).withColumn("x", F.col("x") + 1)
    kept = tables.drop_seam_rows(stage(first.unionByName(second), "seams"), ["series_id", "ts"])
    return kept.groupBy("series_id").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))


@query
def demand_features_stored(spark, d):
    """Features from a stored extract in buckets of series: no exchange but the write's."""
    stored = tables.write_sorted_extract(base.clean(spark, d), f"extract_{uuid.uuid4().hex}", base.scratch(spark, "sorted-extract"))
    return features.demand_features(stored, cal.holiday_table(spark, 2023, 2025))


@query
def source_unpivot(spark, d):
    line = base.table(spark, d, "lineitem")
    wide = line.groupBy(F.col("l_shipdate").cast("timestamp").alias("ts")).agg(*[F.round(F.sum(F.when(F.col("l_returnflag") == k, F.col("l_extendedprice"))), 2).alias(f"zone_{k.lower()}_mw") for k in "ANR"])
    long = tables.unpivot_columns(wide, ["ts"], {f"zone_{k.lower()}_mw": k for k in "ANR"})
    return long.filter("x is not null")


def _raw_csv(spark, d, columns: dict[str, str], ts_column: str) -> str:
    """Hourly series as a wide CSV with other columns beside them, in the shared folder: what a download looks like."""
    path = base.scratch(spark, "raw-csv")
    wide = base.hourly(spark, d).groupBy("ts").pivot("series_id", list(columns)).agg(F.first("x"))
    out = wide.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(ts_column), *[F.col(c).alias(raw) for c, raw in columns.items()], F.lit("n/a").alias("comment"))
    out.write.option("header", True).csv(path)
    return path


RAW_COLUMNS = {"click": "DE_click_actual", "view": "DE_view_actual", "purchase": "DE_purchase_actual"}


@query
def source_wide_csv(spark, d):
    path = _raw_csv(spark, d, RAW_COLUMNS, "utc_timestamp")
    return tables.read_wide_csv(spark, path, {raw: f"{c}_mw" for c, raw in RAW_COLUMNS.items()})


@query
def source_weather(spark, d):
    path = _raw_csv(spark, d, {"click": "box", "view": "land", "purchase": "population"}, "timestamp")
    return tables.read_weather(spark, path, "population").filter("temp_c is not null")


@query
def source_extract(spark, d):
    """A cleaned extract written by year and read back."""
    path = base.scratch(spark, "extract")
    tables.write_extract(base.daily_orders(spark, d), path)
    return spark.read.parquet(path).groupBy("series_id", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 1).alias("x"))


@query
def source_scores(spark, d):
    """A score table written with its mode and read back."""
    path = base.scratch(spark, "scores")
    tables.write_scores(scoring.scores(_pred(spark, d), "model").select("model", "n", F.round("mae", 4).alias("mae")), path, weather="none")
    return spark.read.schema("model string, n long, mae double, weather string").option("header", True).csv(path)


@query
def source_grid(spark, d):
    """Two yearly files in Kelvin that overlap, with an ensemble dimension: the first member, the first file's hours, all weightings."""
    path, cut = base.scratch(spark, "grid"), F.lit("2024-01-15").cast("timestamp")
    field = base.grid(spark, d).select(F.col("ts").alias("valid_time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), (F.col("t2m") + 273.15).alias("t2m"))
    parts = [field.filter(F.col("valid_time") <= cut + F.expr("interval 12 hours")), field.filter(F.col("valid_time") >= cut).withColumn("t2m", F.col("t2m") + 1)]
    for name, part in zip("ab", parts, strict=True):
        members = part.withColumn("number", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("t2m", F.col("t2m") + F.col("number") * 50)
        members.withColumn("source_file", F.lit(name)).write.parquet(f"{path}/{name}")
    grid = tables.read_grid(spark, [f"{path}/a", f"{path}/b"])
    return geo.seam_safe_series(grid, geo.checked_weights(_weights(spark)))


# ---- geo -----------------------------------------------------------------------------------


@query
def geo_inside_outline(spark, d):
    return geo.inside_outline(base.customer_points(spark, d), geo.outline_edges(spark)).withColumn("area", geo.area_weight())


@query
def geo_population(spark, d):
    return geo.population_weights(base.customer_points(spark, d), geo.state_table(spark))


@query
def geo_kept_area(spark, d):
    return geo.kept_area(geo.inside_outline(base.customer_points(spark, d), geo.outline_edges(spark)))


def _nation_polygons(spark, d):
    """A ring of twelve corners around each nation's made-up place, its radius from 3 to 4.5 degrees."""
    corner = F.sequence(F.lit(0), F.lit(11))
    k = F.col("n_nationkey")
    rings = base.table(spark, d, "nation").select(k.alias("poly_id"), (F.lit(35.0) + k * 0.8).alias("clat"), (F.lit(-10.0) + k * 1.5).alias("clon"), F.explode(corner).alias("edge_id"))

    def at(v):
        r = F.lit(3.0) + (k * 7 + F.pmod(v, F.lit(12)) * 5) % 4 * 0.5
        return F.col("clon") + r * F.cos(v * 0.5235987755982988), F.col("clat") + r * F.sin(v * 0.5235987755982988)

    k = F.col("poly_id")
    (x1, y1), (x2, y2) = at(F.col("edge_id")), at(F.pmod(F.col("edge_id") + 1, F.lit(12)))
    return rings.select("poly_id", "edge_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


@query
def geo_polygons(spark, d):
    """Every customer's own place, and the nations' rings that hold it."""
    k = F.col("c_custkey").cast("double")
    points = base.table(spark, d, "customer").select("c_custkey", (F.lit(30.0) + F.pmod(k * 0.618033988749895, F.lit(1.0)) * 30).alias("lat"), (F.lit(-15.0) + F.pmod(k * 0.754877666246693, F.lit(1.0)) * 45).alias("lon"))
    return geo.points_in_polygons(points, _nation_polygons(spark, d)).select("c_custkey", "poly_id")


@query
def geo_nearest(spark, d):
    """The supplier nearest to every customer."""
    k, m = F.col("c_custkey").cast("double"), F.col("s_suppkey").cast("double")
    points = base.table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), (F.lit(47.0) + F.pmod(k * 0.618033988749895, F.lit(1.0)) * 8).alias("lat"), (F.lit(5.5) + F.pmod(k * 0.754877666246693, F.lit(1.0)) * 10).alias("lon"))
    suppliers = base.table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"), (F.lit(47.0) + F.pmod(m * 0.569840290998053, F.lit(1.0)) * 8).alias("clat"), (F.lit(5.5) + F.pmod(m * 0.819172513396165, F.lit(1.0)) * 10).alias("clon"))
    return geo.nearest(points, suppliers).select("point_id", "idx", "d2")


def _weights(spark):
    cells = geo.box_cells(spark, base.BOX_LAT, base.BOX_LON, base.BOX_STEP)
    return geo.grid_weights(cells, geo.outline_edges(spark), geo.state_table(spark))


@query
def geo_weighted_series(spark, d):
    return geo.weighted_series(base.grid(spark, d), geo.checked_weights(_weights(spark)))


@query
def geo_box_mean(spark, d):
    return geo.box_mean(base.grid(spark, d))


@query
def geo_points(spark, d):
    k = F.col("s_suppkey")
    points = base.table(spark, d, "supplier").select(k.alias("point_id"), (F.lit(46.9) + (k * 37 % 83) * 0.1).alias("plat"), (F.lit(5.4) + (k * 11 % 103) * 0.1).alias("plon"))
    at = geo.series_at_points(base.grid(spark, d), geo.point_corners(points, base.BOX_LAT, base.BOX_LON, base.BOX_STEP))
    return at.groupBy("point_id").agg(F.avg("t2m").alias("mean"), F.count(F.lit(1)).alias("n"))


# ---- sun -----------------------------------------------------------------------------------


def _sky(spark, d):
    times = base.event_hours(spark, d).withColumn("air", F.lit(8.0) + F.hour("ts") * 0.5)
    return solar.clear_sky(base.sites(spark, d).crossJoin(times), "air")


@query
def solar_clear_sky(spark, d):
    return _sky(spark, d).drop("share")


def _fleet(spark, d):
    times = base.event_hours(spark, d).withColumn("air", F.lit(8.0) + F.hour("ts") * 0.5)
    return solar.fleet_clear_sky(base.sites(spark, d), times, "air")


@query
def solar_fleet(spark, d):
    return _fleet(spark, d)


def _solar_table(spark, d):
    """Capacity factors (made from totals, dark at night) beside the fleet's clear sky.

    Three digits: a mean of 24 or 168 of them is never halfway between numbers of six.
    """
    clean = base.clean(spark, d)
    sky = _fleet(spark, d).withColumnRenamed("cell_c", "_cell").drop("derate", "cs_output", "_cell")
    rows = clean.join(sky, "ts", "left")
    return rows.withColumn("cf", F.round(F.coalesce("cs_poa", F.lit(0.0)) / 1000.0 * (F.pmod(F.col("x"), F.lit(7.0)) + 1) / 8.0, 3)).withColumn("temp", F.lit(8.0) + F.hour("ts") * 0.5)


@query
def solar_daylight_rows(spark, d):
    rows = folds.daylight_rows(base.clean(spark, d), _fleet(spark, d))
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.min("ts").alias("first"))


@query
def solar_index(spark, d):
    t = _solar_table(spark, d)
    return t.select("series_id", "ts", solar.clear_sky_index(F.col("cf") * 3000, F.col("cs_poa")).alias("kt"), solar.air_mass(F.col("zenith")).alias("am")).filter("kt is not null")


@query
def solar_features_lagged(spark, d):
    return features.solar_features(_solar_table(spark, d), "cf", "lagged", "temp")


@query
def solar_features_clearsky(spark, d):
    return features.without_history(features.solar_features(_solar_table(spark, d), "cf", "clearsky"))


@query
def solar_features_no_record(spark, d):
    """A site with no production record whose temperature is known."""
    return features.without_history(features.solar_features(_solar_table(spark, d), "cf", "perfect", "temp"), "perfect")


def _solar_pred(spark, d):
    t = baselines.solar_baselines(_solar_table(spark, d))
    scored = t.filter(F.col("daylight") & (F.col("ts") >= F.lit(SCORED_FROM).cast("timestamp")))
    names = ["yesterday", "last_week", "clearsky_persistence"]
    return baselines.to_long(baselines.filled_on_scored_rows(t, scored, names), names, "cf"), t


@query
def solar_scores(spark, d):
    pred, t = _solar_pred(spark, d)
    capacity = t.select("series_id", "ts", (F.col("x") + 1000).alias("capacity_mw"))
    return scoring.solar_score_table(pred, capacity, "yesterday", ("series_id",))


@query
def solar_night_effect(spark, d):
    t = baselines.solar_baselines(_solar_table(spark, d)).filter(F.col("ts") >= F.lit(SCORED_FROM).cast("timestamp"))
    return scoring.night_effect(baselines.to_long(t, ["yesterday", "clearsky_persistence"], "cf"), _fleet(spark, d))


@query
def solar_drift(spark, d):
    sky = _fleet(spark, d).withColumn("series_id", F.lit("fleet"))
    dense = series.densify(sky.select("series_id", "ts", "cs_poa", "daylight"))
    return scoring.clear_sky_drift(dense)


@query
def solar_demeaned_correlation(spark, d):
    t = _solar_table(spark, d).withColumn("kt", solar.clear_sky_index(F.col("cf") * 3000, F.col("cs_poa"))).filter("daylight")
    return scoring.demeaned_correlation(base.with_temperature(t.drop("temp")), "temp", "kt")


# ---- calendar and features -----------------------------------------------------------------


@query
def calendar_columns(spark, d):
    ts = F.col("ts")
    t = base.clean(spark, d).select("series_id", "ts")
    return t.withColumns(cal.local_calendar(ts) | cal.cycles(ts))


@query
def calendar_holidays(spark, d):
    days = base.daily_orders(spark, d).select("series_id", "ts")
    return cal.with_holiday(days, cal.holiday_table(spark, 1992, 2002)).groupBy("series_id").agg(F.sum("is_holiday").alias("n_holidays"), F.min(F.when(F.col("is_holiday") == 1, F.col("ts"))).alias("first"), F.max(F.when(F.col("is_holiday") == 1, F.col("ts"))).alias("last"), F.sum(F.when(F.col("is_holiday") == 1, F.datediff("ts", F.lit("1990-01-01").cast("date")))).alias("checksum"))


@query
def demand_features(spark, d):
    return features.demand_features(base.clean(spark, d), cal.holiday_table(spark, 2023, 2025))


@query
def demand_features_chunked(spark, d):
    holidays = cal.holiday_table(spark, 2023, 2025)
    return scale.with_halo(base.clean(spark, d), lambda t: features.demand_features(t, holidays), chunk_rows=240, halo_rows=504)


@query
def demand_features_perfect(spark, d):
    t = base.with_temperature(base.clean(spark, d))
    return features.demand_features(t, cal.holiday_table(spark, 2023, 2025), temp="temp", mode="perfect").select("series_id", "ts", *features.demand_columns("perfect")[-5:])


@query
def temperature_modes(spark, d):
    t = base.with_temperature(base.clean(spark, d))
    modes = {m: features.usable_temperature("temp", m, seed=3) for m in ("lagged", "noisy", "perfect")}
    return t.select("series_id", "ts", *[c.alias(m) for m, c in modes.items()])


# ---- folds, baselines, scores --------------------------------------------------------------


@query
def chronological_split(spark, d):
    s = folds.chronological_split(base.clean(spark, d), "2024-01-12", "2024-01-20")
    return s.groupBy("series_id", "split").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


def _folds(df):
    return folds.backtest_folds(df, "1998-01-01", least_rows=60)


@query
def backtest_folds(spark, d):
    return _folds(base.daily_orders(spark, d))


@query
def fold_roles(spark, d):
    t = base.daily_orders(spark, d)
    assigned = folds.assign_folds(t, _folds(t))
    refit = folds.refit_rows(assigned).groupBy("series_id", "fold").agg(F.count(F.lit(1)).alias("n_refit"))
    return assigned.groupBy("series_id", "fold", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x")).join(refit, ["series_id", "fold"])


@query
def demand_baselines(spark, d):
    return baselines.demand_baselines(base.clean(spark, d)).filter(F.col("ts") >= F.lit(SCORED_FROM).cast("timestamp"))


def _pred(spark, d):
    t = baselines.demand_baselines(base.clean(spark, d)).filter(F.col("ts") >= F.lit(SCORED_FROM).cast("timestamp"))
    return baselines.to_long(t, MODELS, "x")


@query
def demand_scores(spark, d):
    return scoring.score_table(_pred(spark, d), "seasonal_naive", ("series_id",))


@query
def published_forecast(spark, d):
    """A forecast with holes in some series: only series without a hole in the scored rows keep it."""
    t = baselines.demand_baselines(base.clean(spark, d))
    scored = t.filter(F.col("ts") >= F.lit(SCORED_FROM).cast("timestamp"))
    hole = (F.length("series_id") % 2 == 0) & (F.hour("ts") == 7)
    t = t.withColumn("published", F.when(~hole, F.round(F.col("x") + features.seeded_normal(5, F.col("series_id"), F.unix_timestamp("ts")) * 20, 4)))
    long = baselines.to_long(t, [*MODELS, "published"], "x")
    return scoring.scores(baselines.on_scored_rows(long, scored, ("published",)), "series_id", "model")


@query
def same_rows_check(spark, d):
    pred = _pred(spark, d).filter(~((F.col("model") == "yesterday") & (F.hour("ts") == 3)))
    actual = base.clean(spark, d).filter(F.col("ts") >= F.lit("2024-01-11").cast("timestamp"))
    return scoring.same_rows(actual, pred)


@query
def wide_predictions(spark, d):
    actual = base.clean(spark, d).withColumnRenamed("x", "y").filter(F.col("ts") >= F.lit("2024-01-09").cast("timestamp"))
    return tables.wide_predictions(_pred(spark, d), actual, MODELS)


@query
def scores_by_hour(spark, d):
    return scoring.mae_by_hour(_pred(spark, d), MODELS)


@query
def worst_days(spark, d):
    return scoring.worst_days(_pred(spark, d), 3)


@query
def best_model(spark, d):
    return scoring.best_and_gap(scoring.scores(_pred(spark, d), "model"), *MODELS)


def _daily_pred(spark, d):
    t = baselines.demand_baselines(base.daily_orders(spark, d), day=1)
    test = folds.assign_folds(t, _folds(t)).filter("role = 'test'")
    long = test.select("series_id", "ts", "fold", "test_start", F.col("x").alias("y"), *MODELS)
    return long.unpivot(["series_id", "ts", "fold", "test_start", "y"], MODELS, "model", "pred")


@query
def backtest(spark, d):
    return scoring.backtest_scores(_daily_pred(spark, d))


@query
def backtest_summary(spark, d):
    return scoring.backtest_summary(scoring.backtest_scores(_daily_pred(spark, d)))


def _moded(spark, d):
    """The same forecast with and without a seeded gain, as two modes."""
    p = _daily_pred(spark, d).filter("model = 'yesterday'")
    gain = F.col("pred") + (F.col("y") - F.col("pred")) * 0.1 * F.pmod(F.col("fold"), F.lit(3))
    return p.withColumn("mode", F.lit("none")).unionByName(p.withColumn("pred", gain).withColumn("mode", F.lit("noisy")))


@query
def mode_comparison(spark, d):
    return scoring.against(scoring.scores(_moded(spark, d), "mode"), "mode", "none")


@query
def weighting_comparison(spark, d):
    """One forecast driven by the temperature of each weighting, against the box's."""
    warm = geo.weighted_series(base.grid(spark, d), geo.checked_weights(_weights(spark)))
    rows = base.clean(spark, d).join(warm, "ts").select(F.concat_ws("|", "kind", "series_id").alias("series_id"), "kind", "ts", "x", "t2m")
    pred = rows.withColumn("pred", features.lag("x", 24) + (F.col("t2m") - features.lag("t2m", 24)) * 3).filter(F.col("ts") >= F.lit(SCORED_FROM).cast("timestamp"))
    return scoring.against(scoring.scores(pred.withColumn("y", F.col("x")), "kind").select("kind", "n", "mae"), "kind", "box")


@query
def fold_delta(spark, d):
    tidy = _moded(spark, d).groupBy("fold", "test_start", "model", "mode").agg(scoring.mae().alias("mae"))
    return scoring.fold_delta(tidy, "none", "noisy")


@query
def fold_delta_summary(spark, d):
    tidy = _moded(spark, d).groupBy("fold", "test_start", "model", "mode").agg(scoring.mae().alias("mae"))
    return scoring.delta_summary(scoring.fold_delta(tidy, "none", "noisy"))


@query
def seed_spread(spark, d):
    seeds = spark.range(10).withColumnRenamed("id", "seed")
    rows = base.clean(spark, d).crossJoin(seeds)
    p = rows.select("seed", F.col("x").alias("y"), (F.col("x") + features.seeded_normal(F.col("seed"), F.col("series_id"), F.unix_timestamp("ts"))).alias("pred"))
    return scoring.seed_spread(scoring.scores(p, "seed"))


@query
def monthly_modes(spark, d):
    m = _moded(spark, d).withColumn("model", F.col("mode"))
    return scoring.monthly_delta(m, "none", "noisy")


@query
def bias_by_period(spark, d):
    p = _daily_pred(spark, d)
    periods = p.select(F.year("ts").alias("y")).distinct().select(F.col("y").cast("string").alias("period"), F.make_timestamp("y", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("lo"), F.make_timestamp(F.col("y") + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("hi"))
    return scoring.bias_by_period(p, periods, MODELS)


@query
def error_cube(spark, d):
    """Errors by month, weekday, fold, fold and month, and over all, from one pass."""
    ts = F.col("ts")
    slices = {"month": {"m": F.month(ts)}, "weekday": {"d": F.weekday(ts)}, "fold": {"f": F.col("fold")}, "fold_month": {"f": F.col("fold"), "m": F.month(ts)}, "all": {}}
    return scoring.error_cube(_daily_pred(spark, d), slices)


@query
def temperature_bins(spark, d):
    return scoring.binned_mean(base.with_temperature(base.clean(spark, d)), "temp", "x", 30)


@query
def first_week(spark, d):
    return scoring.local_slice(base.clean(spark, d), 7)


@query
def autocorrelation(spark, d):
    return scoring.autocorrelation(base.clean(spark, d), "x")


@query
def daily_correlation(spark, d):
    return scoring.daily_correlation(base.with_temperature(base.clean(spark, d)), "x", "temp")


@query
def degree_hour_shares(spark, d):
    hdh, cdh = cal.degree_hours(F.col("temp"))
    return scoring.active_shares(base.with_temperature(base.clean(spark, d)).withColumns({"hdh": hdh, "cdh": cdh}), "hdh", "cdh")


# ---- audit and models ----------------------------------------------------------------------


def _history(t):
    return t.withColumns(features.history_columns("x"))


HISTORY = ["lag_24h", "lag_48h", "lag_72h", "lag_168h", "lag_336h", "roll_mean_24h", "roll_mean_168h", "roll_std_24h", "same_hour_3wk_mean"]


@query
def leakage_audit(spark, d):
    return audit.audit(base.clean(spark, d), _history, "x", "2024-01-05 06:00:00", 50000.0, HISTORY)


@query
def reacting_columns(spark, d):
    t = base.with_temperature(base.clean(spark, d))
    before, after = _history(t), _history(audit.poke(t, "x", "2024-01-05 06:00:00", 50000.0))
    reacting = audit.reacting_columns(before, after, [*HISTORY, "temp"])
    return reacting.join(audit.dependency_check(reacting, [*HISTORY, "kt_yesterday"]), "column", "full")


@query
def lookback_profile(spark, d):
    """How far back each feature of the days reads, and one that is too late to be right."""

    def build(t):
        rows = t.withColumns({f"lag_{k}": features.lag("x", k) for k in DAY_LAGS})
        return rows.withColumn("mean_7", features.rolling_mean("x", 7, 1)).withColumn("own", F.col("x")).withColumn("none", F.dayofweek("ts"))

    return audit.lookback_profile(base.daily_orders(spark, d), build, "x", [*(f"lag_{k}" for k in DAY_LAGS), "mean_7", "own", "none"], 64, 1e7, 86400)


def _daily_features(spark, d):
    """Features of days with each fold's roles, written once: fits read them many times."""
    rows, fold_table, columns, _ = _model_rows(spark, d)
    return stage(folds.assign_folds(rows, fold_table), "daily-roles"), columns


@query
def scaler(spark, d):
    rows, columns = _daily_features(spark, d)
    return models.scaler(rows.filter("role = 'train'"), columns, ["series_id", "fold"])


@query
def standardised(spark, d):
    """Features of every fold standardised by its training rows, and how far they are off when taken back."""
    rows, columns = _daily_features(spark, d)
    fitted = models.scaler(rows.filter("role = 'train'"), columns, ["series_id", "fold"])
    named = rows.withColumns({f"was_{c}": F.col(c) for c in columns})
    z = models.standardise(named, fitted, columns, ["series_id", "fold"]).withColumns({f"z_{c}": F.col(c) for c in columns})
    back = models.unstandardise(z, fitted, columns, ["series_id", "fold"])
    same = F.greatest(*[F.max(F.abs(F.col(c) - F.col(f"was_{c}"))) for c in columns]) < 1e-3
    return back.groupBy("series_id", "fold", "role").agg(*[F.round(F.avg(f"z_{c}"), 4).alias(f"mean_{c}") for c in columns], same.alias("taken_back"))


def _model_rows(spark, d):
    """Days with their features, the folds, the features' names, and the days themselves; tables that are read again are staged."""
    t = stage(base.daily_orders(spark, d), "days")
    columns = [*(f"lag_{k}" for k in DAY_LAGS), "mean_7"]
    rows = t.withColumns({f"lag_{k}": features.lag("x", k) for k in DAY_LAGS}).withColumn("mean_7", features.rolling_mean("x", 7, 1)).dropna()
    return stage(rows, "daily-features"), stage(_folds(t), "fold-table"), columns, t


@query
def ridge_moments(spark, d):
    """Sums of products of each block of time between fold boundaries, as the fits take them."""
    rows, fold_table, columns, _ = _model_rows(spark, d)
    bounds = models.boundaries(fold_table)
    packed = models.ridge_moments(rows, bounds, columns, "x")
    p = len(columns) + 2

    def sums(pdf):
        out = []
        for series, block, raw, shift in zip(pdf["series_id"], pdf["block"], pdf["packed"], pdf["shift"], strict=True):
            s, a = np.frombuffer(raw).reshape(p, p), np.asarray(shift)
            n = s[0, 0]
            first = s[0, 1:] + n * a
            out.append([series, block, int(n), *(first / n), *((np.diag(s)[1:] + 2 * a * s[0, 1:] + n * a * a) / n), *((s[1:-1, -1] + a[:-1] * s[0, -1] + a[-1] * s[0, 1:-1] + n * a[:-1] * a[-1]) / n)])
        return pd.DataFrame(out, columns=names)

    names = ["series_id", "block", "n", *(f"mean_{c}" for c in [*columns, "x"]), *(f"square_{c}" for c in [*columns, "x"]), *(f"with_{c}" for c in columns)]
    got = packed.groupBy("series_id").applyInPandas(sums, ", ".join(f"{c} {'string' if c == 'series_id' else 'long' if c in ('block', 'n') else 'double'}" for c in names))
    return got.select("series_id", "block", "n", *[_figures(c, 6).alias(c) for c in names[3:]])


def _figures(c: str, digits: int):
    """A number to so many significant figures: large sums agree to a share of their size, not to a decimal place."""
    scale = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(c))))
    return F.when(F.col(c) == 0, F.lit("0")).otherwise(F.concat_ws("|", F.round(F.col(c) * scale).cast("long"), F.floor(F.log10(F.abs(c))).cast("long")))


@query
def linear_predictions(spark, d):
    """Predictions by given coefficients, clipped at 0."""
    rows, _, columns, _ = _model_rows(spark, d)
    given = rows.select("series_id").distinct().select("series_id", (F.length("series_id") * 10.0).alias("intercept"), F.array(*[F.lit(w) for w in (0.4137, -0.2091, 0.1073, 0.2969, 0.1531, 0.2473)]).alias("coef"), F.lit(1.0).alias("alpha"))
    return models.predict_linear(rows, given, columns, ["series_id"], least=0.0).select("series_id", "ts", F.round("pred", 2).alias("pred"))


@query
def ridge_backtest(spark, d):
    rows, fold_table, columns, _ = _model_rows(spark, d)
    fitted = models.fit_ridge_folds(rows, fold_table, columns, "x")
    pred = models.predict_linear(folds.assign_folds(rows, fold_table).filter("role = 'test'"), fitted, columns, ["series_id", "fold"], least=0.0)
    return pred.groupBy("series_id", "fold", "alpha").agg(F.avg(F.abs(F.col("pred") - F.col("x"))).alias("mae"), F.count(F.lit(1)).alias("n"))


@query
def gbm_backtest(spark, d):
    rows, columns = _daily_features(spark, d)
    out = None
    for fold in sorted(r["fold"] for r in _folds(base.daily_orders(spark, d)).select("fold").collect()):
        model, _ = models.fit_gbm(rows, columns, "x", fold)
        pred = models.predict_trees(rows.filter((F.col("role") == "test") & (F.col("fold") == fold)), model, columns, least=0.0)
        out = pred if out is None else out.unionByName(pred)
    out = rows.limit(0).withColumn("pred", F.lit(0.0)) if out is None else out
    return out.groupBy("series_id", "fold").agg(F.avg(F.abs(F.col("pred") - F.col("x"))).alias("mae"), F.count(F.lit(1)).alias("n"))


def _scored_beside(days, fold_table, fitted):
    """Long predictions of baselines and a published forecast on the folds' test rows beside fitted ones, and the rows themselves."""
    based = baselines.demand_baselines(days, day=1)
    published = F.when(~((F.length("series_id") % 2 == 0) & (F.dayofmonth("ts") == 7)), F.round(F.col("x") + features.seeded_normal(5, F.col("series_id"), F.unix_timestamp("ts")) * 20, 4))
    test = stage(folds.assign_folds(based.withColumn("published", published), fold_table).filter("role = 'test'"), "test-rows")
    names = [*MODELS, "published"]
    plain = test.select("series_id", "ts", "fold", "test_start", F.col("x").alias("y"), *names).unpivot(["series_id", "ts", "fold", "test_start", "y"], names, "model", "pred")
    actual = test.select("series_id", "ts", "fold", "test_start", F.col("x").alias("y"))
    return baselines.without_holes(plain, ("published",)).unionByName(fitted), actual


@query
def models_scored(spark, d):
    """Fitted models, baselines and a published forecast on the same test rows of every fold: a table as the last step of a run.

    A published forecast with a hole leaves a series; models that are scored on other rows fail the table.
    """
    rows, fold_table, columns, days = _model_rows(spark, d)
    fitted = models.forecasts(rows, fold_table, columns, "x", {"ridge": models.ridge_forecast, "gbm": models.gbm_forecast}, least=0.0)
    pred, actual = _scored_beside(days, fold_table, fitted)
    return scoring.score_table(pred, "seasonal_naive", ("series_id", "fold"), actual)


@query
def gbm_pooled_scores(spark, d):
    """One boosted model a fold over all series, the whole grid, beside the baselines on the same test rows."""
    rows, fold_table, columns, days = _model_rows(spark, d)
    fitted = models.forecasts(rows, fold_table, columns, "x", {"gbm_pooled": models.pooled_forecast}, least=0.0)
    pred, actual = _scored_beside(days, fold_table, fitted)
    return scoring.score_table(pred.filter("model <> 'published'"), "seasonal_naive", ("fold",), actual)


def _demand_modes(spark, d):
    """Ridge on the days' own features and on the temperature as each mode knows it, on the test rows of every fold."""
    _, fold_table, columns, days = _model_rows(spark, d)
    warm = base.with_temperature(days)

    def build(mode):
        t = features.usable_temperature("temp", mode, seed=3, day=1)
        rows = warm.withColumns({f"lag_{k}": features.lag("x", k) for k in DAY_LAGS}).withColumn("mean_7", features.rolling_mean("x", 7, 1))
        if t is None:
            return rows.select("series_id", "ts", "x", *columns).dropna(), columns
        hdh, cdh = cal.degree_hours(F.col("temp_c"))
        rows = rows.withColumn("temp_c", t).withColumns({"hdh": hdh, "cdh": cdh, "change": F.col("temp_c") - features.lag("temp_c", 1)})
        mine = [*columns, "temp_c", "hdh", "cdh", "change"]
        return rows.select("series_id", "ts", "x", *mine).dropna(), mine

    return ablation.mode_forecasts(features.MODES, build, fold_table, "x", models.ridge_forecast)


@query
def demand_mode_scores(spark, d):
    """What each way of knowing the temperature is worth to a fitted model, by fold and against none, on the same rows."""
    return ablation.mode_table(_demand_modes(spark, d), "none")


@query
def demand_mode_folds(spark, d):
    """Fold by fold, the fitted model's error under perfect weather less that without."""
    tidy = ablation.tidy_modes(_demand_modes(spark, d))
    return scoring.fold_delta(tidy, "none", "perfect").join(scoring.delta_summary(scoring.fold_delta(tidy, "none", "perfect")), "model")


@query
def solar_mode_scores(spark, d):
    """Ridge on each mode's solar features with and without the production record, on the same daylight rows."""
    t = stage(_solar_table(spark, d), "solar")
    fold_table = spark.createDataFrame([(1, "2024-01-16", "2024-01-22", "2024-02-01")], "fold int, a string, b string, c string").select("fold", *[F.col(c).cast("timestamp").alias(n) for c, n in zip("abc", ("val_start", "test_start", "test_end"), strict=True)])
    out = None
    for record in (True, False):

        def build(mode, record=record):
            rows = features.solar_features(t, "cf", mode, "temp")
            columns = [c for c in features.solar_columns(mode) if record or c not in features.solar_history_columns(mode)]
            return folds.daylight_rows(rows, t), columns

        got = ablation.mode_table(ablation.mode_forecasts(features.SOLAR_MODES, build, fold_table, "cf", models.ridge_forecast, least=0.0), "none").withColumn("record", F.lit(record))
        out = got if out is None else out.unionByName(got)
    return out
