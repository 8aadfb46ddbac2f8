"""Invariants of operators on small frames."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import calendar_cols as cal
from tideline.functions import solar
from tideline.operators import audit, baselines, features, folds, geo, models, scale, scoring, series
from tideline import sources


def hours(spark, n, start="2019-01-01 00:00:00", name="a"):
    t0 = F.lit(start).cast("timestamp")
    return spark.range(n).select(F.lit(name).alias("series_id"), F.timestamp_seconds(F.unix_timestamp(t0) + F.col("id") * 3600).alias("ts"), F.col("id"))


def test_densify_crosses_years_and_keeps_steps(spark):
    df = spark.createDataFrame([("a", dt.datetime(2019, 12, 31, 21, 30), 1.0), ("a", dt.datetime(2020, 1, 1, 2, 30), 2.0), ("b", dt.datetime(2020, 1, 1), 3.0)], "series_id string, ts timestamp, x double")
    got = series.densify(df).orderBy("series_id", "ts").collect()
    assert [r["ts"].hour for r in got if r["series_id"] == "a"] == [21, 22, 23, 0, 1, 2]
    assert sum(r["x"] is not None for r in got) == 3
    assert series.densify(df.limit(0)).count() == 0


def test_fill_is_forward_then_leading_back(spark):
    h = hours(spark, 6).withColumn("x", F.when(F.col("id").isin(1, 4), F.col("id").cast("double")))
    assert [r["x"] for r in series.fill_gaps(h, "x").orderBy("ts").collect()] == [1, 1, 1, 1, 4, 4]
    assert [r["x"] for r in scale.carry_in_fill(h, "x", 2).orderBy("ts").collect()] == [1, 1, 1, 1, 4, 4]


def test_interpolation_stops_after_the_limit(spark):
    h = hours(spark, 11).withColumn("x", F.when(F.col("id").isin(0, 10), F.col("id").cast("double")))
    assert [r["x"] for r in series.interpolate_gaps(h, "x", 6).orderBy("ts").collect()] == [0, 1, 2, 3, 4, 5, 6, 6, 6, 6, 10]


@pytest.mark.parametrize("window,least", [(5, 1), (7, 3), (24, 24)])
def test_trailing_max_is_the_direct_frame(spark, window, least):
    h = hours(spark, 200).withColumn("x", F.when(F.col("id") % 5 != 2, (F.col("id") * 7919 % 101).cast("double")))
    frame = series.by_series().rowsBetween(-window + 1, 0)
    direct = h.withColumn("m", F.when(F.count("x").over(frame) >= least, F.max("x").over(frame)))
    a = [r["m"] for r in direct.orderBy("ts").collect()]
    b = [r["m"] for r in scale.trailing_max(h, "x", window, least, "m").orderBy("ts").collect()]
    assert a == b


def test_mask_keeps_the_known_area(spark):
    cells = geo.inside_outline(geo.box_cells(spark), geo.outline_edges(spark))
    got = geo.kept_area(cells).first()
    assert got["n_cells"] == 740 and round(got["km2"]) == 357451
    known = {(r["lat"], r["lon"]): r["inside"] for r in cells.collect()}
    assert known[52.5, 13.5] and known[48.25, 11.5] and not known[54.5, 6.5] and not known[52.5, 15.25]


def test_constant_field_and_empty_mask(spark):
    cells = geo.box_cells(spark)
    w = geo.grid_weights(cells, geo.outline_edges(spark), geo.state_table(spark))
    grid = hours(spark, 2).select("ts").crossJoin(cells).withColumn("t2m", F.lit(7.5))
    assert all(abs(r["t2m"] - 7.5) < 1e-9 for r in geo.weighted_series(grid, w).collect())
    with pytest.raises(Exception, match="weights sum to zero"):
        geo.checked_weights(w.withColumn("w", F.lit(0.0))).collect()


def test_bilinear_is_exact_on_a_plane_and_refuses_outside(spark):
    cells = geo.box_cells(spark, (50.0, 50.5), (9.0, 9.5), 0.25)
    grid = hours(spark, 3).select("ts", "id").crossJoin(cells).withColumn("t2m", F.col("lat") * 2 + F.col("lon") * 3 + F.col("id"))
    points = spark.createDataFrame([(1, 50.1, 9.4), (2, 49.0, 9.25), (3, 50.5, 9.5)], "point_id int, plat double, plon double")
    got = geo.series_at_points(grid, geo.point_corners(points, (50.0, 50.5), (9.0, 9.5), 0.25)).orderBy("point_id", "ts").collect()
    assert [round(r["t2m"], 9) for r in got] == [128.4, 129.4, 130.4, 129.5, 130.5, 131.5]
    assert [r["point_id"] for r in geo.outside_points(points, (50.0, 50.5), (9.0, 9.5)).collect()] == [2]


def test_sun_against_known_figures(spark):
    site = spark.createDataFrame([(52.52, 13.40)], "lat double, lon double")
    year = solar.with_sun(hours(spark, 8760).select("ts").crossJoin(site)).agg(F.max("declination").alias("hi"), F.min("declination").alias("lo"), F.max("eot_minutes").alias("e"), F.min("eot_minutes").alias("f"), F.avg((F.col("zenith") < 90).cast("int")).alias("light")).first()
    assert abs(year["hi"] - 23.44) < 0.05 and abs(year["lo"] + 23.44) < 0.05
    assert 15 < year["e"] < 17 and -15 < year["f"] < -13 and 0.45 < year["light"] < 0.6
    day = spark.range(240).select(F.timestamp_seconds(F.unix_timestamp(F.lit("2019-06-21 09:00:00").cast("timestamp")) + F.col("id") * 60).alias("ts")).crossJoin(site)
    noon = solar.with_sun(day).orderBy(F.desc("elevation")).first()
    assert abs(noon["elevation"] - 60.92) < 0.3 and abs(noon["azimuth"] - 180) < 0.5 and 45 < (dt.datetime(2019, 6, 21, 12) - noon["ts"]).seconds / 60 < 62


def test_clear_sky_identities(spark):
    site = spark.createDataFrame([(51.2, 10.4)], "lat double, lon double")
    t = hours(spark, 8760).select("ts").crossJoin(site)
    flat = solar.clear_sky(t, tilt=0.0)
    assert flat.filter(F.abs(F.col("cs_poa") - F.col("cs_ghi")) > 1e-6).count() == 0
    assert flat.filter(F.col("cs_dni") * F.cos(F.radians("zenith")) > F.col("cs_ghi") + 1e-6).count() == 0
    got = solar.clear_sky(t).agg(F.max("cs_ghi").alias("peak"), (F.sum("cs_poa") / F.sum("cs_ghi")).alias("gain")).first()
    assert 800 < got["peak"] < 1000 and 1.1 < got["gain"] < 1.4


def test_fleet_azimuth_is_circular(spark):
    sites = spark.createDataFrame([("w", 51.0, 6.0, 1.0), ("e", 51.0, 15.0, 1.0)], "site_id string, lat double, lon double, share double")
    t = hours(spark, 48, "2015-09-30 00:00:00").select("ts")
    fleet = {r["ts"]: r["azimuth"] for r in solar.fleet_clear_sky(sites, t).collect()}
    each = solar.with_sun(t.crossJoin(sites)).collect()
    worst = 0.0
    for ts, got in fleet.items():
        az = [math.radians(r["azimuth"]) for r in each if r["ts"] == ts]
        want = math.degrees(math.atan2(sum(map(math.sin, az)), sum(map(math.cos, az)))) % 360
        assert abs((got - want + 180) % 360 - 180) < 1e-9
        worst = max(worst, abs((math.degrees(sum(az) / 2) - want + 180) % 360 - 180))
    assert worst > 10


def test_scalar_figures(spark):
    one = spark.range(1).select(solar.temperature_derate(F.lit(25.0)).alias("a"), solar.cell_temperature(F.lit(25.0), F.lit(1000.0)).alias("b"), *[c.alias(n) for n, c in zip("cd", cal.degree_hours(F.lit(-5.0)), strict=True)], *[c.alias(n) for n, c in zip("ef", cal.degree_hours(F.lit(30.0)), strict=True)], cal.degree_hours(F.lit(None).cast("double"))[0].alias("g"), solar.clear_sky_index(F.lit(5.0), F.lit(1.0)).alias("h"), solar.clear_sky_index(F.lit(5.0), F.lit(0.0)).alias("i")).first()
    assert tuple(one) == (1.0, 56.25, 20.0, 0.0, 0.0, 8.0, None, 2.0, None)


def test_holidays_by_rule():
    known = {"2015-04-03", "2016-05-16", "2017-10-31", "2018-05-10", "2019-06-10", "2020-04-13", "2020-12-26"}
    days = {d.isoformat() for d in cal.german_holidays(2015, 2020)}
    assert known <= days and len(days) == 55


def test_calendar_is_local(spark):
    df = spark.createDataFrame([(dt.datetime(2018, 12, 31, 23),), (dt.datetime(2019, 3, 31, 1),), (dt.datetime(2019, 10, 27, 0),), (dt.datetime(2019, 10, 27, 1),)], "ts timestamp")
    got = cal.with_holiday(df.withColumns(cal.local_calendar(F.col("ts"))), cal.holiday_table(spark, 2018, 2019)).orderBy("ts").collect()
    assert (got[0]["hour"], got[0]["is_holiday"]) == (0, 1)
    assert [r["hour"] for r in got[1:]] == [3, 2, 2]


def test_feature_tables_have_their_columns(spark):
    h = hours(spark, 700).withColumn("x", F.col("id") % 24 + 0.5).withColumn("temp", F.lit(10.0))
    holidays = cal.holiday_table(spark, 2018, 2020)
    plain, warm = features.demand_features(h, holidays), features.demand_features(h, holidays, temp="temp", mode="noisy", seed=1)
    assert len(plain.columns) == 3 + 20 and len(warm.columns) == 3 + 25 and plain.count() == 700 - 504
    with pytest.raises(ValueError):
        features.demand_features(h, holidays, mode="perfect")
    for mode, n in (("none", 12), ("clearsky", 17), ("perfect", 22)):
        assert len(features.solar_columns(mode)) == n


def test_noise_depends_on_key_alone(spark):
    h = hours(spark, 3000).select("series_id", "ts", features.seeded_normal(4, F.col("series_id"), F.unix_timestamp("ts")).alias("z"))
    a = {r["ts"]: r["z"] for r in h.collect()}
    assert a == {r["ts"]: r["z"] for r in h.repartition(7).collect()}
    z = np.array(list(a.values()))
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05


def test_leakage_is_found_when_it_is_there(spark):
    h = hours(spark, 400).withColumn("x", F.col("id").cast("double"))
    good = audit.audit(h, lambda t: t.withColumn("f", features.lag("x", 24)), "x", "2019-01-05 00:00:00", 5.0, ["f"]).first()
    bad = audit.audit(h, lambda t: t.withColumn("f", features.lag("x", 2)), "x", "2019-01-05 00:00:00", 5.0, ["f"]).first()
    assert (good["too_soon"], good["allowed"]) == (0, 1) and bad["too_soon"] == 1


def test_split_and_fold_edges(spark):
    h = hours(spark, 24 * 800).withColumn("x", F.lit(1.0))
    s = folds.chronological_split(h, "2019-06-01", "2020-01-01")
    folds.check_split(s)
    with pytest.raises(ValueError):
        folds.check_split(folds.chronological_split(h, "2010-01-01", "2020-01-01"))
    f = folds.backtest_folds(h, "2020-01-01").orderBy("fold").collect()
    assert [r["test_start"].isoformat()[:10] for r in f] == ["2020-01-01", "2020-07-01", "2021-01-01"]
    assert f[-1]["test_end"] == dt.datetime(2021, 3, 11, 0)


def test_same_rows_fails_on_a_mismatch(spark):
    h = hours(spark, 5)
    actual, pred = h, h.withColumn("model", F.lit("m")).withColumn("pred", F.lit(1.0))
    assert tuple(scoring.same_rows(actual, pred).first())[2:] == (0, 0, 0)
    assert tuple(scoring.same_rows(actual, pred.filter("id <> 2")).first())[2:] == (1, 0, 0)
    assert tuple(scoring.same_rows(actual.filter("id <> 2"), pred).first())[2:] == (0, 1, 0)


def test_published_forecast_with_a_hole_is_left_out(spark):
    h = hours(spark, 4).unionByName(hours(spark, 4, name="b"))
    pred = h.withColumn("model", F.lit("published")).withColumn("y", F.lit(1.0)).withColumn("pred", F.when(~((F.col("series_id") == "a") & (F.col("id") == 2)), 1.0))
    assert {r["series_id"] for r in baselines.on_scored_rows(pred, h, ("published",)).collect()} == {"b"}


def test_skill(spark):
    df = spark.createDataFrame([(10.0, "self", 10.0), (20.0, "self", 20.0), (10.0, "base", 12.0), (20.0, "base", 18.0)], "y double, model string, pred double")
    got = {r["model"]: r["skill"] for r in scoring.score_table(df, "base").collect()}
    assert got == {"self": 1.0, "base": 0.0}


def test_ridge_is_the_closed_form(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((300, 3)) * [1, 50, 0.1] + [0, 1e4, 5]
    y = x @ [2.0, -0.3, 4.0] + 7 + r.standard_normal(300)
    role = np.where(np.arange(300) < 200, "train", np.where(np.arange(300) < 250, "validation", "test"))
    pdf = pd.DataFrame(x, columns=["p", "q", "r"]).assign(x=y, role=role, series_id="a", fold=np.int32(1), ts=pd.Timestamp("2019-01-01"))
    df = spark.createDataFrame(pdf).withColumn("fold", F.col("fold").cast("int"))
    got = models.fit_ridge(df, ["p", "q", "r"], "x").first()

    def closed(rows, alpha):
        m, s = x[rows].mean(0), x[rows].std(0)
        z = (x[rows] - m) / s
        w = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y[rows] - y[rows].mean())) / s
        return w, y[rows].mean() - w @ m

    def loss(alpha):
        w, b = closed(role == "train", alpha)
        return np.abs(x[role == "validation"] @ w + b - y[role == "validation"]).mean()

    best = min(models.ALPHAS, key=loss)
    w, b = closed(role != "test", best)
    assert got["alpha"] == best and np.allclose(got["coef"], w, rtol=1e-6) and abs(got["intercept"] - b) < 1e-3


def test_tuning_takes_the_first_of_equals():
    assert models.tune(((1, "a"), (2, "b"), (3, "c")), lambda c: c, lambda c: {1: 2.0, 2: 1.0, 3: 1.0}[c[0]]) == (2, "b")


def test_sources_round_trip(spark, tmp_path):
    wide = hours(spark, 30).select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("utc_timestamp"), F.col("id").cast("double").alias("LOAD"), F.lit("junk").alias("other"))
    wide.coalesce(1).write.option("header", True).csv(str(tmp_path / "raw"))
    got = sources.read_wide_csv(spark, str(tmp_path / "raw"), {"LOAD": "load_mw"})
    assert got.columns == ["ts", "load_mw"] and got.agg(F.sum("load_mw")).first()[0] == 435
    sources.write_extract(got, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).filter("year = 2019").count() == 30
    for k, start in ((0, "2019-12-31 00:00:00"), (1, "2020-01-01 00:00:00")):
        cells = geo.box_cells(spark, (54.0, 55.0), (5.5, 6.5), 0.25)
        hours(spark, 36, start).crossJoin(cells).select(F.col("ts").alias("valid_time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), (F.lit(273.15) + F.col("id") + k).alias("t2m"), F.lit(f"y{k}").alias("source_file")).write.parquet(str(tmp_path / f"grid{k}"))
    grid = sources.read_grid(spark, [str(tmp_path / "grid0"), str(tmp_path / "grid1")])
    first = sources.drop_seam_duplicates(grid, ["ts", "lat", "lon"])
    mean = geo.box_mean(first).orderBy("ts").collect()
    assert len(mean) == 60 and [round(r["t2m"], 6) for r in mean] == [*map(float, range(36)), *[float(i + 1) for i in range(12, 36)]]
    assert sources.seam_duplicates(grid, ["ts", "lat", "lon"]).first()["n_duplicates"] == 12 * 25


def test_hourly_stream(spark, tmp_path):
    from tideline.streaming import hourly_stream

    spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 10), "a", 1.0), (dt.datetime(2024, 1, 1, 0, 50), "a", 2.0), (dt.datetime(2024, 1, 1, 9), "a", 4.0)], "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = hourly_stream(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("hourly_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r["ts"].hour, r["x"]) for r in spark.table("hourly_out").collect()} == {(0, 3.0), (9, 4.0)}


def test_gbm_backtest_fits_all_folds_with_the_whole_grid(spark, monkeypatch):
    from tideline.plans import queries

    fit, seen = models.fit_gbm, []

    def small(rows, columns, target, fold, **cut):
        seen.append((fold, cut))
        return fit(rows, columns, target, fold, grid=((0.1, 2),), max_depth=2)

    monkeypatch.setattr(queries.models, "fit_gbm", small)
    d = "/root/testdata/sf0.001"
    got = {(r["series_id"], r["fold"]): r["n"] for r in queries.QUERIES["gbm_backtest"](spark, d).collect()}
    want = {(r["series_id"], r["fold"]): r["n"] for r in queries.QUERIES["ridge_backtest"](spark, d).collect()}
    assert seen == [(f, {}) for f in sorted({f for _, f in want})] and len(seen) > 1
    assert got == want


def test_score_tables_refuse_other_rows(spark):
    rows = [(1.0, "a", 1.5), (2.0, "a", 2.5), (1.0, "b", 1.0), (2.0, "b", None)]
    pred = spark.createDataFrame(rows, "y double, model string, pred double").withColumns({"series_id": F.lit("s"), "ts": F.lit("2019-01-01").cast("timestamp"), "fold": F.lit(1), "test_start": F.lit("2019-01-01").cast("timestamp")})
    capacity = pred.select("series_id", "ts", F.lit(5.0).alias("capacity_mw")).distinct()
    for part in (pred, pred.dropna()):  # a value is missing, a row is missing
        for table in (scoring.score_table(part, "a"), scoring.solar_score_table(part, capacity, "a"), scoring.backtest_scores(part)):
            with pytest.raises(Exception, match="different rows"):
                table.collect()
    whole = pred.fillna(3.0, "pred")
    assert scoring.backtest_scores(whole).count() == 2


def test_normalised_error_is_a_share_of_rated_capacity(spark):
    pred = spark.createDataFrame([("s", 0.1, "a", 0.2), ("s", 0.3, "a", 0.1)], "series_id string, y double, model string, pred double").withColumn("ts", F.lit("2019-01-01").cast("timestamp"))
    got = scoring.solar_score_table(pred, pred.select("series_id", "ts", F.lit(50.0).alias("capacity_mw")).distinct(), "a").first()
    want = math.sqrt((0.1**2 + 0.2**2) / 2)
    assert abs(got["rmse"] - want) < 1e-12 and abs(got["nrmse"] - 100 * want) < 1e-9 and abs(got["mae_mw"] - 0.15 * 50) < 1e-9


def test_local_slice_from_a_day(spark):
    h = hours(spark, 24 * 10)
    got = scoring.local_slice(h, 2, "2019-01-04").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    assert (got["lo"], got["hi"]) == (dt.datetime(2019, 1, 3, 23), dt.datetime(2019, 1, 5, 22))


def test_fill_back_is_the_direct_frame(spark):
    h = hours(spark, 300).withColumn("x", F.when(F.col("id") % 37 == 5, F.col("id").cast("double")))
    direct = h.withColumn("m", F.first("x", ignorenulls=True).over(series.by_series().rowsBetween(0, 10**6)))
    assert [r["m"] for r in direct.orderBy("ts").collect()] == [r["x"] for r in scale.fill_back(h, "x", 24).orderBy("ts").collect()]


def test_trailing_max_of_series_that_begin_anywhere(spark):
    h = hours(spark, 90, "2019-01-01 05:00:00").unionByName(hours(spark, 40, "2019-01-02 17:00:00", "b")).withColumn("x", F.when(F.col("id") % 4 != 1, (F.col("id") * 7919 % 101).cast("double")))
    frame = series.by_series().rowsBetween(-29, 0)
    direct = h.withColumn("m", F.when(F.count("x").over(frame) >= 2, F.max("x").over(frame)))
    got = scale.trailing_max(h, "x", 30, 2, "m")
    assert [r["m"] for r in direct.orderBy("series_id", "ts").collect()] == [r["m"] for r in got.orderBy("series_id", "ts").collect()]


def boosted_rows(spark, n=900):
    r = np.random.default_rng(1)
    x = r.standard_normal((n, 3))
    y = np.sin(3 * x[:, 0]) + (x[:, 1] > 0) * 2 + r.standard_normal(n) * 0.1
    role = np.where(np.arange(n) < n * 0.6, "train", np.where(np.arange(n) < n * 0.8, "validation", "test"))
    pdf = pd.DataFrame(x, columns=["p", "q", "r"]).assign(x=y, role=role, series_id=np.where(np.arange(n) % 2, "a", "b"), fold=1, ts=pd.Timestamp("2019-01-01"))
    return spark.createDataFrame(pdf), pdf


def test_boosting_beats_the_mean_and_takes_the_first_of_equals(spark):
    df, pdf = boosted_rows(spark)
    model, best = models.fit_gbm(df, ["p", "q", "r"], "x", 1, grid=((0.1, 40), (0.1, 80), (0.2, 80)), max_depth=3)
    pred = models.predict_trees(df.filter("role = 'test'").withColumn("r", F.when(F.col("r") < 2, F.col("r"))), model, ["p", "q", "r"], least=0.0).toPandas()
    assert pred["pred"].isna().sum() == pred["r"].isna().sum() and (pred["pred"].dropna() >= 0).all()
    assert (pred["pred"] - pred["x"]).abs().mean() < 0.5 * (pdf["x"] - pdf["x"].mean()).abs().mean()
    assert {r["series_id"] for r in best.collect()} == {"a", "b"}
    from tideline.operators import boosting

    y = np.arange(200.0)
    flat = boosting.tune_and_fit(np.zeros((200, 1)), y, y > 150, ((0.1, 3), (0.2, 3)), 2)
    assert flat[0] == (0.1, 3) and np.allclose(flat[1].predict(np.zeros((2, 1))), y.mean())


def test_first_trees_of_a_longer_fit_are_those_of_a_shorter_one(spark):
    from tideline.operators import boosting

    _, pdf = boosted_rows(spark)
    x, y = pdf[["p", "q", "r"]].to_numpy(), pdf["x"].to_numpy()
    assert np.allclose(boosting.fit_trees(x, y, 0.1, 30).predict(x, 10), boosting.fit_trees(x, y, 0.1, 10).predict(x))


def test_pooled_model_and_ridge_by_blocks(spark):
    df, _ = boosted_rows(spark, 300)
    model, best = models.fit_gbm_pooled(df, ["p", "q", "r"], "x", 1, grid=((0.3, 3), (0.3, 5)), max_depth=2)
    assert best in ((0.3, 3), (0.3, 5)) and models.predict_pooled(df, model, ["p", "q", "r"], least=0.0).filter("pred < 0").count() == 0
    h = hours(spark, 24 * 800).withColumn("p", F.sin("id")).withColumn("x", F.col("p") * 3 + F.pmod(F.col("id") * 7919, F.lit(11)))
    fold_table = folds.backtest_folds(h, "2020-07-01")
    rows = h.select("series_id", "ts", "p", "x")
    one = {(r["fold"], r["alpha"]): r for r in models.fit_ridge_folds(rows, fold_table, ["p"], "x").collect()}
    two = {(r["fold"], r["alpha"]): r for r in models.fit_ridge(folds.assign_folds(rows, fold_table), ["p"], "x").collect()}
    assert set(one) == set(two) and all(np.allclose([*one[k]["coef"], one[k]["intercept"]], [*two[k]["coef"], two[k]["intercept"]]) for k in one)
