"""Same rows in score tables, joins on time, fields reduced where they are read, models on all folds."""

import bisect
import datetime as dt
import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_operators import boosted_rows, hours
from tideline import staging
from tideline.operators import ablation, folds, geo, joins, models, scoring, series
from tideline.plans import base, queries
from tideline.sources import tables

DAY = dt.datetime(2019, 1, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- same rows -----------------------------------------------------------------------------


def predictions(spark, rows):
    """rows: series, hour, y, model."""
    return spark.createDataFrame([(s, DAY + dt.timedelta(hours=h), float(y), m, y + 0.5, 1, DAY) for s, h, y, m in rows], "series_id string, ts timestamp, y double, model string, pred double, fold int, test_start timestamp")


BOTH = [(s, h, h + (s == "q"), m) for s in "pq" for h in range(3) for m in "ab"]
OTHER = {
    "other hours": [r if r[3] == "a" else (r[0], r[1] + 744, r[2], r[3]) for r in BOTH],
    "a key twice, another missing": [r if r[3] == "a" or r[1] != 2 else (r[0], 1, r[2] - 1, r[3]) for r in BOTH],
    "another y": [r if r[3:] != ("b",) or r[:2] != ("q", 1) else (*r[:2], 77, r[3]) for r in BOTH],
    "one series of two": [r if r[3] == "a" or r[0] == "p" else (r[0], r[1] + 1, r[2] + 1, r[3]) for r in BOTH],
    "rows of one series under another's name": [r if r[3] == "a" else ("q" if r[0] == "p" else "p", *r[1:]) for r in BOTH],
}


def all_tables(pred, actual=None):
    capacity = pred.select("series_id", "ts").distinct().withColumn("capacity_mw", F.lit(5.0))
    return [scoring.score_table(pred, "a", actual=actual), scoring.solar_score_table(pred, capacity, "a", actual=actual), scoring.backtest_scores(pred, actual)]


@pytest.mark.parametrize("case", sorted(OTHER))
def test_equal_counts_of_other_rows_fail(spark, case):
    for table in all_tables(predictions(spark, OTHER[case])):
        with pytest.raises(Exception, match="different rows"):
            table.collect()


def test_same_rows_pass_in_any_order_and_against_the_actual_ones(spark):
    pred = predictions(spark, BOTH).repartition(5, "pred")
    actual = pred.filter("model = 'a'").drop("model", "pred")
    assert [len(t.collect()) for t in all_tables(pred)] == [2, 2, 2]
    assert [len(t.collect()) for t in all_tables(pred, actual)] == [2, 2, 2]
    with_keys = scoring.score_table(pred, "a", ("series_id",), actual)
    assert [tuple(r) for r in with_keys.select("series_id", "model").collect()] == [("p", "a"), ("p", "b"), ("q", "a"), ("q", "b")]


def test_rows_that_all_models_lack_or_repeat_fail_against_the_actual_ones(spark):
    pred = predictions(spark, BOTH)
    actual = pred.filter("model = 'a'").drop("model", "pred")
    for wrong in (pred.filter("hour(ts) <> 1"), pred.unionByName(pred), pred.withColumn("y", F.col("y") + 1)):
        for table in all_tables(wrong, actual):
            with pytest.raises(Exception, match="different rows"):
                table.collect()
    with pytest.raises(Exception, match="different rows"):  # one series' models are gone altogether
        scoring.score_table(pred.filter("series_id = 'p'"), "a", ("series_id",), actual).collect()


def test_modes_must_share_their_rows(spark):
    pred = predictions(spark, BOTH).withColumn("mode", F.when(F.col("model") == "a", "none").otherwise("perfect"))
    assert ablation.mode_table(pred, "none").count() == 2 and ablation.tidy_modes(pred).count() == 2
    short = pred.filter("mode = 'none' or hour(ts) > 0")
    for table in (ablation.mode_table(short, "none"), ablation.tidy_modes(short)):
        with pytest.raises(Exception, match="different rows"):
            table.collect()


# ---- as of ---------------------------------------------------------------------------------


def brute_asof(left, right, backward, tolerance):
    out = []
    for s, t in left:
        mine = sorted({(u, min(v for q, w, v in right if (q, w) == (s, u))) for q, u, _ in right if q == s}) if t is not None else []
        times = [u for u, _ in mine]
        k = bisect.bisect_right(times, t) - 1 if backward else bisect.bisect_left(times, t)
        hit = mine[k] if mine and 0 <= k < len(mine) else None
        if hit and tolerance is not None and abs((t - hit[0]).total_seconds()) > tolerance:
            hit = None
        out.append((s, t, hit[1] if hit else None, hit[0] if hit else None))
    return out


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("tolerance", [None, 900.0])
def test_asof_join_at_any_stamps(spark, direction, tolerance):
    r = np.random.default_rng(5)
    at = lambda n: [DAY + dt.timedelta(seconds=int(s), microseconds=int(s) % 3) for s in r.integers(0, 90000, n)]
    left = [(s, t) for s in "abc" for t in at(60)] + [("a", None), ("d", DAY)] * 2
    right = [(s, t, float(v)) for s in "ab" for t, v in zip(at(70), r.integers(0, 50, 70), strict=True)]
    right += [("a", left[3][1], -1.0), ("a", left[3][1], -2.0), ("c", DAY + dt.timedelta(days=300), 9.0)]
    df = spark.createDataFrame(left, "series_id string, ts timestamp").withColumn("value_", F.lit(1))
    got = joins.asof_join(df.repartition(4), spark.createDataFrame([*right, ("a", None, 1.0)], "series_id string, ts timestamp, v double"), "v", direction=direction, tolerance_seconds=tolerance, at="found", chunk_seconds=7200)
    key = lambda r: (r[0], r[1] or DAY, str(r))
    assert sorted([(r["series_id"], r["ts"], r["v"], r["found"]) for r in got.collect()], key=key) == sorted(brute_asof(left, right, direction == "backward", tolerance), key=key)


def test_asof_cuts_a_long_series_into_tasks(spark):
    h = hours(spark, 100)
    text = plan_of(joins.asof_join(h.select("series_id", "ts"), h.select("series_id", "ts", F.col("id").alias("v")), "v"))
    assert "hashpartitioning(series_id#" in text and re.search(r"hashpartitioning\(series_id#\d+, _chunk#\d+", text)
    assert joins.asof_join(h.limit(0), h, "id").count() == 0 and joins.asof_join(h.select("series_id", "ts"), h.limit(0), "id").filter("id is null").count() == 100


def test_spread_keeps_figures_off_the_grid(spark):
    h = hours(spark, 48)
    daily = spark.createDataFrame([("a", DAY + dt.timedelta(hours=5, minutes=30), 1.0), ("a", DAY + dt.timedelta(hours=29, minutes=1), 2.0), ("a", DAY + dt.timedelta(hours=31), None)], "series_id string, ts timestamp, c double")
    assert [r["c"] for r in series.spread_daily(h, daily, "c").orderBy("ts").collect()] == [1.0] * 30 + [2.0] * 18


# ---- intervals -----------------------------------------------------------------------------


def test_thousands_of_overlapping_intervals(spark):
    r = np.random.default_rng(6)
    begin, long = r.integers(0, 10**6, 3000), 2 ** r.integers(0, 18, 3000) + r.integers(0, 3, 3000)
    points = r.integers(-100, 10**6 + 2**18, 2000)
    at = lambda c: F.timestamp_seconds(c)
    p = spark.createDataFrame(pd.DataFrame({"id": range(2000), "s": points})).select("id", at("s").alias("ts")).unionByName(spark.range(1).select("id", F.lit(None).cast("timestamp").alias("ts")))
    frame = pd.DataFrame({"k": range(3000), "a": begin, "b": begin + long})
    q = spark.createDataFrame(pd.concat([frame, pd.DataFrame({"k": [3000, 3001], "a": [5, 9], "b": [5, 3]})])).select("k", at("a").alias("lo"), at("b").alias("hi"))
    want = sorted((i, k) for i, x in enumerate(points.tolist()) for k in np.flatnonzero((begin <= x) & (x < begin + long)).tolist())
    for most in (0, 1 << 17):
        joined = joins.interval_join(p, q, most=most)
        assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)
        assert sorted((r["id"], r["k"]) for r in joined.collect()) == want
    assert joins.interval_join(p, q.limit(0)).count() == 0


def test_roles_and_periods_without_nested_loops(spark):
    d = "/root/testdata/sf0.001"
    for name in ("fold_roles", "bias_by_period", "backtest_folds", "ridge_backtest"):
        text = plan_of(queries.QUERIES[name](spark, d))
        assert "NestedLoop" not in text.replace("BroadcastNestedLoopJoin BuildRight, Inner, true", "") and "Cartesian" not in text, name
    t = base.daily_orders(spark, d)
    none = folds.assign_folds(t, queries._folds(t).limit(0))
    assert none.count() == 0 and none.columns == folds.assign_folds(t, queries._folds(t)).columns


# ---- fields --------------------------------------------------------------------------------


def test_a_stored_field_stays_where_it_is_read(spark, tmp_path):
    cells = geo.box_cells(spark)
    field = hours(spark, 30).select("ts").crossJoin(cells).withColumn("t2m", F.col("lat") + F.hour("ts"))
    field.withColumn("source_file", F.lit("a")).write.parquet(str(tmp_path / "grid"))
    grid = spark.read.parquet(str(tmp_path / "grid"))
    w = geo.checked_weights(geo.grid_weights(cells, geo.outline_edges(spark), geo.state_table(spark)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        for df in (geo.weighted_series(grid, w), geo.seam_safe_series(grid, w)):
            text = plan_of(df)
            shuffled = re.findall(r"hashpartitioning\(([^)]*)\)", text.split("broadcast")[0] if False else text)
            field_side = [k for k in shuffled if "lat#" in k and "lon#" in k]
            assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
            assert len(field_side) <= 1  # that of the staged cells, which are a row a cell
        direct = geo.weighted_series(grid, w, most_cells=0)
        assert "BroadcastHashJoin" not in plan_of(direct)
        assert {(r["kind"], r["ts"]): round(r["t2m"], 9) for r in direct.collect()} == {(r["kind"], r["ts"]): round(r["t2m"], 9) for r in geo.weighted_series(grid, w).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_mask_without_cells_fails(spark):
    far = geo.box_cells(spark, (30.0, 31.0), (0.0, 1.0))
    w = geo.grid_weights(far, geo.outline_edges(spark), geo.state_table(spark))
    assert {r["kind"] for r in w.select("kind").distinct().collect()} == {"box"}
    grid = hours(spark, 2).select("ts").crossJoin(far).withColumn("t2m", F.lit(1.0)).withColumn("source_file", F.lit("a"))
    for reduce in (geo.weighted_series, geo.seam_safe_series):
        with pytest.raises(Exception, match="weights sum to zero"):
            reduce(grid, geo.checked_weights(w)).collect()
        with pytest.raises(Exception, match="weights sum to zero"):
            reduce(grid, w.limit(0)).collect()
    assert geo.checked_weights(w, ("box",)).count() == 25


def test_first_slices_are_broadcast(spark, tmp_path):
    rows = hours(spark, 4).select(F.col("ts").alias("valid_time"), F.lit(50.0).alias("latitude"), F.lit(8.0).alias("longitude"), (F.lit(273.15) + F.col("id")).alias("t2m"), F.explode(F.array(F.lit(3), F.lit(2))).alias("number"))
    rows.withColumn("t2m", F.col("t2m") + F.col("number")).write.parquet(str(tmp_path / "g"))
    got = tables.read_grid(spark, str(tmp_path / "g"))
    assert "SortMergeJoin" not in plan_of(got) and sorted(round(r["t2m"]) for r in got.collect()) == [2, 3, 4, 5]


# ---- models --------------------------------------------------------------------------------


def test_all_folds_in_one_job_are_the_single_fits(spark):
    df, pdf = boosted_rows(spark, 400)
    days = pd.Timestamp("2019-01-01") + pd.to_timedelta(np.arange(400), unit="D")
    rows = spark.createDataFrame(pdf[["series_id", "p", "q", "r", "x"]].assign(ts=days)).withColumn("r", F.when(F.col("r") < 2, F.col("r")))
    stamp = lambda s: dt.datetime.fromisoformat(s)
    fold_table = spark.createDataFrame([(1, stamp("2019-06-01"), stamp("2019-09-01"), stamp("2019-12-01")), (2, stamp("2019-09-01"), stamp("2019-12-01"), stamp("2020-03-01")), (3, stamp("2018-01-01"), stamp("2018-06-01"), stamp("2019-03-01"))], "fold int, val_start timestamp, test_start timestamp, test_end timestamp")
    grid = ((0.1, 10), (0.1, 20))
    got = models.gbm_forecast(rows, fold_table, ["p", "q", "r"], "x", grid=grid, max_depth=3)
    assert plan_of(got).count("Exchange") == 1
    have = {(r["series_id"], r["fold"], r["ts"]): r["pred"] for r in got.collect()}
    assigned = folds.assign_folds(rows, fold_table)
    assert len(have) == assigned.filter("role = 'test'").count()
    for fold in (1, 2):
        model, _ = models.fit_gbm(assigned, ["p", "q", "r"], "x", fold, grid=grid, max_depth=3)
        for r in models.predict_trees(assigned.filter((F.col("role") == "test") & (F.col("fold") == fold)), model, ["p", "q", "r"]).collect():
            mine = have[r["series_id"], fold, r["ts"]]
            assert (mine is None) == (r["pred"] is None) == (r["r"] is None) and (mine is None or abs(mine - r["pred"]) < 1e-9)
    assert all(v is None for (_, fold, _), v in have.items() if fold == 3)  # no training rows


def test_pooled_forecast_of_all_folds(spark):
    df, pdf = boosted_rows(spark, 600)
    days = pd.Timestamp("2019-01-01") + pd.to_timedelta(np.arange(600), unit="D")
    rows = spark.createDataFrame(pdf[["series_id", "p", "q", "r", "x"]].assign(ts=days)).withColumn("r", F.when(F.col("r") < 2, F.col("r")))
    stamp = lambda s: dt.datetime.fromisoformat(s)
    fold_table = spark.createDataFrame([(1, stamp("2019-09-01"), stamp("2019-12-01"), stamp("2020-03-01")), (2, stamp("2018-01-01"), stamp("2018-06-01"), stamp("2019-03-01"))], "fold int, val_start timestamp, test_start timestamp, test_end timestamp")
    got = models.pooled_forecast(rows, fold_table, ["p", "q", "r"], "x", grid=((0.3, 6), (0.3, 12)), max_depth=3).toPandas()
    one = got[got.fold == 1]
    assert len(one) == 91 and one["pred"].isna().sum() == one["r"].isna().sum() and got[got.fold == 2]["pred"].isna().all()
    known = one.dropna()
    assert (known["pred"] - known["x"]).abs().mean() < 0.6 * (pdf["x"] - pdf["x"].mean()).abs().mean()


def test_models_scored_reads_staged_rows(spark):
    text = plan_of(queries.QUERIES["models_scored"](spark, "/root/testdata/sf0.001"))
    assert "Cartesian" not in text
    assert len(re.findall(r"\bExchange\b", text)) < 60 and len(re.findall(r"FileScan|Scan parquet", text)) <= 10


def test_fitted_modes(spark):
    d = "/root/testdata/sf0.01"
    demand = {r["mode"]: r for r in queries.QUERIES["demand_mode_scores"](spark, d).collect()}
    assert set(demand) == {"none", "lagged", "noisy", "perfect"} and len({r["n"] for r in demand.values()}) == 1
    assert all(abs(r["delta"] - (r["mae"] - demand["none"]["mae"])) < 1e-5 for r in demand.values()) and len({r["mae"] for r in demand.values()}) == 4
    solar = {(r["mode"], r["record"]): r for r in queries.QUERIES["solar_mode_scores"](spark, d).collect()}
    assert len(solar) == 8 and solar["perfect", False]["mae"] <= solar["none", False]["mae"]


def test_staged_folders_can_be_removed(spark, tmp_path):
    import os

    path = staging.shared_folder(spark, "x")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path) and staging.remove_staged(spark) >= 1 and not os.path.exists(path)


# ---- polygons, seams, stored order, cubes, look-back ---------------------------------------


def test_cover_keeps_the_known_mask_and_its_strict_edges(spark):
    cells = geo.box_cells(spark)
    edges = geo.outline_edges(spark).withColumn("poly_id", F.lit(7))
    for step in (0.25, 0.4, 3.0):
        got = geo.points_in_polygons(cells, edges, step)
        assert got.count() == 740 and got.select("lat", "lon").distinct().count() == 740
    direct = {(r["lat"], r["lon"]) for r in geo.inside_outline(cells, geo.outline_edges(spark)).filter("inside").collect()}
    assert {(r["lat"], r["lon"]) for r in geo.points_in_polygons(cells, edges, 0.3).collect()} == direct
    whole = geo.polygon_cover(edges, 0.25)
    assert whole.filter("whole").count() > 500 and whole.groupBy("poly_id", "_i", "_j").count().filter("count > 1").count() == 0


def test_points_of_many_polygons_against_all_edges(spark):
    r = np.random.default_rng(8)
    rings = {k: [(float(x + 2 * math.cos(a) * q), float(y + 2 * math.sin(a) * q)) for a, q in zip(np.linspace(0, 2 * math.pi, 9)[:-1], r.uniform(0.3, 1.5, 8), strict=True)] for k, (x, y) in enumerate(r.uniform(-5, 5, (30, 2)))}
    rings[99] = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    edges = spark.createDataFrame([(k, i, *a, *b) for k, v in rings.items() for i, (a, b) in enumerate(zip(v, v[1:] + v[:1], strict=True))], "poly_id int, edge_id int, x1 double, y1 double, x2 double, y2 double")
    at = [*map(tuple, r.uniform(-7, 7, (600, 2)).tolist()), (0.5, 0.5), (0.0, 0.5), (1.0, 0.5), (0.5, 1.0), (1.0, 1.0), (0.25, 0.25), (0.25, 0.25)]
    points = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(at)], "id int, lat double, lon double")

    def inside(x, y, ring):
        odd = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if abs((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) < 1e-9 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            odd ^= (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1)
        return odd

    want = sorted((i, k) for i, (x, y) in enumerate(at) for k, ring in rings.items() if inside(x, y, ring))
    for step, most in ((0.25, 1 << 20), (1.0, 0), (10.0, 1 << 20)):
        assert sorted((q["id"], q["poly_id"]) for q in geo.points_in_polygons(points, edges, step, most).collect()) == want


def test_seams_shuffle_only_what_files_share(spark, tmp_path):
    spans = [("a", 0, 10), ("b", 8, 20), ("c", 21, 30), ("d", 28, 40), ("e", 29, 33), ("f", 50, 60)]
    rows = spark.createDataFrame([("s", DAY + dt.timedelta(hours=h), f, float(ord(f))) for f, lo, hi in spans for h in range(lo, hi + 1)] + [("s", None, "b", 1.0), ("s", None, "a", 2.0)], "series_id string, ts timestamp, source_file string, x double")
    hour = lambda h: DAY + dt.timedelta(hours=h)
    assert tables.file_overlaps(rows) == [(hour(8), hour(10)), (hour(28), hour(33))]
    got = tables.drop_seam_rows(rows, ["series_id", "ts"])
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.collect())) == sorted(map(key, tables.drop_seam_duplicates(rows, ["series_id", "ts"]).select(rows.columns).collect()))
    assert tables.file_overlaps(rows.limit(0)) == [] and tables.drop_seam_rows(rows.filter("source_file = 'f'"), ["series_id", "ts"]).count() == 11


def test_features_of_a_stored_extract_need_no_exchange(spark):
    text = plan_of(queries.QUERIES["demand_features_stored"](spark, "/root/testdata/sf0.001"))
    moved = re.findall(r"Exchange hashpartitioning\((\w+)", text)
    assert set(moved) <= {"holiday_date"} and "SortMergeJoin" not in text and "Window" in text


def test_lookback_of_all_demand_columns_from_two_builds(spark):
    from tideline.functions import calendar_cols as cal
    from tideline.operators import audit, features

    h = hours(spark, 24 * 200).withColumn("x", F.pmod(F.col("id") * 7919, F.lit(1013)).cast("double"))
    holidays = cal.holiday_table(spark, 2018, 2020)
    names = features.demand_columns()
    got = {r["column"]: (r["first"], r["last"], r["n_steps"]) for r in audit.lookback_profile(h, lambda t: features.demand_features(t, holidays), "x", names, 1100, 1e6).collect()}
    want = {f"lag_{k}h": (k, k, 1) for k in (24, 48, 72, 168, 336)} | {"roll_mean_24h": (24, 47, 24), "roll_std_24h": (24, 47, 24), "roll_mean_168h": (24, 191, 168), "same_hour_3wk_mean": (168, 504, 3)}
    assert {k: got[k] for k in want} == want and all(got[k] == (None, None, 0) for k in names if k not in want)
    ahead = audit.lookback_profile(h, lambda t: t.withColumn("f", F.lead("x", 3).over(series.by_series())), "x", ["f"], 50, 1.0).first()
    assert (ahead["first"], ahead["last"]) == (-3, -3)


def test_cube_is_the_single_tables(spark):
    d = "/root/testdata/sf0.01"
    pred = queries._daily_pred(spark, d).cache()
    cube = scoring.error_cube(pred, {"month": {"m": F.month("ts")}, "all": {}})
    assert len(re.findall("InMemoryTableScan", plan_of(cube))) <= 2 and "Expand" in plan_of(cube)
    got = {(r["slice"], r["model"], r["key"]): r for r in cube.collect()}
    for r in scoring.scores(pred, "model").collect():
        mine = got["all", r["model"], ""]
        assert mine["n"] == r["n"] and all(abs(mine[c] - r[c]) < 1e-6 * abs(r[c]) for c in ("mae", "rmse", "mape", "bias"))
    for r in pred.groupBy(F.month("ts").alias("m"), "model").agg(scoring.mae().alias("mae")).collect():
        assert abs(got["month", r["model"], str(r["m"])]["mae"] - r["mae"]) < 1e-6 * r["mae"]


def test_nearest_of_many_against_all(spark):
    r = np.random.default_rng(9)
    c = np.round(np.concatenate([r.uniform(0, 1, (400, 2)), r.uniform(40, 60, (30, 2))]), 2)
    c = np.concatenate([c, c[:20]])  # ties go to the least idx
    p = np.round(np.concatenate([r.uniform(-5, 70, (150, 2)), r.uniform(0, 1, (100, 2)), c[:10]]), 2)
    centroids = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(c)] + [(999, None, 1.0)], "idx int, clat double, clon double")
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(5000, None, 1.0)], "point_id int, lat double, lon double")
    d2 = (p[:, None, 0] - c[None, :, 0]) ** 2 + ((p[:, None, 1] - c[None, :, 1]) * np.cos(np.radians(p[:, 0]))[:, None]) ** 2
    for levels, most in ((7, 1 << 20), (2, 0)):
        df = geo.nearest(points, centroids, levels, most)
        assert "Cartesian" not in plan_of(df) and "NestedLoop" not in plan_of(df)
        got = {q["point_id"]: (q["idx"], q["d2"]) for q in df.collect()}
        assert sorted(got) == list(range(len(p)))
        for i in got:
            idx = got[i][0]
            assert abs(got[i][1] - d2[i].min()) < 1e-12 and d2[i][idx] <= d2[i].min() + 1e-15 and idx == np.flatnonzero((c == c[idx]).all(axis=1))[0]
    assert geo.nearest(points, centroids.limit(0)).count() == 0
    one = geo.nearest(points, centroids.filter("idx = 3"), 3)
    assert one.count() == len(p) and one.filter("idx <> 3").count() == 0
