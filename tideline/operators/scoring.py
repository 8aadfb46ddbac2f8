"""Scores on identical rows, and the tables built from them.

Long predictions: series_id, ts, y, model, pred. Tables that compare models fail where these aren't
scored on the same rows, told by order-free digests of series_id, ts and y that are summed beside the
scores, or have a row with a null in y or pred; same_rows tells where that happens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar_cols as cal
from .joins import interval_join


def error() -> Column:
    return F.col("pred") - F.col("y")


def mae() -> Column:
    return F.avg(F.abs(error()))


def rmse() -> Column:
    return F.sqrt(F.avg(error() * error()))


def mape() -> Column:
    """Percent, over rows whose actual isn't 0."""
    return F.avg(F.abs(F.try_divide(error(), F.col("y")))) * 100


def bias() -> Column:
    return F.avg(error())


def row_digest(df: DataFrame) -> list[Column]:
    """n_rows, _xor and _sum of df's rows as aggregates: the same for the same (series_id, ts, y), in any order.

    A row that is there twice cancels in the xor, but counts and sums again. The sum takes 28 bits of a
    second hash, so it holds 2^35 rows.
    """
    named = [F.col(c) for c in ("series_id", "ts") if c in df.columns] + [F.col("y").cast("double") + F.lit(0.0)]
    return [F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*named)).alias("_xor"), F.sum(F.shiftrightunsigned(F.xxhash64(F.lit(1), *named), 36)).alias("_sum")]


def scores(pred: DataFrame, *keys: str, n_rows: bool = False) -> DataFrame:
    """By keys: n, mae, rmse, mape, n_zero (rows mape leaves out) and bias; n_rows adds what on_same_rows reads."""
    extra = row_digest(pred) if n_rows else []
    return pred.groupBy(*keys).agg(*extra, F.count(error()).alias("n"), mae().alias("mae"), rmse().alias("rmse"), mape().alias("mape"), F.coalesce(F.sum((F.col("y") == 0).cast("long")), F.lit(0)).alias("n_zero"), bias().alias("bias"))


def on_same_rows(table: DataFrame, keys: tuple[str, ...] = (), actual: DataFrame | None = None) -> DataFrame:
    """table (keys, model, n, mae and a row digest) without the digest, failing the job where models differ in their rows or lack a value.

    actual (series_id, ts, y and the keys): the rows that should be scored. Its digest joins the comparison
    as one more model, so rows that all models lack or repeat alike fail too; so does a model without any rows left.
    """
    digest = ["n_rows", "_xor", "_sum"]
    if actual is not None:
        want = actual.groupBy(*keys).agg(*row_digest(actual)).withColumn("_actual", F.lit(True)).withColumn("n", F.col("n_rows"))
        table = table.withColumn("_actual", F.lit(False)).unionByName(want, allowMissingColumns=True)
    w = Window.partitionBy(*keys)
    same = F.min("n").over(w) == F.max("n_rows").over(w)
    for c in digest:
        same = same & F.min(c).over(w).eqNullSafe(F.max(c).over(w))
    if actual is not None:
        same = same & F.max("_actual").over(w) & ~F.min("_actual").over(w)
    out = table.withColumn("mae", F.when(same, F.col("mae")).otherwise(F.raise_error(F.lit("models are scored on different rows")).cast("double"))).drop(*digest)
    # A group of which only actual rows are left has no model's row to fail on: mae is read here too.
    return out.filter(~F.col("_actual") | (F.coalesce("mae", F.lit(0.0)) < 0)).drop("_actual") if actual is not None else out


def with_skill(table: DataFrame, base: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """skill = 1 - mae / mae of the base model, within keys."""
    of_base = F.max(F.when(F.col("model") == base, F.col("mae"))).over(Window.partitionBy(*keys))
    return table.withColumn("skill", 1 - F.try_divide(F.col("mae"), of_base))


def score_table(pred: DataFrame, base: str, keys: tuple[str, ...] = (), actual: DataFrame | None = None) -> DataFrame:
    """A row for each model (within keys), best first; with actual, the rows must be those."""
    table = scores(pred, *keys, "model", n_rows=True)
    return with_skill(on_same_rows(table, keys, actual), base, keys).orderBy(*keys, "mae", "model")


def solar_score_table(pred: DataFrame, capacity: DataFrame, base: str, keys: tuple[str, ...] = (), actual: DataFrame | None = None) -> DataFrame:
    """As score_table for capacity factors, with nrmse (percent of rated capacity, which is 1) and mae_mw
    by the mean capacity of the scored rows. capacity: series_id, ts, capacity_mw."""
    rows = pred.join(capacity, ["series_id", "ts"], "left")
    t = rows.groupBy(*keys, "model").agg(*row_digest(pred), F.count(error()).alias("n"), mae().alias("mae"), rmse().alias("rmse"), (rmse() * 100).alias("nrmse"), bias().alias("bias"), F.avg("capacity_mw").alias("_cap"))
    return with_skill(on_same_rows(t, keys, actual).drop("n"), base, keys).withColumn("mae_mw", F.col("mae") * F.col("_cap")).drop("_cap").orderBy(*keys, "mae", "model")


def same_rows(actual: DataFrame, pred: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """By model: n_rows, and how many keys are missing, extra or without a value. All zero is a pass."""
    models = models if models is not None else pred.select("model").distinct()
    want = actual.select("series_id", "ts", F.lit(1).alias("_a")).crossJoin(models)
    have = pred.select("series_id", "ts", "model", "pred", F.lit(1).alias("_p"))
    both = want.join(have, ["series_id", "ts", "model"], "full")

    def n(c: Column) -> Column:
        return F.sum(c.cast("long"))

    return both.groupBy("model").agg(n(F.col("_a").isNotNull()).alias("n_rows"), n(F.col("_p").isNull()).alias("missing"), n(F.col("_a").isNull()).alias("extra"), n(F.col("_p").isNotNull() & F.col("pred").isNull()).alias("nulls"))


def error_cube(pred: DataFrame, slices: dict[str, dict[str, Column]]) -> DataFrame:
    """slice, model, key and the scores of each slice, all from one pass over the predictions.

    slices: name to the key columns of a slice, as expressions (the local hour, the day, the fold); a slice
    without keys is all rows. Counts and sums of errors, which add up over any rows, are all that is
    grouped; key is the slice's keys as text, joined by '|'.
    """
    columns = {f"_{s}_{k}": c for s, keys in slices.items() for k, c in keys.items()}
    rows = pred.withColumns(columns).select("model", *columns, error().alias("_e"), F.try_divide(error(), F.col("y")).alias("_r"))
    sets = [["model", *[f"_{s}_{k}" for k in keys]] for s, keys in slices.items()]
    sums = rows.groupingSets([[F.col(c) for c in one] for one in sets], "model", *columns).agg(F.grouping_id().alias("_set"), F.count("_e").alias("n"), F.sum(F.abs("_e")).alias("_a"), F.sum(F.col("_e") * F.col("_e")).alias("_s"), F.sum("_e").alias("_b"), F.sum(F.abs("_r")).alias("_p"), F.count("_r").alias("_m"))
    order = ["model", *columns]
    ids = {s: sum(1 << (len(order) - 1 - i) for i, c in enumerate(order) if c not in one) for s, one in zip(slices, sets, strict=True)}
    name, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s, keys in slices.items():
        mine = F.col("_set") == ids[s]
        name = F.when(mine, F.lit(s)).otherwise(name)
        key = F.when(mine, F.concat_ws("|", *[F.col(f"_{s}_{k}").cast("string") for k in keys]) if keys else F.lit("")).otherwise(key)
    n = F.col("n")
    return sums.select(name.alias("slice"), "model", key.alias("key"), "n", F.try_divide("_a", n).alias("mae"), F.sqrt(F.try_divide("_s", n)).alias("rmse"), (F.try_divide("_p", "_m") * 100).alias("mape"), F.try_divide("_b", n).alias("bias"))


def mae_by_hour(pred: DataFrame, models: list[str], tz: str = cal.TZ) -> DataFrame:
    """hour (local) and a column of MAE for each model."""
    return pred.groupBy(F.hour(cal.local(F.col("ts"), tz)).alias("hour")).pivot("model", models).agg(mae())


def mae_by_month(pred: DataFrame, models: list[str], tz: str = cal.TZ) -> DataFrame:
    return pred.groupBy(F.month(cal.local(F.col("ts"), tz)).alias("month")).pivot("model", models).agg(mae())


def monthly_delta(pred: DataFrame, first: str, second: str, tz: str = cal.TZ) -> DataFrame:
    """By local month, MAE of two modes and the second's change in percent."""
    return mae_by_month(pred, [first, second], tz).withColumn("delta_pct", F.try_divide(F.col(second) - F.col(first), F.col(first)) * 100)


def worst_days(pred: DataFrame, n: int = 5, tz: str = cal.TZ) -> DataFrame:
    """The n local days of the largest MAE, of each model; ties go to the earlier day."""
    days = pred.groupBy("model", F.to_date(cal.local(F.col("ts"), tz)).alias("day")).agg(mae().alias("mae"))
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("mae"), "day"))
    return days.withColumn("rank", rank).filter(F.col("rank") <= n)


def best_and_gap(table: DataFrame, a: str, b: str, tie: float = 0.02) -> DataFrame:
    """best model, relative gap of a against b, and whether that counts as a tie."""
    pick = {m: F.max(F.when(F.col("model") == m, F.col("mae"))) for m in (a, b)}
    gap = F.try_divide(pick[a] - pick[b], pick[b])
    return table.agg(F.min_by("model", F.struct("mae", "model")).alias("best"), gap.alias("gap")).withColumn("tie", F.abs("gap") < tie)


def night_effect(pred: DataFrame, daylight: DataFrame) -> DataFrame:
    """By model: MAE over all rows, over daylight rows, and their ratio. daylight: ts, daylight."""
    rows = pred.join(daylight.select("ts", "daylight"), "ts", "left")
    light = F.avg(F.when(F.coalesce("daylight", F.lit(False)), F.abs(error())))
    return rows.groupBy("model").agg(mae().alias("mae_all"), light.alias("mae_daylight")).withColumn("ratio", F.try_divide("mae_all", "mae_daylight"))


def backtest_scores(pred: DataFrame, actual: DataFrame | None = None) -> DataFrame:
    """fold, test_start, model, mae from test rows that carry fold and test_start; in each fold models share their rows, of all series."""
    table = pred.groupBy("fold", "test_start", "model").agg(*row_digest(pred), F.count(error()).alias("n"), mae().alias("mae"))
    return on_same_rows(table, ("fold", "test_start"), actual).drop("n")


def backtest_summary(tidy: DataFrame) -> DataFrame:
    """model, mean and worst MAE over folds, and folds won (ties go to the first name)."""
    won = F.row_number().over(Window.partitionBy("fold").orderBy("mae", "model")) == 1
    return tidy.withColumn("_won", won.cast("long")).groupBy("model").agg(F.avg("mae").alias("mean_mae"), F.max("mae").alias("worst_mae"), F.sum("_won").alias("folds_won")).orderBy("mean_mae", "model")


def against(table: DataFrame, key: str, base: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Difference of MAE to the row whose key is base (mode none, weighting box), absolute and percent."""
    of_base = F.max(F.when(F.col(key) == base, F.col("mae"))).over(Window.partitionBy(*keys))
    return table.withColumn("delta", F.col("mae") - of_base).withColumn("delta_pct", F.try_divide(F.col("delta"), of_base) * 100)


def fold_delta(tidy: DataFrame, first: str, second: str) -> DataFrame:
    """By fold, MAE of mode second less mode first; folds of both must be the same."""
    a, b = (tidy.filter(F.col("mode") == m).select("fold", "test_start", "model", F.col("mae").alias(n)) for m, n in ((first, "first"), (second, "second")))
    both = a.join(b, ["fold", "test_start", "model"], "full")
    matched = F.when(F.col("first").isNull() | F.col("second").isNull(), F.raise_error(F.lit("folds differ")).cast("double")).otherwise(F.col("second") - F.col("first"))
    return both.withColumn("delta", matched)


def delta_summary(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("model").agg(F.avg("delta").alias("mean_delta"), F.sum((F.col("delta") < 0).cast("long")).alias("wins"), F.min("delta").alias("least"), F.max("delta").alias("most"))


def seed_spread(by_seed: DataFrame, *keys: str) -> DataFrame:
    """Mean, sample deviation and range of MAE over seeds."""
    t = by_seed.groupBy(*keys) if keys else by_seed
    return t.agg(F.avg("mae").alias("mean"), F.stddev_samp("mae").alias("std"), F.min("mae").alias("least"), F.max("mae").alias("most")).withColumn("range", F.col("most") - F.col("least"))


def clear_sky_drift(df: DataFrame, poa: str = "cs_poa", day: int = 24) -> DataFrame:
    """Mean change of the clear sky over a day relative to its daylight mean, and the daylight share."""
    from .features import lag

    d = df.withColumn("_d", F.abs(F.col(poa) - lag(poa, day)))
    return d.agg(F.try_divide(F.avg(F.when(F.col("daylight"), F.col("_d"))), F.avg(F.when(F.col("daylight"), F.col(poa)))).alias("drift"), F.avg(F.col("daylight").cast("double")).alias("daylight_share"))


def binned_mean(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """Mean of y in equal-width bins of x, 1 to bins, by series."""
    ends = df.groupBy("series_id").agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    k = F.ceil(F.try_divide((F.col(x) - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")))
    b = F.greatest(F.lit(1), F.least(F.lit(bins), F.coalesce(k, F.lit(1)))).cast("int")
    return df.filter(F.col(x).isNotNull()).join(ends, "series_id").groupBy("series_id", b.alias("bin")).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))


def local_slice(df: DataFrame, days: int, start: str | None = None, tz: str = cal.TZ) -> DataFrame:
    """Rows of `days` local days from start, or from the first local day."""
    day = F.to_date(cal.local(F.col("ts"), tz))
    if start:
        begin = F.lit(start).cast("date")
        return df.filter((day >= begin) & (day < F.date_add(begin, days)))
    first = df.agg(F.min(day).alias("_first"))
    return df.crossJoin(first).filter(day < F.date_add("_first", days)).drop("_first")


def bias_by_period(pred: DataFrame, periods: DataFrame, models: list[str]) -> DataFrame:
    """period and a column of bias for each model. periods: period, lo, hi (hi excluded), any number, which may overlap."""
    return interval_join(pred, periods).groupBy("period").pivot("model", models).agg(bias())


def autocorrelation(df: DataFrame, x: str, lags: tuple[int, ...] = (1, 24, 168)) -> DataFrame:
    """By series, the correlation of x with itself k steps back."""
    from .features import lag

    d = df.withColumns({f"_l{k}": lag(x, k) for k in lags})
    return d.groupBy("series_id").agg(*[F.corr(x, f"_l{k}").alias(f"r_{k}") for k in lags])


def daily_correlation(df: DataFrame, x: str, t: str, tz: str = cal.TZ) -> DataFrame:
    """By series, correlation of the daily mean of x with that of t on the same day and the day before."""
    from .series import by_series

    days = df.groupBy("series_id", F.to_date(cal.local(F.col("ts"), tz)).alias("ts")).agg(F.avg(x).alias("x"), F.avg(t).alias("t"))
    return days.withColumn("t1", F.lag("t").over(by_series())).groupBy("series_id").agg(F.corr("x", "t").alias("r_today"), F.corr("x", "t1").alias("r_yesterday"))


def active_shares(df: DataFrame, *columns: str) -> DataFrame:
    """By series, the share of rows in which each column is above 0, and exactly 0."""
    return df.groupBy("series_id").agg(*[a for c in columns for a in (F.avg((F.col(c) > 0).cast("double")).alias(f"active_{c}"), F.avg((F.col(c) == 0).cast("double")).alias(f"zero_{c}"))])


def demeaned_correlation(df: DataFrame, a: str, b: str, tz: str = cal.TZ) -> DataFrame:
    """By series, the correlation of a and b, and that left after taking out each local month's means."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_m", F.month(cal.local(F.col("ts"), tz)))
    w = Window.partitionBy("series_id", "_m")
    d = rows.withColumns({"_a": F.col(a) - F.avg(a).over(w), "_b": F.col(b) - F.avg(b).over(w)})
    return d.groupBy("series_id").agg(F.corr(a, b).alias("r"), F.corr("_a", "_b").alias("r_within_month"))
