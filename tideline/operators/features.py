"""Leakage-safe features: no column reads the target less than one day back.

Tables must be dense. With steps other than hours, day is the number of steps in a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import calendar_cols as cal
from ..functions import solar
from .series import by_series

LAGS = (24, 48, 72, 168, 336)
SOLAR_LAGS = (24, 48, 72, 168)
MODES = ("none", "lagged", "noisy", "perfect")
SOLAR_MODES = ("none", "clearsky", "lagged", "perfect")
NOISE_C = 1.0


def lag(x: Column | str, k: int) -> Column:
    return F.lag(x, k).over(by_series())


def _full(agg, x: Column | str, n: int, back: int) -> Column:
    """agg over the n rows that end `back` rows ago, null unless all n have a value."""
    frame = by_series().rowsBetween(-(back + n - 1), -back)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


def rolling_mean(x: Column | str, n: int, back: int = 0) -> Column:
    return _full(F.avg, x, n, back)


def rolling_std(x: Column | str, n: int, back: int = 0) -> Column:
    return _full(F.stddev_samp, x, n, back)


def rolling_sum(x: Column | str, n: int, back: int = 0) -> Column:
    return _full(F.sum, x, n, back)


def mean_of_lags(x: str, lags: tuple[int, ...]) -> Column:
    """Null if any of them is."""
    total = lag(x, lags[0])
    for k in lags[1:]:
        total = total + lag(x, k)
    return total / len(lags)


def history_columns(x: str, day: int = 24, lags: tuple[int, ...] = LAGS, std: bool = True, weeks: bool = True) -> dict[str, Column]:
    """Lags and rolling columns off the series one day back."""
    week = 7 * day
    out = {f"lag_{k}h": lag(x, k) for k in lags}
    out[f"roll_mean_{day}h"] = rolling_mean(x, day, day)
    out[f"roll_mean_{week}h"] = rolling_mean(x, week, day)
    if std:
        out[f"roll_std_{day}h"] = rolling_std(x, day, day)
    if weeks:
        out["same_hour_3wk_mean"] = mean_of_lags(x, (week, 2 * week, 3 * week))
    return out


def seeded_normal(seed: Column | int, *key: Column, tag: str = "noise") -> Column:
    """A standard normal value that depends on seed and key alone, not on partitions: MD5, then Box-Muller."""
    digest = F.md5(F.concat_ws("|", F.lit(tag), F.lit(seed).cast("string") if isinstance(seed, int) else seed.cast("string"), *[k.cast("string") for k in key]).cast("binary"))

    def uniform(at: int) -> Column:
        return (F.conv(F.substring(digest, at, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)

    return F.sqrt(F.log(uniform(1)) * -2.0) * F.cos(uniform(13) * 6.283185307179586)


def usable_temperature(temp: str, mode: str, seed: Column | int = 0, day: int = 24, sigma: float = NOISE_C) -> Column | None:
    """What a forecast may know of the temperature: nothing, yesterday's, a seeded guess, or all."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "none":
        return None
    if mode == "lagged":
        return lag(temp, day)
    if mode == "perfect":
        return F.col(temp)
    return F.col(temp) + seeded_normal(seed, F.col("series_id"), F.unix_timestamp("ts")) * sigma


def temperature_columns(t: str, day: int = 24) -> dict[str, Column]:
    """Degree hours, the mean of the last day (this hour included) and the change against a day ago."""
    hdh, cdh = cal.degree_hours(F.col(t))
    return {"hdh": hdh, "cdh": cdh, "temp_roll_mean_24h": rolling_mean(t, day), "temp_change_24h": F.col(t) - lag(t, day)}


def demand_features(df: DataFrame, holidays: DataFrame, target: str = "x", temp: str | None = None, mode: str = "none", seed: int = 0, day: int = 24, lags: tuple[int, ...] = LAGS, tz: str = cal.TZ) -> DataFrame:
    """series_id, ts, target and 20 features, 25 with a temperature; rows with a null among them go.

    df: dense series_id, ts, target and, if named, temp. All windows share one exchange and sort.
    """
    t = usable_temperature(temp, mode, seed, day) if temp and mode != "none" else None
    if mode != "none" and not temp:
        raise ValueError(f"mode {mode!r} needs a temperature")
    ts = F.col("ts")
    d = df.select("series_id", "ts", target, *([t.alias("temp_c")] if t is not None else []))
    d = d.withColumns(history_columns(target, day, lags) | (temperature_columns("temp_c", day) if t is not None else {}))
    d = cal.with_holiday(d.withColumns(cal.local_calendar(ts, tz) | cal.cycles(ts, tz)), holidays, "ts", tz)
    return d.select("series_id", "ts", target, *demand_columns(mode, day, lags)).dropna()


def demand_columns(mode: str = "none", day: int = 24, lags: tuple[int, ...] = LAGS) -> list[str]:
    cols = ["hour", "dayofweek", "month", "is_weekend", "is_holiday", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "doy_sin", "doy_cos"]
    cols += [f"lag_{k}h" for k in lags] + [f"roll_mean_{day}h", f"roll_mean_{7 * day}h", f"roll_std_{day}h", "same_hour_3wk_mean"]
    return cols + (["temp_c", "hdh", "cdh", "temp_roll_mean_24h", "temp_change_24h"] if mode != "none" else [])


def solar_history_columns(mode: str = "clearsky") -> list[str]:
    """Every solar feature that reads the target."""
    cols = [f"lag_{k}h" for k in SOLAR_LAGS] + ["roll_mean_24h", "roll_mean_168h"]
    return cols + (["kt_yesterday"] if mode in ("lagged", "perfect") else [])


def without_history(df: DataFrame, mode: str = "clearsky") -> DataFrame:
    """Features of a site with no production record."""
    return df.drop(*solar_history_columns(mode))


def solar_columns(mode: str = "clearsky") -> list[str]:
    cols = ["hour", "month", "hour_sin", "hour_cos", "doy_sin", "doy_cos", *[f"lag_{k}h" for k in SOLAR_LAGS], "roll_mean_24h", "roll_mean_168h"]
    if mode != "none":
        cols += ["cs_poa", "cs_ghi", "elevation", "azimuth", "is_daylight"]
    return cols + (["temp_c", "cell_c", "derate", "cs_output", "kt_yesterday"] if mode in ("lagged", "perfect") else [])


def daily_clearness(cf: str, poa: str, day: int = 24) -> Column:
    """Yesterday's generation over yesterday's clear sky, both summed over the day."""
    sky = rolling_sum(poa, day, day)
    return F.when(sky > 1.0, rolling_sum(cf, day, day) / sky)


def solar_features(df: DataFrame, target: str = "cf", mode: str = "clearsky", temp: str | None = None, tz: str = cal.TZ) -> DataFrame:
    """series_id, ts, target, daylight (if known) and 12, 17 or 22 features; rows with a null among them go.

    df: dense series_id, ts, target; beyond mode none also cs_poa, cs_ghi, elevation, azimuth and
    daylight of the fleet; for lagged and perfect also temp.
    """
    if mode not in SOLAR_MODES:
        raise ValueError(f"mode must be one of {SOLAR_MODES}")
    ts = F.col("ts")
    new = history_columns(target, 24, SOLAR_LAGS, std=False, weeks=False)
    calendar = cal.local_calendar(ts, tz)
    new |= {"hour": calendar["hour"], "month": calendar["month"]} | cal.cycles(ts, tz, weekday=False)
    if mode != "none":
        new["is_daylight"] = F.col("daylight").cast("int")
    if mode in ("lagged", "perfect"):
        if not temp:
            raise ValueError(f"mode {mode!r} needs a temperature")
        t = lag(temp, 24) if mode == "lagged" else F.col(temp)
        new |= {"temp_c": t, "kt_yesterday": daily_clearness(target, "cs_poa")}
    d = df.withColumns(new)
    if mode in ("lagged", "perfect"):
        d = d.withColumn("cell_c", solar.cell_temperature(F.col("temp_c"), F.col("cs_poa"))).withColumn("derate", solar.temperature_derate(F.col("cell_c"))).withColumn("cs_output", F.col("cs_poa") / solar.RATED * F.col("derate"))
    return d.select("series_id", "ts", target, *solar_columns(mode)).dropna()


