"""Calendar columns of local time, holidays by rule, and degree hours."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TZ = "Europe/Berlin"
HEATING_BASE, COOLING_BASE = 15.0, 22.0


def local(ts: Column, tz: str = TZ) -> Column:
    return F.from_utc_timestamp(ts, tz)


def local_calendar(ts: Column, tz: str = TZ) -> dict[str, Column]:
    """hour, dayofweek (Monday 0), month and is_weekend of local time."""
    at = local(ts, tz)
    return {"hour": F.hour(at), "dayofweek": F.weekday(at), "month": F.month(at), "is_weekend": (F.weekday(at) >= 5).cast("int")}


def cyclical(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def cycles(ts: Column, tz: str = TZ, weekday: bool = True) -> dict[str, Column]:
    at = local(ts, tz)
    parts = {"hour": (F.hour(at), 24), "dow": (F.weekday(at), 7), "doy": (F.dayofyear(at), 365)}
    out = {}
    for name, (value, period) in parts.items():
        if weekday or name != "dow":
            out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(value, period)
    return out


def easter(year: int) -> dt.date:
    """Western Easter Sunday, by the Gregorian computus."""
    golden, century = year % 19, year // 100
    epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
    epact -= epact // 28 * (1 - epact // 28 * (29 // (epact + 1)) * ((21 - golden) // 11))
    weekday = (year + year // 4 + epact + 2 - century + century // 4) % 7
    day = epact - weekday
    month = 3 + (day + 40) // 44
    return dt.date(year, month, day + 28 - 31 * (month // 4))


def german_holidays(first_year: int, last_year: int) -> list[dt.date]:
    """Nationwide public holidays: fixed days, days around Easter, and Reformation Day in 2017."""
    out = []
    for y in range(first_year, last_year + 1):
        e = easter(y)
        out += [dt.date(y, 1, 1), dt.date(y, 5, 1), dt.date(y, 10, 3), dt.date(y, 12, 25), dt.date(y, 12, 26)]
        out += [e + dt.timedelta(days=k) for k in (-2, 1, 39, 50)]
        if y == 2017:
            out.append(dt.date(2017, 10, 31))
    return sorted(out)


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """holiday_date: about ten rows a year."""
    return spark.createDataFrame([(d,) for d in german_holidays(first_year, last_year)], "holiday_date date")


def with_holiday(df: DataFrame, holidays: DataFrame, ts: str = "ts", tz: str = TZ) -> DataFrame:
    """is_holiday by the local date. No row is multiplied, and none moves: distinct dates are 366 a year at most, so they are broadcast."""
    h = F.broadcast(holidays.select("holiday_date").distinct().withColumn("_holiday", F.lit(1)))
    return df.join(h, F.to_date(local(F.col(ts), tz)) == F.col("holiday_date"), "left").withColumn("is_holiday", F.coalesce("_holiday", F.lit(0))).drop("holiday_date", "_holiday")


def degree_hours(temp_c: Column) -> tuple[Column, Column]:
    """Heating and cooling degree hours; null where the temperature is."""
    return F.when(temp_c.isNotNull(), F.greatest(F.lit(0.0), F.lit(HEATING_BASE) - temp_c)), F.when(temp_c.isNotNull(), F.greatest(F.lit(0.0), temp_c - COOLING_BASE))
