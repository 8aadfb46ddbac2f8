"""Solar geometry and a clear-sky model, as columns of ts (UTC), latitude and longitude in degrees.

The public methods: NOAA's solar position, Haurwitz global irradiance, Kasten and Young air mass,
beam attenuation, an isotropic sky, and the NOCT cell temperature.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOLAR_CONSTANT = 1361.0
PANEL_TILT, PANEL_AZIMUTH, ALBEDO = 30.0, 180.0, 0.2
NOCT, GAMMA, RATED = 45.0, -0.004, 1000.0


def _wrap(x: Column, period: float = 360.0) -> Column:
    return x - period * F.floor(x / period)


def _poly(t: Column, *coefficients: float) -> Column:
    """c0 + t * (c1 + t * (c2 + ...))"""
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = F.lit(c) + t * out
    return out


def with_sun(df: DataFrame, ts: str = "ts", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """df with zenith, elevation, azimuth, declination and eot_minutes (equation of time)."""
    keep = df.columns
    seconds = F.unix_timestamp(ts)
    d = df.withColumn("_t", (seconds / 86400.0 + 2440587.5 - 2451545.0) / 36525.0)
    t = F.col("_t")
    d = d.withColumns({
        "_l": F.radians(_wrap(_poly(t, 280.46646, 36000.76983, 0.0003032))),
        "_m": F.radians(_poly(t, 357.52911, 35999.05029, -0.0001537)),
        "_e": _poly(t, 0.016708634, -0.000042037, -0.0000001267),
        "_node": F.radians(_poly(t, 125.04, -1934.136)),
        "_tilt": F.lit(23.0) + (F.lit(26.0) + _poly(t, 21.448, -46.815, -0.00059, 0.001813) / 60.0) / 60.0,
    })
    m, node = F.col("_m"), F.col("_node")
    centre = F.sin(m) * _poly(t, 1.914602, -0.004817, -0.000014) + F.sin(2 * m) * _poly(t, 0.019993, -0.000101) + F.sin(3 * m) * 0.000289
    d = d.withColumns({
        "_sun": F.radians(F.degrees("_l") + centre - 0.00569 - F.sin(node) * 0.00478),
        "_eps": F.radians(F.col("_tilt") + F.cos(node) * 0.00256),
    })
    d = d.withColumns({"_decl": F.asin(F.sin("_eps") * F.sin("_sun")), "_y": F.pow(F.tan(F.col("_eps") / 2), F.lit(2.0))})
    l0, e, y = F.col("_l"), F.col("_e"), F.col("_y")
    eot = F.degrees(y * F.sin(2 * l0) - 2 * e * F.sin(m) + 4 * e * y * F.sin(m) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * e * e * F.sin(2 * m)) * 4.0
    d = d.withColumn("eot_minutes", eot)
    minutes = F.pmod(seconds, F.lit(86400)) / 60.0
    d = d.withColumn("_hour", F.radians(_wrap((minutes + F.col("eot_minutes") + F.col(lon) * 4.0) / 4.0) - 180.0))
    phi, decl, hour = F.radians(lat), F.col("_decl"), F.col("_hour")
    cos_z = F.sin(phi) * F.sin(decl) + F.cos(phi) * F.cos(decl) * F.cos(hour)
    d = d.withColumns({
        "zenith": F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos_z)))),
        "azimuth": _wrap(F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(decl) * F.cos(phi))) + 180.0),
        "declination": F.degrees(decl),
    }).withColumn("elevation", F.lit(90.0) - F.col("zenith"))
    return d.select(*keep, "zenith", "elevation", "azimuth", "declination", "eot_minutes")


def is_daylight(zenith: Column, horizon: float = 90.0) -> Column:
    return zenith < horizon


def _cos_up(zenith: Column) -> Column:
    """cos of the zenith held within 0 and 90 degrees."""
    return F.cos(F.radians(F.greatest(F.lit(0.0), F.least(F.lit(90.0), zenith))))


def air_mass(zenith: Column) -> Column:
    """Path length through the air, 1 overhead; infinite from the horizon on."""
    z = F.greatest(F.lit(0.0), zenith)
    below = F.lit(1.0) / (_cos_up(zenith) + F.pow(F.lit(96.07995) - z, F.lit(-1.6364)) * 0.50572)
    return F.when(zenith >= 90.0, F.lit(float("inf"))).when(zenith.isNotNull(), below)


def extraterrestrial(ts: Column) -> Column:
    return (F.cos(F.dayofyear(ts) * (2 * math.pi) / 365.25) * 0.033 + 1.0) * SOLAR_CONSTANT


def clear_sky_ghi(zenith: Column) -> Column:
    c = _cos_up(zenith)
    ghi = c * F.exp(F.lit(-0.059) / F.greatest(c, F.lit(1e-6))) * 1098.0
    return F.when(zenith >= 90.0, 0.0).when(zenith.isNotNull(), F.greatest(ghi, F.lit(0.0)))


def clear_sky_dni(ts: Column, zenith: Column) -> Column:
    """Direct beam; its horizontal part is at most the clear-sky global."""
    c = _cos_up(zenith)
    through = F.pow(F.lit(0.7), F.pow(air_mass(zenith), F.lit(0.678)))
    most = F.when(c > 1e-6, clear_sky_ghi(zenith) / F.greatest(c, F.lit(1e-6))).otherwise(0.0)
    return F.when(zenith >= 90.0, 0.0).when(zenith.isNotNull(), F.greatest(F.lit(0.0), F.least(extraterrestrial(ts) * through, most)))


def plane_of_array(ghi: Column, dni: Column, zenith: Column, azimuth: Column, tilt: float = PANEL_TILT, panel_azimuth: float = PANEL_AZIMUTH, albedo: float = ALBEDO) -> Column:
    """Irradiance on a tilted panel: beam, isotropic sky and ground."""
    z = F.radians(F.greatest(F.lit(0.0), F.least(F.lit(90.0), zenith)))
    cos_b, sin_b = math.cos(math.radians(tilt)), math.sin(math.radians(tilt))
    facing = F.greatest(F.lit(0.0), F.cos(z) * cos_b + F.sin(z) * F.cos(F.radians(azimuth - panel_azimuth)) * sin_b)
    sky = F.greatest(ghi - dni * F.cos(z), F.lit(0.0)) * ((1 + cos_b) / 2)
    return F.when(zenith >= 90.0, 0.0).when(zenith.isNotNull(), dni * facing + sky + ghi * (albedo * (1 - cos_b) / 2))


def cell_temperature(air_c: Column, poa: Column, noct: float = NOCT) -> Column:
    return air_c + poa * ((noct - 20.0) / 800.0)


def temperature_derate(cell_c: Column, gamma: float = GAMMA) -> Column:
    return (cell_c - 25.0) * gamma + 1.0


def clear_sky_index(generation: Column, clear_sky: Column, floor: float = 1e-3, most: float = 2.0) -> Column:
    """Generation over clear sky, at most `most`; null where the clear sky is at or under the floor."""
    ratio = F.when(clear_sky > floor, generation / clear_sky)
    return F.when(ratio.isNotNull(), F.least(ratio, F.lit(most)))


def clear_sky(df: DataFrame, air_c: str | None = None, tilt: float = PANEL_TILT, panel_azimuth: float = PANEL_AZIMUTH) -> DataFrame:
    """df (ts, lat, lon, ...) with the sun, cs_ghi, cs_dni, cs_poa and daylight; given air
    temperature, also cell_c, derate and cs_output."""
    z = F.col("zenith")
    d = with_sun(df).withColumns({"cs_ghi": clear_sky_ghi(z), "cs_dni": clear_sky_dni(F.col("ts"), z), "daylight": is_daylight(z)})
    d = d.withColumn("cs_poa", plane_of_array(F.col("cs_ghi"), F.col("cs_dni"), z, F.col("azimuth"), tilt, panel_azimuth))
    if air_c:
        d = d.withColumn("cell_c", cell_temperature(F.col(air_c), F.col("cs_poa")))
        d = d.withColumn("derate", temperature_derate(F.col("cell_c"))).withColumn("cs_output", F.col("cs_poa") / RATED * F.col("derate"))
    return d


def fleet_clear_sky(sites: DataFrame, times: DataFrame, air_c: str | None = None, **panel: float) -> DataFrame:
    """By ts, the share-weighted mean over sites(site_id, lat, lon, share) of all figures.

    Azimuth is a circular mean; daylight is any site's. Shares are scaled to 1. times: ts and, if
    named, the air temperature. Sites are few; Spark broadcasts them if they are small enough.
    """
    total = sites.agg(F.sum("share").alias("total"))
    weighted = sites.crossJoin(total).withColumn("w", F.col("share") / F.when(F.col("total") > 0, F.col("total")).otherwise(F.raise_error(F.lit("fleet shares sum to zero")).cast("double")))
    rows = clear_sky(times.crossJoin(weighted.select("lat", "lon", "w")), air_c, **panel)
    means = ["zenith", "elevation", "declination", "eot_minutes", "cs_ghi", "cs_dni", "cs_poa", *(["cell_c", "derate", "cs_output"] if air_c else [])]
    az = F.radians("azimuth")
    fleet = rows.groupBy("ts").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in means], F.sum(F.col("w") * F.sin(az)).alias("_s"), F.sum(F.col("w") * F.cos(az)).alias("_c"), F.bool_or("daylight").alias("daylight"))
    return fleet.withColumn("azimuth", _wrap(F.degrees(F.atan2("_s", "_c")))).drop("_s", "_c")
