"""Reference evapotranspiration and daylight as column expressions. Daily values, J is the day of the year."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SOLAR = 0.0820  # MJ m-2 min-1
LATENT = 2.45  # MJ kg-1
STEFAN = 4.903e-9  # MJ K-4 m-2 day-1
ALBEDO = 0.23


def _season(j: Column) -> tuple[Column, Column]:
    """Inverse relative distance to the sun, and declination; the year counts 365 days on leap days too."""
    turn = j * (2 * math.pi / 365)
    return 1 + 0.033 * F.cos(turn), 0.409 * F.sin(turn - 1.39)


def _sunset_angle(lat: float, decl: Column) -> Column:
    x = -math.tan(lat) * F.tan(decl)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def extraterrestrial_radiation(lat_deg: float, j: Column) -> Column:
    lat = math.radians(lat_deg)
    dr, decl = _season(j)
    ws = _sunset_angle(lat, decl)
    return (24 * 60 / math.pi) * SOLAR * dr * (ws * math.sin(lat) * F.sin(decl) + math.cos(lat) * F.cos(decl) * F.sin(ws))


def hargreaves(tmax: Column, tmin: Column, tmean: Column, ra: Column) -> Column:
    """mm a day; null where the maximum is under the minimum."""
    return F.when(tmax >= tmin, 0.0023 * F.sqrt(F.greatest(tmax - tmin, F.lit(0.0))) * (tmean + 17.8) * ra / LATENT)


def saturation_pressure(t: Column) -> Column:
    return 0.6108 * F.exp(17.27 * t / (t + 237.3))


def pressure_slope(t: Column) -> Column:
    return 4098 * saturation_pressure(t) / F.pow(t + 237.3, F.lit(2))


def psychrometric(p_kpa: Column) -> Column:
    return 0.000665 * p_kpa


def net_radiation(ra: Column, tmax: Column, tmin: Column, ea: Column, elevation: float, krs: float = 0.19) -> Column:
    """Solar radiation from the temperature range, less reflection and long waves; the clearness ratio lies in 0.33 to 1."""
    rs = krs * F.sqrt(F.greatest(tmax - tmin, F.lit(0.0))) * ra
    rso = (0.75 + 2e-5 * elevation) * ra
    clear = F.greatest(F.lit(0.33), F.least(F.lit(1.0), rs / F.nullif(rso, F.lit(0.0))))
    heat = STEFAN * (F.pow(tmax + 273.16, F.lit(4)) + F.pow(tmin + 273.16, F.lit(4))) / 2
    return (1 - ALBEDO) * rs - heat * (0.34 - 0.14 * F.sqrt(F.greatest(ea, F.lit(0.0)))) * (1.35 * clear - 0.35)


def penman_monteith(tmax: Column, tmin: Column, p_kpa: Column, ea: Column, ra: Column, elevation: float, wind: float = 2.0) -> Column:
    """mm a day for the reference crop, without soil heat flux; vapour deficit at least 0, null where the maximum is under the minimum."""
    tmean = (tmax + tmin) / 2
    es = (saturation_pressure(tmax) + saturation_pressure(tmin)) / 2
    deficit = F.greatest(es - ea, F.lit(0.0))
    slope, gamma = pressure_slope(tmean), psychrometric(p_kpa)
    rn = net_radiation(ra, tmax, tmin, ea, elevation)
    return F.when(tmax >= tmin, (0.408 * slope * rn + gamma * 900 / (tmean + 273) * wind * deficit) / (slope + gamma * (1 + 0.34 * wind)))


def preferred(pm: Column, hs: Column) -> Column:
    """The first where it is a positive number, else the second."""
    return F.when(pm.isNotNull() & ~F.isnan(pm) & (pm > 0), pm).otherwise(hs)


def daylight(lat_deg: float, j: Column) -> tuple[Column, Column, Column]:
    """Sunrise, sunset (hours of solar time) and hours between."""
    _, decl = _season(j)
    hours = 24 / math.pi * _sunset_angle(math.radians(lat_deg), decl)
    return 12 - hours / 2, 12 + hours / 2, hours


def half_sine(daily: Column, hour: Column, sunrise: Column, hours: Column) -> Column:
    """The part of a day's amount at the middle of an hour: half a sine wave between sunrise and sunset."""
    at = hour + 0.5 - sunrise
    rate = daily * (math.pi / 2) / F.nullif(hours, F.lit(0.0)) * F.sin(math.pi * at / F.nullif(hours, F.lit(0.0)))
    return F.when((at >= 0) & (at <= hours), rate).otherwise(0.0)
