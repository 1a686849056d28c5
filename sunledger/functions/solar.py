"""Solar noon and the sun's height then, from the published NOAA equation of time, as Column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SITE, Site
from .time import day_start


def _poly(t: Column, *c: float) -> Column:
    """c0 + c1 t + c2 t^2 ..., by Horner's rule."""
    out = F.lit(c[-1])
    for k in reversed(c[:-1]):
        out = F.lit(k) + t * out
    return out


def with_solar_noon(df: DataFrame, day: str = "local_day", site: Site = SITE) -> DataFrame:
    """Adds `noon` (the instant of solar noon, whole seconds) and `noon_height` (degrees) of a local day.

    The steps are columns of their own, so that no expression is repeated inside another.
    """
    t = F.col("__t")
    anomaly, node, ecc, long, tilt, half = (F.col(f"__{c}") for c in ("anomaly", "node", "ecc", "long", "tilt", "half"))
    centre = F.sin(anomaly) * _poly(t, 1.914602, -0.004817, -0.000014) + F.sin(2 * anomaly) * _poly(t, 0.019993, -0.000101) + F.sin(3 * anomaly) * 0.000289
    equation = 4.0 * F.degrees(
        half * F.sin(2 * long) - 2 * ecc * F.sin(anomaly) + 4 * ecc * half * F.sin(anomaly) * F.cos(2 * long) - half * half * F.sin(4 * long) / 2 - ecc * ecc * F.sin(2 * anomaly) * 1.25
    )
    steps = (
        {"__midnight": F.unix_seconds(day_start(F.col(day), site.tz))},
        {"__offset": (F.unix_date(day).cast("long") * 86400 - F.col("__midnight")) / 3600.0},
        # Centuries since the epoch J2000.0, at local noon.
        {"__t": (F.unix_date(day) - 10957 - F.lit(0.5) + (F.lit(12.0) - F.col("__offset")) / 24.0) / 36525.0},
        {"__anomaly": F.radians(_poly(t, 357.52911, 35999.05029, -0.0001537)), "__node": F.radians(_poly(t, 125.04, -1934.136)), "__ecc": _poly(t, 0.016708634, -0.000042037, -0.0000001267)},
        {"__long": F.radians(F.pmod(_poly(t, 280.46646, 36000.76983, 0.0003032), F.lit(360.0))), "__tilt": F.radians(23.0 + (26.0 + _poly(t, 21.448, -46.8150, -0.00059, 0.001813) / 60.0) / 60.0 + F.cos(node) * 0.00256)},
        {"__seen": long + F.radians(centre - 0.00569 - F.sin(node) * 0.00478), "__half": F.pow(F.tan(tilt / 2.0), 2)},
        {"__sun": F.degrees(F.asin(F.sin(tilt) * F.sin(F.col("__seen")))), "__eq": equation},
        {"noon": F.timestamp_seconds(F.floor(F.col("__midnight") + (720.0 - 4.0 * site.lon - F.col("__eq") + F.col("__offset") * 60.0) * 60.0)), "noon_height": 90.0 - F.abs(F.lit(site.lat) - F.col("__sun"))},
    )
    out = df
    for step in steps:
        out = out.withColumns(step)
    return out.select(*df.columns, "noon", "noon_height")
