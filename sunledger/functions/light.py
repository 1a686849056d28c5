"""Light arithmetic: photon flux from lux and from spectra, the lamp decision."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from ..config import SITE, Site


def lux_to_ppfd(lux: Column) -> Column:
    return lux / C.LUX_PER_PPFD


def micromoles_to_moles(x: Column) -> Column:
    return x / 1e6


def spectrum_sum(prefix: str = "") -> Column:
    """The sum of count / response * wavelength over the channels; null if any channel is."""
    return reduce(add, (F.col(f"{prefix}{c}") / F.lit(float(C.RESPONSE[c])) * F.lit(float(C.WAVELENGTH[c])) for c in C.CHANNELS))


def spectrum_ppfd(cal: float | Column, prefix: str = "") -> Column:
    return spectrum_sum(prefix) * (F.lit(cal) if isinstance(cal, float) else cal)


def datasheet_cal(gain: float, tint_ms: float) -> float:
    """The absolute factor that the datasheet's first channel implies."""
    rho = C.F415_COUNTS / C.F415_IRRADIANCE / (C.F415_GAIN * C.F415_MS)
    return C.PHOTONS_PER_WATT_NM * C.RESPONSE["f415"] / (rho * gain * tint_ms)


def cal_agrees(cal: Column, datasheet: float) -> Column:
    return (cal / F.lit(datasheet)).between(0.5, 2.0)


def recalibrate(cal_old: Column, meter: Column, shown: Column) -> Column:
    return cal_old * F.try_divide(meter, shown)


def lamp_share(lux: Column, lux_ref: Column) -> Column:
    return lux - lux_ref


def lamp_fraction(lux: Column, lux_ref: Column) -> Column:
    return F.try_divide(lux - lux_ref, lux)


def any_at_least(limit: float, columns: tuple[str, ...] = C.CHANNELS) -> Column:
    """Whether any channel reaches the limit. Nulls are ignored."""
    return F.coalesce(F.greatest(*columns) >= limit, F.lit(False))


def all_present(columns: tuple[str, ...] = C.CHANNELS) -> Column:
    return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))


def forced_state(lux: Column, age_s: Column, minute: Column, end_min: int | Column, site: Site = SITE) -> Column:
    """ON or OFF where the reading forces a state; null inside the hysteresis band."""
    in_window = (minute >= site.lamp_start) & (minute < end_min)
    blind = lux.isNull() | age_s.isNull() | (age_s > site.stale_s)
    return (
        F.when(~in_window, "OFF").when(blind, "ON").when(lux < site.lux_on_below, "ON").when(lux > site.lux_off_above, "OFF")
    )


def decide(lux: Column, age_s: Column, minute: Column, current: Column, end_min: int | Column, site: Site = SITE) -> Column:
    """The wanted lamp state; in the band the current state stays."""
    return F.coalesce(forced_state(lux, age_s, minute, end_min, site), F.when(current == "ON", "ON").otherwise("OFF"))


def top_up(dli: Column, last: Column, target: float = SITE.dli_target) -> Column:
    """Whether to go on lighting this evening: the last answer if today's integral is unknown."""
    return F.coalesce(dli < target, last)
