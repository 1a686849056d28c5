"""Leaf reflectance: net signal, quality, vegetation indices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def net(lit: Column, dark: Column) -> Column:
    return lit - dark


def reflect_status(lit: list[str], dark_clear: str = "dark_clear") -> Column:
    """saturated before ambient_leak before ok."""
    return F.when(F.greatest(*lit) >= C.DEVICE_SATURATED, "saturated").when(F.col(dark_clear) > C.AMBIENT_LEAK, "ambient_leak").otherwise("ok")


def nir_invalid(columns: list[str]) -> Column:
    """All bands at full scale: the bus answered, the sensor didn't."""
    return F.least(*columns) >= C.FULL_SCALE


def _gated(value: Column, valid: Column, *bands: Column) -> Column:
    for band in bands:
        valid = valid & (band > 0)
    return F.when(valid, value)


def vegetation_indices(red: Column, edge: Column, nir: Column, valid: Column) -> dict[str, Column]:
    """ndvi, ndre and cire from net bands; null unless valid, with all bands positive, and the ratios in [-1, 1]."""
    ndvi, ndre = F.try_divide(nir - red, nir + red), F.try_divide(nir - edge, nir + edge)
    return {
        "ndvi": _gated(F.when(ndvi.between(-1, 1), ndvi), valid, red, edge, nir),
        "ndre": _gated(F.when(ndre.between(-1, 1), ndre), valid, red, edge, nir),
        "cire": _gated(F.try_divide(nir, edge) - 1, valid, red, edge, nir),
    }
