"""Leaf reflectance: quality, indices, bursts, history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import reflect as R
from ..operators import series as S


def reflect_net(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Adds net_<channel>, saturated, ambient_leak and status from dark_ and lit_ columns."""
    lit = [f"lit_{c}" for c in channels]
    nets = {f"net_{c}": R.net(F.col(f"lit_{c}"), F.col(f"dark_{c}")) for c in channels}
    status = R.reflect_status(lit) if "dark_clear" in df.columns else F.when(F.greatest(*lit) >= C.DEVICE_SATURATED, "saturated").otherwise("ok")
    return df.withColumns(nets | {"status": status}).withColumns({"saturated": (F.col("status") == "saturated").cast("double"), "ambient_leak": (F.col("status") == "ambient_leak").cast("double")})


def with_indices(df: DataFrame, red: str = "net_n680", edge: str = "net_n730", nir: str = "net_n810") -> DataFrame:
    return df.withColumns(R.vegetation_indices(F.col(red), F.col(edge), F.col(nir), F.coalesce(F.col("nir_valid") == 1, F.lit(False))))


def latest_spectrum(spectrum: DataFrame) -> DataFrame:
    """(device, time, wavelength, value): the newest ambient spectrum of each device, a row a channel."""
    last = S.latest_per(spectrum.filter("mode = 'ambient'"), ("device",))
    long = last.unpivot(["device", "time"], list(C.CHANNELS), "channel", "value")
    return long.select("device", "time", F.substring("channel", 2, 4).cast("int").alias("wavelength"), "value")


def latest_reflectance(spectrum: DataFrame, channels: Sequence[str]) -> DataFrame:
    """(plant, time, channel, value): the newest reflect row of each plant, a row a net channel."""
    last = S.latest_per(spectrum.filter("mode = 'reflect'"), ("plant",))
    return last.unpivot(["plant", "time"], [f"net_{c}" for c in channels], "channel", "value")


def burst_summary(df: DataFrame, channels: Sequence[str], burst: str = "request_id") -> DataFrame:
    """Samples, failures, time span and channel medians of each burst."""
    good = F.col("status") == "ok"
    return df.groupBy("plant", burst).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(~good).alias("failures"), ((F.max(F.unix_micros("time")) - F.min(F.unix_micros("time"))) / 1e6).alias("span_s"), *(F.median(F.when(good, F.col(f"net_{c}"))).alias(f"net_{c}") for c in channels)
    )


def sessions(df: DataFrame, by: Sequence[str], gap: str = "10 minutes") -> DataFrame:
    """Bursts by time alone, for rows without a request id: (by, session_start, samples)."""
    return df.groupBy(*by, F.session_window("time", gap).alias("__w")).agg(F.count(F.lit(1)).alias("samples")).select(*by, F.col("__w.start").alias("session_start"), "samples")


def veg_index_history(df: DataFrame, burst: str = "request_id") -> DataFrame:
    """Median indices of each burst of each plant."""
    indexed = with_indices(df.filter("status = 'ok'"))
    return indexed.groupBy("plant", burst).agg(F.max("time").alias("time"), *(F.median(i).alias(i) for i in ("ndvi", "ndre", "cire")))


def veg_index_latest(df: DataFrame, burst: str = "request_id") -> DataFrame:
    return S.latest_per(veg_index_history(df, burst), ("plant",), ("time", burst))


def index_drift(history: DataFrame, setup: Sequence[str] = (), index: str = "ndvi", n: int = 5) -> DataFrame:
    """Each burst's index against the median of the plant's n bursts before, with the same capture setup."""
    return S.baseline_drift(history.filter(F.col(index).isNotNull()), ("plant", *setup), index, n)
