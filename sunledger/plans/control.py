"""The lamp controller over history: decisions, hysteresis, exact replay."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SITE, Site
from ..functions import time as T
from ..functions.light import forced_state
from ..operators.days import carried
from ..operators.joins import asof_join, state_held
from ..operators.ordered import replay_light
from .light import running_dli


def prepare_ticks(ticks: DataFrame, air: DataFrame, site: Site = SITE) -> DataFrame:
    """(location, time, lux, lux_age_s, minute, local_day, dli) for each tick (location, time): what the controller saw then.

    `air` has location, time and lux. The look-back for readings is a day: an older one is stale anyway.
    """
    seen = air.filter("lux IS NOT NULL").select("location", "time", "lux")
    flux = running_dli(seen.withColumnRenamed("location", "device"), site.tz).select(F.col("device").alias("location"), "time", "dli", F.col("local_day").alias("dli_day"))
    with_lux = asof_join(ticks.select("location", "time"), seen, ("location",), ("lux",), timedelta(days=1)).withColumn("lux_age_s", (F.unix_micros("time") - F.unix_micros("asof_time")) / 1e6).drop("asof_time")
    with_dli = asof_join(with_lux, flux, ("location",), ("dli", "dli_day"), timedelta(days=1)).drop("asof_time")
    placed = with_dli.withColumns({"minute": T.minute_of_day(F.col("time"), site.tz), "local_day": T.local_day(F.col("time"), site.tz)})
    return placed.withColumn("dli", F.when(F.col("dli_day") == F.col("local_day"), F.col("dli"))).drop("dli_day")


def hysteresis(prepared: DataFrame, site: Site = SITE) -> DataFrame:
    """The state at each tick without any hold: the last forced state stays through the band."""
    forced = forced_state(F.col("lux"), F.col("lux_age_s"), F.col("minute"), site.lamp_end, site)
    return carried(prepared, ("location",), forced, "state").withColumn("state", F.coalesce("state", F.lit("OFF")))


def controller_rows(ticks: DataFrame, air: DataFrame, commands: DataFrame, site: Site = SITE) -> DataFrame:
    """What the controller is given, a row a tick or command. Retained commands are ignored, as is anything but ON and OFF."""
    prepared = prepare_ticks(ticks, air, site).withColumns({"kind": F.lit("tick"), "cmd": F.lit(None).cast("string")})
    state = F.upper("state")
    cmds = commands.filter(~F.coalesce("retained", F.lit(False)) & state.isin("ON", "OFF")).select("location", "time", F.lit("cmd").alias("kind"), state.alias("cmd"))
    return prepared.unionByName(cmds, allowMissingColumns=True)


def replay(ticks: DataFrame, air: DataFrame, commands: DataFrame, site: Site = SITE) -> DataFrame:
    """Every switch of the lamp that the controller would have made, from ticks, readings and commands."""
    return replay_light(controller_rows(ticks, air, commands, site), site)


def verify_lamp_off(windows: DataFrame, light: DataFrame) -> DataFrame:
    return state_held(windows, light, ("location",), "on", 0.0)
