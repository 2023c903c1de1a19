"""Measurement channels, sensor groups and their limits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The channels' physical bounds (value must lie within), the
# bounds beyond which a possible value is suspect, and the sensor groups by
# name prefix.
HARD_LIMITS = {
    "temp": (-60.0, 60.0),
    "humidity": (0.0, 100.0),
    "windspeed": (0.0, 250.0),
    "windgust": (0.0, 300.0),
    "winddir": (0.0, 360.0),
    "pressure": (870.0, 1085.0),
    "pressure_trend": (-20.0, 20.0),
    "precip": (0.0, 1000.0),
    "solar": (0.0, 1600.0),
    "uv": (0.0, 25.0),
}
SUSPECT_MAX = {"solar": 1100.0, "uv": 16.0, "windspeed": 150.0, "windgust": 180.0, "precip": 300.0}
GROUP_OF = {
    "temp": "thermo_hygrometer",
    "humidity": "thermo_hygrometer",
    "windspeed": "anemometer",
    "windgust": "anemometer",
    "winddir": "wind_vane",
    "precip": "rain_gauge",
    "solar": "light_uv",
    "uv": "light_uv",
    "pressure": "barometer",
}
GROUPS = ("anemometer", "barometer", "light_uv", "rain_gauge", "thermo_hygrometer", "wind_vane")

#: Channels that the derived station-hour table carries.
CHANNELS = ("temp_avg_c", "windspeed_avg_kmh", "precip_rate_mmh", "solar_radiation_high_wm2", "pressure_max_hpa")
IGNORE_ZERO = ("precip_rate_mmh", "solar_radiation_high_wm2", "uv_high", "windspeed_low_kmh", "windgust_low_kmh")


def _prefix(channel: str, table) -> str | None:
    found = [p for p in table if channel == p or channel.startswith(p + "_")]
    return max(found, key=len, default=None)


def sensor_group(channel: str) -> str:
    """Group of a channel by its longest known prefix, else ``other``."""
    return GROUP_OF.get(_prefix(channel, GROUP_OF), "other")


def group_channels(channels=CHANNELS) -> dict[str, list[str]]:
    """Channels of each sensor group that has any, in the groups' order."""
    out = {g: [c for c in channels if sensor_group(c) == g] for g in GROUPS}
    return {g: c for g, c in out.items() if c}


def hard_limit(channel: str) -> tuple[float, float] | None:
    return HARD_LIMITS.get(_prefix(channel, HARD_LIMITS))


def is_impossible(value: Column, channel: str) -> Column:
    """Outside the hard limits, which are possible themselves; null is not."""
    limit = hard_limit(channel)
    if limit is None:
        return F.lit(False)
    return F.coalesce((value < limit[0]) | (value > limit[1]), F.lit(False))


def is_suspect(value: Column, channel: str) -> Column:
    """Possible but over the suspect bound."""
    bound = SUSPECT_MAX.get(_prefix(channel, SUSPECT_MAX))
    if bound is None:
        return F.lit(False)
    return F.coalesce(value > bound, F.lit(False)) & ~is_impossible(value, channel)


def wind_components(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def log_rain(value: Column) -> Column:
    return F.log1p(value)


def kmh_to_ms(value: Column) -> Column:
    return value / 3.6
