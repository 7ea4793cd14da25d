"""Unit conversions and the cattle temperature-humidity index.

All are plain column arithmetic, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: conversion factors --------------------------------------
# 1 inHg = 0.0254 m * 13595.1 kg/m^3 * 9.80665 m/s^2 = 3386.388640341 Pa
HPA_PER_INHG = 33.86388640341
KPA_PER_INHG = 3.386388640341
MS_PER_MPH = 0.44704           # 1609.344 m / 3600 s
KMH_PER_MPH = 1.609344
MM_PER_INCH = 25.4
# Field map: imperial source field -> metric field, per conversion.
TEMPERATURE_FIELDS: dict[str, str] = {"tempf": "temp_c", "tempinf": "tempin_c"}
PRESSURE_FIELDS: dict[str, str] = {"baromrelin": "baromrel_hpa", "baromabsin": "baromabs_hpa"}
WIND_SPEED_FIELDS: dict[str, str] = {"windspeedmph": "windspeed_ms", "windgustmph": "windgust_ms"}
RAIN_FIELDS: dict[str, str] = {
    "rainratein": "rainrate_mm",
    "eventrainin": "eventrain_mm",
    "dailyrainin": "dailyrain_mm",
    "weeklyrainin": "weeklyrain_mm",
    "monthlyrainin": "monthlyrain_mm",
    "yearlyrainin": "yearlyrain_mm",
    "totalrainin": "totalrain_mm",
}
VPD_FIELDS: dict[str, str] = {"vpd": "vpd_kpa"}
FIELD_MAPS = [TEMPERATURE_FIELDS, PRESSURE_FIELDS, WIND_SPEED_FIELDS, RAIN_FIELDS, VPD_FIELDS]
# ---------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fahrenheit_to_celsius(c: Column | str) -> Column:
    """degF -> degC."""
    return (_col(c) - F.lit(32.0)) / F.lit(1.8)


def kelvin_to_celsius(c: Column | str) -> Column:
    return _col(c) - F.lit(273.15)


def inhg_to_hpa(c: Column | str) -> Column:
    """inHg -> hPa."""
    return _col(c) * F.lit(HPA_PER_INHG)


def inhg_to_kpa(c: Column | str) -> Column:
    """inHg -> kPa (used for vpd, which stations report in inHg)."""
    return _col(c) * F.lit(KPA_PER_INHG)


def mph_to_ms(c: Column | str) -> Column:
    """mph -> m/s."""
    return _col(c) * F.lit(MS_PER_MPH)


def mph_to_kmh(c: Column | str) -> Column:
    """mph -> km/h."""
    return _col(c) * F.lit(KMH_PER_MPH)


def inches_to_mm(c: Column | str) -> Column:
    """in -> mm (also in/h -> mm/h for rain rate)."""
    return _col(c) * F.lit(MM_PER_INCH)


def thi(t: Column | str, rh: Column | str, unit: str = "degC") -> Column:
    """THI = (1.8T + 32) - (0.55 - 0.0055RH)(1.8T - 26), T in degC.

    ``unit`` names the unit of ``t`` ("degC", "degF" or "K"); it is converted
    to degC first.  Null in, null out.
    """
    unit_key = unit.lower()
    if unit_key in ("degc", "c", "celsius"):
        t_c = _col(t)
    elif unit_key in ("degf", "f", "fahrenheit"):
        t_c = fahrenheit_to_celsius(t)
    elif unit_key in ("k", "kelvin"):
        t_c = kelvin_to_celsius(t)
    else:
        raise ValueError(f"unsupported temperature unit {unit!r}")
    r = _col(rh)
    return (F.lit(1.8) * t_c + F.lit(32.0)) - (
        (F.lit(0.55) - F.lit(0.0055) * r) * (F.lit(1.8) * t_c - F.lit(26.0))
    )


CONVERSIONS: list[tuple[dict[str, str], object]] = [
    (TEMPERATURE_FIELDS, fahrenheit_to_celsius),
    (PRESSURE_FIELDS, inhg_to_hpa),
    (WIND_SPEED_FIELDS, mph_to_ms),
    (RAIN_FIELDS, inches_to_mm),
    (VPD_FIELDS, inhg_to_kpa),
]
