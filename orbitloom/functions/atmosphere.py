"""Moist air and pressure heights as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magnus coefficients over water, gas constant of dry air, standard gravity.
MAGNUS_A, MAGNUS_B, MAGNUS_PA = 17.625, 243.04, 610.94
DRY_AIR, GRAVITY = 287.05, 9.80665


def dew_point(celsius: Column, humidity: Column) -> Column:
    """Dew point in Celsius of a relative humidity in percent."""
    g = F.log(humidity / 100) + MAGNUS_A * celsius / (MAGNUS_B + celsius)
    return MAGNUS_B * g / (MAGNUS_A - g)


def virtual_temperature(celsius: Column, humidity: Column, pascal: Column) -> Column:
    """Virtual temperature in kelvin; dry (null or 0 percent) and saturated beyond the pressure: the plain one."""
    plain = celsius + 273.15
    vapour = humidity / 100 * MAGNUS_PA * F.exp(MAGNUS_A * celsius / (celsius + MAGNUS_B))
    ratio = 0.622 * vapour / (pascal - vapour)
    return F.when((humidity > 0) & (vapour < pascal), plain * (1 + 0.61 * ratio / (1 + ratio))).otherwise(plain)


def log_pressure_rate(first: Column, last: Column, seconds: Column) -> Column:
    """Change of the logarithm of a pressure per second; null without positive pressures and time."""
    return F.when((first > 0) & (last > 0) & (seconds > 0), F.log(last / first) / seconds)


def pressure_height(log_change: Column, kelvin: Column) -> Column:
    """Metres that a change of the logarithm of the pressure stands for."""
    return -(DRY_AIR / GRAVITY) * kelvin * log_change


def combined(*parts: Column) -> Column:
    """Root of the sum of squares."""
    return F.sqrt(sum(p * p for p in parts))
