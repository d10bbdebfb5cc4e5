"""Earth-fixed coordinates, directions, wrapped time and orbits as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 and time constants.
SEMI_MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
ECCENTRICITY_2 = FLATTENING * (2 - FLATTENING)
EARTH_ROTATION = 7.2921151467e-5
GRAVITY = 3.986005e14
WEEK_S = 604800
SIDEREAL_S = 86164
BIN_S = 300


def to_ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """Geodetic degrees and metres to metres."""
    sin, cos = F.sin(F.radians(lat)), F.cos(F.radians(lat))
    n = F.lit(SEMI_MAJOR_M) / F.sqrt(1 - F.lit(ECCENTRICITY_2) * sin * sin)
    return (n + height) * cos * F.cos(F.radians(lon)), (n + height) * cos * F.sin(F.radians(lon)), (n * (1 - ECCENTRICITY_2) + height) * sin


def azimuth_elevation(lat: Column, lon: Column, dx: Column, dy: Column, dz: Column) -> tuple[Column, Column]:
    """Direction in degrees of an earth-fixed difference seen from a place."""
    sl, cl, so, co = F.sin(F.radians(lat)), F.cos(F.radians(lat)), F.sin(F.radians(lon)), F.cos(F.radians(lon))
    east, north, up = -so * dx + co * dy, -sl * co * dx - sl * so * dy + cl * dz, cl * co * dx + cl * so * dy + sl * dz
    azimuth = F.degrees(F.atan2(east, north))
    return F.when(azimuth < 0, azimuth + 360).otherwise(azimuth), F.degrees(F.atan2(up, F.sqrt(east * east + north * north)))


def wrapped_age(now: Column, then: Column, period: float = WEEK_S) -> Column:
    """now - then, taken to the half-open range of half a period around zero."""
    d = now - then
    return d - period * F.floor(d / period + 0.5)


def sidereal_cycle(unix_s: Column) -> tuple[Column, Column]:
    """Number of the sidereal day and the bin within it."""
    return F.floor(unix_s / SIDEREAL_S), F.floor(F.pmod(unix_s, F.lit(SIDEREAL_S)) / BIN_S)


def kepler_position(t: Column, toe: Column, sqrt_a: Column, e: Column, m0: Column, i0: Column, omega0: Column, omega: Column, omega_dot: Column, steps: int = 15) -> tuple[Column, Column, Column]:
    """Earth-fixed position in metres of an orbit without harmonics at a second of the week; Newton steps inside one expression."""
    a = sqrt_a * sqrt_a
    tk = wrapped_age(t, toe)
    m = m0 + F.sqrt(F.lit(GRAVITY) / (a * a * a)) * tk
    ecc = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), m, lambda x, _: x - (x - e * F.sin(x) - m) / (1 - e * F.cos(x)))
    return _position(ecc, a, e, tk, toe, i0, omega0, omega, omega_dot)


def _position(ecc: Column, a: Column, e: Column, tk: Column, toe: Column, i0: Column, omega0: Column, omega: Column, omega_dot: Column) -> tuple[Column, Column, Column]:
    u = F.atan2(F.sqrt(1 - e * e) * F.sin(ecc), F.cos(ecc) - e) + omega
    r = a * (1 - e * F.cos(ecc))
    node = omega0 + (omega_dot - EARTH_ROTATION) * tk - F.lit(EARTH_ROTATION) * toe
    x, y = r * F.cos(u), r * F.sin(u)
    return x * F.cos(node) - y * F.cos(i0) * F.sin(node), x * F.sin(node) + y * F.cos(i0) * F.cos(node), y * F.sin(i0)


def to_geodetic(x: Column, y: Column, z: Column, steps: int = 10) -> tuple[Column, Column, Column]:
    """Metres to geodetic degrees and metres: a fixed number of latitude steps inside one expression."""
    p = F.sqrt(x * x + y * y)
    e2 = F.lit(ECCENTRICITY_2)
    normal = lambda lat: F.lit(SEMI_MAJOR_M) / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    lat = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.atan2(z, p * (1 - e2)), lambda a, _: F.atan2(z + e2 * normal(a) * F.sin(a), p))
    height = p * F.cos(lat) + z * F.sin(lat) - F.lit(SEMI_MAJOR_M) * F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), height


def sub_point(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Geodetic latitude and longitude below a position, in degrees."""
    lat, lon, _ = to_geodetic(x, y, z)
    return lat, lon


def distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Straight-line distance."""
    return F.sqrt(sum((p - q) * (p - q) for p, q in zip(a, b)))


def surveyed_distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    """Straight-line metres between two surveyed places (degrees, degrees, metres)."""
    return distance(to_ecef(*a), to_ecef(*b))


def sun_direction(unix: Column) -> tuple[Column, Column, Column]:
    """Earth-fixed unit vector to the sun, by the low-precision solar coordinates of Meeus."""
    days = unix / 86400 + 2440587.5 - 2451545
    t = days / 36525
    m = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    node = F.radians(125.04 - 1934.136 * t)
    center = F.sin(m) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * m) * (0.019993 - 0.000101 * t) + F.sin(3 * m) * 0.000289
    longitude = F.radians(280.46646 + t * (36000.76983 + 0.0003032 * t) + center - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(23 + (26 + (21.448 - t * (46.815 + t * (0.00059 - t * 0.001813))) / 60) / 60 + 0.00256 * F.cos(node))
    declination = F.asin(F.sin(tilt) * F.sin(longitude))
    ascension = F.atan2(F.cos(tilt) * F.sin(longitude), F.cos(longitude))
    meridian = ascension - F.radians(280.46061837 + 360.98564736629 * days + 0.000387933 * t * t - t * t * t / 38710000)
    return F.cos(declination) * F.cos(meridian), F.cos(declination) * F.sin(meridian), F.sin(declination)


def whole_week_shift(now: Column, toa: Column, m0: Column, sqrt_a: Column, omega0: Column, omega_dot: Column) -> tuple[Column, Column]:
    """Mean anomaly and node of an almanac referred to the whole week nearest to now, each within pi of zero."""
    dt = F.rint((now - toa) / WEEK_S) * WEEK_S
    a = sqrt_a * sqrt_a
    wrapped = lambda x: x - F.lit(2 * math.pi) * F.rint(x / (2 * math.pi))
    return wrapped(m0 + F.sqrt(F.lit(GRAVITY) / (a * a * a)) * dt), wrapped(omega0 + (omega_dot - EARTH_ROTATION) * dt)
