"""Names, frequencies, accuracies, ionosphere and clocks of satellite signals as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Carrier frequencies in MHz by (constellation, signals), GLONASS bases and steps by signal, letters,
# range of satellite numbers, accuracy table of GLONASS, signals merged into one (constellation, tag -> canonical tag),
# carrier of L1, thin shell, and the relativistic factor by constellation.
CARRIERS_MHZ = {
    (0, (0,)): 1575.42, (0, (3, 4)): 1227.60, (0, (6, 7)): 1176.45,
    (1, (0,)): 1575.42,
    (2, (0, 1)): 1575.42, (2, (3, 4)): 1176.45, (2, (5, 6)): 1207.14,
    (3, (0, 1)): 1561.098, (3, (2, 3)): 1207.14, (3, (5, 6)): 1575.42, (3, (7, 8)): 1176.45,
    (5, (0, 1)): 1575.42, (5, (4, 5)): 1227.60, (5, (8, 9)): 1176.45,
}
GLONASS_HZ = {0: (1602e6, 562500), 2: (1246e6, 437500)}
LETTERS = {0: "G", 1: "S", 2: "E", 3: "C", 5: "J", 6: "R", 7: "I"}
NUMBERS = {0: (1, 32), 1: (120, 158), 2: (1, 36), 3: (1, 63), 5: (1, 10), 7: (1, 14)}
GLONASS_ACCURACY_M = [1, 2, 2.5, 4, 5, 7, 10, 12, 14, 16, 32, 64, 128, 256, 512]
CANONICAL = {(0, 4): 3, (0, 7): 6, (2, 1): 0, (2, 4): 3, (2, 6): 5, (3, 1): 0, (3, 3): 2, (3, 6): 5, (3, 7): 8, (5, 5): 4, (5, 9): 8}
L1_HZ = 1575.42e6
EARTH_RADIUS_M = 6371000.0
SHELL_M = 350000.0
RELATIVITY = {0: -4.442807633e-10, 2: -4.442807309e-10, 3: -4.442807309e-10, 5: -4.442807633e-10, 6: 0.0, 7: -4.442807633e-10}


def frequency(gnss: Column, signal: Column, channel: Column) -> Column:
    """Carrier in Hz; null where a signal is not known. GLONASS channels are numbered from 0 (-7)."""
    found = F.lit(None).cast("double")
    for s, (base, step) in GLONASS_HZ.items():
        found = F.when((gnss == 6) & (signal == s), base + (channel - 7) * step).otherwise(found)
    for (g, tags), mhz in CARRIERS_MHZ.items():
        found = F.when((gnss == g) & signal.isin(*tags), F.lit(mhz * 1e6)).otherwise(found)
    return found


def canonical(gnss: Column, signal: Column) -> Column:
    """The tag of the band that a tag belongs to."""
    found = signal
    for (g, tag), band in CANONICAL.items():
        found = F.when((gnss == g) & (signal == tag), F.lit(band)).otherwise(found)
    return found


def letter(gnss: Column) -> Column:
    """Letter of a constellation, '?' if not known."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in LETTERS.items() for v in pair]), gnss.cast("int")), F.lit("?"))


def name(gnss: Column, sv: Column, signal: Column | None = None) -> Column:
    """G05 or G05@0."""
    plain = F.concat(letter(gnss), F.when(sv < 10, F.lit("0")).otherwise(F.lit("")), sv.cast("string"))
    return plain if signal is None else F.concat_ws("@", plain, signal.cast("string"))


def number_in_range(gnss: Column, sv: Column) -> Column:
    """Whether the constellation is known and has such a satellite number (GLONASS numbers are judged by slot elsewhere)."""
    ok = gnss == 6
    for g, (low, high) in NUMBERS.items():
        ok = ok | ((gnss == g) & sv.between(low, high))
    return ok


def user_range_accuracy(index: Column, least: int = 0) -> Column:
    """Metres of an accuracy index from least (0; -15 for the signed kind) to 14, else null."""
    metres = F.when(index <= 6, F.pow(F.lit(2.0), 1 + index / 2)).otherwise(F.pow(F.lit(2.0), index - 2))
    return F.when(index.between(least, 14), metres)


def signal_in_space_accuracy(index: Column) -> Column:
    """Metres of a Galileo index: steps of 1, 2, 4 and 16 cm; null from 126 on."""
    metres = F.when(index <= 49, index * 0.01).when(index <= 74, 0.5 + (index - 50) * 0.02).when(index <= 99, 1 + (index - 75) * 0.04).otherwise(2 + (index - 100) * 0.16)
    return F.when(index.between(0, 125), metres)


def glonass_accuracy(index: Column) -> Column:
    """Metres of a GLONASS index from 0 to 14, else null."""
    return F.when(index.between(0, 14), F.try_element_at(F.array(*[F.lit(float(m)) for m in GLONASS_ACCURACY_M]), (index + 1).cast("int")))


def broadcast_delay(alpha: list[Column], beta: list[Column], lat: Column, lon: Column, azimuth: Column, elevation: Column, tow: Column) -> Column:
    """Ionosphere delay in seconds by the eight-parameter model; angles in radians, elevations below 0 taken as 0."""
    pi = math.pi
    el = F.greatest(elevation, F.lit(0.0)) / pi
    psi = 0.0137 / (el + 0.11) - 0.022
    phi = F.greatest(F.least(lat / pi + psi * F.cos(azimuth), F.lit(0.416)), F.lit(-0.416))
    lam = lon / pi + psi * F.sin(azimuth) / F.cos(phi * pi)
    geomagnetic = phi + 0.064 * F.cos((lam - 1.617) * pi)
    local = F.pmod(43200 * lam + tow, F.lit(86400.0))
    cubic = lambda c: c[0] + geomagnetic * (c[1] + geomagnetic * (c[2] + geomagnetic * c[3]))
    x = 2 * pi * (local - 50400) / F.greatest(cubic(beta), F.lit(72000.0))
    day = F.when(F.abs(x) < 1.57, F.greatest(cubic(alpha), F.lit(0.0)) * (1 - x * x / 2 + F.pow(x, F.lit(4)) / 24)).otherwise(F.lit(0.0))
    return (1 + 16 * F.pow(0.53 - el, F.lit(3))) * (5e-9 + day)


def scaled_delay(delay_l1: Column, hz: Column) -> Column:
    """A delay on L1 as one on another carrier."""
    return delay_l1 * (L1_HZ / hz) * (L1_HZ / hz)


def slant_from_code(p1: Column, p2: Column, f1: Column, f2: Column, bias: Column) -> Column:
    """Slant delay in metres on the first carrier from two pseudoranges; null for equal carriers."""
    return F.when(f1 != f2, (p2 - p1 - bias) / (F.pow(f1 / f2, F.lit(2)) - 1))


def obliquity(elevation: Column) -> Column:
    """Slant over vertical of a thin shell, for radians."""
    s = EARTH_RADIUS_M / (EARTH_RADIUS_M + SHELL_M) * F.cos(elevation)
    return 1 / F.sqrt(1 - s * s)


def vertical_tec(slant: Column, hz: Column, elevation: Column) -> Column:
    """Vertical electron content in TECU of a slant delay in metres."""
    return slant / obliquity(elevation) / (F.lit(40.308e16) / (hz * hz))


def clock_offset(gnss: Column, dt: Column, af0: Column, af1: Column, af2: Column, e: Column, sqrt_a: Column, ecc_anomaly: Column, group_delay: Column) -> Column:
    """Satellite clock correction in seconds."""
    factor = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for pair in RELATIVITY.items() for v in pair]), gnss.cast("int")), F.lit(0.0))
    return af0 + af1 * dt + af2 * dt * dt + factor * e * sqrt_a * F.sin(ecc_anomaly) - group_delay
