"""Satellite positions from broadcast elements and state vectors, as columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitloom.functions.geodesy import wrapped_age

# Gravity and earth rotation by constellation; gravity in km, equatorial radius in km, zonal harmonic and
# rotation of the GLONASS model; geostationary BeiDou numbers; largest step and span of the integration in seconds, and eccentricities from which elements are refused.
GRAVITY = {0: 3.986005e14, 2: 3.986004418e14, 3: 3.986004418e14, 5: 3.986005e14, 7: 3.986005e14}
ROTATION = {0: 7.2921151467e-5, 2: 7.2921151467e-5, 3: 7.2921150e-5, 5: 7.2921151467e-5, 7: 7.2921151467e-5}
MU_KM, RADIUS_KM, J2, ROTATION_GLONASS = 398600.4418, 6378.136, 1.0826257e-3, 7.2921150e-5
GEOSTATIONARY = [1, 2, 3, 4, 5, 59, 60, 61, 62, 63]
STEP_S, SPAN_S, MOST_ECCENTRIC = 60.0, 172800.0, 0.25

#: Element columns that are taken as 0 where a table has none.
CORRECTIONS = ["delta_n", "delta_n_dot", "a_dot", "i_dot", "cuc", "cus", "crc", "crs", "cic", "cis"]


#: Names that with_kepler uses between its steps.
HELPERS = ["_mu", "_we", "_tk", "_a", "_m", "_ea", "_phi", "_s", "_c", "_u", "_r", "_i", "_n", "_x", "_y", "_px", "_py", "_pz"]


def _by(values: dict[int, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col("gnss").cast("int"))


def with_kepler(rows: DataFrame, at: str, steps: int = 15) -> DataFrame:
    """rows (gnss, sv, toe, sqrt_a, e, m0, i0, omega0, omega, omega_dot and corrections) with position: x, y, z in metres, earth-fixed, at a
    second of the week, the eccentric anomaly and the time since toe; null for other constellations and elements out of range."""
    names = rows.columns
    clash = sorted(set(names) & {*HELPERS, *(f"_{c}" for c in CORRECTIONS)})
    if clash:
        raise ValueError(f"columns with names of helpers: {', '.join(clash)}")
    mine = rows.withColumns({f"_{c}": F.coalesce(F.col(c), F.lit(0.0)) if c in names else F.lit(0.0) for c in CORRECTIONS}).withColumns({"_mu": _by(GRAVITY), "_we": _by(ROTATION), "_tk": wrapped_age(F.col(at), F.col("toe"))})
    a = F.col("sqrt_a") * F.col("sqrt_a")
    first = mine.withColumns({"_a": a + F.col("_a_dot") * F.col("_tk"), "_m": F.col("m0") + (F.sqrt(F.col("_mu") / (a * a * a)) + F.col("_delta_n") + 0.5 * F.col("_delta_n_dot") * F.col("_tk")) * F.col("_tk")})
    e = F.col("e")
    newton = lambda x, _: x - (x - e * F.sin(x) - F.col("_m")) / (1 - e * F.cos(x))
    solved = first.withColumn("_ea", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.col("_m"), newton))
    phi = F.atan2(F.sqrt(1 - e * e) * F.sin("_ea"), F.cos("_ea") - e) + F.col("omega")
    turned = solved.withColumn("_phi", phi).withColumns({"_s": F.sin(2 * F.col("_phi")), "_c": F.cos(2 * F.col("_phi"))})
    bent = lambda s, c: F.col(s) * F.col("_s") + F.col(c) * F.col("_c")
    plane = turned.withColumns({"_u": F.col("_phi") + bent("_cus", "_cuc"), "_r": F.col("_a") * (1 - e * F.cos("_ea")) + bent("_crs", "_crc"), "_i": F.col("i0") + bent("_cis", "_cic") + F.col("_i_dot") * F.col("_tk")})
    still = (F.col("gnss") == 3) & F.col("sv").isin(GEOSTATIONARY)
    node = F.col("omega0") + (F.col("omega_dot") - F.when(still, F.lit(0.0)).otherwise(F.col("_we"))) * F.col("_tk") - F.col("_we") * F.col("toe")
    flat = plane.withColumns({"_n": node, "_x": F.col("_r") * F.cos("_u"), "_y": F.col("_r") * F.sin("_u")})
    placed = flat.withColumns({"_px": F.col("_x") * F.cos("_n") - F.col("_y") * F.cos("_i") * F.sin("_n"), "_py": F.col("_x") * F.sin("_n") + F.col("_y") * F.cos("_i") * F.cos("_n"), "_pz": F.col("_y") * F.sin("_i")})
    tilt, spin = math.radians(-5), F.col("_we") * F.col("_tk")
    ty, tz = math.cos(tilt) * F.col("_py") + math.sin(tilt) * F.col("_pz"), -math.sin(tilt) * F.col("_py") + math.cos(tilt) * F.col("_pz")
    x = F.when(still, F.cos(spin) * F.col("_px") + F.sin(spin) * ty).otherwise(F.col("_px"))
    y = F.when(still, -F.sin(spin) * F.col("_px") + F.cos(spin) * ty).otherwise(F.col("_py"))
    z = F.when(still, tz).otherwise(F.col("_pz"))
    ok = F.col("_mu").isNotNull() & (F.col("sqrt_a") > 0) & (F.col("_a") > 0) & (e >= 0) & (e < MOST_ECCENTRIC) & (F.abs(F.col("_ea") - e * F.sin("_ea") - F.col("_m")) < 1e-10 * F.greatest(F.lit(1.0), F.abs("_m")))
    return placed.select(*names, F.when(ok, F.struct(x.alias("x"), y.alias("y"), z.alias("z"), F.col("_ea").alias("ea"), F.col("_tk").alias("tk"))).alias("position"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rates(s: np.ndarray, pull: np.ndarray) -> np.ndarray:
    """Change per second of states (x, y, z, vx, vy, vz in km by rows, one column to a state)."""
    x, y, z, vx, vy, vz = s
    r2 = x * x + y * y + z * z
    near = -MU_KM / (r2 * np.sqrt(r2))
    bulge = -1.5 * J2 * MU_KM * RADIUS_KM**2 / (r2 * r2 * np.sqrt(r2))
    w = ROTATION_GLONASS
    flat = 1 - 5 * z * z / r2
    return np.stack([vx, vy, vz, x * (near + bulge * flat + w * w) + 2 * w * vy + pull[0], y * (near + bulge * flat + w * w) - 2 * w * vx + pull[1], z * (near + bulge * (flat + 2)) + pull[2]])


def _moved(*columns: pd.Series) -> pd.Series:
    """Places of a batch of states (6 columns), pulls (3) and seconds: all states go one step together, those with most steps first, so the rest drop off."""
    data = np.array([c.to_numpy(np.float64, na_value=np.nan) for c in columns])
    ready = np.flatnonzero(~np.isnan(data).any(axis=0))
    steps = np.maximum(np.ceil(np.abs(data[9, ready]) / STEP_S), 1).astype(np.int64)
    order = ready[np.argsort(-steps, kind="stable")]
    steps = np.sort(steps)[::-1]
    s, pull, h = data[:6, order], data[6:9, order], data[9, order] / steps
    with np.errstate(all="ignore"):
        for i in range(steps[0] if len(steps) else 0):
            n = np.searchsorted(-steps, -i)  # states that have more than i steps
            now, j, d = s[:, :n], pull[:, :n], h[:n]
            k1 = _rates(now, j)
            k2 = _rates(now + k1 * (d / 2), j)
            k3 = _rates(now + k2 * (d / 2), j)
            k4 = _rates(now + k3 * d, j)
            s[:, :n] = now + ((k1 + k4) + (2 * k2 + 2 * k3)) * (d / 6)
    places: list[list[float] | None] = [None] * data.shape[1]
    for i, place in zip(order.tolist(), (s[:3] * 1000).T.tolist()):
        places[i] = place
    return pd.Series(places, dtype=object)


def integrated(state: list[Column], pull: list[Column], tk: Column) -> Column:
    """Position (x, y, z in metres) of a GLONASS state (km, km/s, pull in km/s²) tk seconds later, by Runge-Kutta steps of at most a
    minute; null beyond two days, and for a state without a place. Batches of rows are stepped together in numpy."""
    far = F.sqrt(sum(c * c for c in state[:3])) >= 1
    span = F.when((F.abs(tk) <= SPAN_S) & far, tk)  # rows without one are not stepped
    return F.pandas_udf(_moved, "array<double>")(*[c.cast("double") for c in (*state, *pull, span)])
