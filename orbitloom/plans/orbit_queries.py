"""Orbit propagation over rows of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitloom.functions import orbits
from orbitloom.operators.tables import table
from orbitloom.plans.registry import registry

QUERIES, SQL, query = registry()

_ELEMENTS = (
    "e0 as (select p_partkey as k, [0, 2, 3, 5, 7][1 + p_partkey % 5] as g, p_partkey % 9 + 1 as sv, 5153.0::double + p_partkey % 7 as sa, 0.001::double * (1 + p_partkey % 20) as e, (p_partkey % 628) / 100.0::double as m0, 0.9::double + (p_partkey % 10) / 100.0::double as i0, (p_partkey * 3 % 628) / 100.0::double as o0, (p_partkey * 5 % 628) / 100.0::double as w, 7200.0::double * (p_partkey % 12) as toe, p_size * 1.0::double as s from part), "
    "e1 as (select *, (43200 - toe) - 604800 * floor((43200 - toe) / 604800 + 0.5) as tk, case when g in (2, 3) then 3.986004418e14::double else 3.986005e14::double end as mu, case when g = 3 then 7.292115e-5::double else 7.2921151467e-5::double end as we from e0), "
    "e2 as (select *, sa * sa + 1e-3::double * s * tk as a, m0 + (sqrt(mu / (sa*sa*sa*sa*sa*sa)) + 4e-9::double + 0.5 * 1e-14::double * s * tk) * tk as m from e1), "
    "x0 as (select *, m as x from e2), " + ", ".join(f"x{i} as (select * exclude (x), x - (x - e * sin(x) - m) / (1 - e * cos(x)) as x from x{i - 1})" for i in range(1, 16)) + ", "
    "p as (select *, atan2(sqrt(1 - e*e) * sin(x), cos(x) - e) + w as p from x15), c as (select *, p + 1e-7::double * s * sin(2 * p) - 2e-7::double * cos(2 * p) as u, a * (1 - e * cos(x)) + s * sin(2 * p) + 200 * cos(2 * p) as r, i0 + 3e-8::double * sin(2 * p) + 1e-8::double * s * cos(2 * p) + 2e-10::double * tk as i from p), "
    "n as (select *, g = 3 and sv <= 5 as geo, o0 + (-8e-9::double - case when g = 3 and sv <= 5 then 0 else we end) * tk - we * toe as n from c), "
    "q as (select *, r * (cos(u) * cos(n) - sin(u) * cos(i) * sin(n)) as px, r * (cos(u) * sin(n) + sin(u) * cos(i) * cos(n)) as py, r * sin(u) * sin(i) as pz from n), "
    "t as (select *, cos(radians(5)) * py - sin(radians(5)) * pz as ty, sin(radians(5)) * py + cos(radians(5)) * pz as tz from q) "
)


@query(f"with {_ELEMENTS} select k as p_partkey, round(case when geo then cos(we * tk) * px + sin(we * tk) * ty else px end, 2) as x, round(case when geo then cos(we * tk) * ty - sin(we * tk) * px else py end, 2) as y, round(case when geo then tz else pz end, 2) as z from t")
def h8_kepler_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with harmonics, rates, and the rotation of geostationary satellites, by constellation."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    one = lambda v: F.lit(float(v))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", F.element_at(F.array(*[F.lit(g) for g in (0, 2, 3, 5, 7)]), (k % 5 + 1).cast("int")).alias("gnss"), (k % 9 + 1).alias("sv"), one(43200).alias("t"), (7200.0 * (k % 12)).alias("toe"), (5153.0 + k % 7).alias("sqrt_a"),
        (0.001 * (1 + k % 20)).alias("e"), (k % 628 / 100.0).alias("m0"), (0.9 + k % 10 / 100.0).alias("i0"), (k * 3 % 628 / 100.0).alias("omega0"), (k * 5 % 628 / 100.0).alias("omega"), one(-8e-9).alias("omega_dot"),
        one(4e-9).alias("delta_n"), (1e-14 * s).alias("delta_n_dot"), (1e-3 * s).alias("a_dot"), one(2e-10).alias("i_dot"), one(-2e-7).alias("cuc"), (1e-7 * s).alias("cus"), one(200).alias("crc"), s.alias("crs"), (1e-8 * s).alias("cic"), one(3e-8).alias("cis"),
    )
    return orbits.with_kepler(rows, "t").select("p_partkey", *[F.round(f"position.{c}", 2).alias(c) for c in "xyz"])


@query()
def h9_glonass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrated states (steps depend on each other: tested against plain Python)."""
    p = F.radians(F.col("p_partkey") * 7 % 360)
    state = [25500 * F.cos(p), 25500 * F.sin(p) * 0.43, 25500 * F.sin(p) * 0.9, -F.sin(p) * 3.2, F.cos(p) * 1.4, F.cos(p) * 2.9]
    found = orbits.integrated(state, [F.lit(0.0), F.lit(1e-9), F.lit(-1e-9)], (F.col("p_size") - 25) * 60.0)
    return table(spark, sf_dir, "part").withColumn("_p", found).select("p_partkey", "p_size", *[F.round(F.col("_p")[i], 3).alias(c) for i, c in enumerate("xyz")])
