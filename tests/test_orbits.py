"""Propagation against plain Python, and its guards."""

import math
import time

import pytest
from pyspark.sql import functions as F

from orbitloom.functions import orbits
from orbitloom.plans import orbit_queries


def rates(s, j):
    x, y, z, vx, vy, vz = s
    r = math.sqrt(x * x + y * y + z * z)
    w = 7.292115e-5
    g = -398600.4418 / r**3
    c = 1.5 * 1.0826257e-3 * 398600.4418 * 6378.136**2 / r**5
    return [vx, vy, vz, g * x - c * x * (1 - 5 * z * z / r**2) + w * w * x + 2 * w * vy + j[0], g * y - c * y * (1 - 5 * z * z / r**2) + w * w * y - 2 * w * vx + j[1], g * z - c * z * (3 - 5 * z * z / r**2) + j[2]]


def plain(s, j, tk):
    n = max(1, math.ceil(abs(tk) / 60))
    h = tk / n
    for _ in range(n):
        a = rates(s, j)
        b = rates([p + q * h / 2 for p, q in zip(s, a)], j)
        c = rates([p + q * h / 2 for p, q in zip(s, b)], j)
        d = rates([p + q * h for p, q in zip(s, c)], j)
        s = [p + h / 6 * (q + 2 * r + 2 * t + u) for p, q, r, t, u in zip(s, a, b, c, d)]
    return [1000 * v for v in s[:3]]


def test_states_against_plain_python(spark):
    got = orbit_queries.h9_glonass(spark, "/root/testdata/sf0.01").orderBy("p_partkey").limit(40).collect()
    for r in got:
        p = math.radians(r.p_partkey * 7 % 360)
        state = [25500 * math.cos(p), 25500 * math.sin(p) * 0.43, 25500 * math.sin(p) * 0.9, -math.sin(p) * 3.2, math.cos(p) * 1.4, math.cos(p) * 2.9]
        want = plain(state, [0, 1e-9, -1e-9], (r.p_size - 25) * 60.0)
        assert max(abs(a - b) for a, b in zip((r.x, r.y, r.z), want)) < 0.01


def test_guards(spark):
    lits = lambda *v: [F.lit(float(x)) for x in v]
    state = lits(25500, 0, 0, 0, 2, 3)
    at = lambda tk, s=state: spark.range(1).select(orbits.integrated(s, lits(0, 0, 0), F.lit(float(tk)))).first()[0]
    assert at(0) == [25500000.0, 0.0, 0.0]
    assert at(172801) is None and at(60, lits(0.1, 0, 0, 1, 1, 1)) is None


def test_long_spans_of_many_states(spark):
    """2,880 steps of each of 1,000 states, with spans of both directions, a state without a place and an unknown span between them."""
    lits = lambda *v: [F.lit(float(x)) for x in v]
    k = F.col("id")
    tk = F.when(k == 7, None).when(k == 8, 172801.0).when(k % 2 == 0, 172800.0 - k).otherwise(-60.0 * k)
    state = [F.when(k == 9, 0.1).otherwise(25500.0 - k), *lits(0, 0, 0, 2, 3)]
    began = time.time()
    got = [r[0] for r in spark.range(0, 1000, 1, 1).select(orbits.integrated(state, lits(0, 1e-9, -1e-9), tk)).collect()]
    assert time.time() - began < 60
    assert [i for i, p in enumerate(got) if p is None] == [7, 8, 9]
    for i in (0, 1, 10, 11, 998, 999):
        want = plain([25500.0 - i, 0, 0, 0, 2, 3], [0, 1e-9, -1e-9], 172800.0 - i if i % 2 == 0 else -60.0 * i)
        assert max(abs(a - b) for a, b in zip(got[i], want)) < 0.01


def test_elements_out_of_range(spark):
    row = "select {g} as gnss, 1 as sv, 0.0d as toe, {a}d as sqrt_a, {e}d as e, 1.0d as m0, 1.0d as i0, 0.0d as omega0, 0.0d as omega, 0.0d as omega_dot, 100.0d as t"
    of = lambda g=0, a=5153.0, e=0.01: orbits.with_kepler(spark.sql(row.format(g=g, a=a, e=e)), "t").first().position
    assert of(g=6) is None and of(a=0.0) is None and of(e=0.25) is None and of(e=-0.1) is None
    p = of()
    assert abs(math.sqrt(p.x**2 + p.y**2 + p.z**2) - 5153.0**2 * (1 - 0.01 * math.cos(p.ea))) < 1e-3


def test_helper_names_are_refused(spark):
    with pytest.raises(ValueError, match="_a, _i"):
        orbits.with_kepler(spark.sql("select 1 as _i, 2 as _a, 0 as gnss"), "t")
