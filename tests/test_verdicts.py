"""Cases by hand of the verdicts on motion, levels, capabilities, pressure, and of changeovers."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from orbitloom.functions import gnsstime
from orbitloom.operators import capability, changeovers, levels, motion, pressure
from tests.test_orbits import plain

MOVE = "key string, seq long, time timestamp, x double, y double, z double, vx double, vy double, vz double, s_acc double, ok boolean"


def at(spark, rows, schema):
    """Rows whose time is given in seconds."""
    names = [c.split()[0] for c in schema.split(", ")]
    told = spark.createDataFrame(rows, schema.replace("time timestamp", "time double"))
    return told.withColumn("time", F.timestamp_micros((F.col("time") * 1e6).cast("long"))).select(names)


def moves(spark, rows):
    return at(spark, rows, MOVE)


def velocity(rows):
    return {r.seq: r for r in motion.position_velocity(rows, "key", "time", F.col("ok"), 5, 2, (3, 6), (0.5, 2), (1, 4)).collect()}


def test_position_follows_velocity(spark):
    track = [("a", i, float(i), 10.0 * i, i * i / 2.0, 0.0, 10.0, float(i), 0.0, 0.1, True) for i in range(12)]
    got = velocity(moves(spark, track))
    assert [got[i].state for i in range(5)] == ["unavailable"] * 5 and got[4].reason == "no_base_epoch"
    assert all(got[i].state == "assured" and got[i].residual < 1e-9 and got[i].interval_s == 5 for i in range(5, 12))
    jump = [(*r[:3], r[3] + (30 if r[1] >= 9 else 0), *r[4:]) for r in track]
    got = velocity(moves(spark, jump))
    assert got[9].state == "unassured" and abs(got[9].residual - 6) < 1e-9 and got[9].reason == "velocity_residual"


def test_base_skips_unusable_rows_and_old_ones(spark):
    track = [("a", i, float(t), 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.1, ok) for i, (t, ok) in enumerate([(0, True), (6, False), (7, True), (8, None), (30, True)])]
    got = velocity(moves(spark, track))
    assert got[2].interval_s == 7 and got[1].reason == got[3].reason == "no_3d_fix" and got[4].reason == "no_base_epoch"
    assert velocity(moves(spark, [])) == {}


def kinematic(spark, rows, **limits):
    told = moves(spark, rows).withColumns({"down": F.col("vz"), "ux": F.lit(0.0), "uy": F.lit(0.0), "uz": F.lit(1.0)})
    return {r.seq: (r.state, r.reasons) for r in motion.kinematics(told, "key", "time", F.col("ok"), **limits).collect()}


def test_a_turn_is_lateral_and_braking_is_not(spark):
    at_rest = (0.0, 0.0, 0.0)
    turn = [("a", 0, 0.0, *at_rest, 20.0, 0.0, 0.0, 0.1, True), ("a", 1, 1.0, *at_rest, 0.0, 20.0, 0.0, 0.1, True)]
    brake = [("b", 2, 0.0, *at_rest, 20.0, 0.0, 0.0, 0.1, True), ("b", 3, 1.0, *at_rest, 5.0, 0.0, 0.0, 0.1, True)]
    got = kinematic(spark, turn + brake, lateral=9)
    assert got[1] == ("unassured", "lateral_acceleration") and got[3] == ("assured", "") and got[0][0] == "unavailable"
    got = kinematic(spark, turn + brake, acceleration=9, lateral=9)
    assert got[1] == ("unassured", "acceleration,lateral_acceleration") and got[3] == ("unassured", "acceleration")


def test_kinematics_without_a_row_before_at_the_same_time_and_without_limits(spark):
    zero = (0.0, 0.0, 0.0)
    rows = [("a", 0, 0.0, *zero, 1.0, 0.0, 0.0, 0.1, True), ("a", 1, 0.0, *zero, 1.0, 0.0, 0.0, 0.1, True), ("a", 2, 60.0, *zero, 0.0, 0.0, 0.0, 0.1, True), ("a", 3, 61.0, *zero, 0.0, 0.0, 0.0, 0.1, False)]
    assert {s for s, _ in kinematic(spark, rows, acceleration=5).values()} == {"unavailable"}
    got = kinematic(spark, rows)
    assert [got[i][0] for i in range(4)] == ["assured", "assured", "assured", "unavailable"]
    assert kinematic(spark, rows, speed=0.2)[0][0] == "unavailable"  # three sigmas are over the limit


def test_levels(spark):
    even = [("s", 3, float(e), 50.0 + e / 10) for e in range(0, 60, 10)]
    rough = [("s", 5, float(e), 40.0 + 10 * (e // 10 % 2)) for e in range(0, 60, 10)]
    sbas = [("s", 1, 30.0, 50.0 + i) for i in range(6)]
    few = [("t", 3, 10.0, 50.0)]
    rows = spark.createDataFrame(even + rough + sbas + few, "station string, gnss int, x double, y double")
    found = {(r.station, r.gnss): r for r in levels.fits(rows, ["station"], "gnss", "x", "y").collect()}
    assert ("s", 1) not in found and found["s", None].sats == 18 and found["s", 3].residual < 1e-9
    got = {r.station: r for r in levels.uniformity(rows, ["station"], "gnss", "x", "y").collect()}
    assert got["s"].state == "unassured" and got["s"].tripped_gnss == 3 and got["t"].state == "unavailable" and got["t"].reason == "too_few_satellites"
    null = spark.createDataFrame([("u", 3, None, None)], "station string, gnss int, x double, y double")
    assert levels.uniformity(null, ["station"], "gnss", "x", "y").first().state == "unavailable"


def test_capabilities(spark):
    seen = spark.createDataFrame([("a", 0, 0, 20, 1000), ("a", 0, 3, 20, 100), ("b", 2, 1, 20, 100)], "station string, gnss int, sig int, count long, last_seen long")
    declared = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("c", 0, 0)], "station string, gnss int, sig int")
    telemetry = spark.createDataFrame([("b", 950), ("d", 999)], "station string, last_seen long")
    told = capability.report(seen, declared, telemetry)
    rows = {(r.station, r.sig): r for r in told.collect()}
    assert len(rows) == 4 and rows["c", 0].last_seen is None and rows["c", 0].station_last_seen is None and rows["b", 1].station_last_seen == 950
    state = lambda now: {(r.station, r.sig): r.state for r in capability.lost(told, F.lit(now)).collect()}
    assert state(1001) == {("a", 0): "present", ("a", 3): "lost", ("b", 1): "lost"}  # telemetry keeps b alive
    assert set(state(5000).values()) == {None}
    assert {r.station: (r.state, r.signals) for r in capability.impossible(told).collect()} == {"a": ("impossible", "0:3"), "c": ("ok", "")}


def test_glonass_changeover_against_plain_python(spark):
    first, pull = [25500.0, 0.0, 0.0, 0.0, 1.4, 2.9], [0.0, 1e-9, -1e-9]
    shifted = [25500.5, 0.0, 0.0, 0.0, 1.4, 2.9]
    rows = at(spark, [("r", 0, 0.0, 84600, first, pull, 1e-6, 1e-12), ("r", 1, 60.0, 0, shifted, pull, None, None), ("r", 2, 90.0, 0, shifted, pull, 2e-6, 1e-12), ("r", 3, 120.0, 7200, first, pull, 2e-6, 0.0)],
              "sat string, seq long, time timestamp, tb int, state array<double>, pull array<double>, tau double, gamma double")
    a, b = changeovers.glonass(rows, "sat", "time").orderBy("seq").collect()
    want = math.dist(plain(first, pull, 900.0), plain(shifted, pull, -900.0))
    assert a.step_s == 1800 and abs(a.orbit_m - want) < 0.01  # the day wraps
    assert abs(a.clock_ns - (2e-6 - (1e-6 - 1e-12 * 1800)) * 1e9) < 1e-6 and a.clock_at.second == 30  # the clock came 30 s later
    assert b.orbit_m is None and b.clock_ns is None and b.step_s == 7200


def test_kepler_changeover_of_one_orbit(spark):
    def row(seq, time, issue, toe, m0, af0):
        return ("g", seq, float(time), issue, 0, 1, float(toe), float(toe), 5153.6, 0.01, m0, 0.95, 1.0 - 8e-9 * toe, 0.5, -8e-9, af0, 0.0, 0.0)

    n = math.sqrt(3.986005e14) / 5153.6**3
    later = row(1, 60, 2, 7200, 1.0 + n * 7200, 1e-6 + 5e-9)
    rows = at(spark, [row(0, 0, 1, 0, 1.0, 1e-6), later, row(2, 120, 3, 36000, 1.0, 0.0), row(3, 99999, 4, 36000, 1.0, 0.0)],
              "sat string, seq long, time timestamp, issue int, gnss int, sv int, toe double, toc double, sqrt_a double, e double, m0 double, i0 double, omega0 double, omega double, omega_dot double, af0 double, af1 double, af2 double")
    got = changeovers.kepler(rows, ["sat"], "time", "issue").orderBy("seq").collect()
    assert [r.seq for r in got] == [1, 2, 3] and abs(got[0].orbit_m) < 1e-3 and abs(got[0].clock_ns - 5) < 1e-6
    assert got[1].orbit_m is None and got[2].orbit_m is None  # eight hours apart; silent for a day


def test_pressure(spark):
    rows = [(s, i * 10 + j, 1800.0 * j + d, 100000.0 * math.exp(r * j), 5.0) for i, (s, d, r) in enumerate([("a", 0, 1e-3), ("b", -60, 1e-4), ("c", -30, 2e-4), ("far", 0, 5e-3)]) for j in range(2)]
    samples = at(spark, rows, "station string, seq long, time timestamp, pascal double, sigma double")
    places = spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 9e4, 0.0, 0.0), ("c", 0.0, -9e4, 0.0), ("far", 0.0, 0.0, 9e5)], "station string, x double, y double, z double")
    context = pressure.regional(samples, places, 1800, 360, 1e5, 660, 2)
    got = {r.station: r for r in context.collect()}
    assert set(got) == {"a", "b", "c", "far"} and got["a"].neighbours == 2 and got["far"].reason == "insufficient_neighbours" and got["far"].region_rate is None
    assert abs(got["a"].region_rate * 1800 - 1.5e-4) < 1e-9 and abs(got["a"].region_spread * 1800 - 5e-5) < 1e-9 and abs(got["a"].max_gap - 9e4) < 1e-6 and got["a"].max_age == 60
    judged = {r.station: r for r in pressure.departures(context, F.lit(288.15), 3, 4, 7).collect()}
    assert judged["a"].state == "unassured" and abs(judged["a"].delta_m + 287.05 / 9.80665 * 288.15 * 8.5e-4) < 1e-6 and judged["far"].state == "unavailable"
    assert pressure.regional(samples.limit(0), places, 1800, 360, 1e5, 660, 2).count() == 0


def test_silent_neighbours_make_no_rows(spark):
    """4,000 stations in one place, a hundred of which speak in turn: the pairs of all stations would be 16 million."""
    rows = at(spark, [(i % 100, i, 60.0 * i, 1e5 + i % 7, 5.0) for i in range(400)], "station int, seq long, time timestamp, pascal double, sigma double")
    places = spark.range(4000).selectExpr("int(id) as station", "0d as x", "0d as y", "0d as z")
    context = pressure.regional(rows, places, 6000, 60, 1e4, 600, 2)
    got = {r.seq: r for r in context.collect()}
    assert len(got) == 300 and {r.neighbours for r in got.values()} == {*range(11)}  # those of the last ten minutes, which began as long ago
    assert all((r.reason is None) == (r.neighbours >= 2) for r in got.values()) and max(r.max_age or 0 for r in got.values()) == 600
    most = max(m.value() for m in _row_counts(context))
    assert most < 20_000


def test_neighbours_make_no_pairs(spark, monkeypatch):
    """Stations of several cubes, some at the radius exactly, some samples at one time: as by brute force, and no node of the plan puts out the pairs."""
    monkeypatch.setattr(pressure, "BITS", 64)
    rng = random.Random(3)
    where = {s: (1e4 * rng.randrange(-6, 7), 1e4 * rng.randrange(-2, 3), 5e3 * rng.randrange(2)) for s in range(60)}
    rows = [(i % 60, i, float(rng.randrange(0, 40_000, 10)), 1e5 + rng.randrange(9), 4.0 + i % 3) for i in range(1500)] + [(70, 2000, 0.0, 1e5, 5.0), (70, 2001, 600.0, 1e5, 5.0), (None, 2002, 600.0, 1e5, 5.0), (3, 2003, None, 1e5, 5.0)]
    samples = at(spark, rows, "station int, seq long, time timestamp, pascal double, sigma double")
    places = spark.createDataFrame([(s, *p) for s, p in where.items()], "station int, x double, y double, z double")
    context = pressure.regional(samples, places, 600, 500, 2e4, 700, 2)

    known = [r for r in rows if r[0] is not None and r[2] is not None]
    began, after = {}, {}
    for s, i, t, p, e in known:
        old = min(((abs(t - 600 - u), j, u, q, f) for r, j, u, q, f in known if r == s and 100 <= t - u <= 1100), default=None)
        if old and s in where:
            began[i] = (s, t, old[1], old[2], math.log(p / old[3]) / (t - old[2]), math.hypot(old[4] / old[3], e / p) / (t - old[2]))
        after[i] = min(((u, j) for r, j, u, _, _ in known if r == s and (u, j) > (t, i)), default=(math.inf, 0))[0]
    want = {}
    for i, (s, t, start, began_at, rate, _) in began.items():
        met = [(r, e, t - u, math.dist(where[s], where[o])) for j, (o, u, _, b, r, e) in began.items() if o != s and u <= t < after[j] and t - u <= 700 and abs(b - began_at) <= 700 and math.dist(where[s], where[o]) <= 2e4]
        middle = statistics.median(m[0] for m in met) if met else 0
        want[i] = (start, rate, len(met), *((middle, max(abs(m[0] - middle) for m in met), *(max(m[k] for m in met) for k in (1, 2, 3))) if len(met) > 1 else [None] * 5))
    got = {r.seq: (r.start, r.rate, r.neighbours, r.region_rate, r.region_spread, r.region_sigma, r.max_age, r.max_gap) for r in context.collect()}
    assert got.keys() == want.keys() and len({w[2] for w in want.values()}) > 5
    plain_row = lambda r: [-1 if v is None else v for v in r]
    assert all(plain_row(got[i]) == pytest.approx(plain_row(w), rel=1e-9, abs=1e-15) for i, w in want.items())
    crowd = at(spark, [(i % 300, i, 60.0 * (i // 300), 1e5 + i % 7, 5.0) for i in range(6000)], "station int, seq long, time timestamp, pascal double, sigma double")
    one = spark.range(300).selectExpr("int(id) as station", "0d as x", "0d as y", "0d as z")
    packed = pressure.regional(crowd, one, 600, 60, 1e4, 600, 2)
    assert {r.neighbours for r in packed.collect()} == {299}
    assert max(m.value() for m in _row_counts(packed)) < 30_000  # the pairs are 1.5 million


def _row_counts(df):
    """Rows that each node of a query has put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan, found = plan.finalPhysicalPlan() if hasattr(plan, "finalPhysicalPlan") else plan, []

    def walk(node):
        if node.metrics().contains("numOutputRows"):
            found.append(node.metrics().apply("numOutputRows"))
        if "QueryStage" in node.getClass().getSimpleName():
            walk(node.plan())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return found


def test_clock_that_is_trusted(spark):
    rows = spark.createDataFrame([(10.0, None, False, True), (10.0, 11.5, True, False), (10.0, 8.0, True, True), (10.0, 50.0, True, True), (10.0, 50.0, True, False), (10.0, 11.0, False, True)], "r double, l double, s boolean, n boolean")
    stamp, own = gnsstime.utc_reference(*[F.col(c) for c in "rlsn"])
    assert [tuple(x) for x in rows.select(stamp, own).collect()] == [(10.0, True), (11.5, True), (None, False), (10.0, False), (None, False), (None, False)]
