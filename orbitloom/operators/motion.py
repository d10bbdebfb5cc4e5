"""Checks of position against velocity, of a fixed station's speed and place, and of what a moving one can do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitloom.functions import grades
from orbitloom.functions.atmosphere import combined
from orbitloom.operators.checks import from_base
from orbitloom.operators.series import ordered

NO_FIX, NO_BASE, NO_WINDOW, ACCURACY = "no_3d_fix", "no_base_epoch", "no_window", "insufficient_accuracy"


def _dot(a: list[Column], b: list[Column]) -> Column:
    return sum(p * q for p, q in zip(a, b))


def _split(rows: DataFrame, usable: Column) -> tuple[DataFrame, DataFrame]:
    ok = F.coalesce(usable, F.lit(False))
    return rows.filter(ok), rows.filter(~ok)


def position_velocity(rows: DataFrame, key: str, time: str, usable: Column, window_s: float, slack_s: float, sigmas: tuple[float, float], inconsistent: tuple[float, float], unassured: tuple[float, float], tie: str = "seq") -> DataFrame:
    """rows (x, y, z, vx, vy, vz, s_acc) with state, reason, interval_s, residual, derived_speed, reported_speed and rms_s_acc.

    The way since the newest usable epoch at least window_s old (and at most slack_s older than that) is held against the trapezoid
    integral of the velocities between; limits are multiples of the rms speed accuracy within their bounds. Unusable rows and rows
    without such an epoch are unavailable. Running sums make the integral a difference, so each key is sorted once.
    """
    good, bad = _split(rows, usable)
    w = ordered(key, time, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    dt = (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6
    steps = good.withColumns({f"_t{a}": F.coalesce((F.col(f"v{a}") + F.lag(f"v{a}").over(w)) * dt / 2, F.lit(0.0)) for a in "xyz"})
    summed = steps.withColumns({**{f"_i{a}": F.sum(f"_t{a}").over(upto) for a in "xyz"}, "_q": F.sum(F.col("s_acc") * F.col("s_acc")).over(upto), "_n": F.count("*").over(upto)})
    based = from_base(summed, key, time, ["x", "y", "z", "_ix", "_iy", "_iz", "_q", "_n", "s_acc"], window_s, window_s + slack_s)
    b = lambda c: F.col(f"base.{c}")
    timed = based.withColumn("interval_s", (F.unix_micros(time) - F.unix_micros(b(time))) / 1e6)
    derived = [(F.col(a) - b(a)) / F.col("interval_s") for a in "xyz"]
    reported = [(F.col(f"_i{a}") - b(f"_i{a}")) / F.col("interval_s") for a in "xyz"]
    found = timed.withColumns({
        "residual": combined(*[p - q for p, q in zip(derived, reported)]), "derived_speed": combined(*derived), "reported_speed": combined(*reported),
        "rms_s_acc": F.sqrt((F.col("_q") - b("_q") + b("s_acc") * b("s_acc")) / (F.col("_n") - b("_n") + 1)),
    })
    limits = [grades.scaled_limit(F.col("rms_s_acc"), s, *bounds) for s, bounds in zip(sigmas, (inconsistent, unassured))]
    state = grades.graded(F.col("residual"), *limits)
    judged = found.withColumn("state", state).withColumn("reason", F.when(F.col("state") == "unavailable", NO_BASE).when(F.col("state") != "assured", "velocity_residual"))
    shown = judged.select(*rows.columns, "state", "reason", "interval_s", "residual", "derived_speed", "reported_speed", "rms_s_acc")
    return shown.unionByName(bad.withColumns({"state": F.lit("unavailable"), "reason": F.lit(NO_FIX)}), allowMissingColumns=True)


def stationary_velocity(usable: Column, velocity: list[Column], s_acc: Column, sigmas: tuple[float, float], inconsistent: tuple[float, float], unassured: tuple[float, float]) -> dict[str, Column]:
    """Speed of a station that should not move, its state against limits that scale with the speed accuracy, and the reason."""
    speed = combined(*velocity)
    graded = grades.graded(speed, grades.scaled_limit(s_acc, sigmas[0], *inconsistent), grades.scaled_limit(s_acc, sigmas[1], *unassured))
    state = F.when(F.coalesce(usable, F.lit(False)), graded).otherwise("unavailable")
    return {"speed": F.when(usable, speed), "state": state, "reason": F.when(state == "unavailable", NO_FIX).when(state != "assured", "speed")}


def displacement(east: Column, north: Column, up: Column, h_acc: Column, v_acc: Column, h_reference: float, v_reference: float, limit: float, v_limit: float) -> dict[str, Column]:
    """State of a place against its surveyed one: it is away only if the offset less three sigmas exceeds the limit; a limit of 0
    tests nothing, and where three sigmas exceed a limit nothing can be said."""
    h, v = combined(east, north), F.abs(up)
    hu, vu = 3 * combined(h_acc, F.lit(float(h_reference))), 3 * combined(v_acc, F.lit(float(v_reference)))
    tested = [(c, u, most, name) for c, u, most, name in ((h, hu, limit, "horizontal_error"), (v, vu, v_limit, "vertical_error")) if most > 0]
    vague, away = F.lit(False), F.lit(False)
    for value, sure, most, _ in tested:
        vague, away = vague | (sure > most), away | (value - sure > most)
    state = F.when(vague, "unavailable").when(away, "unassured").otherwise("assured")
    named = F.concat_ws(",", *[F.when(value - sure > most, F.lit(name)) for value, sure, most, name in tested])
    return {"horizontal": h, "vertical": v, "state": state, "reasons": F.when(vague, ACCURACY).otherwise(named)}


def kinematics(rows: DataFrame, key: str, time: str, usable: Column, speed: float = 0, vertical: float = 0, acceleration: float = 0, lateral: float = 0, max_s_acc: float = 0, gap_s: float = 10, tie: str = "seq") -> DataFrame:
    """rows (vx, vy, vz, down: vertical speed, ux, uy, uz: the unit vector up, s_acc) with state and reasons (comma-joined).

    A quantity trips if it exceeds its limit by more than three sigmas; a limit of 0 tests nothing. Where three sigmas exceed the
    limit, or the usable row before is missing or further back than gap_s, the quantity cannot be judged: unavailable, unless another trips.
    Lateral acceleration is what turns the mean horizontal velocity, so it needs a speed above its own uncertainty.
    """
    good, bad = _split(rows, usable)
    w = ordered(key, time, tie)
    v, up = [F.col(c) for c in ("vx", "vy", "vz")], [F.col(c) for c in ("ux", "uy", "uz")]
    had = good.withColumns({"_dt": F.nullif((F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6, F.lit(0.0)), "_ps": F.lag("s_acc").over(w), **{f"_p{c}": F.lag(f"v{c}").over(w) for c in "xyz"}})
    before = [F.col(f"_p{c}") for c in "xyz"]
    near = F.coalesce((F.col("_dt") > 0) & (F.col("_dt") <= gap_s), F.lit(False))
    both = F.col("s_acc") + F.col("_ps")
    turned = had.withColumns({f"_d{c}": (a - b) / F.col("_dt") for c, a, b in zip("xyz", v, before)}).withColumns({f"_m{c}": (a + b) / 2 for c, a, b in zip("xyz", v, before)})
    d, mean = [F.col(f"_d{c}") for c in "xyz"], [F.col(f"_m{c}") for c in "xyz"]
    level = turned.withColumns({f"_h{c}": m - u * _dot(mean, up) for c, m, u in zip("xyz", mean, up)})
    flat = [F.col(f"_h{c}") for c in "xyz"]
    sized = level.withColumn("_hn", combined(*flat)).withColumns({f"_a{c}": h / F.nullif(F.col("_hn"), F.lit(0.0)) for c, h in zip("xyz", flat)})
    along = [F.col(f"_a{c}") for c in "xyz"]
    side = combined(*[a - u * _dot(d, up) - t * _dot(d, along) for a, u, t in zip(d, up, along)])
    turns = near & (F.col("_hn") > 3 * both)
    sigma = 3 * F.col("s_acc")
    tests = [("reported_speed", speed, combined(*v), sigma, F.lit(True), F.lit(False)), ("vertical_speed", vertical, F.abs("down"), sigma, F.lit(True), F.lit(False)),
             ("acceleration", acceleration, combined(*d), 3 * both / F.col("_dt"), near, ~near),
             ("lateral_acceleration", lateral, side, 3 * both / F.col("_dt"), turns, ~near | (~turns & (combined(*v) > sigma)))]
    missing, names = F.lit(False), []
    for name, limit, value, sure, tested, unknown in tests:
        if limit > 0:
            missing = missing | unknown | (tested & (sure > limit))
            names.append(F.when(tested & (sure <= limit) & (value - sure > limit), F.lit(name)))
    reasons = F.concat_ws(",", *names) if names else F.lit("")
    vague = F.col("s_acc") > max_s_acc if max_s_acc > 0 else F.lit(False)
    judged = sized.withColumns({"_reasons": reasons, "_missing": missing, "_vague": vague})
    state = F.when(F.col("_vague"), "unavailable").when(F.col("_reasons") != "", "unassured").when(F.col("_missing"), "unavailable").otherwise("assured")
    named = F.when(F.col("_vague"), ACCURACY).when((F.col("_reasons") == "") & F.col("_missing"), f"{NO_WINDOW},{ACCURACY}").otherwise(F.col("_reasons"))
    shown = judged.select(*rows.columns, state.alias("state"), named.alias("reasons"))
    return shown.unionByName(bad.withColumns({"state": F.lit("unavailable"), "reasons": F.lit(f"{NO_FIX},{ACCURACY}")}))
