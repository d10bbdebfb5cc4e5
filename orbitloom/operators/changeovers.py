"""Jumps of orbit and clock where a satellite goes over to its next set of elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitloom.functions import orbits, signals
from orbitloom.functions.atmosphere import combined
from orbitloom.functions.geodesy import wrapped_age

# Age in seconds from which a set is no longer trusted; largest distance of GLONASS sets that follow each other; nanoseconds in a second.
TRUST_S, ADJACENT_S, NANO = 14400, 3600, 1e9


def _changed(rows: DataFrame, key: list[str], time: str, mark: str, tie: str) -> DataFrame:
    """Rows that bring a new set, with old: the row before."""
    w = Window.partitionBy(*key).orderBy(time, tie)
    return rows.withColumn("old", F.lag(F.struct(*rows.columns)).over(w)).filter(F.col("old").isNotNull() & ~F.col(mark).eqNullSafe(F.col(f"old.{mark}")))


def _since(time: str) -> Column:
    return (F.unix_micros(time) - F.unix_micros(f"old.{time}")) / 1e6


def kepler(rows: DataFrame, key: list[str], time: str, issue: str, silent_s: float = TRUST_S, tie: str = "seq") -> DataFrame:
    """Changeovers of Keplerian sets: key, time, tie, issue, old_issue, orbit_m and clock_ns at the new reference time.

    rows: what orbits.with_kepler takes, with toc, af0, af1, af2. Both are null where the sets' reference times are TRUST_S or more apart
    or the old set was last received silent_s or longer ago (the first wraps with the week, the second does not). Group delay does not count.
    """
    changed = _changed(rows, key, time, issue, tie)
    elements = [c for c in rows.columns if c not in (*key, time, tie, "gnss", "sv")]
    new = orbits.with_kepler(changed, "toe").withColumnRenamed("position", "_new")
    trusted = (F.abs(wrapped_age(F.col("toe"), F.col("old.toe"))) < TRUST_S) & (_since(time) < silent_s)
    kept = [c for c in dict.fromkeys([*key, time, tie, "gnss", "sv"])]
    sides = new.select(*kept, *[F.col(c).alias(f"_n_{c}") for c in elements], *[F.col(f"old.{c}").alias(c) for c in elements], "_new", F.col("toe").alias("_at"), trusted.alias("_trusted"))
    done = orbits.with_kepler(sides, "_at")

    def offset(p: str, ecc: str) -> Column:
        return signals.clock_offset(F.col("gnss"), wrapped_age(F.col("_at"), F.col(f"{p}toc")), *[F.col(f"{p}{c}") for c in ("af0", "af1", "af2", "e", "sqrt_a")], F.col(ecc), F.lit(0.0))

    apart = combined(*[F.col(f"_new.{c}") - F.col(f"position.{c}") for c in "xyz"])
    jump = F.abs(offset("_n_", "_new.ea") - offset("", "position.ea")) * NANO
    shown = list(dict.fromkeys([*key, time, tie]))
    return done.select(*shown, F.col(f"_n_{issue}").alias("issue"), F.col(issue).alias("old_issue"), F.when(F.col("_trusted"), apart).alias("orbit_m"), F.when(F.col("_trusted"), jump).alias("clock_ns"))


def glonass(rows: DataFrame, key: str, time: str, silent_s: float = TRUST_S, tie: str = "seq") -> DataFrame:
    """Changeovers of GLONASS sets: key, time, tie, tb, step_s, orbit_m between the sets half-way, clock_ns at the new tb, clock_at.

    rows: tb (seconds of the day), state (array of x, y, z, vx, vy, vz in km), pull (array of three, km/s²), tau, gamma (null until the string that
    brings them). Sets more than ADJACENT_S apart, and an old set last received silent_s or longer ago, give no figures. Where the new set
    still lacks its clock, the first of its later rows that has one completes the jump; clock_at says when."""
    w = Window.partitionBy(key).orderBy(time, tie)
    cut = F.coalesce(~F.col("tb").eqNullSafe(F.lag("tb").over(w)), F.lit(True)).cast("int")
    runs = rows.withColumn("_cut", cut).withColumn("_run", F.sum("_cut").over(w))
    own = Window.partitionBy(key, "_run").orderBy(time, tie)
    clocked = F.when(F.col("tau").isNotNull(), F.struct("tau", "gamma", F.col(time).alias("at")))
    known = runs.withColumns({"_so_far": F.last(clocked, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), "_first": F.first(clocked, ignorenulls=True).over(own.rowsBetween(0, Window.unboundedFollowing))})
    old = known.withColumn("old", F.lag(F.struct("tb", time, "state", "pull", "_so_far")).over(w)).filter("_cut = 1 and old is not null")
    step = wrapped_age(F.col("tb"), F.col("old.tb"), 86400)
    fits = (F.abs(step) <= ADJACENT_S) & (_since(time) < silent_s)
    placed = old.withColumn("step_s", step).withColumn("_fits", fits)
    parts = lambda c, n: [F.col(c)[i] for i in range(n)]
    half = F.col("step_s") / 2
    both = placed.withColumns({
        "_a": F.when(F.col("_fits"), orbits.integrated(parts("old.state", 6), parts("old.pull", 3), half)),
        "_b": F.when(F.col("_fits"), orbits.integrated(parts("state", 6), parts("pull", 3), -half)),
    })
    was = F.col("old._so_far.tau") - F.col("old._so_far.gamma") * F.col("step_s")
    jump = F.when(F.col("_fits"), F.abs(F.col("_first.tau") - was) * NANO)
    return both.select(key, time, tie, "tb", "step_s", combined(*[F.col("_a")[i] - F.col("_b")[i] for i in range(3)]).alias("orbit_m"), jump.alias("clock_ns"), F.when(jump.isNotNull(), F.col("_first.at")).alias("clock_at"))
